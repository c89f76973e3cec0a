"""Suffix-array de-duplication of byte strings by distributed prefix doubling.

Every window of 100 bytes that stands earlier in the corpus, in a document with a
smaller id or further up in the same one, is removed with all bytes it covers.

Prefix doubling ranks positions by ever longer prefixes: the rank of 2h bytes is the
rank of the pair (h bytes here, h bytes at offset h), and positions whose rank is
unique or whose prefix has reached the threshold need no further look. Two things keep
it within a few times the input. Only a sample of positions that every repeat must hold is
ranked at first (see sampling), and a rank is the 64-bit name of the pair, so equal
ranks are brought together by hashed aggregates instead of a total order. Prefixes
grow from 32 over 64 and 96 to 100 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidyledger.llm import sampling
from tidyledger.llm.common import id_back

LENGTH = 100
PREFIXES = (32, 64, 96, 100)


def repeated_runs(texts: DataFrame, length: int = LENGTH, prefixes: tuple = PREFIXES) -> DataFrame:
    """(doc, key, lo, n): runs of window starts whose window stands earlier; ``texts`` comes from sampling.keyed."""
    if prefixes[-1] != length or list(prefixes) != sorted(prefixes):
        raise ValueError("prefixes must grow up to the window's length")
    rounds = sampling.Rounds(within_document=True)
    rounds.meet(sampling.all_segments(texts, sampling.BYTES, length, prefixes[0]))
    for prefix in prefixes[1:]:
        rounds.meet(sampling.cut_segments(texts, rounds.open, sampling.BYTES, length, prefix))
    return rounds.repeats()


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def deduplicate(docs: DataFrame, length: int = LENGTH, prefixes: tuple = PREFIXES, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked for kept (the bytes that remain).

    A null text is empty; texts shorter than a window keep all. Null ids count as one document behind all
    others. Rows that repeat id and text are the same document and none of them is earlier than the other; rows
    that share an id only tie where a window starts at the same place. No documents give no rows. Columns other
    than doc_id and text are never read.
    """
    texts = sampling.keyed(docs)
    runs = repeated_runs(texts, length, prefixes)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, some in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                gone = sampling.covered(len(data), some, length)
                kept = data[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(),
                             kept if with_text else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    out = id_back(sampling.with_runs(texts, runs).mapInPandas(cut, RESULT), "doc_id")
    return out if with_text else out.drop("kept")
