"""Substring de-duplication of word sequences by prefix-partitioned suffix trees.

Every window of 50 words that also starts in a document with a smaller id is removed
with all words it covers. Windows whose sampled place is unique, and runs of windows that
repeat as a whole, are settled before any tree is built (see sampling): a run that
several documents share is one path of the tree without branches. What is left are the
windows around branches. Their suffixes are partitioned by prefixes of variable length:
a prefix that more suffixes share than a tree may hold is made longer until none is.
Each task builds the trees of a memory-sized set of prefixes, as sorted paths with the
depth that neighbours share; nodes at 50 words or deeper with several documents below
are the maximal repeats. A whole window that is more frequent than a tree may hold needs no
tree and is settled by an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm import sampling
from tidyledger.llm.common import id_back, shuffle_partitions, stored

LENGTH = 50
GRAMS = (20, 40, 48)
STEPS = 5  # edges of a path: the window's length in equal parts
TREE_ROWS = 50_000


class Subtree:
    """Suffixes sorted by their paths. ``shared`` is the depth, in edges, that a suffix shares with the one before it."""

    def __init__(self, paths: np.ndarray):
        self.order = np.lexsort(paths.T[::-1])
        ranked = paths[self.order]
        same = ranked[1:] == ranked[:-1]
        self.shared = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)]) if len(paths) else np.zeros(0, int)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in sorted order, of each internal node that is at least so deep."""
        inside = self.shared >= depth
        starts = np.flatnonzero(np.append(inside[1:], False) & ~inside)
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
        return starts, ends

    def later(self, docs: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes below a deep node that a suffix of a smaller document shares."""
        starts, ends = self.nodes(depth)
        if not len(starts):
            return np.zeros(0, np.int64)
        ranked = docs[self.order]
        node = np.repeat(np.arange(len(starts)), ends - starts + 1)
        place = np.concatenate([np.arange(s, e + 1) for s, e in zip(starts, ends, strict=True)])
        least = np.full(len(starts), np.iinfo(np.int64).max)
        np.minimum.at(least, node, ranked[place])
        return self.order[place[ranked[place] > least[node]]]


def _labels() -> list[str]:
    return [f"d{i}" for i in range(STEPS)]


def _suffixes(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """doc, key, lo and the path of every window start in the runs of ``asked``."""
    lists = asked.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "n")).alias("asked"))
    step = -(-length // STEPS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, key, text, some in zip(batch["doc"], batch["key"], batch["text"], batch["asked"], strict=True):
                names = sampling.Names(sampling.WORDS.named(sampling.words_of(text)))
                lo = np.concatenate([np.arange(r["lo"], r["lo"] + r["n"]) for r in some])
                edge = names.of(step)
                out = pd.DataFrame({"doc": doc, "key": key, "lo": lo.astype(np.int32)})
                for i, label in enumerate(_labels()):
                    # The last edge ends with the window, so it may overlap the one before.
                    out[label] = edge[lo + min(i * step, length - step)].view(np.int64)
                yield out

    kind = "doc long, key long, lo int, " + ", ".join(f"{label} long" for label in _labels())
    return texts.select("doc", "key", "text").join(lists, ["doc", "key"]).mapInPandas(run, kind)


def by_trees(suffixes: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc, key, lo, n=1): suffixes whose whole path also starts in a smaller document."""
    labels = _labels()
    suffixes = stored(suffixes, "suffixes")
    rows, total = suffixes.withColumn("depth", F.lit(1)), suffixes.count()
    for depth in range(1, STEPS + 1):
        # Prefixes that outgrow a tree: at most total / tree_rows of them.
        prefix = labels[:depth]
        large = suffixes.groupBy(*prefix).agg(F.count("*").alias("n")).filter(F.col("n") > tree_rows).select(
            *prefix, F.lit(True).alias("large"))
        rows = rows.join(large, prefix, "left").withColumn(
            "depth", F.when(F.col("large"), F.lit(depth + 1)).otherwise(F.col("depth"))).drop("large")
    rows = stored(rows, "prefixes")
    prefix = F.xxhash64(*[F.when(F.col("depth") > i, F.col(label)) for i, label in enumerate(labels)])
    trees = max(shuffle_partitions(suffixes.sparkSession), -(-total // tree_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Subtree(pdf[labels].to_numpy(np.int64))
        found = pdf.iloc[np.sort(tree.later(pdf["doc"].to_numpy(np.int64), STEPS))]
        return found[["doc", "key", "lo"]].assign(n=np.int32(1))

    in_trees = (rows.filter(F.col("depth") <= STEPS).withColumn("tree", F.pmod(prefix, F.lit(trees)))
                .groupBy("tree").applyInPandas(build, "doc long, key long, lo int, n int"))
    whole = rows.filter(F.col("depth") > STEPS)
    least = stored(whole.groupBy(*labels).agg(F.min("doc").alias("least")), "frequent-windows")
    frequent = whole.join(least, labels).filter("doc > least").select("doc", "key", "lo", F.lit(1).alias("n"))
    return stored(in_trees.unionAll(frequent), "tree-repeats")


def repeated_runs(texts: DataFrame, length: int = LENGTH, grams: tuple = GRAMS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc, key, lo, n): runs of window starts whose window also starts in a smaller document."""
    rounds = sampling.Rounds(within_document=False)
    rounds.meet(sampling.all_segments(texts, sampling.WORDS, length, grams[0]))
    for gram in grams[1:]:
        rounds.meet(sampling.cut_segments(texts, rounds.open, sampling.WORDS, length, gram))
    return rounds.repeats().unionAll(by_trees(_suffixes(texts, rounds.open, length), tree_rows))


RESULT = "doc_id string, n_words long, n_removed long, kept_sha256 string, kept string"


def deduplicate(docs: DataFrame, length: int = LENGTH, grams: tuple = GRAMS, tree_rows: int = TREE_ROWS,
                with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and if asked for kept (the words that remain, joined by one space).

    Words are separated by space and tab to carriage return; a null text has none, shorter ones than a
    window keep all. Null ids count as one document behind all others. Rows that repeat an id are the same document, so
    none of them is smaller than the other. No documents give no rows. Columns other than doc_id and text are never read.
    """
    texts = sampling.keyed(docs)
    runs = repeated_runs(texts, length, grams, tree_rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, some in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                words = sampling.words_of(text)
                gone = sampling.covered(len(words), some, length)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "surrogatepass") if with_text else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    out = id_back(sampling.with_runs(texts, runs).mapInPandas(cut, RESULT), "doc_id")
    return out if with_text else out.drop("kept")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS p FROM w WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS k FROM starts JOIN w USING (doc_id)
), hits AS (
  SELECT doc_id, p FROM windows JOIN (SELECT k, min(doc_id) AS least FROM windows GROUP BY k) USING (k) WHERE doc_id > least
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), marked AS (
  SELECT doc_id, p, word, count(h.p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM each LEFT JOIN hits h USING (doc_id, p)
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
