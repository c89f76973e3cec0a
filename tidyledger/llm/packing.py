"""Best-fit packing of documents into token sequences, large documents matched first.

How many pieces there are of each length (at most as many lengths as a sequence
has tokens) is all that the plan needs. Pieces above a third of the capacity
share a sequence with at most one other of their kind: the longest takes the
longest partner that still fits. Shorter pieces then go, longest first, to the
fullest sequence that has room. Whole runs of equal lengths are placed at once,
so the plan's size depends on the capacity and not on the corpus, and each piece
finds its own place by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import id_back, id_text, releases, ship, shuffle_partitions, stored, trim

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 300_000  # of either table of a worker; the newer half goes when one is full
SEEN_SLOTS = 1 << 21  # marks of a worker for words that came once
PIECES_PER_BUCKET = 50_000
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


# Fixed values of the vocabulary's byte-level alphabet: printable bytes stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_TAIL = b".,;:!?*#%&$|"


class WordIds:
    """Token ids of texts, put together from the ids of their whitespace-separated words.

    The vocabulary drops white space and never merges across it, lower-cases, and
    keeps letters, digits and marks apart. So a word's ids depend on the word alone, on
    its lower-cased form, and marks behind a letter or digit can be looked up apart. Words that
    come again stay in a bounded table, as more than half of all different words come once; the first ones
    in are the frequent ones, so the last ones go. A worker process keeps it from task to task, until
    a function of another operator asks for the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN_SLOTS)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.words
        for text in texts:
            out = []
            for word in text.encode("utf-8", "surrogatepass").split():
                ids = known.get(word)
                if ids is None:
                    ids = self._word(word)
                    self._keep(known, word, ids)
                out.append(ids)
            yield b"".join(out)

    def _keep(self, table: dict[bytes, bytes], word: bytes, ids: bytes) -> None:
        """Put a word into a table if it came before. Both tables share the marks, each at its own place."""
        at = (hash(word) + (table is self.parts)) % SEEN_SLOTS
        if not self.seen[at]:
            self.seen[at] = 1
            return
        if len(table) >= CACHED_WORDS:
            for _ in range(CACHED_WORDS // 2):
                table.popitem()
            self.seen = bytearray(SEEN_SLOTS)
        table[word] = ids

    def _word(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold a special token, which is no ordinary text
            return self._encoded(word)
        head = word.rstrip(_TAIL)
        if head[-1:].isalnum() and head != word:
            return self._part(head) + self._part(word[len(head):])
        return self._part(word)

    def _part(self, part: bytes) -> bytes:
        low = part.lower()
        part = part if low == part else low  # one object in both tables where it can be
        ids = self.parts.get(part)
        if ids is None:
            ids = self._encoded(part)
            self._keep(self.parts, part, ids)
        return ids

    def _encoded(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        if _LETTERS.fullmatch(text):  # normal form already, and one word for the vocabulary's rules
            tokens = self.model.tokenize(part.decode("latin-1").translate(_BYTE_NAMES))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


releases.append(word_ids.cache_clear)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """Token pieces of every document, the end id included; ``ids`` holds the little-endian ids when asked for."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        words = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at:at + 64]
                rows = []
                for doc_id, ids in zip(part["doc_id"], words.ids(list(part["text"])), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[start:start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(some) // 4, zlib.crc32(some), some))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                yield out if with_ids else out.drop(columns="ids")

    return id_back(docs.select(id_text("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        cut, PIECES + (", ids binary" if with_ids else "")), "doc_id")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where pieces of each length go: rows (length, first rank, pieces, first sequence, offset, pieces per sequence),
    and the number of sequences. Piece j of a row goes to sequence first + j // per at offset + length * (j % per)."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple] = []
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first sequence, count)
    rooms: list[int] = []
    sequences = 0

    def put(length, n, first, offset, per=1):
        rows.append((length, rank[length], n, first, offset, per))
        rank[length] += n

    def leave(room, first, n):
        if n and room:
            if not open_at[room]:
                bisect.insort(rooms, room)
            open_at[room].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        if at < 0:
            n, room = left[longest], capacity - longest
            put(longest, n, sequences, 0)
            large.pop()
        elif large[at] == longest:
            n, odd = divmod(left[longest], 2)
            if n:
                put(longest, 2 * n, sequences, 0, 2)
                leave(capacity - 2 * longest, sequences, n)
                sequences += n
            n, room = odd, capacity - longest
            large.pop()
            if odd and large:  # the odd one still takes a shorter partner
                other = large[-1]
                put(longest, 1, sequences, 0)
                put(other, 1, sequences, longest)
                room -= other
                left[other] -= 1
                if not left[other]:
                    large.pop()
            elif odd:
                put(longest, 1, sequences, 0)
        else:
            other = large[at]
            n, room = min(left[longest], left[other]), capacity - longest - other
            put(longest, n, sequences, 0)
            put(other, n, sequences, longest)
            left[longest] -= n
            left[other] -= n
            if not left[other]:
                large.pop(at)
            if not left[longest]:
                large.remove(longest)
        leave(room, sequences, n)
        sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                leave(capacity, sequences, -(-todo // per))
                sequences += -(-todo // per)
                continue
            room = rooms[at]
            first, n = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
            per = room // length
            full = min(n, todo // per)
            if full:
                put(length, full * per, first, capacity - room, per)
                leave(room - per * length, first, full)
                todo -= full * per
            if todo and full < n:  # fewer pieces than one sequence takes
                put(length, todo, first + full, capacity - room, per)
                leave(room - todo * length, first + full, 1)
                todo, full = 0, full + 1
            leave(room, first + full, n - full)
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces."""
    ship(cut.sparkSession)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 48) + rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
        j = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + j // row[:, 5], "offset": row[:, 4] + length * (j % row[:, 5])})

    buckets = max(shuffle_partitions(cut.sparkSession), -(-sum(counts.values()) // PIECES_PER_BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(inside)).join(before, ["length", "bucket"])
    return ranked.withColumn("place", find("length", F.col("before") + F.col("row") - 1)).select(
        *cut.columns, F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id. Only documents longer than the capacity are
    cut. Null ids and repeated rows are packed like any other. No documents give no rows. Columns other than
    doc_id and text are never read.
    """
    return placed(stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of at most ``capacity`` token ids)."""
    whole = placed(stored(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces"), capacity)

    @F.pandas_udf("array<long>")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in parts])

    parts = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", joined(F.col("parts.ids")).alias("ids"))
