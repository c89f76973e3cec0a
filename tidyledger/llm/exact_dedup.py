"""Exact de-duplication with a bucketed index of live digests that cuckoo filters guard.

Texts are equal when they are identical after lower-casing A-Z. Every text has a
SHA-256 digest; the index keeps one key row per live digest, dealt into buckets
by the digest, and one cuckoo filter per bucket. A digest that the filter does
not know is new for certain; a hit is verified against the bucket's stored keys.
Deletion takes the fingerprint out of the filter and the key out of the bucket.
When a filter overflows, it is built anew with twice the room from the stored keys.

Documents are inserted in batches. The copies of one batch meet in a map-side aggregate
before anything is dealt out, so a group that holds a third of all rows reaches its bucket as
one row per task; copies of different batches meet in the index, where the filter's hits
are verified and the live key takes the larger id and the sum of the counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm.common import ascii_lower, discard, forget, scratch_mark, ship, shuffle_partitions, stored

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_BUCKET = 20_000
BATCHES = 4
# No number is ever null, as pandas would turn the ids beside a null into doubles.
STATE = "bucket int, text_sha256 string, keep_id long, no_id boolean, group_size long, n_keep long, room int, slots binary"
KEY = {"text_sha256": object, "keep_id": np.int64, "no_id": bool, "group_size": np.int64, "n_keep": np.int64}


class CuckooFilter:
    """Cuckoo filter over 64-bit keys: buckets of four 16-bit fingerprints, two possible buckets per key."""

    def __init__(self, room: int, slots: bytes | None = None):
        self.room = room
        self.slots = (np.zeros((room, SLOTS), np.uint16) if slots is None
                      else np.frombuffer(slots, np.uint16).reshape(room, SLOTS).copy())
        self._random = np.random.default_rng(room)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        room = 16
        while room * SLOTS * 0.9 < n:
            room *= 2
        return cls(room)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (keys & np.uint64(self.room - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        spread = (np.asarray(mark).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return np.asarray(place) ^ (spread & np.uint64(self.room - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        return ((self.slots[first] == mark[:, None]) | (self.slots[second] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when a key found no place: the filter is full and must be built anew from the stored keys."""
        for mark, first, second in zip(*self._places(keys), strict=True):
            if not self._insert(mark, int(first), int(second)):
                return False
        return True

    def _insert(self, mark, first: int, second: int) -> bool:
        for place in (first, second):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = second
        for _ in range(MAX_KICKS):
            slot = int(self._random.integers(SLOTS))
            mark, self.slots[place, slot] = self.slots[place, slot], mark
            place = int(self._other(place, mark))
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Only for keys that were verified to be live."""
        for mark, first, second in zip(*self._places(keys), strict=True):
            for place in (int(first), int(second)):
                found = np.flatnonzero(self.slots[place] == mark)
                if len(found):
                    self.slots[place, found[0]] = 0
                    break


def filter_keys(digests) -> np.ndarray:
    """The first 16 hex digits of each digest."""
    return np.fromiter((int(d[:16], 16) for d in digests), np.uint64, len(digests))


def built(digests) -> CuckooFilter:
    """A filter of all these live digests, with twice the room as often as it takes."""
    keys = filter_keys(digests)
    index = CuckooFilter.for_keys(len(keys))
    while not index.insert(keys):
        index = CuckooFilter(index.room * 2)
    return index


def _merge_bucket(stored_rows: pd.DataFrame, batch: pd.DataFrame, delete: bool) -> pd.DataFrame:
    """New state of one bucket: key rows, then one row with the filter (``room`` is 0 in key rows).

    What the filter does not know is new; only its hits are looked up among the stored keys.
    """
    bucket = int((stored_rows if len(stored_rows) else batch)["bucket"].iloc[0])
    is_key = stored_rows["room"].to_numpy() == 0
    keys = {c: stored_rows[c].to_numpy()[is_key].astype(t) for c, t in KEY.items()}
    index = CuckooFilter.for_keys(len(batch))
    for _, guard in stored_rows[~is_key].iterrows():
        index = CuckooFilter(int(guard["room"]), guard["slots"])
    more = {c: batch[c].to_numpy().astype(t) for c, t in KEY.items()}
    place = np.full(len(batch), -1)
    hit = np.flatnonzero(index.contains(filter_keys(more["text_sha256"])))
    place[hit] = pd.Index(keys["text_sha256"]).get_indexer(more["text_sha256"][hit])
    live, fresh = place >= 0, place < 0
    at = place[live]
    if delete:
        index.delete(filter_keys(keys["text_sha256"][at]))
        keys = {c: np.delete(v, at) for c, v in keys.items()}
    else:
        new = {c: v[live] for c, v in more.items()}
        larger = ~new["no_id"] & (keys["no_id"][at] | (new["keep_id"] > keys["keep_id"][at]))
        same = (new["no_id"] == keys["no_id"][at]) & (new["keep_id"] == keys["keep_id"][at])
        keys["n_keep"][at] = np.where(larger, new["n_keep"], keys["n_keep"][at] + np.where(same, new["n_keep"], 0))
        keys["keep_id"][at] = np.where(larger, new["keep_id"], keys["keep_id"][at])
        keys["no_id"][at] &= ~larger
        keys["group_size"][at] += new["group_size"]
        keys = {c: np.concatenate([v, more[c][fresh]]) for c, v in keys.items()}
        if not index.insert(filter_keys(more["text_sha256"][fresh])):
            index = built(keys["text_sha256"])
    last = {"text_sha256": None, "keep_id": 0, "no_id": True, "group_size": 0, "n_keep": 0}
    n = len(keys["text_sha256"])
    return pd.DataFrame({"bucket": np.full(n + 1, bucket, np.int32)} | {c: np.append(v, np.array([last[c]], v.dtype)) for c, v in keys.items()}
                        | {"room": np.append(np.zeros(n, np.int32), np.int32(index.room)), "slots": [None] * n + [index.slots.tobytes()]})


class DigestIndex:
    """Live digests in buckets. Every change writes a new version of the state to the shared folder."""

    def __init__(self, state: DataFrame, buckets: int):
        self.state, self.buckets = state, buckets

    @classmethod
    def empty(cls, spark: SparkSession, expected_rows: int) -> DigestIndex:
        buckets = max(shuffle_partitions(spark), -(-expected_rows // KEYS_PER_BUCKET))
        return cls(spark.createDataFrame([], STATE), buckets)

    def _changed(self, batch: DataFrame, delete: bool) -> DigestIndex:
        ship(batch.sparkSession)
        bucket = F.pmod(F.xxhash64("text_sha256"), F.lit(self.buckets)).cast("int")
        state = (self.state.groupBy("bucket").cogroup(batch.withColumn("bucket", bucket).groupBy("bucket"))
                 .applyInPandas(lambda old, new: _merge_bucket(old, new, delete), STATE))
        return DigestIndex(stored(state, "digest-index"), self.buckets)

    def insert(self, rows: DataFrame) -> DigestIndex:
        """Add rows of (doc_id, text_sha256); a digest keeps its largest id and counts its rows."""
        copies = rows.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
        batch = copies.groupBy("text_sha256").agg(
            F.coalesce(F.max("doc_id"), F.lit(0)).alias("keep_id"), F.max("doc_id").isNull().alias("no_id"),
            F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "doc_id"), F.sum("n")).alias("n_keep"))
        return self._changed(batch, delete=False)

    def insert_all(self, rows: DataFrame, batches: int) -> DigestIndex:
        """Insert in batches by a hash of the id, so copies of other ids meet the index. The states in between are deleted.

        Any number of batches gives the same live digests.
        """
        index = self
        for number in range(batches):
            older = index.state
            index = index.insert(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
            if number:
                forget(older)
        return index

    def delete(self, digests: DataFrame) -> DigestIndex:
        """Take whole digests out; digests that are not live change nothing."""
        batch = digests.select("text_sha256").distinct().selectExpr(
            "text_sha256", "0L keep_id", "true no_id", "0L group_size", "0L n_keep")
        return self._changed(batch, delete=True)

    def live(self) -> DataFrame:
        """text_sha256, keep_id, group_size, n_keep (rows that share the largest id)."""
        return self.state.filter("text_sha256 is not null").selectExpr(
            "text_sha256", "if(no_id, null, keep_id) keep_id", "group_size", "n_keep")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is the empty text. Null ids lose to any id; a group of null ids alone keeps its rows.
    Rows that repeat both id and text cannot be told apart, so all of them carry the same values.
    No documents give no rows. Other columns are ignored.
    """
    rows = stored(digests(docs), "digests")
    live = DigestIndex.empty(docs.sparkSession, rows.count()).insert_all(rows, batches).live()
    return rows.join(live, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text, one.

    A null text is the empty text, a null id loses to any id, no documents give no rows.
    """
    mark = scratch_mark()
    rows = stored(digests(docs), "digests")
    live = DigestIndex.empty(docs.sparkSession, rows.count()).insert_all(rows, batches).live()
    discard(docs.sparkSession, mark)
    packed = docs.select(F.struct("*").alias("row"))
    digest = F.sha2(ascii_lower(F.col("row.text")).cast("binary"), 256)
    kept = (packed.withColumn("text_sha256", digest).join(live, "text_sha256")
            .filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id"))))
    single = kept.filter("n_keep = 1").select("row.*")
    # Only rows whose winner repeats come here; they are few, and one of each stays.
    repeated = kept.filter("n_keep > 1").dropDuplicates(["text_sha256"]).select("row.*")
    return single.unionByName(repeated)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
