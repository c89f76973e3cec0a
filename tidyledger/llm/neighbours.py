"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of the vectors is cut into balanced
partitions, a small network learns to tell a vector's partition, and every vector is
indexed under its most probable one. A query goes to its most probable partitions and
is ranked exactly there, by the inner product in double precision. How many partitions
a query asks is measured on the sample, for the recall asked for.

Equal vectors are indexed once, with the smallest ids that can appear in a result.
Partitions are split into shards of bounded size, so neither a partition nor a
group of equal vectors has to fit into one task. The queries that ask a partition
are split into blocks, and a row is copied to the blocks that ask its partition only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import ship, stored

SAMPLE = 4000
PARTITIONS = 16
GRAPH_NEIGHBOURS = 12
HIDDEN = 64
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
WANTED_RECALL = 0.94  # on the sample; the rest of the way to the promised 0.9 is margin


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows by inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        scores = x[at:at + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out[at:at + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Labels of equal-sized parts that cut few edges: halves along the main direction, then moves with bounded sizes."""
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for group in groups:
            centred = x[group] - x[group].mean(axis=0)
            direction = np.linalg.svd(centred[:2000], full_matrices=False)[2][0]
            order = group[np.argsort(centred @ direction, kind="stable")]
            halves += [order[:len(order) // 2], order[len(order) // 2:]]
        groups = halves
    for part, group in enumerate(groups):
        label[group] = part
    room = int(np.ceil(1.05 * len(x) / parts))
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        for column in graph.T:
            np.add.at(votes, (rows, label[column]), 1)  # neighbours of a vector
            np.add.at(votes, (column, label), 1)  # vectors it is a neighbour of
        margin = np.sort(votes, axis=1)
        order = np.argsort(-(margin[:, -1] - margin[:, -2]), kind="stable")
        left = np.full(parts, room)
        choice = np.argsort(-votes, axis=1, kind="stable")
        after = label.copy()
        for i in order:
            part = next(p for p in choice[i] if left[p])
            after[i] = part
            left[part] -= 1
        if (after == label).all():
            break
        label = after
    return label


class Router:
    """A small network: the partition probabilities of a vector."""

    def __init__(self, dims: int, parts: int):
        r = np.random.default_rng(3)
        self.w1 = r.normal(0, 1 / np.sqrt(dims), (dims, HIDDEN))
        self.b1 = np.zeros(HIDDEN)
        self.w2 = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts))
        self.b2 = np.zeros(parts)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self._unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1])

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40) -> Router:
        """Adam on the cross-entropy with the partition shares of a vector and its neighbours."""
        r = np.random.default_rng(4)
        x = self._unit(x)
        names = ("w1", "b1", "w2", "b2")
        first = {n: 0.0 for n in names}
        second = {n: 0.0 for n in names}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 128):
                some = order[at:at + 128]
                hidden = np.maximum(x[some] @ self.w1 + self.b1, 0)
                out = hidden @ self.w2 + self.b2
                p = np.exp(out - out.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d_out = (p - target[some]) / len(some)
                d_hidden = (d_out @ self.w2.T) * (hidden > 0)
                step += 1
                for n, g in zip(names, (x[some].T @ d_hidden, d_hidden.sum(0), hidden.T @ d_out, d_out.sum(0)), strict=True):
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    setattr(self, n, getattr(self, n) - 0.004 * (first[n] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-9))
        return self


def learn(sample: np.ndarray, parts: int, wanted: float, k: int) -> tuple[Router, int]:
    """The router, and how many partitions a query has to ask."""
    dims = sample.shape[1] if sample.size else 1
    parts = max(1, min(parts, 1 << int(np.log2(max(1, len(sample) // 64)))))  # a power of two, 64 sample rows each
    if parts == 1:
        return Router(dims, 1), 1
    graph = neighbour_graph(sample, min(GRAPH_NEIGHBOURS, len(sample) - 1))
    label = balanced_partition(sample, graph, parts)
    target = np.eye(parts)[label] * 0.5 + np.eye(parts)[label[graph]].mean(axis=1) * 0.5
    held = np.arange(len(sample)) % 5 == 0
    router = Router(dims, parts).fit(sample[~held], target[~held])
    # Queries that training has not seen, against the partitions that the index will use.
    near = neighbour_graph(sample, min(k, len(sample) - 1))[held]
    home = router.logits(sample).argmax(axis=1)
    rank = np.argsort(np.argsort(-router.logits(sample[held]), axis=1), axis=1)
    needed = np.take_along_axis(rank, home[near], axis=1)
    recall = [(needed < probes).mean() for probes in range(1, parts + 1)]
    return router, 1 + next(i for i, r in enumerate(recall) if r >= wanted or i == parts - 1)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector that is not null, empty or zero and holds finite numbers only."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64)


def _best_ids(asked: np.ndarray, scores: np.ndarray, base: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple]:
    """(row of ``asked``, ids, scores): the k best different ids of each row, best first, ties to the smaller id."""
    counts = np.array([len(i) for i in ids])
    starts, flat = np.cumsum(counts) - counts, np.concatenate(ids)
    out, left, wanted = [], np.arange(len(asked)), k
    while len(left):  # an id may stand behind many vectors, so k vectors can be too few
        m = min(wanted, len(base))
        border = np.partition(scores[left], -m, axis=1)[:, -m]
        # With everything that the product's rounding cannot tell from the border: ties go to the smaller id.
        who, which = np.nonzero(scores[left] >= (border - 1e-9 * (1 + np.abs(border)))[:, None])
        # Summed pair by pair, so that equal vectors get equal scores wherever they stand in a block.
        exact = np.einsum("ij,ij->i", asked[left[who]], base[which])
        times = counts[which]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found = flat[np.repeat(starts[which], times) + place]
        who, exact = np.repeat(who, times), np.repeat(exact, times)
        order = np.lexsort((-exact, found, who))
        who, found, exact = who[order], found[order], exact[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1])
        who, found, exact = who[first], found[first], exact[first]
        order = np.lexsort((found, -exact, who))
        who, found, exact = who[order], found[order], exact[order]
        done = (np.bincount(who, minlength=len(left)) >= k) | (m == len(base))
        kept = done[who] & (np.arange(len(who)) - np.searchsorted(who, who) < k)
        out.append((left[who[kept]], found[kept], exact[kept]))
        left, wanted = left[~done], wanted * 4
    return out


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best different ids of one shard for each query vector of one block."""
    out = [pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    if not len(queries) or not len(rows):
        return out[0]
    base, ids = _matrix(rows["embedding"]), list(rows["ids"])
    for at in range(0, len(queries), 128):
        some = queries.iloc[at:at + 128]
        asked, keys = _matrix(some["asked"]), some["q"].to_numpy()
        out += [pd.DataFrame({"q": keys[who], "vec_id": found, "score": exact})
                for who, found, exact in _best_ids(asked, asked @ base.T, base, ids, k)]
    return pd.concat(out, ignore_index=True)


def meetings(asked: DataFrame, routed: DataFrame, parts: int, query_block: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows by the (part, shard, block) they meet in: every query that asks a part meets all its rows once.

    ``routed`` has key, ids, embedding and parts (the most probable first), ``asked`` the keys of the queries.
    """
    asking = asked.join(routed, "key").select("key", "embedding", F.explode("parts").alias("part"))

    def pieces(counted: DataFrame, size: int):
        n = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.count("*").alias("n")).collect()}
        return F.get(F.array(*[F.lit(-(-n.get(p, 0) // size)) for p in range(parts)]), F.col("part"))

    homes = routed.withColumn("part", F.col("parts")[0])
    shards, blocks = pieces(homes.select("part"), shard_rows), pieces(asking.select("part"), query_block)

    def piece_of(n):
        return F.pmod(F.xxhash64("key"), n).cast("int")

    def every(n):  # none if the part has no rows, or no queries
        return F.explode(F.filter(F.sequence(F.lit(0), n), lambda i: i < n))

    left = asking.withColumn("block", piece_of(blocks)).withColumn("shard", every(shards)).select(
        "part", "shard", "block", F.col("key").alias("q"), F.col("embedding").alias("asked"))
    right = homes.withColumn("shard", piece_of(shards)).withColumn("block", every(blocks)).select(
        "part", "shard", "block", "ids", "embedding")
    return left, right


def nearest(vectors: DataFrame, is_query, k: int = 20, partitions: int = PARTITIONS, sample_rows: int = SAMPLE,
            wanted_recall: float = WANTED_RECALL, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row that ``is_query`` (a condition) picks.

    Nearest first by inner product, ties to the smaller id; all other ids if there are fewer than k. Vectors
    that are null, empty or zero, or hold null or non-finite numbers, and null ids take no part, nor do vectors
    of another length than most. Rows that repeat a query's id count as its own; rows that repeat id and vector
    count once. An id that repeats with different vectors is one query and one candidate, and the best pair of
    vectors gives the score. No rows give no rows. The index is fitted on ``sample_rows`` vectors and holds every row.
    """
    ship(vectors.sparkSession)
    every = usable(vectors)
    dims = every.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = every.filter(F.size("embedding") == (dims[0]["d"] if dims else 0)).distinct()
    # Of equal vectors only the smallest k + 1 ids can be among a query's k nearest others.
    smallest = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    # The key is written with its vector, so it is the same for every later reader.
    index = stored(
        rows.withColumn("n", smallest).filter(F.col("n") <= k + 1).groupBy("embedding").agg(
            F.sort_array(F.collect_list(F.col("vec_id").cast("long"))).alias("ids"))
        .select(F.monotonically_increasing_id().alias("key"), "ids", "embedding"), "vectors")
    sample = index.orderBy(F.xxhash64("embedding"), "key").limit(sample_rows).select("embedding").collect()
    router, probes = learn(np.array([r["embedding"] for r in sample], np.float64), partitions, wanted_recall, k)

    @F.pandas_udf("array<int>")
    def ranked(some: pd.Series) -> pd.Series:
        order = np.argsort(-router.logits(_matrix(some)), axis=1, kind="stable").astype(np.int32)
        return pd.Series(list(order[:, :probes]))

    routed = stored(index.withColumn("parts", ranked("embedding")), "routed")
    queries = stored(rows.filter(is_query).join(index.select("embedding", "key"), "embedding").select(
        F.col("vec_id").cast("long").alias("query_id"), "key"), "queries")
    left, right = meetings(queries.select("key").distinct(), routed, len(router.b2), query_block, shard_rows)
    keys = ("part", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda q, r: _search(q, r, k + 1), "q long, vec_id long, score double")
    # One id more than asked for, as the query's own may be among them. One shuffle serves both steps.
    of_vector = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = stored(found.repartition("q").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
                  .withColumn("n", F.row_number().over(of_vector)).filter(F.col("n") <= k + 1).drop("n"), "best")
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (queries.join(best, queries["key"] == best["q"]).filter("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(of_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
