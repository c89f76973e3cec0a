import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyledger.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, part string, shard string, q string"


def brute(rows, k):
    good = [(i, v) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v))]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            scored = sorted((-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def test_one_partition_is_exact_with_ties_and_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(i, [1.0, 2.0, 1.0, 0.0]) for i in range(200, 260)] + [(0, rows[0][1]), (300, [0.0] * 4), (320, None), (340, []),
             (360, [1.0, None, 1.0, 1.0]), (380, [float("nan")] * 4), (400, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4),
             (420, [1.0, 2.0])]
    got = N.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, partitions=1).collect()
    want = brute([x for x in rows if x[0] != 420], 20)
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g.rank)):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(s == pytest.approx(t) for q in want for (_, s), (_, t) in zip(found[q], want[q]))
    assert all(g.rank >= 1 for g in got)


def test_fewer_rows_than_asked_for_and_none(spark):
    got = N.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 20 == 0).collect()
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in got] == [(0, 1, 1, 0.0)]
    assert N.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_learned_partitions_reach_the_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.7 * r.normal(size=16)]) for i in range(3000)]
    got = N.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, sample_rows=1500).collect()
    want = brute(rows, 20)
    hits = sum(len({g.vec_id for g in got if g.query_id == q} & {i for i, _ in v}) for q, v in want.items())
    assert hits / (20 * len(want)) >= 0.9


def test_ids_that_repeat_with_other_vectors_are_exact_over_many_partitions_shards_and_blocks(spark):
    r = np.random.default_rng(5)

    def vector():
        return [float(x) for x in r.integers(-3, 4, 4)]

    rows = [(i, vector()) for i in range(1, 400)] + [(0, vector()) for _ in range(40)] + [(7, vector()) for _ in range(300)]
    rows += [(40, vector()) for _ in range(30)] + [(500 + i, [2.0, 1.0, 0.0, 1.0]) for i in range(60)] + [(3, vector())]
    rows = [(i, v) for i, v in rows if any(v)]
    got = N.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, partitions=4, wanted_recall=1.01, query_block=5,
                    shard_rows=40).collect()
    found, want = {}, {}
    for g in sorted(got, key=lambda g: (g.query_id, g.rank)):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    for q in {i for i, _ in rows if i % 20 == 0}:
        scores = {}
        for _, v in (x for x in rows if x[0] == q):
            for j, w in rows:
                if j != q:
                    scores[j] = max(scores.get(j, -math.inf), sum(a * b for a, b in zip(v, w)))
        want[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:20]
    assert found == want


def test_rows_go_only_to_the_blocks_that_ask_their_part(spark):
    routed = spark.createDataFrame(
        [(i, [i], [float(i)], [i % 3, 2] if i % 3 == 0 else [i % 3]) for i in range(90)],
        "key long, ids array<long>, embedding array<double>, parts array<int>")
    asked = routed.filter("key % 3 = 0 and key < 30").select("key")  # ten queries: parts 0 and 2, never 1
    left, right = N.meetings(asked, routed, 4, query_block=5, shard_rows=10)
    assert right.filter("part = 1").count() == 0
    assert right.count() == 2 * 30 * 2  # parts 0 and 2 hold 30 rows each, for two blocks each
    pairs = left.join(right, ["part", "shard", "block"])
    assert pairs.count() == pairs.select("q", "ids").distinct().count() == 10 * 60


def test_parts_are_balanced_and_follow_the_graph():
    r = np.random.default_rng(3)
    x = np.concatenate([c + 0.1 * r.normal(size=(200, 8)) for c in 3 * np.eye(8)[:4]])
    graph = N.neighbour_graph(x, 10)
    label = N.balanced_partition(x, graph, 4)
    assert np.bincount(label, minlength=4).max() <= 1.05 * 200 + 1
    assert (label[graph] == label[:, None]).mean() > 0.9
    router, probes = N.learn(x, 4, 0.95, 10)
    assert router.logits(x).argmax(1).shape == (800,) and probes <= 2
