import math

import numpy as np
import pytest

from tidyledger.llm import whitening

CLASHING = ("n", "component", "width", "data", "whitened", "total")


@pytest.fixture
def vectors_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *(["x"] * len(CLASHING)))
                                      for i, v in rows], "vec_id long, embedding array<double>, "
                                     + ", ".join(f"{c} string" for c in CLASHING)).repartition(5)

    return make


def brute_force(rows, k):
    """Exact integers, and the eigenvectors of the centred covariance in extended precision."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], dtype=object)
    centred = (y / n).astype(np.longdouble)
    cov = np.asarray(centred.T @ centred / n, dtype=float)
    e, vectors = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    return n, (y * y).sum(axis=1).tolist(), e[order], vectors[:, order], np.asarray(centred, float), np.trace(cov)


def check(got, rows, k, tolerance=1e-7):
    n, deviation, e, vectors, centred, trace = brute_force(rows, k)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = centred @ vectors / np.sqrt(e)
    signs = [np.sign(by[rows[0][0], j + 1].whitened * want[0, j]) for j in range(k)]
    for i, (vec_id, _) in enumerate(rows):
        for j in range(k):
            r = by[vec_id, j + 1]
            assert int(r.deviation_digits) == deviation[i]
            assert r.deviation == (deviation[i] if deviation[i] < 2**63 else None)
            assert r.explained == pytest.approx(e[j] / trace, rel=1e-9)
            assert r.whitened == pytest.approx(signs[j] * want[i, j], abs=tolerance)


def test_equals_eigenvectors(vectors_of):
    rng = np.random.default_rng(1)
    rows = [(2**60 + i, v) for i, v in enumerate((rng.normal(size=(700, 40)) * np.linspace(3, 0.2, 40)).round(5).tolist())]
    check(whitening.whitening_report(vectors_of(rows)).collect(), rows, 8)


def test_badly_conditioned_and_dependent_dimensions(vectors_of):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6)) * [1e5, 3e3, 100, 7, 1, 0.1]
    tail = np.stack([base[:, 0], base[:, 0], np.full(400, 3.0)], axis=1)
    rows = [(i, v) for i, v in enumerate(np.hstack([base, tail]).tolist())]
    got = whitening.whitening_report(vectors_of(rows), components=6).collect()
    check(got, rows, 6, tolerance=1e-5)
    eight = whitening.whitening_report(vectors_of(rows), components=9).collect()
    assert {r.component for r in eight} == set(range(1, 7))  # the copies and the constant add no variance


def test_very_large_entries_stay_exact(vectors_of):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 2.0**46).tolist()) for i in range(50)]
    check(whitening.whitening_report(vectors_of(rows), components=3).collect(), rows, 3)
    rows = [(i, (rng.normal(size=3) * 2.0**12).tolist()) for i in range(50)]
    check(whitening.whitening_report(vectors_of(rows), components=3).collect(), rows, 3)


def test_odd_rows(vectors_of):
    rng = np.random.default_rng(4)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(30, 4)).tolist())]
    odd = [(100, None), (101, []), (102, [1, None, 2, 3]), (103, [1, math.nan, 2, 3]), (104, [math.inf, 1, 2, 3]),
           (105, [1, 2, 3]), (106, [2.0**60, 1, 1, 1]), (None, None)]
    got = whitening.whitening_report(vectors_of(good + odd), components=4).collect()
    check(got, good, 4)
    twice = whitening.whitening_report(vectors_of([*good, *good, (None, good[0][1])]), components=4).collect()
    assert {r.n for r in twice} == {61} and sum(r.vec_id is None for r in twice) == 4


def test_nothing_to_whiten(vectors_of):
    for rows in ([], [(1, None)], [(1, [1, 2, 3])], [(i, [0.5, 0.25]) for i in range(20)]):
        got = whitening.whitening_report(vectors_of(rows))
        assert got.count() == 0 and got.columns[:3] == ["vec_id", "component", "n"]


def test_triangular_solves():
    rng = np.random.default_rng(5)
    r = np.triu(rng.normal(size=(37, 37))) + 5 * np.eye(37)
    a = rng.normal(size=(20, 37))
    assert np.allclose(whitening.divided(a, r) @ r, a)


def test_exact_squares_beyond_64_bits():
    y = np.array([[2**40 + 3, -(2**41), 5], [1, -1, 0]])
    assert whitening.squares(y) == [(2**40 + 3) ** 2 + 2**82 + 25, 2]
    y = np.array([[2**61, -(2**61)]])
    assert whitening.squares(y) == [2**123]


def test_a_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(whitening.whitening_report(table).collect(), rows, 8)
