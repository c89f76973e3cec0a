"""Similarity and clustering against a plain sequential pass."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidyledger.functions.similarity import Leaders, Names, Texts, assign_to_block, first_similar, indel_ratio, pair_ratio, ratio
from tidyledger.operators import dedupe as D, lineage


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    total = len(a) + len(b)
    return 100 if not total else round((1.0 - (total - 2 * plain_lcs(a, b)) / total) * 100.0)


def sequential(counts, threshold):
    """Leader of every value, walking down the ranks."""
    order = sorted(counts, key=lambda v: (-counts[v], -len(v), v))
    leader = {}
    for i, seed in enumerate(order):
        if seed in leader:
            continue
        for other in order[i:]:
            if other not in leader and (other == seed or plain_ratio(seed.lower(), other.lower()) >= threshold):
                leader[other] = seed
    return leader


names = st.text(alphabet="abcdeé .", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(names, names), min_size=1, max_size=8))
def test_ratio_equals_plain(pairs):
    got = pair_ratio([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [plain_ratio(a, b) for a, b in pairs]


def test_ratio_of_long_names():
    rng = random.Random(1)
    for n in (63, 64, 65, 128, 200):
        a, b = ("".join(rng.choice("abcd") for _ in range(n)) for _ in "xy")
        assert Names([b, a]).lcs(a).tolist() == [plain_lcs(a, b), n]
        assert ratio(plain_lcs(a, b), n, n) == plain_ratio(a, b)


def test_ratio_of_many_long_names_at_once():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.choice([0, 1, 30, 63, 64, 65, 130, 200]))) for _ in range(60)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(150)]
    assert list(pair_ratio(*zip(*pairs))) == [plain_ratio(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcde ", max_size=40) | st.text(alphabet="ab", min_size=30, max_size=60), min_size=1, max_size=25),
       st.sampled_from([0, 50, 75, 100]), st.integers(1, 3), st.integers(-1, 3))
def test_first_similar_names_equal_plain_search(texts, threshold, keep, after):
    ranks = np.arange(len(texts)) * 2
    j, i, score, _ = first_similar(ranks, Texts(texts), ranks, Texts(texts), np.full(len(texts), after), threshold, keep)
    got = {}
    for target, seed, s in sorted(zip(j.tolist(), i.tolist(), score.tolist())):
        got.setdefault(target, []).append((seed, s))
    for target, text in enumerate(texts):
        near = [(seed, plain_ratio(texts[seed], text)) for seed in range(target) if 2 * seed > after]
        assert got.get(target, [])[:keep] == [x for x in near if x[1] >= threshold][:keep]


def invented_names(n, seed=5):
    """Different names of firms and persons, a few of them near one another."""
    rng = random.Random(seed)
    parts = ["".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]
    made = set()
    while len(made) < n:
        name = " ".join(rng.choice(parts) for _ in range(rng.randint(2, 3)))
        made.add(name)
        if rng.random() < 0.1:
            cut = rng.randrange(len(name))
            made.add(name[:cut] + rng.choice("aeix") + name[cut + 1:])
    return sorted(made, key=lambda _: rng.random())[:n]


def test_few_of_twenty_thousand_different_names_are_compared():
    texts = invented_names(20_000)
    ranks = np.arange(len(texts))
    block, compared = 2000, 0
    names = [Texts(texts[a:a + block]) for a in range(0, len(texts), block)]
    for a, seeds in enumerate(names):
        for b, targets in enumerate(names[a:], a):
            at = slice(a * block, (a + 1) * block), slice(b * block, (b + 1) * block)
            compared += first_similar(ranks[at[0]], seeds, ranks[at[1]], targets, np.full(block, -1), 75, 8)[3]
    assert compared < 0.05 * len(texts) ** 2 / 2


def test_known_similarities(spark):
    df = spark.createDataFrame([("Limpieza", "LIMPIESA", 88), ("Tecnología", "Tecnologia", 90), ("a", None, None)],
                               "a string, b string, s int")
    assert all(r[0] == r[1] for r in df.select(indel_ratio(F.col("a"), F.col("b")), "s").collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcAB ", min_size=1, max_size=9), st.integers(1, 4), min_size=1, max_size=30),
       st.sampled_from([50, 75, 90]), st.integers(1, 8))
def test_blocks_equal_sequential_pass(counts, threshold, size):
    """The block-by-block pass, without Spark, gives every value the leader of the sequential pass."""
    left = sorted(counts, key=lambda v: (-counts[v], -len(v), v))
    leader = {}
    while left:
        found = Leaders([(v, v.lower()) for v in left[:size]], threshold)
        number, _ = found.assign([v.lower() for v in left])
        leader |= {v: found.found[n][0] for v, n in zip(left, number) if n >= 0}
        left = [v for v in left if v not in leader]
    assert leader == sequential(counts, threshold)


@pytest.mark.parametrize("first,least,keep", [(512, 4096, 8), (3, 40, 8), (3, 7, 1), (1, 100, 2)])
def test_spark_clusters_equal_sequential_pass(spark, first, least, keep):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdefgh ") for _ in range(10)).strip() or "x" for _ in range(15)]
    rows = []
    for _ in range(300):
        text = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append(("".join(text),))
    values = D.value_counts(spark.createDataFrame(rows, "name string"), "name").collect()
    counts = {r["value"]: r["n"] for r in values}
    got = D.cluster(D.value_counts(spark.createDataFrame(rows, "name string"), "name"), 75, first, least, keep).collect()
    assert len(got) == len(counts)
    assert {r["value"]: r["leader"] for r in got} == sequential(counts, 75)
    assert all(r["similarity"] == plain_ratio(r["value"].lower(), r["leader"].lower()) for r in got)


def test_third_of_all_rows_in_one_name(spark):
    rows = [("Suministros Garcia S.L.",)] * 300 + [("Suministros Garcia SL.",)] * 20 + [(f"Empresa {i:03d} {'xyzw' * (i % 5)}",)
                                                                                       for i in range(500)]
    df = spark.createDataFrame(rows, "proveedor string")
    result = D.dedupe(df, ["proveedor"])
    assert result.records.count() == len(rows)
    assert result.records.filter("proveedor = 'Suministros Garcia S.L.'").count() == 320


def test_rounds_equal_the_sequential_pass_for_random_ranks(spark):
    """Chains of names, each near the next: which of them lead depends on the whole chain of ranks before them."""
    rng = random.Random(11)
    base = "abcdefghijklmnopqrstuvwxyz"
    texts = {base[k:k + 14] for k in range(13)} | {base[::-1][k:k + 15] for k in range(12)} | {base[k:k + 12] + "0" * k for k in range(8)}
    rows = [(t, rng.randint(1, 5)) for t in sorted(texts)]
    counts = dict(rows)
    df = spark.createDataFrame(rows, "value string, n long").withColumns({"length": F.length("value"), "low": F.lower("value")})
    for keep in (1, 8):
        got = D.cluster(df, 75, 1, 10, keep).collect()
        assert {r["value"]: r["leader"] for r in got} == sequential(counts, 75) and len(got) == len(counts)


def test_grades_canonical_and_weakest_member(spark):
    rows = [("Distribuciones Lopez Hermanos",)] * 3 + [("distribuciones lopez hermanos",)] * 2 + [("Limpieza",)] * 2 + [("Limpiesa",)]
    clusters = D.cluster(D.value_counts(spark.createDataFrame(rows, "p string"), "p"))
    found = {r["canonical"]: (r["grade"], r["similarity"], r["size"]) for r in D.groups(clusters, "p").collect()}
    assert found == {"Distribuciones Lopez Hermanos": ("merge", 100, 2), "Limpieza": ("review", 88, 2)}


def test_canonical_tie_takes_the_last_name(spark):
    clusters = D.cluster(D.value_counts(spark.createDataFrame([("Limpieza",), ("Limpiesa",)], "p string"), "p"))
    assert D.groups(clusters, "p").first()["canonical"] == "Limpieza"


def test_review_flow(spark):
    rows = [("Limpieza",)] * 2 + [("Limpiesa",), ("Marketing",)]
    df = spark.createDataFrame(rows, "categoria string")
    result = D.dedupe(df, ["categoria"])
    review = D.review_table(result.groups)
    assert D.review_summary(review).first().asDict() == {"total_groups": 1, "pending_groups": 1}
    assert D.approve_above(review, 0.9).first()["status"] == "pending"
    assert D.approve_above(review, 0.85).first()["status"] == "approved"
    made = review.select("group_id", F.lit("approved").alias("status"), F.lit("Aseo").alias("canonical"))
    decided = D.decide(review, made)
    assert sorted(r[0] for r in D.apply_review(result.records, decided, result.members).collect()) == [
        "Aseo", "Aseo", "Aseo", "Marketing"]
    entries = D.review_entries(result.members).orderBy("posicion").collect()
    assert [(e["grupo"], e["posicion"], e["nombre"], e["similitud"]) for e in entries] == [
        ("Limpieza", 1, "Limpieza", 0.88), ("Limpieza", 2, "Limpiesa", 0.88)]


def test_empty_field(spark):
    df = spark.createDataFrame([("",), (None,)], "categoria string")
    result = D.dedupe(df, ["categoria"])
    assert result.records.count() == 2 and result.groups.count() == 0


def test_assignment_function_needs_no_session():
    import pandas as pd

    batch = pd.DataFrame({"value": ["Ab", "zz"], "n": [1, 1], "length": [2, 2], "low": ["ab", "zz"]})
    out = next(assign_to_block([("Ab", "ab")], 75)([batch]))
    assert out["leader"].tolist() == ["Ab", None]


def _forest(log):
    """Final forms by following the last merges one by one; of a circle the oldest merge goes."""
    last = {}
    for field, value, canonical, number in log:
        if None not in (field, value, canonical, number) and value != canonical:
            best = last.get((field, value))
            if best is None or (-number, canonical) < (-best[0], best[1]):
                last[field, value] = (number, canonical)
    for field, value in list(last):
        way = [value]
        while (field, way[-1]) in last and way[-1] not in way[:-1]:
            way.append(last[field, way[-1]][1])
        if way[-1] in way[:-1]:
            circle = way[way.index(way[-1]):-1]
            del last[field, min((last[field, v][0], v) for v in circle)[1]]
    out = {}
    for field, value in last:
        at, steps = value, 0
        while (field, at) in last:
            at, steps = last[field, at][1], steps + 1
        out[field, value] = (at, steps)
    return out


LOG = "field string, value string, canonical string, round int"


def _found(spark, log):
    return {(r["field"], r["value"]): (r["canonical"], r["steps"]) for r in lineage.lineage(spark.createDataFrame(log, LOG)).collect()}


def test_lineage_follows_merges_of_merged_names(spark):
    first, second = [("f", "a", "b", 1), ("f", "c", "b", 1), ("g", "b", "a", 1)], [("f", "b", "d", 2), ("f", "c", "e", 2)]
    want = {("f", "a"): ("d", 2), ("f", "b"): ("d", 1), ("f", "c"): ("e", 1), ("g", "b"): ("a", 1)}
    assert _found(spark, first + second) == _found(spark, second + first + first) == want
    # Merged back in a later round: the older merge goes.
    assert _found(spark, [("f", "a", "b", 1), ("f", "b", "a", 2), ("f", "x", "b", 1), (None, "q", "r", 1), ("f", None, "r", 1),
                          ("f", "s", "s", 3)]) == {("f", "b"): ("a", 1), ("f", "x"): ("a", 2)}
    assert _found(spark, []) == {}
    records = spark.createDataFrame([(1, " a ", "b"), (2, "z", None)], "id int, f string, g string")
    found = lineage.lineage(spark.createDataFrame(first + second, LOG))
    assert [tuple(r) for r in lineage.apply_lineage(records, found).orderBy("id").collect()] == [(1, "d", "a"), (2, "z", None)]


def test_lineage_equals_following_the_merges_one_by_one(spark):
    r = random.Random(4)
    log = [(r.choice("fg"), f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.randrange(4)) for _ in range(90)]
    log += [("deep", f"d{i:03}", f"d{i + 1:03}", 1) for i in range(200)] + [("ring", f"r{i:02}", f"r{(i + 1) % 50:02}", 2) for i in range(50)]
    log += [("ring", f"t{i:02}", f"t{i + 1:02}" if i < 40 else "r07", 1) for i in range(41)]
    assert _found(spark, log) == _found(spark, log[::-1]) == _forest(log)
