import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidyledger.llm import common, simhash
from tidyledger.llm import components as components_module
from tidyledger.llm.components import components


def plain_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("memory", [6_000_000, 3000])
def test_links_equal_all_pairs(monkeypatch, memory):
    monkeypatch.setattr(simhash, "VARIANTS_PER_TASK", memory)
    r = np.random.default_rng(1)
    fps = list(r.integers(0, 1 << 63, 60, np.uint64))
    for value in fps[:40]:
        for _ in range(4):
            for bit in r.choice(64, r.integers(1, 6), replace=False):
                value ^= np.uint64(1 << int(bit))
            fps.append(value)
    fps = np.unique(np.array(fps, np.uint64))
    near = [(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    place = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    found = [(place[a], place[b]) for cls in range(16) for f in simhash._linked(fps, cls, 4, simhash.ball(2))
             for a, b in zip(f["a"], f["b"])]
    assert roots(range(len(fps)), found) == roots(range(len(fps)), near)


def test_components_of_chains_hubs_and_no_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5), (7, 1000)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = dict(map(tuple, components(frame).collect()))
    want = roots({n for link in links for n in link}, links)
    del want[5]
    assert got == want
    assert components(frame.limit(0)).count() == 0


def test_groups_equal_brute_force(docs_of, odd_rows):
    r = random.Random(3)
    rows = [x for x in odd_rows]
    words = [f"word{i}" for i in range(400)]
    for i in range(12):
        text = r.choices(words, k=300)
        rows.append((100 + 10 * i, " ".join(text)))
        for copy in range(3):
            text = list(text)
            text[r.randrange(300)] = "Changed"
            rows.append((100 + 10 * i + copy + 1, "\n".join(text)))
    got = sorted(map(tuple, simhash.near_groups(docs_of(rows)).collect()), key=repr)
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(range(len(rows)), near)
    least = {g: min((rows[i][0] for i in root if root[i] == g and rows[i][0] is not None), default=None) for g in root.values()}
    assert got == sorted([(rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))], key=repr)


def test_near_copies_go_and_others_stay(docs_of, odd_rows):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choices(words, k=200) for _ in range(15)]
    rows = [(1000 + i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:8]):  # two of 200 words changed: similarity about 0.9
        copy = list(b)
        copy[50], copy[150] = "other", "else"
        rows.append((2000 + i, " ".join(copy)))
    half = base[9][:100] + r.choices(words, k=100)
    rows.append((3000, " ".join(half)))
    docs = docs_of(rows)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    ids = {row.doc_id for row in kept.collect()}
    assert ids == set(range(1000, 1015)) | {3000}
    assert simhash.drop_near(docs_of(odd_rows)).filter("doc_id = 4 or doc_id = 6").count() >= 2
    assert simhash.drop_near(docs_of([])).count() == 0
    assert simhash.near_groups(docs_of([])).count() == 0


def kept_by_brute_force(rows, similarity=0.8):
    """Ids that stay: the least of every component of all pairs of that Jaccard similarity."""
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2)
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root, least = roots(range(len(rows)), near), {}
    for i, (doc_id, _) in enumerate(rows):
        least[root[i]] = min(doc_id, least.get(root[i], doc_id))
    return set(least.values())


def independent_variants(r):
    """Many variants of one text, each within reach of the text but few of each other, and chains of changes."""
    words = [f"v{i}" for i in range(5000)]
    base, rows = r.choices(words, k=300), []
    for i in range(120):
        text = list(base)
        for at in r.sample(range(300), r.randint(3, 9)):
            text[at] = r.choice(words)
        rows.append((5000 - i, " ".join(text)))
    return [*rows, (9000, " ".join(base))]


def reordered_texts(r):
    """Near copies that share their word set with other, reordered texts."""
    rows = []
    for g in range(10):
        words = [f"o{g}x{i}" for i in range(120)]
        for k in range(4):
            r.shuffle(words)
            rows.append((100 * g + 10 * k, " ".join(words)))
            rows.append((100 * g + 10 * k + 1, " ".join([*words[-2:], *words[:-2]])))
    return rows


@pytest.mark.parametrize("make", [independent_variants, reordered_texts])
def test_groups_of_variants_equal_brute_force(docs_of, make):
    rows = make(random.Random(6))
    assert {row.doc_id for row in simhash.drop_near(docs_of(rows)).collect()} == kept_by_brute_force(rows)


def passages(r):
    """(rows, kind and wanted similarity by pair): texts with a passage appended, cut off or moved, ids 2 i and 2 i + 1."""
    rows, kinds = [], {}
    for i in range(90):
        n = r.choice([100, 300, 1000])
        kind, want = ("appended", "cut", "moved")[i % 3], (0.8, 0.85, 0.9)[i // 3 % 3]
        text = [f"p{i}x{k}" for k in range(n)]
        some = int((n - 4) * (1 - want) / want)  # shingles that an appended or cut passage of so many words adds or takes
        other = {"appended": text + [f"q{i}x{k}" for k in range(some)], "cut": text[:n - int((n - 4) * (1 - want))],
                 "moved": text[n // 2:] + text[:n // 2]}[kind]
        rows += [(20_000 + 2 * i, " ".join(text)), (20_001 + 2 * i, " ".join(other))]
        kinds[i] = kind, want
    return rows, kinds


def test_appended_cut_and_moved_passages_equal_brute_force(docs_of):
    rows, kinds = passages(random.Random(7))
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) * 0.55
    assert {row.doc_id for row in simhash.drop_near(docs_of(rows)).collect()} == want


def counted(monkeypatch, *modules):
    """(label, rows) of every table that the modules store from here on."""
    made = []

    def stored(df, label):
        out = common.stored(df, label)
        made.append((label, out.count()))
        return out

    for module in modules:
        monkeypatch.setattr(module, "stored", stored)
    return made


def test_texts_of_pairs_that_parities_rule_out_are_not_asked_for(docs_of, monkeypatch):
    rows = []
    for i in range(40):  # half of the shingles in common: similarity 0.3, but every pair shares one that is looked at
        both = [f"c{i}x{k}" for k in range(60)]
        rows += [(2 * i, " ".join(both + [f"a{i}x{k}" for k in range(60)])), (2 * i + 1, " ".join(both + [f"b{i}x{k}" for k in range(60)]))]
    made = counted(monkeypatch, simhash)
    assert simhash.drop_near(docs_of(rows)).count() == 80
    assert sum(n for label, n in made if label == "pairs") >= 40
    assert sum(n for label, n in made if label == "shingles") == 0
    assert [label for label, _ in made].count("different") == 1  # one pass for all fingerprints


def test_stars_need_no_further_round(spark, monkeypatch):
    made = counted(monkeypatch, components_module)
    stars = [(7, i) for i in range(1000, 1300)] + [(5, 6), (5, 5), (7, 1000)]
    got = dict(map(tuple, components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert got == {7: 7, 5: 5, 6: 5} | {i: 7 for i in range(1000, 1300)}
    assert made == [("links", 301)]
