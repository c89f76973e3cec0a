import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidyledger.llm import prefix_trie
from tidyledger.llm.prefix_trie import SlotTable, prefix_nodes

CLASHING = ("a", "b", "depth", "shard", "size", "rank", "start", "t1", "chars", "kind", "block", "h", "base", "carried", "n_convs")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], "conv_id long, turn long, role string, text string, "
                                 + ", ".join(f"{c} string" for c in CLASHING)).repartition(5)


def digest(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def conversations(rows):
    """Turns of every conversation in order. Rows of one turn number must be equal here, as their order is that of a digest."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}


def forked(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs_of in members.items():
        own = (len(convs_of) - 1) * (len(node[-1][1]) if node else 0)
        leaf = children[node] == 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += leaf
            saved[node[:d]] += own
    return sorted((
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()), key=repr)


def result(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def invented(seed, n_convs, longest):
    """Conversations that share beginnings: a third of them one, many others' copies, some of one turn, some long."""
    rng, rows = random.Random(seed), []
    common = [("user", f"hello {i}") for i in range(longest)]
    for c in range(n_convs):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "", None, "a word"])) for _ in range(rng.randrange(1, 5))]
        if c % 3 == 0:
            turns = common[:rng.randrange(1, longest)] + turns
        elif c % 3 == 1:
            turns = common[:2]
        rows += [(c * 7 % 1009, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block", [3, 1000])
def test_equals_brute_force_also_when_conversations_are_cut(spark, block):
    rows = invented(1, 150, 12)
    assert result(prefix_nodes(table(spark, rows), block=block, shards=7)) == brute_force(conversations(rows))
    got = prefix_nodes(table(spark, rows), chains=prefix_trie.forked, block=block, shards=5)
    assert result(got) == brute_force(forked(conversations(rows)))


def test_one_conversation_holds_most_rows(spark):
    rows = [(5, i, "user", f"turn {i % 50}") for i in range(310)] + [(c, i, "user", f"turn {i}") for c in (6, 7) for i in range(40)]
    rows += [(8, i, "user", f"turn {i % 50}") for i in range(270)]
    assert result(prefix_nodes(table(spark, rows), block=20)) == brute_force(conversations(rows))


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [(1, None, "user", "null turns come first"), (1, 0, None, None), (1, 1, "", ""), (2, 0, "user", long), (3, 0, "user", long),
            (3, 1, "assistant", long), (-1, 0, "user", "negative"), (-1, 0, "user", "negative"), (None, 0, "user", "of no conversation"),
            (2**60 + 1, 0, "user", "large"), (2**60 + 3, 0, "user", "large"), (2**60 + 3, 5, "üser", "ünïcode \U0001f600")]
    for chains, built in ((prefix_trie.whole, lambda c: c), (prefix_trie.forked, forked)):
        assert result(prefix_nodes(table(spark, rows), chains=chains)) == brute_force(built(conversations(rows)))


def test_turnless_conversations_are_members_of_the_root(spark):
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lonely, 0, "user", "cut away")]
    want = brute_force(forked(conversations(rows)))
    assert len(want) == 1 and result(prefix_nodes(table(spark, rows), chains=prefix_trie.forked)) == want


def test_no_conversations(spark):
    for chains in (prefix_trie.whole, prefix_trie.forked):
        assert result(prefix_nodes(table(spark, []), chains=chains)) == []
        assert result(prefix_nodes(table(spark, [(None, 1, "a", "b")]), chains=chains)) == []


def test_equal_turn_numbers_are_ordered_alike_whatever_the_order_of_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    assert [r[3] for r in result(prefix_nodes(table(spark, rows)))] == [2, 2, 2]


def test_slots_are_minimal_and_know_foreign_keys():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    a[:100], b[100:200] = 7, 7  # keys that share a half
    table = SlotTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(b, a) == -1).all() and len(SlotTable(a[:0], b[:0]).slots(a, b)) == 5000


def test_two_prefixes_with_one_digest_are_an_error():
    import pandas as pd

    rows = pd.DataFrame({"conv_id": [1, 2, 2], "depth": [1, 1, 2], "e1": [5, 4, 2], "e2": [6, 6, 0], "chars": [1, 1, 1],
                         "size": [1, 2, 2], "block": [0, 0, 0], "carried": [False] * 3, "shard": [0, 0, 0]})
    assert len(prefix_trie._shard_nodes(rows, 9)) == 5
    rows.loc[2, "e1"] = 1  # now both conversations have the digest (5, 6), by different turns
    with pytest.raises(ValueError):
        prefix_trie._shard_nodes(rows, 9)


def test_ids_that_end_at_one_node_are_hashed_in_runs(spark, monkeypatch):
    ends = spark.range(30_000).selectExpr("9L a", "id % 2 b", "id * 3 conv_id").repartition(9)
    got = {r.b: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    for odd in (0, 1):
        text = ",".join(str(i * 3) for i in range(30_000) if i % 2 == odd)
        assert got[odd] == hashlib.sha256(text.encode()).hexdigest()
