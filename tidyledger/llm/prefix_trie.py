"""Trie of conversation prefixes in flat arrays behind minimal perfect hashes.

Every distinct sequence of the first d turns is a node. Turns become 128-bit digests where they are read;
only digests and lengths are shuffled. A prefix is named by the exclusive-or of its digests, each bound to its depth.

1. Turns get their place by a sort that cuts long conversations too (:func:`placed`).
2. Chains are dealt into shards by nearby ids and blocks of depth. A shard enumerates its distinct prefixes, gives them
   slots of a minimal perfect hash that holds its keys, scatters where conversations end into flat arrays, and adds
   them up through the parents' slots, deepest first (:func:`_shard_nodes`). Sums over shards give the members of a node.
3. A node's own leaf flag and savings are put into one shard, that of its smallest member, and added up likewise
   (:func:`_shard_sums`). Sums over shards give the whole subtree.

No shard depends on how many conversations share a prefix: a very common first turn lies in all shards, once in each.
A conversation longer than a block goes on in other shards; what comes from deeper blocks is added at the block's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import ship, shuffle_partitions, stored

BLOCK = 1000  # turns of one conversation that one shard takes
SHARD_ROWS = 50_000  # turns of a shard, on average
NEARBY = 100  # so many neighbouring ids share a shard
CHUNK = 4096  # ids that are joined before the shuffle
_GOLDEN, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_ROW_BITS = 33  # of monotonically_increasing_id

NODE, EDGE, END = 0, 1, 2
PARTIAL = ("kind int, shard int, a long, b long, pa long, pb long, depth long, chars long, n_convs long, conv_id long, "
           "block long, more boolean, proof long")
SUMS = "a long, b long, n_leaves long, saved_tokens long, n_children long"


# --- places and chains ------------------------------------------------------


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, t1, t2, chars): digested turns, ranked by (conv_id, turn, digest) over the whole table.

    The sort deals a conversation of any length over several tasks; ranks come from counts per task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = stored(conversations.filter("conv_id is not null").select("conv_id", "turn", digest.alias("t"), F.length(text).cast("long").alias("chars"))
                   .select("conv_id", "turn", F.xxhash64("t").alias("t1"), F.xxhash64(F.lit(1), "t").alias("t2"), "chars"),
                   "turns")
    order = ["conv_id", "turn", "t1", "t2"]
    ordered = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "t1", "t2", "chars", F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row")), "ordered-turns")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("task").count().select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    # One row per task of the sort, whatever the size of the table.
    return ordered.join(F.broadcast(offsets), "task").select(
        "conv_id", (F.col("offset") + F.col("row")).alias("rank"), "t1", "t2", "chars")


def whole(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, size) and the chains (conv_id, depth, t1, t2, chars, size)."""
    turns = placed(conversations)
    sizes = stored(turns.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("size")), "sizes")
    chains = turns.join(sizes, "conv_id").select(
        "conv_id", (F.col("rank") - F.col("start") + 1).alias("depth"), "t1", "t2", "chars", "size")
    return sizes.select("conv_id", "size"), chains


def forked(conversations: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their hundred does.

    The first h turns come from conversation ``c - c % family`` (none if it is absent), the rest are the own turns
    after the first h, where h is crc32 of the decimal id modulo ``heads``.
    """
    turns = placed(conversations)
    own = turns.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count("*").alias("own"))
    own = stored(own.withColumns({
        "base": F.expr(f"conv_id - conv_id % {family}"),
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads}), "own-sizes")
    bases = own.filter(f"conv_id % {family} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("given"))
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    sizes = stored(own.join(bases, "base", "left").select(
        "conv_id", "base", "start", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "sizes")
    place = F.col("rank") - F.col("start")
    tails = turns.join(sizes, "conv_id").filter(place >= F.col("h")).select(
        "conv_id", (place - F.col("h") + F.col("taken") + 1).alias("depth"), "t1", "t2", "chars", "size")
    first = turns.filter(f"conv_id % {family} = 0").join(sizes.select("conv_id", "start"), "conv_id").filter(
        place < heads - 1).select(F.col("conv_id").alias("base"), (place + 1).alias("depth"), "t1", "t2", "chars")
    begun = first.join(sizes, "base").filter("depth <= h").select("conv_id", "depth", "t1", "t2", "chars", "size")
    return sizes.select("conv_id", "size"), tails.unionByName(begun)


# --- one shard --------------------------------------------------------------


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of two 64-bit words."""
    x = a.view(np.uint64) + np.uint64((seed + 1) * _GOLDEN & _WORD)
    for word in (b.view(np.uint64), np.uint64(0)):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31)) ^ word
    return x


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys.

    Keys that fall alone into a place of a level take it; the others go on to the next level. A key's slot is the
    rank of its place. The slots hold the keys, so that a look-up of a foreign key is known as such.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, n, left = [], 0, np.arange(len(a))
        while len(left):
            size = 2 * len(left) + 1
            at = mixed(a[left], b[left], len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + n))
            n += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slots = self._place(a, b)
        self.a[slots], self.b[slots] = a, b

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = mixed(a[left], b[left], level) % np.uint64(len(alone))
            hit = alone[at]
            slots[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return slots

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for keys that the table does not hold."""
        slots = self._place(a, b)
        known = slots >= 0
        known[known] = (self.a[slots[known]] == a[known]) & (self.b[slots[known]] == b[known])
        return np.where(known, slots, -1)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of one row of each different key."""
    order = np.lexsort((b, a))
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[first]


def upwards(depth: np.ndarray, parent: np.ndarray, block: int):
    """(children, their parents) of each depth, deepest first; nodes without a parent here are left out.

    What lies below a block's first depth comes to the block above as a carried sum, also when both are in one shard.
    """
    parent = np.where((depth - 1) % block == 0, -1, parent)
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        part = part[parent[part] >= 0]
        if len(part):
            yield part, parent[part]


def _shard_nodes(rows: pd.DataFrame, size_of_block: int) -> pd.DataFrame:
    """Nodes of one shard with their members here, the last node of cut conversations, and where conversations end."""
    carried = rows["carried"].to_numpy()
    before = {(c, k): (x, y) for c, k, x, y in rows.loc[carried, ["conv_id", "block", "e1", "e2"]].itertuples(index=False)}
    rows = rows[~carried]
    shard = rows["shard"].iloc[0] if len(rows) else 0
    conv, block, depth = (rows[c].to_numpy() for c in ("conv_id", "block", "depth"))
    order = np.lexsort((depth, block, conv))
    conv, block, depth = conv[order], block[order], depth[order]
    e1, e2, chars, size = (rows[c].to_numpy()[order] for c in ("e1", "e2", "chars", "size"))
    start = np.ones(len(conv), bool)
    start[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
    starts, run = np.flatnonzero(start), np.cumsum(start) - 1
    carry = np.array([before.get((c, k), (0, 0)) for c, k in zip(conv[starts], block[starts])], np.int64).reshape(-1, 2)
    keys, parents = [], []
    for e, given in ((e1, carry[:, 0]), (e2, carry[:, 1])):
        sums = np.bitwise_xor.accumulate(e) if len(e) else e
        key = sums ^ (sums[starts] ^ e[starts] ^ given)[run]
        parent = np.empty_like(key)
        parent[1:] = key[:-1]
        parent[starts] = given
        keys.append(key)
        parents.append(parent)
    (a, b), (pa, pb) = keys, parents
    one = _distinct(a, b)
    nodes = SlotTable(a[one], b[one])
    slot, n = nodes.slots(a, b), len(nodes.a)
    proof = mixed(mixed(e1, e2, 1).view(np.int64), mixed(pa, pb, 2), 3).view(np.int64)
    held = {name: np.zeros(n, np.int64) for name in ("pa", "pb", "depth", "chars", "proof")}
    for name, values in (("pa", pa), ("pb", pb), ("depth", depth), ("chars", chars), ("proof", proof)):
        held[name][slot[one]] = values[one]
    if (held["proof"][slot] != proof).any():
        raise ValueError("Two different prefixes share a digest")
    last = np.append(start[1:], True) if len(start) else start
    n_convs, smallest = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(n_convs, slot[last], 1)
    np.minimum.at(smallest, slot[last], conv[last])
    for child, parent in upwards(held["depth"], nodes.slots(held["pa"], held["pb"]), size_of_block):
        np.add.at(n_convs, parent, n_convs[child])
        np.minimum.at(smallest, parent, smallest[child])
    more = np.zeros(n, bool)
    more[slot[depth < size]] = True
    table = pd.DataFrame(dict(kind=NODE, shard=shard, a=nodes.a, b=nodes.b, **held, n_convs=n_convs, conv_id=smallest,
                              block=0, more=more))
    tail = pd.DataFrame(dict(kind=np.where(depth < size, EDGE, END), shard=shard, a=a, b=b, pa=0, pb=0, depth=depth, chars=0,
                             proof=0, n_convs=0, conv_id=conv, block=block, more=False))[last]
    return pd.concat([table, tail])[[c.split()[0] for c in PARTIAL.split(", ")]]


def _shard_sums(rows: pd.DataFrame, size_of_block: int) -> pd.DataFrame:
    """Sums over the subtrees of one shard's nodes."""
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    is_node = rows["is_node"].to_numpy()
    held = rows[is_node]
    nodes = SlotTable(a[is_node], b[is_node])
    slot, n = nodes.slots(a, b), len(nodes.a)
    own = slot[is_node]
    depth, pa, pb = (np.zeros(n, np.int64) for _ in range(3))
    for array, name in ((depth, "depth"), (pa, "pa"), (pb, "pb")):
        array[own] = held[name].to_numpy()
    sums = {}
    for name in ("n_leaves", "saved_tokens"):
        sums[name] = np.zeros(n, np.int64)
        np.add.at(sums[name], slot, rows[name].to_numpy())
    for child, parent in upwards(depth, nodes.slots(pa, pb), size_of_block):
        for values in sums.values():
            np.add.at(values, parent, values[child])
    return pd.DataFrame(dict(a=nodes.a, b=nodes.b, **sums, n_children=0))


# --- digests of the conversations that end at a node ---------------------------


def _joined(batches):
    """Sorted (a, b, conv_id) to one row per node and run of ids: the decimal ids joined by commas."""
    for batch in batches:
        a, b, ids = (batch[c].to_numpy() for c in ("a", "b", "conv_id"))
        cut = np.ones(len(ids), bool)
        cut[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        cut[::CHUNK] = True
        starts = np.flatnonzero(cut)
        text = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])] if len(ids) else []
        yield pd.DataFrame({"a": a[starts], "b": b[starts], "first": ids[starts], "ids": text})


def _hashed(batches):
    """Sorted (a, b, first, ids) to one digest per node, in a stream."""
    node, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(batch["a"], batch["b"], batch["ids"]):
            if (a, b) == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id). Ids are joined in runs before the shuffle, so a node at which a third
    of all conversations end is a few long strings; its digest is one sequential hash by definition."""
    runs = (ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
            .mapInPandas(_joined, "a long, b long, first long, ids string"))
    return (runs.repartition("a", "b").sortWithinPartitions("a", "b", "first")
            .mapInPandas(_hashed, "a long, b long, ends_sha256 string"))


# --- the trie -----------------------------------------------------------------


def _block(block: int):
    return F.expr(f"(depth - 1) div {block}")


def prefix_nodes(conversations: DataFrame, chains: Callable = whole, block: int = BLOCK,
                 shards: int | None = None) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; ``chains`` says which turns a conversation is made of.
    Turns are ordered by turn, null first; equal turns by the digest of role and text, so repeated rows are turns of their own.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation and take no part.
    The root (depth 0) has every conversation as a member. An empty table gives no rows. Other columns are ignored.
    Two prefixes with one digest (128 bits) are found by a check of every row and are an error.
    """
    spark = conversations.sparkSession
    ship(spark)
    sizes, rows = chains(conversations)
    facts = sizes.agg(F.count("*"), F.min("conv_id"), F.sum("size"), F.max("size")).first()
    if not facts[0]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    n_convs, smallest, n_rows, longest = facts
    shards = shards or max(2 * spark.sparkContext.defaultParallelism, -(-n_rows // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv_id") / NEARBY), F.col("block")), F.lit(shards)).cast("int")
    dealt = rows.select("conv_id", "depth", F.xxhash64("depth", "t1").alias("e1"), F.xxhash64("t2", "depth").alias("e2"),
                        "chars", "size", _block(block).alias("block"), F.lit(False).alias("carried"))
    if longest > block:  # else no conversation is cut, and nothing is carried
        totals = dealt.filter(F.col("size") > block).groupBy("conv_id", "block").agg(
            F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.unionByName(totals.select(
            "conv_id", F.lit(0).cast("long").alias("depth"), F.bit_xor("e1").over(earlier).alias("e1"),
            F.bit_xor("e2").over(earlier).alias("e2"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("size"),
            "block", F.lit(True).alias("carried")).filter("block > 0"))
    partial = stored(dealt.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda rows: _shard_nodes(rows, block), PARTIAL), "trie-shards")
    parts = partial.filter(F.col("kind") == NODE)
    same = F.when(F.min("proof") != F.max("proof"), F.raise_error(F.lit("Two different prefixes share a digest")).cast("long"))
    nodes = stored(parts.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("chars").alias("chars"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.coalesce(same, F.max(F.col("more").cast("long"))).alias("more")), "trie-nodes")

    own = nodes.select("a", "b", "conv_id", "depth", (1 - F.col("more")).alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    placed_once = parts.select("shard", "a", "b", "pa", "pb", "depth", "conv_id").join(own.drop("depth"), ["a", "b", "conv_id"], "left").select(
        "shard", "a", "b", "pa", "pb", "depth", F.lit(True).alias("is_node"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_leaves", "saved_tokens")))
    if longest > block:
        deeper = own.select("conv_id", _block(block).alias("at"), "n_leaves", "saved_tokens").filter("at > 0").groupBy(
            "conv_id", "at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        edges = partial.filter(F.col("kind") == EDGE).select("conv_id", (F.col("block") + 1).alias("at"), "shard", "a", "b")
        below = Window.partitionBy("conv_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        carried = edges.unionByName(deeper, allowMissingColumns=True).select(
            "shard", "a", "b", zero.alias("pa"), zero.alias("pb"), zero.alias("depth"), F.lit(False).alias("is_node"),
            F.coalesce(F.sum("n_leaves").over(below), zero).alias("n_leaves"),
            F.coalesce(F.sum("saved_tokens").over(below), zero).alias("saved_tokens")).filter("shard is not null")
        placed_once = placed_once.unionByName(carried)
    subtrees = placed_once.groupBy("shard").applyInPandas(lambda rows: _shard_sums(rows, block), SUMS)
    children = nodes.select(F.col("pa").alias("a"), F.col("pb").alias("b"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
                            F.lit(1).cast("long").alias("n_children"))
    totals = stored(subtrees.unionByName(children).groupBy("a", "b").agg(
        *(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children"))), "trie-sums")
    below_root = nodes.join(totals, ["a", "b"])
    ends = partial.filter(F.col("kind") == END).select("a", "b", "conv_id").unionByName(
        sizes.filter("size = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    at_root = F.struct(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")), F.count("*").alias("n_children"))
    root = below_root.filter("depth = 1").agg(at_root.alias("r")).select(
        zero.alias("a"), zero.alias("b"), zero.alias("depth"), F.lit(n_convs).cast("long").alias("n_convs"),
        F.lit(smallest).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.coalesce("r.n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("r.saved_tokens", zero).alias("saved_tokens"), "r.n_children")
    kept = ("a", "b", "depth", "n_convs", "conv_id", "parent_conv_id", "n_leaves", "saved_tokens", "n_children")
    # All nodes of depth 1 have one parent, whose smallest member is known; only deeper ones look theirs up.
    top = below_root.filter("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long")).select(*kept)
    parent = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = below_root.filter("depth > 1").join(parent, ["pa", "pb"]).select(*kept)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return root.unionByName(top).unionByName(deep).join(end_digests(ends), ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: crc32 goes bit by bit over the decimal id; a prefix is known by the digests of its turns.
ORACLE = """
WITH own AS (
  SELECT conv_id, list(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
                       ORDER BY turn NULLS FIRST) AS t,
         list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS k
  FROM conversations GROUP BY conv_id
), crc AS (
  SELECT conv_id, t, k, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT + 256, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, x: CASE WHEN x >= 256 THEN xor(s, x - 256) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END),
    4294967295::BIGINT) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t, list_concat(coalesce(b.k[1:c.h], []), c.k[c.h + 1:]) AS k
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), chain AS (
  SELECT conv_id, len(t) AS size, d AS depth, array_to_string(t[1:d], ',') AS node, array_to_string(t[1:d - 1], ',') AS parent,
         CASE WHEN d = 0 THEN 0 ELSE k[d] END AS chars
  FROM (SELECT conv_id, t, k, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT node, depth, CASE WHEN depth > 0 THEN any_value(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         max(size) = depth AS leaf, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM chain GROUP BY node, depth
), above AS (
  SELECT c.node, n.leaf, n.saved FROM node n JOIN chain m ON m.conv_id = n.conv_id AND m.depth = n.depth
  JOIN chain c ON c.conv_id = n.conv_id AND c.depth <= n.depth
), sums AS (
  SELECT node, CAST(count_if(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY node
), kids AS (SELECT parent, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens, n.ends_sha256
FROM node n JOIN sums s USING (node) LEFT JOIN kids k ON k.parent = n.node LEFT JOIN node p ON p.node = n.parent
"""
