"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within r differing bits meet in a value that each of them
reaches by flipping at most r/2 bits. So every different fingerprint emits its
ball of variants, the variants are shuffled, and fingerprints that collide on a
variant are linked: both are within r/2 of it, so the collision itself verifies r.

A ball of radius two has 2,081 variants. They are shuffled by class: the lowest
few bits of the variant. A fingerprint goes once to each class that its ball
touches (37 of 256, 137 of 65,536), and the task that holds the class forms the
variants that belong there, so eight bytes cross the network for many variants.
The number of bits follows the number of fingerprints and keeps what a task
holds bounded at every size.

``drop_near`` uses such collisions only to join most copies early. What they miss is found
by an exact join of rare word shingles, so its groups are those of all pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import discard, forget, freed_shuffles, release, scratch_mark, ship, stored
from tidyledger.llm.components import components

BITS = 64
SEED = 42
VARIANTS_PER_TASK = 3_000_000
FREQUENT_SAMPLE = 20_000  # documents in which frequent shingles are counted
FREQUENT_SHINGLES = 100_000  # and how many of them are put last; any choice gives the same groups
PAIR_BLOCK = 1000
STAR_YIELD = 0.05  # part of a turn's pairs that must be near for another turn
PARITY_WORDS = 16  # 64-bit words of a document's parities


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every word shingle in order; fewer words are one shingle."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included; 0 for a text without words."""
    words = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashes = _shingle_hashes(words, shingle)
    counts = np.zeros(BITS, np.int64)
    for block in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[block:block + (1 << 16)], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (signed long) of every row."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", of("text").alias("fp"))


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most this many bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return np.array(masks, np.uint64)


def _linked(fps: np.ndarray, cls: int, bits: int, masks: np.ndarray) -> list[pd.DataFrame]:
    """Links of the fingerprints whose variants collide in this class, each to the first it is connected to here.

    The class holds the variants whose lowest ``bits`` bits are ``cls``. One with too
    many variants for memory is gone through in halves, by the next bit.
    """
    low = np.uint64((1 << bits) - 1)
    order = np.argsort(masks & low, kind="stable")
    sorted_low = (masks & low)[order]
    own = (fps & low) ^ np.uint64(cls)  # low bits of the masks that lead from each fingerprint into this class
    first = np.searchsorted(sorted_low, own, "left")
    count = np.searchsorted(sorted_low, own, "right") - first
    total = int(count.sum())
    if total > 2 * VARIANTS_PER_TASK and bits < 40:
        return _linked(fps, cls, bits + 1, masks) + _linked(fps, cls | 1 << bits, bits + 1, masks)
    ends = np.cumsum(count)
    who = np.repeat(np.arange(len(fps), dtype=np.int32), count)
    which = np.arange(total) - np.repeat(ends - count, count) + np.repeat(first, count)
    variants = fps[who] ^ masks[order[which]]
    del which
    ranked = np.sort(variants)
    met = ranked[1:][ranked[1:] == ranked[:-1]]
    del ranked
    if not len(met):
        return []
    met = np.unique(met)
    near = np.zeros(1 << 20, bool)
    near[(met >> np.uint64(44)).astype(np.int64)] = True
    maybe = near[(variants >> np.uint64(44)).astype(np.int64)]
    variants, who = variants[maybe], who[maybe]
    place = np.minimum(np.searchsorted(met, variants), len(met) - 1)
    same = met[place] == variants
    place, who = place[same], who[same]
    label = np.arange(len(fps))
    while True:
        least = np.full(len(met), len(fps))
        np.minimum.at(least, place, label[who])
        after = label.copy()
        np.minimum.at(after, who, least[place])
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return [pd.DataFrame({"a": signed[label[moved]], "b": signed[moved]})]


def fingerprint_links(different: DataFrame, count: int, distance: int, turns: int = 1) -> DataFrame:
    """(kind, a, b): links between different fingerprints of a kind whose components are those of 'at most distance bits apart'.

    ``count`` is the number of fingerprints of a kind. In each class a fingerprint is linked to the first of those it is
    connected to there. ``turns`` different orders make different ones the first, class by class.
    """
    ship(different.sparkSession)
    masks = ball(distance // 2)
    bits = max(4, int(np.ceil(np.log2(max(1, count * len(masks) / VARIANTS_PER_TASK)))))
    low = (1 << bits) - 1
    steps = F.array(*[F.lit(int(c)) for c in np.unique(masks & np.uint64(low))])
    own = F.col("fp").bitwiseAND(F.lit(low))
    nothing = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    def link(key, pdf):
        release()
        fps = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        kind, cls = map(int, key)
        turn = np.uint64(cls % turns)
        if turn:
            fps = fps[np.argsort((fps ^ turn) * np.uint64(0x9E3779B97F4A7C15) * (turn * np.uint64(2) + np.uint64(1)))]
        return pd.concat([nothing, *_linked(fps, cls, bits, masks)], ignore_index=True).assign(kind=kind)

    dealt = different.select("kind", "fp", own.alias("own")).select(
        "kind", "fp", F.explode(F.transform(steps, lambda s: s.bitwiseXOR(F.col("own")))).alias("cls"))
    return dealt.groupBy("kind", "cls").applyInPandas(link, "kind int, a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link when they differ in at most ``distance`` (even) bits; a component
    carries its smallest doc_id. Null and empty texts have fingerprint zero and link as any other.
    Rows that repeat an id count as one node per different text. Null ids take part; a
    component of null ids alone has a null id. No documents give no rows.
    """
    if distance % 2:
        raise ValueError("distance must be even: half of it is flipped on either side")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    different = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "different")
    links = fingerprint_links(different.withColumn("kind", F.lit(0)), different.count(), distance)
    roots = components(links)
    named = stored(different.join(roots, different["fp"] == roots["node"], "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    labels = stored(named.join(least, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _word_set_prints(texts: pd.Series, seeds: range) -> pd.DataFrame:
    """Fingerprints of the set of different words: one per seed."""
    out = np.zeros((len(texts), len(seeds)), np.uint64)
    for i, text in enumerate(texts):
        words = set(("" if text is None else text).encode("utf-8", "surrogatepass").lower().split())
        for j, seed in enumerate(seeds):
            if words:
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], "<u8")
                counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i, j] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return pd.DataFrame({f"fp{j}": out[:, j].view(np.int64) for j in range(len(seeds))})


def shingle_set(text: str | None, shingle: int) -> bytes:
    """Sorted 64-bit hashes of the different word shingles; a shorter text is one shingle."""
    return _different_shingles(text, shingle).astype("<i8").tobytes()


def _different_shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes (signed) of the different word shingles."""
    words = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    return np.unique(_shingle_hashes(words, shingle).view(np.int64))


def _frequent(docs: DataFrame, shingle: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank of each by rising count): the most frequent shingles of a sample of documents."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([_different_shingles(t, shingle) for t in texts])

    share = max(1, count // FREQUENT_SAMPLE)
    with freed_shuffles(docs.sparkSession):
        rows = (docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.explode(of("text")).alias("key"))
                .groupBy("key").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "key")
                .limit(FREQUENT_SHINGLES).collect())
    keys, counts = np.array([r["key"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, counts))] = np.arange(len(keys))
    return keys[order], rank[order]


def _prefixes(docs: DataFrame, node, shingle: int, similarity: float, count: int) -> DataFrame:
    """(node, n, keys, w0, …): of the n different shingles of each document the first n - ceil(similarity n) + 1, and its parities.

    All documents order their shingles alike, frequent ones last, by count. Two documents
    of the wanted similarity share one of these shingles. Bit i of the parities says whether an odd number of the shingles
    hash to i; the bits in which two documents differ are at most the shingles that only one of them has.
    """
    known, rank = _frequent(docs, shingle, count)
    words = [f"w{i}" for i in range(PARITY_WORDS)]

    @F.pandas_udf("n int, keys array<long>, " + ", ".join(f"{w} long" for w in words))
    def first(texts: pd.Series) -> pd.DataFrame:
        release()
        sizes, chosen, parities = [], [], np.zeros((len(texts), PARITY_WORDS * 64), np.uint8)
        for i, text in enumerate(texts):
            keys = _different_shingles(text, shingle)
            sizes.append(len(keys))
            parities[i] = np.bincount(keys & (PARITY_WORDS * 64 - 1), minlength=PARITY_WORDS * 64) & 1
            wanted = len(keys) - int(np.ceil(similarity * len(keys) - 1e-9)) + 1
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                frequent = known[place] == keys
                late = np.argsort(rank[place[frequent]])
                keys = np.concatenate([keys[~frequent], keys[frequent][late]])
            chosen.append(keys[:wanted])
        bits = np.packbits(parities, axis=1, bitorder="little").view("<i8")
        return pd.DataFrame({"n": np.array(sizes, np.int32), "keys": chosen} | {w: bits[:, i] for i, w in enumerate(words)})

    return docs.select(node.alias("node"), first("text").alias("p")).select("node", "p.*")


def _ball_pairs(nodes: DataFrame, distance: int, tables: int) -> DataFrame:
    """Pairs of nodes that collide in one of several fingerprints: each with the first of those it is connected to."""
    own = nodes.select("node", F.posexplode(F.array(*[f"fp{j}" for j in range(tables)])).alias("kind", "fp"))
    different = stored(own.groupBy("kind", "fp").agg(F.min("node").alias("first")), "different")
    links = stored(fingerprint_links(different, different.count() // tables, distance, turns=8), "print-links")
    same = own.join(different, ["kind", "fp"]).selectExpr("first a", "node b")
    other = (links.join(different.selectExpr("kind", "fp a", "first x"), ["kind", "a"])
             .join(different.selectExpr("kind", "fp b", "first y"), ["kind", "b"]).selectExpr("x a", "y b"))
    return same.unionAll(other)


def near_pairs(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, tables: int = 3) -> tuple:
    """(nodes, links): every row's node key and id, and links between nodes.

    The links' components are those of all pairs whose different word shingles have the
    wanted Jaccard similarity. First candidates are collisions of several fingerprints of the
    set of words, and every document that shares a shingle of its prefix with another against
    one of those that have it. This is repeated among documents that are not joined yet, with another centre each time,
    as long as a good part of the pairs are joined: large groups are joined in few pairs. Then all that share such
    a shingle, and are not joined yet, are compared. Pairs whose sizes, places of the
    shingle or parities rule the similarity out are left out.
    """
    ship(docs.sparkSession)
    seeds = range(1, tables + 1)
    kind = ", ".join(f"fp{j} long" for j in range(tables))

    @F.pandas_udf(kind)
    def prints(texts: pd.Series) -> pd.DataFrame:
        release()
        return _word_set_prints(texts, seeds)

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([shingle_set(t, shingle) for t in texts])

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        release()
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= similarity * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    node = F.xxhash64("doc_id", "text")
    nodes = stored(docs.select(node.alias("node"), "doc_id", prints("text").alias("p")).select("node", "doc_id", "p.*"),
                   "word-prints")

    def verify(pairs: DataFrame) -> DataFrame:
        mark = scratch_mark()
        asked = stored(pairs.selectExpr("a node").unionAll(pairs.selectExpr("b node")).distinct(), "asked")
        words = stored(docs.select(node.alias("node"), "text").join(asked, "node", "left_semi").dropDuplicates(["node"])
                       .select("node", sets("text").alias("set")), "shingles")
        near = stored(pairs.join(words.selectExpr("node a", "set left"), "a").join(words.selectExpr("node b", "set right"), "b")
                      .filter(alike("left", "right")).select("a", "b"), "near-links")
        discard(docs.sparkSession, mark)
        return near

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and parities do not rule out, so that only their texts are asked for."""
        return stored(pairs.join(parities.withColumnRenamed("node", "a"), "a").join(others_parities, "b")
                      .filter(sizes & few_differ).select("a", "b"), "possible")

    def different_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()

    lists = stored(_prefixes(docs, node, shingle, similarity, nodes.count()), "prefixes")
    entries = lists.select("node", "n", F.posexplode("keys").alias("place", "key"))
    met = stored(entries.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "shared-keys")
    entries = stored(entries.join(met, "key"), "met-prefixes")
    words = [f"w{i}" for i in range(PARITY_WORDS)]
    parities = stored(lists.select("node", "n", *words).dropDuplicates(["node"]), "parities")
    forget(met)
    forget(lists)
    others_parities = parities.select(F.col("node").alias("b"), F.col("n").alias("m"), *(F.col(w).alias(f"x{w}") for w in words))
    sizes = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6
    differ = reduce(Column.__add__, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w}"))) for w in words])
    few_differ = differ <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
    rest = 1 + F.least(F.col("n") - 1 - F.col("place"), F.col("m") - 1 - F.col("at"))
    fits = sizes & (rest >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6)

    def opened(roots: DataFrame) -> DataFrame:
        """Entries, with their document's root, of the shingles that documents of several roots share."""
        mark = scratch_mark()
        rooted = stored(entries.join(roots, "node", "left").select(
            "key", "node", "n", "place", F.coalesce("root", "node").alias("root")), "rooted-prefixes")
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"))
        out = stored(rooted.join(several.filter("lo <> hi").select("key", "rows"), "key"), "open-prefixes")
        discard(docs.sparkSession, mark)
        return out

    def stars(found: DataFrame, turn: int) -> DataFrame:
        """Every document against one that shares a shingle with it. The order is the same for all shingles, so documents
        that share many meet few different centres."""
        centre = found.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "place", "root")).alias("c")).select(
                "key", F.col("c.node").alias("b"), F.col("c.n").alias("m"), F.col("c.place").alias("at"), F.col("c.root").alias("other"))
        return found.join(centre, "key").filter(fits & (F.col("root") != F.col("other"))).selectExpr("node a", "b")

    alone = entries.withColumn("root", F.col("node"))
    mark = scratch_mark()
    tried = stored(different_pairs(_ball_pairs(nodes, distance, tables).unionAll(stars(alone, 0))), "pairs")
    discard(docs.sparkSession, mark)
    links = verify(possible(tried))
    # Another centre each turn, while turns join many of the pairs they try.
    for turn in count(1):
        mark = scratch_mark()
        roots = stored(components(links), "link-roots")
        discard(docs.sparkSession, mark)
        found = opened(roots)
        more = stored(different_pairs(stars(found, turn)).join(tried, ["a", "b"], "left_anti"), "pairs")
        joined = verify(possible(more))
        tried, links = tried.unionAll(more), links.unionAll(joined)
        if joined.count() < STAR_YIELD * more.count() or more.isEmpty():
            break
        forget(found)
        forget(roots)

    # What is left shares shingles without being near a centre. Only pairs that the parities do not rule out are made.
    found = found.withColumn("blocks", F.ceil(F.col("rows") / PAIR_BLOCK)).join(parities.drop("n"), "node")
    left = found.select("key", F.col("node").alias("a"), "n", "place", "root", F.pmod(F.xxhash64("node"), "blocks").alias("block"), *words)
    right = found.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"),
                         F.col("root").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                         *(F.col(w).alias(f"x{w}") for w in words))
    others = (left.join(right, ["key", "block"]).filter(fits & few_differ & (F.col("a") < F.col("b")) & (F.col("root") != F.col("other")))
              .select("a", "b"))
    untried = stored(different_pairs(others).join(tried, ["a", "b"], "left_anti"), "untried")
    return nodes, verify(untried).unionAll(joined).unionAll(roots.filter("node <> root").selectExpr("root a", "node b"))


def drop_near(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, tables: int = 3) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id, with all its columns.

    Null texts are empty; null ids lose to any id. Of rows that repeat id and text all stay or none.
    """
    mark = scratch_mark()
    nodes, links = near_pairs(docs, shingle, similarity, distance, tables)
    roots = stored(components(links), "near-roots")
    ids = nodes.join(roots, "node").select("root", "node", "doc_id")
    first = stored(ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("f"))
                   .select("root", F.col("f.node").alias("stays")), "near-first")
    gone = stored(roots.join(first, "root").filter("node <> stays").select("node"), "near-gone")
    discard(docs.sparkSession, mark)
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("node"))
    return packed.join(gone, "node", "left_anti").select("row.*")
