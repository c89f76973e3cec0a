"""Merging near-duplicate names, exactly as a sequential pass by rank would.

Names are ranked by (frequency desc, length desc, text). Going down the ranks, a name that is not yet in a cluster opens
one and takes in every later free name that is similar enough *to it*. The distributed form:

1. The most frequent names, a bounded block, go to all tasks; one map-only pass takes out what is similar to their leaders.
   Passes go on with the names left while each takes out a good part of them, so where few leaders take in most names no
   pairs of blocks are met.
2. The names left are cut into blocks by length. Pairs of blocks that may hold similar names meet in a task, which gives
   every name its *first* few similar names of smaller rank (:func:`first_before`). A matrix product over (letter, occurrence)
   tokens bounds the similarity of all pairs; only the few that may reach the threshold are compared.
3. Rounds of the lexicographically first independent set: a name whose similar earlier names have all joined others
   leads; a name whose first similar name that has not joined leads, joins it. Only open names iterate, on a bounded list
   each; a name that has used up its list looks for the next similar names (:func:`cluster`).

No list of pairs grows with the square of a dense group, and no round goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.functions.cleaning import strip_ws
from tidyledger.functions.similarity import assign_to_block, similar_before
from tidyledger.operators.clean import LOG
from tidyledger.sources.scratch import cut, ranked, stored

AUTO_MERGE, REVIEW = 95, 75
FIRST_BLOCK = 512  # names of the first pass
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1024, 4096, 64  # names of a block: as many as make 64 blocks, within bounds
PASS_YIELD = 0.1  # part of the names that a pass must take out for another pass
KEPT = 8  # similar earlier names that a name holds at a time

MERGE_GRADE, REVIEW_GRADE = "merge", "review"
_RANK = (F.desc, "n"), (F.desc, "length"), (F.asc, "value")


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """(value, n, length, low) of the different non-empty values; counted before the shuffle."""
    text = F.col(f"`{field}`").cast("string")
    return (
        df.filter(text != "").select(strip_ws(text).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        .withColumns({"length": F.length("value"), "low": F.lower("value")}))


def _blocks(names: DataFrame, threshold: int, least: int) -> DataFrame:
    """Add ``block``, blocks of about equal size in order of length, and the blocks in reach of it, ``lo`` to ``hi``."""
    per_length = names.groupBy(F.length("low").alias("letters")).count()  # one row per different length
    shorter = Window.orderBy("letters").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_length.withColumn("start", F.coalesce(F.sum("count").over(shorter), F.lit(0)))
    size = max(least, min(MOST_BLOCK, -(-names.count() // BLOCKS)))
    inside = F.pmod(F.xxhash64("value"), F.col("count"))
    placed = stored(names.withColumn("letters", F.length("low")).join(starts, "letters").withColumn(
        "block", F.floor((F.col("start") + inside) / size)).drop("start", "count"), "name-blocks")
    # Names further apart in length than by this factor cannot reach the threshold.
    low = max(threshold - 0.5, 0.0) / 100.0
    factor = low / (2.0 - low)
    # One row per block of a thousand names or more comes to the driver.
    ends = placed.groupBy("block").agg(F.min("letters").alias("least"), F.max("letters").alias("most")).collect()
    near = []
    for one in ends:
        reached = [o["block"] for o in ends if o["least"] * factor <= one["most"] and one["least"] * factor <= o["most"]]
        near.append((one["block"], min(reached), max(reached)))
    reach = names.sparkSession.createDataFrame(near, "block long, lo long, hi long")
    return placed.drop("letters").join(F.broadcast(reach), "block")


def first_before(seeds: DataFrame, targets: DataFrame, threshold: int, keep: int) -> DataFrame:
    """(rank, other, similarity): for every target the first ``keep`` similar seeds with after < other < rank.

    Both have rank, low, block, lo, hi; targets have ``after`` too. A task gets one block of either side.
    """
    reach = F.explode(F.sequence("lo", "hi"))
    s = seeds.select("rank", "low", F.col("block").alias("of_seeds"), reach.alias("of_targets"))
    t = targets.select(F.col("rank").alias("target"), F.col("low").alias("text"), "after", reach.alias("of_seeds"),
                       F.col("block").alias("of_targets"))
    hits = s.groupBy("of_seeds", "of_targets").cogroup(t.groupBy("of_seeds", "of_targets")).applyInPandas(
        similar_before(threshold, keep), "rank long, other long, similarity long")
    order = Window.partitionBy("rank").orderBy("other")
    return hits.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= keep).drop("_place")


def _settled(lists: DataFrame, states: DataFrame) -> DataFrame:
    """One step for every open name: (rank, leader, similarity, after); leader null while the name stays open.

    ``after`` is set where every similar name known so far has joined another one, but there may be more.
    """
    known = states.select(F.col("rank").alias("other"), F.col("leader").alias("others_leader"))
    listed = lists.join(states, "rank", "left_anti").select("rank", "more", F.explode_outer("hits").alias("hit")).select(
        "rank", "more", F.col("hit.other").alias("other"), "hit.similarity").join(known, "other", "left")
    leads = F.col("others_leader") == F.col("other")
    free = F.col("other").isNotNull() & (F.col("others_leader").isNull() | leads)
    best = F.min(F.when(free, F.struct("other", "similarity", F.coalesce(leads, F.lit(False)).alias("leads"))))
    seen = listed.groupBy("rank").agg(best.alias("best"), F.max("other").alias("last"), F.bool_or("more").alias("more"))
    alone = F.col("best").isNull() & ~F.col("more")
    return seen.select(
        "rank", F.when(alone, F.col("rank")).when(F.col("best.leads"), F.col("best.other")).alias("leader"),
        F.when(alone, F.lit(100)).when(F.col("best.leads"), F.col("best.similarity")).cast("long").alias("similarity"),
        F.when(F.col("best").isNull() & F.col("more"), F.col("last")).alias("after"))


def _in_rounds(left: DataFrame, threshold: int, least: int, keep: int) -> DataFrame:
    """Clusters of names of which none is similar to an earlier leader: as :func:`cluster`."""
    names = _blocks(ranked(left, "rank", *(direction(column) for direction, column in _RANK)), threshold, least)

    def lists(targets: DataFrame, seeds: DataFrame) -> DataFrame:
        found = first_before(seeds, targets, threshold, keep).groupBy("rank").agg(
            F.sort_array(F.collect_list(F.struct("other", "similarity"))).alias("hits"))  # at most ``keep``
        return targets.select("rank").join(found, "rank", "left").select(
            "rank", "hits", (F.coalesce(F.size("hits"), F.lit(0)) >= keep).alias("more"))

    waiting = stored(lists(names.withColumn("after", F.lit(-1).cast("long")), names), "similar-before")
    states = left.sparkSession.createDataFrame([], "rank long, leader long, similarity long")
    while True:
        step = stored(_settled(waiting, states), "independent-set")
        n, decided, asking = step.agg(F.count("*"), F.count("leader"), F.count("after")).first()
        if decided:
            states = states.union(step.filter("leader is not null").drop("after"))
        elif asking:
            targets = names.join(step.filter("after is not null").select("rank", "after"), "rank")
            seeds = names.join(states.filter("leader <> rank"), "rank", "left_anti")
            waiting = stored(waiting.join(states, "rank", "left_anti").join(targets, "rank", "left_anti").union(
                lists(targets, seeds)), "similar-before")
        if n == decided:
            break
    leaders = names.select(F.col("rank").alias("leader_rank"), F.col("value").alias("leader"))
    return names.join(states.withColumnRenamed("leader", "leader_rank"), "rank").join(leaders, "leader_rank").select(
        "value", "n", "length", "low", "leader", "similarity")


def cluster(values: DataFrame, threshold: int = REVIEW, first_block: int = FIRST_BLOCK, least_block: int = LEAST_BLOCK,
            keep: int = KEPT) -> DataFrame:
    """Cluster of every value: (value, n, length, low, leader, similarity to the leader).

    ``values`` is what :func:`value_counts` gives. It is checkpointed first, as it is read more than once.
    """
    left, order = cut(values), [direction(name) for direction, name in _RANK]
    schema = "value string, n bigint, length int, low string, leader string, similarity bigint"
    found = []
    while True:
        # At most ``first_block`` rows reach the driver, found by a distributed top-k.
        block = [(r["value"], r["low"]) for r in left.orderBy(*order).limit(first_block).collect()]
        if not block:
            break
        matched = left.mapInPandas(assign_to_block(block, threshold), schema)
        if len(block) < first_block:
            found.append(matched)  # the block held every name, so all of them have a leader
            break
        matched = stored(matched, "first-leaders")
        found.append(matched.filter("leader is not null"))
        left = matched.filter("leader is null").drop("leader", "similarity")
        before, after = matched.agg(F.count("*"), F.count_if(F.col("leader").isNull())).first()
        if after and before - after < PASS_YIELD * before:
            found.append(_in_rounds(left, threshold, least_block, keep))
            break
    return reduce(DataFrame.unionByName, found) if found else values.sparkSession.createDataFrame([], schema)


def groups(clusters: DataFrame, field: str, auto: int = AUTO_MERGE, review: int = REVIEW) -> DataFrame:
    """One row per cluster of two or more values.

    The weakest member decides the grade: one below ``auto`` sends the whole
    cluster to review. The canonical value is the largest by (count, length,
    lower-case text).
    """
    strength = F.struct("n", "length", "low", "value")
    weakest = F.min(F.when(F.col("value") != F.col("leader"), F.col("similarity")))
    out = clusters.groupBy("leader").agg(
        F.count("*").alias("size"), F.sum("n").alias("records"),
        F.max(strength)["value"].alias("canonical"), weakest.alias("similarity"))
    grade = F.when(F.col("similarity") >= auto, MERGE_GRADE).when(F.col("similarity") >= review, REVIEW_GRADE)
    return out.filter("size > 1").select(
        F.lit(field).alias("field"), F.left(F.sha2(F.concat(F.lit(field + "|"), "leader"), 256), F.lit(16)).alias("group_id"),
        "leader", "canonical", "size", "records", "similarity", grade.alias("grade"))


def members(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Long form: every value of every group, with its rank order columns."""
    return clusters.select("leader", "value", "n", "length", F.col("similarity").alias("to_leader")).join(
        found, "leader")


def merge_mapping(group_members: DataFrame) -> DataFrame:
    """(value, canonical) for the variants of groups graded to merge."""
    return group_members.filter((F.col("grade") == MERGE_GRADE) & (F.col("value") != F.col("canonical"))).select(
        "value", "canonical")


def apply_mapping(df: DataFrame, mapping: DataFrame, field: str) -> DataFrame:
    """Replace stripped values by their canonical form and log it; the row count does not change.

    The mapping is stored first, so Spark knows its size when it plans the join: below the broadcast
    threshold it is broadcast and no record moves, a larger one is shuffled, where adaptive execution
    splits the partitions of very common values.
    """
    text = F.col(f"`{field}`").cast("string")
    keyed = df.withColumn("_key", strip_ws(text))
    pairs = stored(mapping.select(F.col("value").alias("_key"), F.col("canonical").alias("_canonical")), "mapping")
    out = keyed.join(pairs, "_key", "left")
    columns = {field: F.coalesce(F.col("_canonical"), F.col(f"`{field}`"))}
    if LOG in df.columns:
        note = F.when(F.col("_canonical").isNotNull(), F.concat(
            F.lit(f"DEDUP: {field}: '"), F.col("_key"), F.lit("' -> '"), F.col("_canonical"), F.lit("'")))
        columns[LOG] = F.concat(F.col(LOG), F.array_compact(F.array(note)))
    return out.withColumns(columns).select(*[F.col(f"`{c}`") for c in df.columns])


class Deduped(NamedTuple):
    """Records with merged names, the clusters found, and the members of each cluster."""

    records: DataFrame
    groups: DataFrame
    members: DataFrame


def dedupe(df: DataFrame, fields: Sequence[str] = words.DEDUPE_FIELDS, auto: int = AUTO_MERGE,
           review: int = REVIEW) -> Deduped:
    """De-duplicate fields one after the other. Only names are compared; records take part in one join per field."""
    all_groups, all_members = [], []
    for field in fields:
        if field not in df.columns:
            continue
        clusters = cluster(value_counts(df, field), review)
        found = groups(clusters, field, auto, review)
        listed = members(clusters, found)
        df = apply_mapping(df, merge_mapping(listed), field)
        all_groups.append(found)
        all_members.append(listed)
    if not all_groups:
        raise ValueError(f"None of the fields {list(fields)} is in the table")
    return Deduped(df, reduce(DataFrame.union, all_groups), reduce(DataFrame.union, all_members))


def dedupe_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "grade").agg(F.count("*").alias("groups"))


# --- review ----------------------------------------------------------------


def review_table(found: DataFrame) -> DataFrame:
    """Groups waiting for a decision; similarity as a fraction."""
    return found.filter(F.col("grade") == REVIEW_GRADE).select(
        "group_id", "field", "canonical", "size", "records",
        F.round(F.col("similarity") / 100, 2).alias("similarity"), F.lit("pending").alias("status"))


def review_summary(review: DataFrame) -> DataFrame:
    return review.agg(F.count("*").alias("total_groups"),
                      F.count_if(F.col("status") == "pending").alias("pending_groups"))


def decide(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set decisions by group: ``decisions`` has group_id, status (approved/rejected), canonical (or null)."""
    made = decisions.select("group_id", F.col("status").alias("_status"), F.col("canonical").alias("_canonical"))
    override = F.when(F.col("_status") == "approved", F.col("_canonical"))
    return review.join(made, "group_id", "left").withColumns({
        "canonical": F.coalesce(override, F.col("canonical")),
        "status": F.coalesce(F.col("_status"), F.col("status")),
    }).select(*review.columns)


def approve_above(review: DataFrame, threshold: float = 0.9) -> DataFrame:
    passes = (F.col("status") == "pending") & (F.col("similarity") >= threshold)
    return review.withColumn("status", F.when(passes, "approved").otherwise(F.col("status")))


def apply_review(df: DataFrame, review: DataFrame, group_members: DataFrame) -> DataFrame:
    """Merge the names of approved groups into the (possibly overridden) canonical value."""
    approved = review.filter(F.col("status") == "approved").select("group_id", "canonical", "field")
    pairs = group_members.select("group_id", "value").join(approved, "group_id").filter(
        F.col("value") != F.col("canonical"))
    for field in [r["field"] for r in approved.select("field").distinct().collect()]:
        df = apply_mapping(df, pairs.filter(F.col("field") == field), field)
    return df


def review_entries(group_members: DataFrame) -> DataFrame:
    """Rows of the review file, one per name: field, group, place in the group (canonical first), name, similarity, action.

    One form for groups of any size; the names of a group are ordered by a sort and never collected.
    """
    waiting = group_members.filter(F.col("grade") == REVIEW_GRADE)
    order = Window.partitionBy("field", "group_id").orderBy(
        (F.col("value") != F.col("canonical")), F.desc("n"), F.desc("length"), "value")
    return waiting.select(
        F.col("field").alias("campo"), F.col("canonical").alias("grupo"), F.row_number().over(order).alias("posicion"),
        F.col("value").alias("nombre"), F.round(F.col("similarity") / 100, 2).alias("similitud"),
        F.lit("pendiente").alias("accion"))
