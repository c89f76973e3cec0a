"""Where a name ends up after several rounds of review: merges as a forest.

Every decision points a name to its canonical one. A canonical name can be merged itself in a
later round, so the names form trees, and a name's final form is the root of its tree. Roots
are found by doubling: each round lets every name point to where its target points, so the rounds
grow with the logarithm of the depth. Only names are read, never records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidyledger.operators.dedupe import apply_mapping
from tidyledger.sources.scratch import stored

KEYS = ("field", "value")


def decision_log(review: DataFrame, group_members: DataFrame, number: int) -> DataFrame:
    """Approved merges of one round of review: (field, value, canonical, round)."""
    approved = review.filter(F.col("status") == "approved").select("group_id", "canonical")
    return group_members.select("group_id", "field", "value").join(approved, "group_id").filter(
        F.col("value") != F.col("canonical")).select("field", "value", "canonical", F.lit(number).alias("round"))


def parents(log: DataFrame) -> DataFrame:
    """The merge of each name that holds: its last one, ties to the smaller canonical name.

    Null names and merges of a name into itself say nothing.
    """
    last = Window.partitionBy(*KEYS).orderBy(F.desc("round"), "canonical")
    return log.select(*KEYS, "canonical", F.col("round").cast("long").alias("round")).filter(
        "value <> canonical and field is not null and round is not null").withColumn("_n", F.row_number().over(last)).filter(
        "_n = 1").drop("_n")


def _doubled(state: DataFrame) -> DataFrame:
    """Every name points to where its target points; ``oldest`` is the least merge on the way."""
    target = state.select(
        "field", F.col("value").alias("to"), F.col("to").alias("_to"), F.col("oldest").alias("_oldest"), F.col("steps").alias("_steps"))
    joined = state.join(target, ["field", "to"], "left")
    # Roots have no merge of their own, so a name that many names were merged into meets no row here.
    return joined.select(
        *KEYS, F.coalesce("_to", "to").alias("to"), F.least("oldest", F.coalesce("_oldest", "oldest")).alias("oldest"),
        (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_to").isNotNull().alias("open"))


def _followed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Each name with its root, and how many names lead into a circle instead."""
    state = edges.select(*KEYS, F.col("canonical").alias("to"), F.struct("round", "value").alias("oldest"),
                         F.lit(1).cast("long").alias("steps"))
    left = None
    while True:
        state = stored(_doubled(state), "lineage")
        now = state.filter("open").count()
        # While a tree is not settled, each doubling settles some of its names.
        if now in (0, left):
            break
        left = now
    if now:
        for _ in range(now.bit_length()):  # then a way is longer than any circle and ends in one
            state = stored(_doubled(state), "lineage")
    return state, now


def lineage(log: DataFrame) -> DataFrame:
    """(field, value, canonical, steps): the final form of every name that was merged, however deep.

    ``log`` has field, value, canonical and round: the decisions of all rounds, in any order. The last
    merge of a name holds; repeated decisions count once. Merges that lead in a circle end with its oldest
    one being dropped (ties: the smaller name), so a later merge back gives the older form again.
    No decisions give no rows. Other columns are not read.
    """
    edges = stored(parents(log), "merges")
    state, circling = _followed(edges)
    if circling:
        # A target that is open lies on a circle, and its oldest merge is the circle's.
        ends = state.filter("open").select("field", F.col("to").alias("value")).distinct()
        dropped = state.join(ends, list(KEYS)).select("field", F.col("oldest.value").alias("value")).distinct()
        state, _ = _followed(stored(edges.join(dropped, list(KEYS), "left_anti"), "merges"))
    return state.select(*KEYS, F.col("to").alias("canonical"), "steps")


def apply_lineage(df: DataFrame, found: DataFrame) -> DataFrame:
    """Give the records the final forms of their names, and log it."""
    for field in sorted(r["field"] for r in found.select("field").distinct().collect()):
        if field in df.columns:
            df = apply_mapping(df, found.filter(F.col("field") == field), field)
    return df
