"""Registered queries: similarity of names, clusters, merging and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidyledger.functions.similarity import indel_ratio
from tidyledger.operators import dedupe as D
from tidyledger.operators.lineage import lineage
from tidyledger.plans.ledger import invoices, table
from tidyledger.sources.scratch import stored


def name_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    other = F.concat_ws(" ", F.reverse("p_name"), "p_type")
    return part.select(
        "p_partkey", indel_ratio(F.col("p_name"), F.upper(F.col("p_type"))).alias("to_type"),
        indel_ratio(F.col("p_name"), other).alias("to_other"))


def _names(spark, sf_dir) -> DataFrame:
    return D.value_counts(table(spark, sf_dir, "part"), "p_name")


def similar_names(spark, sf_dir):
    """Every name with the first-ranked leader it is similar to."""
    return D.cluster(_names(spark, sf_dir)).select("value", "n", "leader", "similarity")


def similar_names_small_blocks(spark, sf_dir):
    """The same through small blocks and lists of one name, so that names look for the next similar one again and again."""
    return D.cluster(_names(spark, sf_dir), first_block=4, least_block=16, keep=1).select("value", "n", "leader", "similarity")


def dense_names(spark, sf_dir):
    """Numbered names that all resemble each other: a few leaders take in everything."""
    clusters = D.cluster(D.value_counts(table(spark, sf_dir, "supplier"), "s_name"))
    return clusters.groupBy("leader").agg(F.count("*").alias("size"), F.min("similarity").alias("weakest"))


def name_groups(spark, sf_dir):
    return D.groups(D.cluster(_names(spark, sf_dir)), "p_name").select(
        "leader", "canonical", "size", "records", "similarity", "grade")


def _long_names(spark, sf_dir) -> DataFrame:
    """Invoices whose supplier is a long name that loses its last letter on every third row."""
    rows = invoices(spark, sf_dir)
    name = F.concat_ws(" ", "proveedor", "proveedor", "proveedor")
    typo = F.when(F.col("_row_number") % 3 == 0, F.left(name, F.length(name) - 1))
    return rows.select("_row_number", F.coalesce(typo, name).alias("proveedor"), "categoria", "importe_total")


def dedupe_records(spark, sf_dir):
    """Fuzzy merge of supplier and category; row count stays, values change."""
    result = D.dedupe(_long_names(spark, sf_dir))
    return result.records.groupBy("proveedor", "categoria").agg(
        F.count("*").alias("n"), F.round(F.sum("importe_total"), 2).alias("total"))


def dedupe_stats(spark, sf_dir):
    return D.dedupe_stats(D.dedupe(_long_names(spark, sf_dir)).groups)


def _review(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    clusters = D.cluster(_names(spark, sf_dir))
    found = D.groups(clusters, "p_name", auto=99)
    return D.review_table(found), D.members(clusters, found)


def review_summary(spark, sf_dir):
    return D.review_summary(_review(spark, sf_dir)[0])


def review_decisions(spark, sf_dir):
    review, _ = _review(spark, sf_dir)
    made = review.select(
        "group_id", F.when(F.col("size") > 3, "rejected").otherwise("approved").alias("status"),
        F.upper("canonical").alias("canonical"))
    return D.decide(review, made).select("canonical", "similarity", "status")


def review_approve_above(spark, sf_dir):
    review, _ = _review(spark, sf_dir)
    return D.approve_above(review, 0.8).select("canonical", "similarity", "status")


def review_replay(spark, sf_dir):
    """Approved groups applied to the records."""
    review, listed = _review(spark, sf_dir)
    approved = D.approve_above(stored(review, "review"), 0.0)
    merged = D.apply_review(table(spark, sf_dir, "part"), approved, listed)
    return merged.groupBy("p_name").agg(F.count("*").alias("n"))


def review_lineage(spark, sf_dir):
    """Three rounds of merged customer names: into the one before in the segment, into the nation's first, into the region's."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    by_segment = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    numbered = stored(customers.select(
        "c_custkey", "c_name", "c_nationkey", "n_regionkey", F.lag("c_name").over(by_segment).alias("before")), "customers")
    first = lambda key, name: numbered.groupBy(key).agg(
        F.min_by("c_name", "c_custkey").alias(name), F.min("c_custkey").alias(f"{name}_key"))
    placed = numbered.join(first("c_nationkey", "of_nation"), "c_nationkey").join(first("n_regionkey", "of_region"), "n_regionkey")
    rounds = ((1, "before", F.lit(True)), (2, "of_nation", F.col("before").isNull() | (F.col("c_custkey") % 7 == 0)),
              (3, "of_region", F.col("c_custkey") == F.col("of_nation_key")))
    log = reduce(DataFrame.unionByName, [
        placed.filter(chosen).select(F.lit("c_name").alias("field"), F.col("c_name").alias("value"),
                                     F.col(target).alias("canonical"), F.lit(n).alias("round")) for n, target, chosen in rounds])
    return lineage(log).select("value", "canonical", "steps")


QUERIES = {f.__name__: f for f in (
    name_similarity, similar_names, similar_names_small_blocks, dense_names, name_groups, dedupe_records,
    dedupe_stats, review_summary, review_decisions, review_approve_above, review_replay,
    review_lineage)}
