"""Registered queries: the pipeline end to end, its hooks, and updates from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyledger.operators.analytics import segmented_long
from tidyledger.plans import pipeline as P
from tidyledger.plans.ledger import dirty_invoices, invoices
from tidyledger.plans.queries_sources import _dirty_csv
from tidyledger.sources.scratch import new_path, stored
from tidyledger.streaming.incremental import gold_snapshot, snapshot, upsert_stream


def pipeline_segments(spark, sf_dir):
    """Raw CSV to segment statistics."""
    result = P.run_pipeline(spark, _dirty_csv(spark, sf_dir), dedupe_fields=("categoria",))
    return result.gold.segments.select("segment_field", "segment", "count", F.round("importe_total_sum", 2).alias("total"))


def pipeline_report(spark, sf_dir):
    result = P.run_layers(dirty_invoices(spark, sf_dir), dedupe_fields=("categoria",))
    return result.report.select(
        F.col("bronze.row_count"), F.col("silver.total_records"), F.col("silver.valid_records"),
        F.col("silver.invalid_records"), "silver.corrected_records", "silver.review_records",
        F.round("silver.valid_rate", 6).alias("valid_rate"), "silver.merged_groups", "silver.review_groups",
        F.col("gold.record_count"), F.array_join("bronze.column_names", ",").alias("column_names"),
        F.array_join("gold.statistics_fields", ",").alias("statistics_fields"),
        F.array_join("gold.index_fields", ",").alias("index_fields"))


def pipeline_merged(spark, sf_dir):
    """Both merges, as by default: long supplier names of which every third row has lost the last letter."""
    raw = dirty_invoices(spark, sf_dir)
    name = F.regexp_replace("proveedor", r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    long = F.concat_ws(" ", name, name, name)
    cut = F.when(F.col("_row_number") % 3 == 0, F.left(long, F.length(long) - 1)).otherwise(long)
    result = P.run_layers(raw.withColumn("proveedor", F.when(name == "", "").otherwise(cut)))
    graded = result.report.select(F.struct("silver.merged_groups", "silver.review_groups")).scalar()
    return result.gold.segments.filter("segment_field = 'proveedor'").withColumn("graded", graded).select(
        "segment", "count", F.round("importe_total_sum", 2).alias("total"), "graded.merged_groups", "graded.review_groups")


def pipeline_hooks(spark, sf_dir):
    """A hook that narrows the input and one that logs totals that do not add up."""
    hooks = P.Hooks()
    hooks.register("silver", "pre", lambda df: df.filter(F.lower(F.trim("categoria")) == "machinery"), "narrow")
    hooks.register("silver", "post", P.totals_match())
    result = P.run_layers(dirty_invoices(spark, sf_dir), hooks=hooks, dedupe_fields=())
    warned = F.exists("_cleaning_log", lambda line: line.contains("is not importe_total"))
    return result.silver.validated.groupBy(F.col("_status").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(warned).alias("warned"))


def stream_upsert(spark, sf_dir):
    """All invoices, then every unpaid one again as paid, as two streams over many files; the rows they leave."""
    rows = invoices(spark, sf_dir).select("num_factura", "_row_number", "estado_factura")
    source = new_path(spark, "stream")
    path = new_path(spark, "versions")
    paid = rows.filter(F.col("estado_factura") != "Pagada").withColumn("estado_factura", F.lit("Pagada"))
    for some, label in ((rows, "first"), (paid, "second")):
        some.repartition(4).write.parquet(f"{source}/{label}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{source}/{label}")
        # The second stream has a checkpoint of its own, as one that lost the first one's.
        upsert_stream(stream, path, new_path(spark, "progress"), parts=8).awaitTermination()
    return snapshot(spark, path).select("num_factura", "_row_number", "estado_factura")


def stream_gold(spark, sf_dir):
    """Statistics, index and segments after both streams, from the states of their batches alone."""
    rows = invoices(spark, sf_dir).select(
        "num_factura", "_row_number", "estado_factura", "categoria", "importe_total", "importe_pendiente")
    rows = stored(rows, "invoices")
    paid = rows.filter(F.col("estado_factura") != "Pagada").withColumns(
        {"estado_factura": F.lit("Pagada"), "importe_pendiente": F.lit(0.0)})
    source, path = new_path(spark, "stream"), new_path(spark, "versions")
    for some, label in ((rows, "first"), (paid, "second")):
        # In row groups of 8 MB, as a row group is the least that a task can read of a file.
        some.repartition(4).write.option("parquet.block.size", 8 << 20).parquet(f"{source}/{label}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{source}/{label}")
        upsert_stream(stream, path, new_path(spark, "progress"), analytics=True).awaitTermination()
    gold = gold_snapshot(spark, path)
    figures = [f for f in gold.statistics.columns if f != "field"]
    doubles = gold.statistics.select("field", *[F.col(f).cast("double").alias(f) for f in figures])
    line = lambda section: F.lit(section).alias("section")
    return (doubles.unpivot(["field"], figures, "metric", "value").select(
                line("statistics"), F.col("field").alias("item"), "metric", F.round("value", 2).alias("value"))
            .unionByName(gold.indexes.select(line("index"), F.col("field").alias("item"), F.col("key").alias("metric"),
                                             F.col("count").cast("double").alias("value")))
            .unionByName(segmented_long(gold.segments).select(
                line("segments"), F.concat_ws("=", "segment_field", "segment").alias("item"), "metric",
                F.round("value", 2).alias("value"))))


QUERIES = {f.__name__: f for f in (pipeline_segments, pipeline_report, pipeline_merged, pipeline_hooks, stream_upsert, stream_gold)}
