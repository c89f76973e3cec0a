"""Registered queries: sources and sinks, over files written from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidyledger.operators import analytics as A, dedupe as D
from tidyledger.plans.ledger import TEXT_COLUMNS, dirty_invoices, invoices, table
from tidyledger.schema import INVOICE_SPEC
from tidyledger.sources import files, store
from tidyledger.sources.scratch import new_path


def _write_csv(df: DataFrame, label: str, encoding: str = "UTF-8", header: bool = True) -> str:
    path = new_path(df.sparkSession, label)
    df.write.csv(path, header=header, encoding=encoding, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)
    return path


def _dirty_csv(spark, sf_dir) -> str:
    rows = dirty_invoices(spark, sf_dir)
    # A leading key column keeps rows apart that have an empty invoice number.
    return _write_csv(rows.select(F.col("_row_number").alias("clave"), *TEXT_COLUMNS), "dirty")


def read_bronze(spark, sf_dir):
    """Every text cell back from CSV, blanks and quotes included."""
    raw = files.read_bronze(spark, _dirty_csv(spark, sf_dir))
    return raw.select(F.col("clave").cast("long"), *TEXT_COLUMNS)


def bronze_row_numbers(spark, sf_dir):
    """Numbers run from 2 without a gap in every file, in file order, over many files and splits.

    The orders of each file ascend, so a row's number follows from the keys of its file.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("file"))
    path = new_path(spark, "orders")
    # The file comes first, so that the writer does not sort by it once more and lose the order of the keys.
    ordered = orders.repartition("file").sortWithinPartitions("file", "o_orderkey")
    ordered.select("o_orderkey", F.lit("x").alias("filler"), "file").write.partitionBy("file").csv(path, header=True)
    raw = files.read_bronze(spark, f"{path}/*/*.csv")
    return raw.select(F.col("o_orderkey").cast("long"), F.col("_row_number").cast("long").alias("row_number"))


def csv_structure(spark, sf_dir):
    """Orders as hand-made CSV lines: some short, some with surplus cells, some blank."""
    k = F.col("o_orderkey")
    line = (F.when(k % 100 == 99, "").when(k % 50 == 48, F.concat_ws(",", k, "o_custkey"))
            .when(k % 50 == 47, F.concat_ws(",", k, "o_custkey", "o_orderstatus", F.lit("x")))
            .when(k % 50 == 46, F.concat_ws(",", k, F.concat(F.lit('"'), "o_custkey", F.lit('\n,"')), "o_orderstatus"))
            .otherwise(F.concat_ws(",", k, F.concat(F.lit('"'), "o_custkey", F.lit(',"')), "o_orderstatus")))
    path = new_path(spark, "lines")
    body = table(spark, sf_dir, "orders").select(line.alias("value"), (k + 1).alias("at"))
    head = spark.range(1).select(F.lit("clave,cliente, clave").alias("value"), F.lit(0).cast("long").alias("at"))
    # Several files, each with the header in front; every key goes to one of them.
    shares = F.explode(F.array(*[F.lit(i).cast("long") for i in range(5)]))
    dealt = body.withColumn("file", F.col("at") % 5).unionByName(head.withColumn("file", shares))
    dealt.repartition("file").sortWithinPartitions("file", "at").select("value", "file").write.partitionBy("file").text(path)
    report = files.check_csv_structure(spark, f"{path}/*/*.txt")
    return report.select(F.regexp_extract("path", "file=([0-9]+)", 1).alias("file"), "is_valid", "row_count", F.col("column_count").cast("long"),
                         F.array_join("column_names", "|").alias("column_names"),
                         F.array_join("duplicate_names", "|").alias("duplicate_names"), "ragged_rows")


def encodings(spark, sf_dir):
    """Documents in one folder of files of three encodings, ingested: every text comes back, each file as it was written."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", "[^\\x20-\\x7e¡-ÿ]", " ").alias("text"))
    path = new_path(spark, "mixed")
    plain = F.regexp_replace("text", "[^\\x20-\\x7e]", " ")
    for i, (charset, text) in enumerate((("UTF-8", F.col("text")), ("ISO-8859-1", F.col("text")), ("US-ASCII", plain))):
        some = docs.filter(F.col("doc_id") % 3 == i).select(F.concat(text, F.lit("" if i == 2 else " ñ")).alias("text"), "doc_id")
        # The order of the columns differs from file to file.
        some.select(*(("doc_id", "text") if i == 1 else ("text", "doc_id"))).write.csv(
            f"{path}/{i}", header=True, encoding=charset, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False)
    manifest = store.ingest(spark, f"{path}/*/*.csv", new_path(spark, "bronze"))
    rows = store.read_ingested(spark, manifest)
    found = manifest.select(F.explode("files").alias("f")).select(F.col("f.path").alias("_file"), F.col("f.encoding"))
    # One row per file.
    return rows.join(F.broadcast(found), "_file").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "encoding")


def infer_schema(spark, sf_dir):
    df = dirty_invoices(spark, sf_dir).withColumns({
        "cliente": F.col("_row_number").cast("string"), "activo": F.when(F.col("_row_number") % 2 == 0, "sí").otherwise("no"),
        "dia": F.lit("2024-01-15T10:00"), "vacio": F.lit(" ")})
    return files.infer_schema(df).select(F.col("column").alias("name"), "type")


def ingest_manifest(spark, sf_dir):
    """The stored rows with what the manifest says of them."""
    manifest = store.ingest(spark, _dirty_csv(spark, sf_dir), new_path(spark, "bronze"))
    facts = manifest.select("encoding", "row_count", F.size("column_names").cast("long").alias("columns"), "ragged_rows").first()
    return store.read_ingested(spark, manifest).select(
        F.col("clave").cast("long").alias("clave"), "num_factura", "importe_total",
        *[F.lit(v).alias(n) for n, v in facts.asDict().items()])


def _clean_round_trip(spark, sf_dir, fmt: str) -> DataFrame:
    path = new_path(spark, "clean")
    store.write_clean(invoices(spark, sf_dir), path, INVOICE_SPEC, fmt, keep=("_row_number",))
    return store.read_clean(spark, path, INVOICE_SPEC, fmt, na_words=fmt == "csv", keep="_row_number bigint")


def clean_sink_parquet(spark, sf_dir):
    return _clean_round_trip(spark, sf_dir, "parquet")


def clean_sink_csv(spark, sf_dir):
    return _clean_round_trip(spark, sf_dir, "csv")


def gold_sink(spark, sf_dir):
    """Analytics tables written, loaded again, and looked at."""
    path = new_path(spark, "gold")
    store.write_gold(A.aggregate(invoices(spark, sf_dir)), path)
    gold = store.load_gold(spark, path)
    none = F.lit(None).cast("string")
    return reduce(DataFrame.unionAll, [
        gold.records.select(F.lit("record").alias("name"), F.col("num_factura").alias("field"), F.col("categoria").alias("key"),
                            F.lit(1).cast("long").alias("n"), F.col("importe_total").alias("amount")),
        gold.statistics.select(F.lit("statistic"), "field", none, "count", "max"),
        gold.indexes.select(F.lit("index"), "field", "key", "count", F.lit(None).cast("double")),
        gold.segments.select(F.lit("segment"), "segment_field", "segment", "count", F.round("importe_total_sum", 2))])


def preview(spark, sf_dir):
    return files.preview(invoices(spark, sf_dir).select("_row_number", "num_factura", "proveedor", "tipo"))


def review_sink(spark, sf_dir):
    clusters = D.cluster(D.value_counts(table(spark, sf_dir, "part"), "p_name"))
    entries = D.review_entries(D.members(clusters, D.groups(clusters, "p_name", auto=101)))
    path = new_path(spark, "review")
    store.write_review(entries, path)
    back = spark.read.schema(entries.schema).json(path)
    return back.withColumn("posicion", F.col("posicion").cast("long"))


def list_runs(spark, sf_dir):
    """Event days as runs: the last event of a day is its state."""
    events = table(spark, sf_dir, "events")
    runs = events.select(
        F.date_format("ts", "yyyyMMdd").alias("run_id"), F.concat(F.lit("user_"), "user_id").alias("file_name"),
        F.col("event_type").alias("status"), F.col("event_id").alias("record_count"), F.col("ts").alias("created_at"))
    return store.list_runs(runs).drop("created_at")


QUERIES = {f.__name__: f for f in (
    read_bronze, bronze_row_numbers, csv_structure, encodings, infer_schema, ingest_manifest, clean_sink_parquet,
    clean_sink_csv, gold_sink, preview, review_sink, list_runs)}
