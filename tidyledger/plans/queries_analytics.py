"""Registered queries: statistics, segments, indexes, summaries, updates and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidyledger.operators import analytics as A, bitmaps, clean as C, updates as U, validate as V
from tidyledger.operators.heavy import heavy_hitters
from tidyledger.plans.ledger import dirty_invoices, invoices, table
from tidyledger.plans.queries_cleaning import stored_by_status
from tidyledger.schema import INVOICE_SPEC
from tidyledger.sources.scratch import new_path

LINE_FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _rounded(df, digits=3, *skip):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double" and f.name not in skip]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def field_statistics(spark, sf_dir):
    return _rounded(A.field_statistics(table(spark, sf_dir, "lineitem"), LINE_FIELDS))


def field_statistics_bracketed(spark, sf_dir):
    """The path for fields too large for one buffer: median by ranking inside a bracket."""
    return _rounded(A.field_statistics(table(spark, sf_dir, "lineitem"), LINE_FIELDS))


def segmented_statistics(spark, sf_dir):
    return A.segmented_statistics(invoices(spark, sf_dir), scale=3)


def segmented_long(spark, sf_dir):
    return _rounded(A.segmented_long(A.segmented_statistics(
        table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice"))))


def value_index(spark, sf_dir):
    return A.value_index(invoices(spark, sf_dir))


def value_index_rows(spark, sf_dir):
    rows = A.value_index_rows(invoices(spark, sf_dir), ("categoria", "tipo", "fecha"), chunk_rows=4096)
    return rows.withColumn("row_indices", F.array_join(F.col("row_indices").cast("array<string>"), ","))


def unique_values(spark, sf_dir):
    return A.unique_values(A.value_index(invoices(spark, sf_dir)))


def lookup(spark, sf_dir):
    found = A.lookup(invoices(spark, sf_dir), "categoria", "Machinery")
    return found.select("_row_number", "num_factura", "importe_total")


def top_k(spark, sf_dir):
    return A.top_k(A.value_index(invoices(spark, sf_dir)), 5)


def bitmap_index(spark, sf_dir):
    index = bitmaps.bitmap_index(invoices(spark, sf_dir), ("categoria", "tipo", "fecha"))
    return index.groupBy("field", "key").agg(F.sum("count").alias("count"))


def bitmap_lookup(spark, sf_dir):
    """Rows by values of three fields, answered on the stored index."""
    index = bitmaps.write_bitmaps(bitmaps.bitmap_index(invoices(spark, sf_dir)), new_path(spark, "bitmaps"))
    found = bitmaps.lookup_rows(index, [[("categoria", "Machinery"), ("categoria", "Furniture")], [("tipo", "Ingreso")],
                                        [("estado_factura", "Pagada"), ("estado_factura", "Pendiente")]])
    return found.withColumnRenamed("row", "_row_number")


def heavy_words(spark, sf_dir):
    """The 20 most frequent words of all texts, from summaries and an exact count of what can be among them."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return heavy_hitters(words, "word", 20)


def heavy_orders(spark, sf_dir):
    """The 10 orders with most lines. All are about as long, so the summaries cannot tell and all are counted."""
    return heavy_hitters(table(spark, sf_dir, "lineitem"), "l_orderkey", 10, capacity=256)


def summary(spark, sf_dir):
    return _rounded(A.summary(A.aggregate(invoices(spark, sf_dir))))


def dashboard_metrics(spark, sf_dir):
    return _rounded(A.dashboard_metrics(invoices(spark, sf_dir)))


def dataset_balance(spark, sf_dir):
    return _rounded(A.balance(invoices(spark, sf_dir)))


def category_counts(spark, sf_dir):
    return A.category_counts(invoices(spark, sf_dir))


def _batches(spark, sf_dir):
    """All invoices as the existing table; every unpaid one again as paid, with a new number for some."""
    existing = invoices(spark, sf_dir)
    unpaid = existing.filter(F.col("estado_factura") != "Pagada")
    number = F.when(F.col("categoria") == "Machinery", F.concat("num_factura", F.lit("-R"))).otherwise(
        F.col("num_factura"))
    new = unpaid.withColumns({"num_factura": number, "estado_factura": F.lit("Pagada"),
                              "importe_pendiente": F.lit(0.0), "origen": F.lit("lote")})
    return existing, new


def upsert(spark, sf_dir):
    existing, new = _batches(spark, sf_dir)
    return U.upsert(existing, new).select(
        "num_factura", "_row_number", "estado_factura", "importe_pendiente", "origen")


def update_counts(spark, sf_dir):
    existing, new = _batches(spark, sf_dir)
    return U.update_counts(existing, U.upsert(existing, new))


def keep_last(spark, sf_dir):
    """Latest order of every customer."""
    orders = table(spark, sf_dir, "orders")
    return U.keep_last(orders, "o_custkey", "o_orderdate", "o_orderkey").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))


def _compared(spark, sf_dir):
    raw = dirty_invoices(spark, sf_dir)
    cleaned = stored_by_status(V.clean_and_validate(raw, INVOICE_SPEC))
    return U.compare_within(V.split(cleaned).clean, INVOICE_SPEC.names)


def compare_layers(spark, sf_dir):
    return _compared(spark, sf_dir).select(
        "_row_number", "modified",
        F.array_join("modified_fields", ",").alias("modified_fields"))


def filter_compare(spark, sf_dir):
    return U.filter_compare(_compared(spark, sf_dir), only_modified=True, search="MACHINERY").select("_row_number")


QUERIES = {f.__name__: f for f in (
    field_statistics, field_statistics_bracketed, segmented_statistics, segmented_long, value_index,
    value_index_rows, unique_values, lookup, top_k, bitmap_index, bitmap_lookup, heavy_words, heavy_orders,
    summary, dashboard_metrics, dataset_balance, category_counts,
    upsert, update_counts, keep_last, compare_layers, filter_compare)}
