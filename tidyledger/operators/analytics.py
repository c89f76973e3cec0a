"""Analytics over clean records: statistics, segments, value indexes and summaries.

Everything is a grouped aggregate with map-side partials, so a value that holds
a large share of the rows is reduced before the shuffle. Results that would
collect a whole group (row lists of one value, all values of a field) come in
long form or in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.operators.clean import row_key
from tidyledger.operators.selection import medians

CHUNK_ROWS = 65_536


def _numbers(df: DataFrame, fields: Sequence[str], *keep: str) -> DataFrame:
    """The fields as numbers; text that is none becomes null."""
    types = df.schema
    return df.select(*keep, *[
        F.nanvl(F.col(f"`{f}`").try_cast("double") if types[f].dataType.typeName() == "string"
                else F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f) for f in fields])


EXACT = "decimal(14,4)"


def exact_parts(value: Column) -> tuple[Column, Column]:
    """A double as a decimal with four places and the rest of it, a double: zero for every usual amount of money.

    Decimals add up exactly, so such sums do not depend on the order of addition. Numbers of ten billion and more,
    and those that are not finite, are all rest.
    """
    part = F.coalesce(value.try_cast(EXACT), F.lit(0).cast(EXACT))
    return part, value - part.cast("double")


def exact_sum(value: Column) -> Column:
    """Sum of doubles, exact where they have up to four places; null without any."""
    part, rest = exact_parts(value)
    return F.sum(F.when(value.isNotNull(), part)).cast("double") + F.sum(rest)


STATISTICS = "field string, count long, sum double, mean double, median double, min double, max double, std double"


def field_statistics(df: DataFrame, fields: Sequence[str] = words.MONEY_FIELDS) -> DataFrame:
    """One row per field: count, sum, mean, exact median, min, max, sample standard deviation.

    Text that is no number is ignored; fields without any number are left out. Amounts add up exactly.
    All fields are aggregated in one pass, in columns; medians take a few passes more (:mod:`.selection`).
    """
    present = [f for f in fields if f in df.columns]
    numbers = _numbers(df, present)
    if not present:
        return df.sparkSession.createDataFrame([], STATISTICS)
    parts = {"count": F.count, "sum": exact_sum, "min": F.min, "max": F.max,
             "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))}
    row = numbers.agg(*[make(F.col(f)).alias(f"{name}_{f}") for f in present for name, make in parts.items()]).first()
    known = {f: {name: row[f"{name}_{f}"] for name in parts} for f in present if row[f"count_{f}"]}
    middle = medians(numbers, {f: (k["count"], k["min"], k["max"]) for f, k in known.items()})
    rows = [(f, k["count"], k["sum"], k["sum"] / k["count"], middle[f], k["min"], k["max"], k["std"]) for f, k in known.items()]
    return df.sparkSession.createDataFrame(rows, STATISTICS)


def _text(df: DataFrame, field: str) -> Column:
    return F.col(f"`{field}`").cast("string")


def segmented_statistics(
    df: DataFrame, segments: Sequence[str] = words.SEGMENT_FIELDS, fields: Sequence[str] = words.MONEY_FIELDS,
    scale: int | None = None,
) -> DataFrame:
    """Row count, sums and means per value of each segment field, in one pass over the data.

    Missing segment values count as the segment "N/A". With ``scale`` the amounts
    are added as decimals with that many places, so the sums do not depend on the
    order in which tasks finish.
    """
    segments = [s for s in segments if s in df.columns]
    fields = [f for f in fields if f in df.columns]
    keyed = df.select(*[_text(df, s).alias(s) for s in segments],
                      *[F.col(f).cast("double").alias(f"_n_{f}") for f in fields])


    def total(f: str) -> Column:
        amount = F.col(f"_n_{f}")
        return F.sum(amount if scale is None else amount.cast(f"decimal(18,{scale})")).cast("double")

    sums = [a for f in fields for a in (
        total(f).alias(f"{f}_sum"),
        F.try_divide(total(f), F.count(f"_n_{f}")).alias(f"{f}_mean"))]
    grouped = keyed.groupingSets([[F.col(s)] for s in segments], *[F.col(s) for s in segments]).agg(
        *[F.grouping(s).alias(f"_g_{s}") for s in segments], F.count("*").alias("count"), *sums)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in segments:
        name = F.when(F.col(f"_g_{s}") == 0, F.lit(s)).otherwise(name)
        value = F.when(F.col(f"_g_{s}") == 0, F.coalesce(F.col(s), F.lit("N/A"))).otherwise(value)
    return grouped.select(name.alias("segment_field"), value.alias("segment"), "count",
                          *[c for f in fields for c in (f"{f}_sum", f"{f}_mean")])


def segmented_long(segments: DataFrame) -> DataFrame:
    """(segment_field, segment, metric, value); metrics without any number are left out."""
    metrics = segments.columns[2:]
    typed = segments.select("segment_field", "segment", *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(["segment_field", "segment"], metrics, "metric", "value").filter("value is not null")


def _entries(df: DataFrame, fields: Sequence[str], *keep: str) -> DataFrame:
    """(field, key, …): the value of each index field as text; dates as YYYY-MM-DD."""
    present = [f for f in fields if f in df.columns]
    cols = [F.left(_text(df, f), F.lit(10)).alias(f)
            if df.schema[f].dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else _text(df, f).alias(f)
            for f in present]
    return df.select(*keep, *cols).unpivot(list(keep), present, "field", "key")


def value_index(df: DataFrame, fields: Sequence[str] = words.INDEX_FIELDS) -> DataFrame:
    """(field, key, count) of every value, missing ones included."""
    return _entries(df, fields).groupBy("field", "key").agg(F.count("*").alias("count"))


def value_index_rows(
    df: DataFrame, fields: Sequence[str] = words.INDEX_FIELDS, row: str | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Row ids of every value: (field, key, chunk, count, row_indices).

    Chunk ``c`` holds the ids from ``c * chunk_rows`` on, so no list gets longer
    than ``chunk_rows`` however common a value is; ids ascend over the chunks.
    """
    row = row or row_key(df)
    chunk = F.floor(F.col(row) / chunk_rows).alias("chunk")
    return _entries(df, fields, row).groupBy("field", "key", chunk).agg(
        F.count("*").alias("count"), F.sort_array(F.collect_list(row)).alias("row_indices"))


def unique_values(index: DataFrame) -> DataFrame:
    """Number of different values per field; a missing value is one of them."""
    return index.groupBy("field").agg(F.count("*").alias("unique_values"))


def approx_unique_values(df: DataFrame, fields: Sequence[str] = words.INDEX_FIELDS, rsd: float = 0.02) -> DataFrame:
    """Estimate of :func:`unique_values` from one pass without grouping by value."""
    return _entries(df, fields).groupBy("field").agg(
        (F.approx_count_distinct("key", rsd) + F.max(F.col("key").isNull().cast("long"))).alias("unique_values"))


def top_k(index: DataFrame, k: int) -> DataFrame:
    """The k most frequent keys per field; ties in key order, missing keys last.

    Catalyst turns the rank filter into a limit per group before the shuffle,
    so only k rows per field and task travel.
    """
    order = Window.partitionBy("field").orderBy(F.col("count").desc(), F.col("key").asc_nulls_last())
    return index.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lookup(df: DataFrame, field: str, value: Any) -> DataFrame:
    """Rows with a value; a plain filter, so it reaches the Parquet scan."""
    return df.filter(F.col(field).isNull() if value is None else F.col(field) == F.lit(value))


class Gold(NamedTuple):
    """Records with their statistics, value index and segment statistics."""

    records: DataFrame
    statistics: DataFrame
    indexes: DataFrame
    segments: DataFrame


def aggregate(df: DataFrame, index_fields: Sequence[str] = words.INDEX_FIELDS,
              fields: Sequence[str] = words.MONEY_FIELDS, segments: Sequence[str] = words.SEGMENT_FIELDS) -> Gold:
    return Gold(df, field_statistics(df, fields), value_index(df, index_fields),
                segmented_statistics(df, segments, fields))


def _line(section: Column | str, item: Column | str, metric: Column | str, value: Column) -> list[Column]:
    as_col = [F.lit(x) if isinstance(x, str) else x for x in (section, item, metric)]
    return [as_col[0].alias("section"), as_col[1].alias("item"), as_col[2].alias("metric"),
            value.cast("double").alias("value")]


def summary(gold: Gold, k: int = 5) -> DataFrame:
    """(section, item, metric, value): record count, mean/sum/min/max, unique values, top k keys per field."""
    stats = gold.statistics.select("field", "mean", "sum", "min", "max").unpivot(
        ["field"], ["mean", "sum", "min", "max"], "metric", "value")
    pieces = [
        gold.records.agg(F.count("*").alias("n")).select(*_line("records", "all", "count", F.col("n"))),
        stats.select(*_line("statistics", F.col("field"), F.col("metric"), F.col("value"))),
        unique_values(gold.indexes).select(
            *_line("unique_values", F.col("field"), "count", F.col("unique_values"))),
        top_k(gold.indexes, k).select(*_line(
            F.concat(F.lit("top:"), F.col("field")), F.col("key"), F.col("rank").cast("string"), F.col("count"))),
    ]
    return reduce(DataFrame.unionByName, pieces)


def dashboard_metrics(df: DataFrame, k: int = 10, label_length: int = 20) -> DataFrame:
    """(metric, label, value) of the overview page."""
    index = value_index(df, ("categoria", "proveedor", "estado_factura"))
    short = F.when(F.length("key") > label_length, F.concat(F.left("key", F.lit(label_length)), F.lit("...")))
    best = top_k(index.filter(F.col("field") != "estado_factura"), k)
    total = F.col("importe_total")
    # One pass gives the row count, both sums and the total-amount figures.
    figures = df.agg(
        F.count("*").cast("double").alias("Total Registros|all"),
        F.sum(F.when(F.col("tipo") == "Ingreso", total)).alias("Ingresos vs Gastos|Ingresos"),
        F.sum(F.when(F.col("tipo") == "Gasto", total)).alias("Ingresos vs Gastos|Gastos"),
        F.sum(total).alias("Importe Total|sum"), F.avg(total).alias("Importe Total|mean"),
        F.min(total).alias("Importe Total|min"), F.max(total).alias("Importe Total|max"))
    flat = figures.unpivot([], figures.columns, "name", "value").select(
        F.split_part("name", F.lit("|"), F.lit(1)).alias("metric"),
        F.split_part("name", F.lit("|"), F.lit(2)).alias("label"), F.coalesce("value", F.lit(0.0)).alias("value"))

    def out(rows: DataFrame, metric: str, label: Column) -> DataFrame:
        return rows.select(F.lit(metric).alias("metric"), label.alias("label"), F.col("count").cast("double").alias("value"))

    return (
        flat
        .unionByName(out(best.filter(F.col("field") == "categoria"), "Distribución por Categoría", F.col("key")))
        .unionByName(out(best.filter(F.col("field") == "proveedor"), "Top 10 Proveedores",
                         F.coalesce(short, F.col("key"))))
        .unionByName(out(index.filter(F.col("field") == "estado_factura"), "Estado de Facturas",
                         F.coalesce("key", F.lit("N/A")))))


def balance(df: DataFrame) -> DataFrame:
    """One row: income and expense counts and totals, and their difference."""
    def side(kind: str, name: str) -> list[Column]:
        mine = F.col("tipo") == kind
        return [F.count_if(mine).alias(f"{name}_count"),
                F.coalesce(exact_sum(F.when(mine, F.col("importe_total").cast("double"))), F.lit(0.0)).alias(f"{name}_total")]

    out = df.agg(F.count("*").alias("records"), *side("Ingreso", "income"), *side("Gasto", "expense"))
    return out.withColumn("net", F.col("income_total") - F.col("expense_total"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("categoria", F.lit("Unknown")).alias("categoria")).agg(F.count("*").alias("count"))
