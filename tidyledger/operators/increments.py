"""Analytics kept up to date from changes alone.

A change is rows that came and rows that went. Everything that :func:`.analytics.aggregate` reports follows from
states that can be added and taken back: counts and sums per segment, counts per index value, and, for every statistics
field, count, sum and squares around a fixed pivot, a histogram over fixed edges, and how often each value occurs. Sums
and squares are kept as decimals, and as doubles what those do not hold: what goes then leaves nothing behind. States
of several changes are rows of one table and are merged by adding, in any order.

Minimum, maximum and median have no such state. The histogram says in which bucket each lies, and only the values of
those buckets are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal, localcontext
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.operators.analytics import STATISTICS, _entries, _numbers, _text, exact_parts
from tidyledger.operators.selection import Range, weighted_medians
from tidyledger.sources.scratch import stored

STATE = ("kind string, field string, key string, measure string, bucket int, value double, n long, total double, "
         "squares double, exact_total decimal(38,4), exact_squares decimal(38,8)")
EDGES = 127  # of the histogram of a field
INDEX, SEGMENT, FIELD, HISTOGRAM, VALUE = "index", "segment", "field", "histogram", "value"


class Shape(NamedTuple):
    """What stays fixed from the first change on: the fields, and per statistics field a pivot and the histogram's edges."""

    pivots: dict[str, float]
    edges: dict[str, list[float]]
    index_fields: list[str]
    segments: list[str]


def shape_of(rows: DataFrame, index_fields: Sequence[str] = words.INDEX_FIELDS, fields: Sequence[str] = words.MONEY_FIELDS,
             segments: Sequence[str] = words.SEGMENT_FIELDS) -> Shape:
    """Fix the shape by the first rows. Later rows may differ: results stay exact, only more values are read for a median."""
    fields = [f for f in fields if f in rows.columns]
    shares = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    row = _numbers(rows, fields).agg(F.count("*"), *[x for f in fields for x in (
        F.avg(f).alias(f"mean_{f}"), F.percentile_approx(f, shares).alias(f"edges_{f}"))]).first()
    # Pivots have the places of the exact sums, so differences to them are exact too.
    return Shape({f: round(float(row[f"mean_{f}"] or 0.0), 4) for f in fields}, {f: sorted(set(row[f"edges_{f}"] or [])) for f in fields},
                 [f for f in index_fields if f in rows.columns], [s for s in segments if s in rows.columns])


def changes(came: DataFrame, went: DataFrame, shape: Shape) -> DataFrame:
    """State of one change. Only the rows that came and went are read; they are stored once in between."""
    fields = list(shape.pivots)
    wanted = {*fields, *shape.index_fields, *shape.segments}

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c in wanted], F.lit(sign).cast("long").alias("_sign"))

    both = stored(signed(came, 1).unionByName(signed(went, -1), allowMissingColumns=True), "change")
    n = F.sum("_sign").alias("n")
    sign = F.col("_sign").cast("decimal(1,0)")
    pieces = []
    if shape.index_fields:
        pieces.append(_entries(both, shape.index_fields, "_sign").groupBy("field", "key").agg(n).withColumn("kind", F.lit(INDEX)))
    if shape.segments:
        measures = [F.struct(F.lit(None).cast("string").alias("measure"), F.lit(0.0).alias("amount"))] + [
            F.struct(F.lit(f).alias("measure"), F.col(f).cast("double").alias("amount")) for f in fields]
        parts = F.array(*[F.struct(F.lit(s).alias("field"), F.coalesce(_text(both, s), F.lit("N/A")).alias("key"))
                          for s in shape.segments])
        exact, rest = exact_parts(F.col("m.amount"))
        pieces.append(both.select("_sign", F.explode(parts).alias("part"), F.array(*measures).alias("measures"))
                      .select("_sign", "part.*", F.explode("measures").alias("m")).filter("m.amount is not null")
                      .groupBy("field", "key", "m.measure").agg(
                          n, F.sum(F.col("_sign") * rest).alias("total"), F.sum(sign * exact).cast("decimal(38,4)").alias("exact_total"))
                      .withColumn("kind", F.lit(SEGMENT)))
    if fields:
        numbers = _numbers(both, fields, "_sign")
        amounts = numbers.unpivot(["_sign"], fields, "field", "value").filter("value is not null")
        values = amounts.groupBy("field", "value").agg(n)
        bucket, pivot = F.lit(None).cast("int"), F.lit(0.0)
        for f in fields:
            edges = F.array(*map(F.lit, shape.edges[f])).cast("array<double>")
            bucket = F.when(F.col("field") == f, F.size(F.filter(edges, lambda e: e <= F.col("value")))).otherwise(bucket)
            pivot = F.when(F.col("field") == f, F.lit(shape.pivots[f])).otherwise(pivot)
        # A value is exact + rest, its distance from the pivot off + rest_off.
        exact, rest = exact_parts(F.col("value"))
        pivot_exact, pivot_rest = exact_parts(pivot)
        off, rest_off = (exact - pivot_exact).cast("decimal(15,4)"), rest - pivot_rest
        values = stored(values.filter("n <> 0").withColumns({"bucket": bucket, "kind": F.lit(VALUE)}), "changed-values")
        pieces += [values, values.groupBy("field", "bucket").agg(F.sum("n").alias("n")).withColumn("kind", F.lit(HISTOGRAM)),
                   amounts.groupBy("field").agg(
                       n, F.sum(F.col("_sign") * rest).alias("total"), F.sum(sign * exact).cast("decimal(38,4)").alias("exact_total"),
                       F.sum(F.col("_sign") * (2 * off.cast("double") * rest_off + rest_off ** 2)).alias("squares"),
                       F.sum(sign * (off * off)).cast("decimal(38,8)").alias("exact_squares")).withColumn("kind", F.lit(FIELD))]
    state = came.sparkSession.createDataFrame([], STATE)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces, state)


def merged(states: DataFrame) -> DataFrame:
    """One state out of many; what came and went is gone from it."""
    return states.groupBy("kind", "field", "key", "measure", "bucket", "value").agg(
        *(F.sum(c).alias(c) for c in ("n", "total", "squares")),
        F.sum("exact_total").cast("decimal(38,4)").alias("exact_total"),
        F.sum("exact_squares").cast("decimal(38,8)").alias("exact_squares")).filter("n <> 0")


def _total() -> Column:
    """The sum that a merged state stands for; states of older versions have no exact part."""
    return F.coalesce(F.col("exact_total").cast("double"), F.lit(0.0)) + F.coalesce("total", F.lit(0.0))


def value_counts(states: DataFrame) -> DataFrame:
    """As :func:`.analytics.value_index`."""
    return merged(states.filter(F.col("kind") == INDEX)).select("field", "key", F.col("n").alias("count"))


def segments(states: DataFrame, shape: Shape) -> DataFrame:
    """As :func:`.analytics.segmented_statistics`."""
    counted = merged(states.filter(F.col("kind") == SEGMENT))
    sums = [x for f in shape.pivots for mine in [F.col("measure") == f] for x in (
        F.max(F.when(mine, _total())).alias(f"{f}_sum"), F.max(F.when(mine, _total() / F.col("n"))).alias(f"{f}_mean"))]
    return counted.groupBy(F.col("field").alias("segment_field"), F.col("key").alias("segment")).agg(
        F.max(F.when(F.col("measure").isNull(), F.col("n"))).alias("count"), *sums)


def _moments(r: Row, pivot: float) -> tuple[float, float]:
    """Sum of a field, and sum of the squared distances from its mean; no digit is lost between large squares."""
    with localcontext() as context:
        context.prec = 100
        total, squares = (exact + Decimal(rest or 0.0) if rest is None or math.isfinite(rest) else Decimal("NaN")
                          for exact, rest in ((r["exact_total"] or Decimal(0), r["total"]), (r["exact_squares"] or Decimal(0), r["squares"])))
        around = squares - (total - r["n"] * Decimal(repr(pivot))) ** 2 / r["n"]
    return (float(total) if total.is_finite() else r["total"]), float(around)


def statistics(states: DataFrame, shape: Shape) -> DataFrame:
    """As :func:`.analytics.field_statistics`."""
    spark = states.sparkSession
    # One row per field and at most one per edge come to the driver.
    totals = {r["field"]: r for r in merged(states.filter(F.col("kind") == FIELD)).collect()}
    counts: dict[str, list[tuple[int, int]]] = {f: [] for f in totals}
    for r in merged(states.filter(F.col("kind") == HISTOGRAM)).select("field", "bucket", "n").collect():
        counts[r["field"]].append((r["bucket"], r["n"]))
    wanted, middle = [], {}
    for f, rows in counts.items():
        before, n = 0, totals[f]["n"]
        ordered = sorted(rows)
        wanted += [(f, ordered[0][0]), (f, ordered[-1][0])]
        middle[f] = []
        for bucket, size in ordered:
            middle[f] += [(bucket, before) for rank in ((n + 1) // 2, (n + 2) // 2) if before < rank <= before + size]
            before += size
        wanted += [(f, bucket) for bucket, _ in middle[f]]
    if not wanted:
        return spark.createDataFrame([], STATISTICS)
    mine = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("bucket") == b) for f, b in sorted(set(wanted))])
    values = stored(merged(states.filter((F.col("kind") == VALUE) & mine)).select("field", "bucket", "value", "n"), "middle-values")
    ends = {(r["field"], r["bucket"]): (r["least"], r["most"]) for r in values.groupBy("field", "bucket").agg(
        F.min("value").alias("least"), F.max("value").alias("most")).collect()}
    medians, sought = {}, {}
    for f, ((low, before), (high, _)) in middle.items():
        if low != high:
            medians[f] = (ends[f, low][1] + ends[f, high][0]) / 2
        elif ends[f, low][0] == ends[f, low][1]:
            medians[f] = ends[f, low][0]
        else:
            sought[f] = totals[f]["n"], Range(*ends[f, low], before)
    medians |= weighted_medians(values, sought)
    out = []
    for f, r in totals.items():
        n, total, around = r["n"], *_moments(r, shape.pivots[f])
        buckets = [b for b, _ in counts[f]]
        out.append((f, n, total, total / n, medians[f], ends[f, min(buckets)][0], ends[f, max(buckets)][1],
                    (max(around, 0.0) / (n - 1)) ** 0.5 if n > 1 else 0.0))
    return spark.createDataFrame(out, STATISTICS)
