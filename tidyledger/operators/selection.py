"""Exact medians of very many numbers by distributed selection.

The range that holds the middle is cut into buckets, and one map-side aggregate counts every bucket and finds its
smallest and largest value. The bucket with the middle becomes the next range, until its values are all equal. Buckets
are ordered like the values, so ranks are known without sorting or ranking anything; a pass sends the driver at most
``BUCKETS`` rows per field. Ranges over many magnitudes are cut by logarithm, so a few passes reach any double.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 16_384
_WIDE = 4.0  # ranges that span a larger factor are cut by logarithm


class Range(NamedTuple):
    """Smallest and largest value of a range, and how many values lie before it."""

    low: float
    high: float
    before: int


def bucket_of(value: Column, low: float, high: float, buckets: int = BUCKETS) -> Column:
    """Bucket of a value in ``low..high`` (low < high): larger values never have smaller buckets, and the ends differ."""
    if not (math.isfinite(low) and math.isfinite(high)) or low <= 0 <= high:
        finite = F.when(value < 0, 1).when(value == 0, 2).otherwise(3)
        return F.when(value == float("-inf"), 0).when(value == float("inf"), 4).otherwise(finite)
    if max(abs(low), abs(high)) > _WIDE * min(abs(low), abs(high)):
        start, end, at = math.log(abs(low)), math.log(abs(high)), F.log(F.abs(value))
    else:
        start, end, at = low, high, value
    share = (at - F.lit(start)) / F.lit(end - start)
    return F.greatest(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")


def _narrowed(rows: list[tuple[int, float, float]], before: int, lower: int, upper: int) -> Range | float:
    """The bucket that holds the ranks ``lower`` and ``upper`` (from 1), or the mean of their values."""
    values = []
    for n, least, most in rows:
        for rank in (lower, upper)[len(values):]:
            if rank <= before + n:
                values.append((least, most, before))
        if len(values) == 2:
            break
        before += n
    (least, most, start), (upper_least, _, upper_start) = values
    if start != upper_start:  # neighbours in two buckets: the last of one and the first of the next
        return (most + upper_least) / 2
    return least if least == most else Range(least, most, start)


def medians(numbers: DataFrame, facts: dict[str, tuple[int, float, float]], buckets: int = BUCKETS) -> dict[str, float]:
    """Exact median of every column, nulls left out; ``facts`` has the count, minimum and maximum of columns with values."""
    known = {f: low for f, (_, low, high) in facts.items() if low == high}
    sought = {f: (n, Range(low, high, 0)) for f, (n, low, high) in facts.items() if f not in known}
    if sought:
        rows = numbers.select(*sought).unpivot([], list(sought), "field", "value").withColumn("n", F.lit(1).cast("long"))
        known |= weighted_medians(rows, sought, buckets)
    return known


def weighted_medians(rows: DataFrame, sought: dict[str, tuple[int, Range]], buckets: int = BUCKETS) -> dict[str, float]:
    """Medians of (field, value, n), each value counted n times, for fields given by their count and the range of the middle."""
    found: dict[str, float] = {}
    ranges = {f: r for f, (_, r) in sought.items()}
    while ranges:
        value, bucket, inside = F.col("value"), F.lit(None).cast("int"), F.lit(False)
        for f, r in ranges.items():
            mine = F.col("field") == f
            inside = inside | (mine & value.between(r.low, r.high))
            bucket = F.when(mine, bucket_of(value, r.low, r.high, buckets)).otherwise(bucket)
        counted = rows.filter(inside).groupBy("field", bucket.alias("bucket")).agg(
            F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        of_field: dict[str, list] = {f: [] for f in ranges}
        for row in counted.collect():
            of_field[row["field"]].append((row["bucket"], row["n"], row["least"], row["most"]))
        for f, r in list(ranges.items()):
            n = sought[f][0]
            step = _narrowed([x[1:] for x in sorted(of_field[f])], r.before, (n + 1) // 2, (n + 2) // 2)
            if isinstance(step, Range):
                ranges[f] = step
            else:
                found[f] = step
                del ranges[f]
    return found
