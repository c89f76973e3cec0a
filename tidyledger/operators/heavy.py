"""The most frequent values of a column with any number of different ones, without shuffling them all.

Each task keeps a summary of bounded size, the summaries are added up, and together they bound how
often any value can occur. Only values that can be among the first k are then counted exactly. If the bound
does not tell, all values are counted, so the result is exact in either case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyledger.functions.frequent import summaries
from tidyledger.sources.scratch import stored

CAPACITY = 4096  # keys that a task keeps; what occurs in more than one row of so many is always found


def _first(counts: DataFrame, k: int) -> DataFrame:
    # Each task cuts its rows to k before they meet.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.col("key").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("key", "count", "rank")


def heavy_hitters_checked(df: DataFrame, value: Column | str, k: int, capacity: int = CAPACITY) -> tuple[DataFrame, bool]:
    """:func:`heavy_hitters`, and whether the summaries were enough."""
    if k < 1 or capacity < 1:
        raise ValueError("k and the capacity must be positive")
    keys = df.select((F.col(value) if isinstance(value, str) else value).cast("string").alias("key"))
    found = stored(keys.mapInPandas(summaries(capacity), "key string, low long, lost long").groupBy("key").agg(
        F.sum("low").alias("low"), F.sum("lost").alias("lost")), "summaries")
    lost = found.agg(F.sum("lost").alias("n")).first()["n"] or 0
    seen = found.filter("low > 0").select("key", "low")
    if not lost:
        return _first(seen.withColumnRenamed("low", "count"), k), True
    best = [r["low"] for r in seen.orderBy(F.desc("low")).limit(k).select("low").collect()]
    # At least k values occur best[-1] times or more; one that no summary kept occurs at most ``lost`` times.
    if len(best) < k or best[-1] <= lost:
        return _first(keys.groupBy("key").agg(F.count("*").alias("count")), k), False
    able = seen.filter(F.col("low") + lost >= best[-1]).select(F.col("key").alias("able"))
    counted = keys.join(able, F.col("key").eqNullSafe(F.col("able")), "left_semi").groupBy("key").agg(F.count("*").alias("count"))
    return _first(counted, k), True


def heavy_hitters(df: DataFrame, value: Column | str, k: int, capacity: int = CAPACITY) -> DataFrame:
    """(key, count, rank) of the k most frequent values as text; ties in key order, the missing value last.

    A missing value counts as a value. Fewer values than k are all listed; no rows give no rows.
    """
    return heavy_hitters_checked(df, value, k, capacity)[0]
