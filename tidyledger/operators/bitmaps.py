"""Value index with row ids as sets per id range, and lookups by several values on the index alone.

Row ids are cut into ranges of 32,768; per value and range there is one set, a list
of two-byte positions while it is short and a bitmap beyond, so no entry is longer than 4 KB however common
a value is. Sets of a range meet in one task, where conditions are joined by and/or.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.functions.rowsets import DENSE, RANGE_BITS, SPAN, bitmap, matching_rows
from tidyledger.operators.analytics import _entries
from tidyledger.operators.clean import row_key

Condition = tuple[str, "str | None"]


def bitmap_index(df: DataFrame, fields: Sequence[str] = words.INDEX_FIELDS, row: str | None = None) -> DataFrame:
    """(field, key, id_range, count, positions, bits) of every value, missing ones included.

    Either ``positions`` or ``bits`` is set. Rows without an id are left out, rows that repeat an id count once.
    """
    row = row or row_key(df)
    at = F.col(row).cast("long")
    place = at.bitwiseAND(F.lit(SPAN - 1)).cast("smallint")
    # At most 32,768 positions can be in a group, and equal ones are dropped before the shuffle.
    sets = _entries(df.filter(F.col(row).isNotNull()), fields, row).groupBy(
        "field", "key", F.shiftright(at, RANGE_BITS).alias("id_range")).agg(F.sort_array(F.collect_set(place)).alias("all"))
    dense = F.size("all") > DENSE
    pack = F.pandas_udf(bitmap, "binary")
    return sets.select(
        "field", "key", "id_range", F.size("all").cast("long").alias("count"), F.when(~dense, F.col("all")).alias("positions"),
        pack(F.when(dense, F.col("all"))).alias("bits"))


def write_bitmaps(index: DataFrame, path: str) -> DataFrame:
    """Store an index by field and in key order, so a lookup reads only the parts that can hold its values."""
    index.repartitionByRange("field", "key", "id_range").sortWithinPartitions("field", "key", "id_range").write.partitionBy("field").parquet(path)
    return read_bitmaps(index.sparkSession, path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, id_range long, count long, positions array<smallint>, bits binary, field string").parquet(path)


def asked_entries(index: DataFrame, clauses: Sequence[Sequence[Condition]]) -> DataFrame:
    """The entries of the index that a lookup reads."""
    wanted = sorted({tuple(c) for clause in clauses for c in clause}, key=repr)
    if not wanted:
        raise ValueError("A lookup needs a condition")
    return index.filter(reduce(lambda a, b: a | b, [
        (F.col("field") == field) & (F.col("key").isNull() if key is None else F.col("key") == key) for field, key in wanted]))


def lookup_rows(index: DataFrame, clauses: Sequence[Sequence[Condition]]) -> DataFrame:
    """(row): ids of the rows that meet at least one condition (field, value) of every clause; null asks for missing values.

    The records are not read. A clause without a condition is met by no row.
    """
    found = asked_entries(index, clauses).select("field", "key", "id_range", "positions", "bits")
    return found.groupBy("id_range").applyInPandas(matching_rows([[tuple(c) for c in clause] for clause in clauses]), "row long")
