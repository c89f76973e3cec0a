"""Incremental updates and raw-versus-clean comparison."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyledger.functions.cleaning import strip_ws
from tidyledger.operators.analytics import Gold, aggregate
from tidyledger.operators.clean import RAW, ROW, ROW_ID, row_key
from tidyledger.sources.scratch import stored


def keep_last(df: DataFrame, key: str | Sequence[str], *order: str) -> DataFrame:
    """Last row per key in ascending ``order``; rows without a key count as one key.

    The rank filter becomes a limit of one row per key and task before the
    shuffle, so a key with very many versions does not pile up in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    last = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") == 1).drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, key: str = "num_factura", row: str = ROW) -> DataFrame:
    """Existing and new rows with the last row per key; new rows win, then later rows of a file.

    Rows of several files that stand at the same place are told apart by their
    number over all files, so the winner does not change from run to run. Columns may differ;
    missing ones are filled with null.
    """
    order = [row, ROW_ID] if row_key(existing, new) == ROW_ID else [row]
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, "_batch", *order).drop("_batch")


class Updated(NamedTuple):
    rows: DataFrame
    gold: Gold
    counts: DataFrame


def update(existing: DataFrame, new: DataFrame, key: str = "num_factura") -> Updated:
    """A whole incremental update: the rows after the upsert, stored once, their analytics, and the counters."""
    rows = stored(upsert(existing, new, key), "updated")
    return Updated(rows, aggregate(rows), update_counts(existing, rows))


def update_counts(existing: DataFrame, updated: DataFrame) -> DataFrame:
    """previous, current and added record counts (added may be negative)."""
    tagged = existing.select(F.lit(0).alias("side")).unionAll(updated.select(F.lit(1).alias("side")))
    return tagged.agg(
        F.count_if(F.col("side") == 0).alias("previous_record_count"),
        F.count_if(F.col("side") == 1).alias("record_count"),
    ).withColumn("new_records_added", F.col("record_count") - F.col("previous_record_count"))


def _plain(c: Column) -> Column:
    return strip_ws(F.coalesce(c.cast("string"), F.lit("")))


def _marked(both: DataFrame, raw_fields: Sequence[str], clean_fields: Sequence[str]) -> DataFrame:
    changed = [
        F.when(_plain(F.col(f"raw.`{c}`")) != _plain(F.col(f"clean.`{c}`")), F.lit(c))
        for c in raw_fields if c in clean_fields]
    known = F.col("raw").isNotNull() & F.col("clean").isNotNull()
    fields = F.when(known, F.array_compact(F.array(*changed))).otherwise(F.array().cast("array<string>"))
    return both.withColumn("modified_fields", fields).withColumn("modified", F.size("modified_fields") > 0)


def compare_within(validated: DataFrame, fields: Sequence[str], on: str | None = None) -> DataFrame:
    """:func:`compare` for rows that still carry their raw text: a projection, no join."""
    on = on or row_key(validated)
    raw_fields = validated.schema[RAW].dataType.names
    both = validated.select(on, F.col(RAW).alias("raw"), F.struct(*[F.col(f"`{f}`") for f in fields]).alias("clean"))
    return _marked(both, raw_fields, list(fields))


def compare(raw: DataFrame, clean: DataFrame, on: str | None = None, how: str = "inner") -> DataFrame:
    """Pair raw and clean rows by their number over all files, or else by row number, and list the fields that differ.

    ``how="full"`` keeps rows that only one side has (rejected records), with an
    empty list. Result: row number, ``raw`` and ``clean`` structs, ``modified``,
    ``modified_fields``.
    """
    on = on or row_key(raw, clean)
    raw_fields = [c for c in raw.columns if not c.startswith("_")]
    clean_fields = [c for c in clean.columns if not c.startswith("_")]
    left = raw.select(on, F.struct(*[F.col(f"`{c}`") for c in raw_fields]).alias("raw"))
    right = clean.select(on, F.struct(*[F.col(f"`{c}`") for c in clean_fields]).alias("clean"))
    return _marked(left.join(right, on, how), raw_fields, clean_fields)


def compare_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("total_rows"), F.count_if("modified").alias("modified_rows"))


def filter_compare(compared: DataFrame, only_modified: bool = False, search: str = "") -> DataFrame:
    """Rows to show: modified ones only, or those with a text in any raw or clean value (case ignored)."""
    if only_modified:
        compared = compared.filter("modified")
    if search:
        values = [F.col(f"{side}.`{f}`").cast("string") for side in ("raw", "clean")
                  for f in compared.schema[side].dataType.names]
        hit = F.lit(False)
        for v in values:
            hit = hit | F.coalesce(F.lower(v).contains(search.lower()), F.lit(False))
        compared = compared.filter(hit)
    return compared
