"""Exact nearest neighbours that pass over what the triangle inequality rules out.

Documents lie in cells: the nearest of a few pivots, and a ring of distances to it. A
cell's smallest and largest distance bound from below how near its documents can
be to a query, so a query asks the cells in the order of these bounds and stops at the first one
that is farther than its k-th document so far. The cells asked grow fourfold from
round to round, so the rounds are few, and the k-th distance travels with the query.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidyledger.functions.vectors import cells_to_ask, nearest_in_share, nearest_pivot
from tidyledger.sources.scratch import stored

# Most query vectors and documents that meet in one task, and how many pieces smaller sizes may make of either side.
QUERY_BLOCK = 1024
SHARE_ROWS = 16_384
BLOCKS = 16
SHARES = 64
# At most so many cells (4,096) whatever the size: their bounds come to the driver and go to every task.
PIVOTS = 64
RINGS = 64


def grown(least: int, rows: int, pieces: int, most: int) -> int:
    """Size of a piece: ``least``, or more where the rows would make more than ``pieces`` of them, up to ``most``."""
    return max(least, min(most, -(-rows // pieces)))


class Cells(NamedTuple):
    """``docs`` with their _cell, and of each cell: its number, pivot, smallest and largest distance, documents."""

    docs: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray


def divide(docs: DataFrame, id_column: str, share_rows: int, pivots: int = PIVOTS, rings: int = RINGS) -> Cells:
    """Cells of about ``share_rows`` documents; larger ones beyond ``SHARES`` of them, or beyond ``pivots * rings`` cells
    of ``SHARE_ROWS``. ``docs`` has _vector."""
    n = docs.count()
    share_rows = grown(share_rows, n, SHARES, SHARE_ROWS)
    shares = -(-n // share_rows)
    if shares <= 1:  # one cell needs no bounds
        return Cells(docs.withColumn("_cell", F.lit(0)), np.zeros((1, 1)), *(np.array([v]) for v in (0, 0, 0.0, np.inf, n)))
    points = np.array([r["_vector"] for r in docs.orderBy(F.xxhash64(id_column), id_column).limit(min(pivots, shares))
                       .select("_vector").collect()], np.float64)
    near = F.pandas_udf(nearest_pivot(points), "pivot int, far double")
    placed = stored(docs.withColumn("_near", near("_vector")).select("*", "_near.*").drop("_near"), "pivots")
    # One row per pivot.
    spans = placed.groupBy("pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
    spans = spans.select("pivot", "low", (F.col("high") - F.col("low")).alias("width"),
                         F.least(F.lit(rings), F.ceil(F.col("n") / share_rows)).alias("rings"))
    ring = F.when(F.col("width") > 0, F.least(
        F.col("rings") - 1, F.floor((F.col("far") - F.col("low")) / F.col("width") * F.col("rings")))).otherwise(0)
    placed = placed.join(F.broadcast(spans), "pivot").withColumn("_cell", (F.col("pivot") * rings + ring).cast("int"))
    facts = placed.groupBy("_cell", "pivot").agg(
        F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).orderBy("_cell").collect()
    return Cells(placed.drop("pivot", "far", "low", "width", "rings"), points,
                 *(np.array([r[c] for r in facts]) for c in ("_cell", "pivot", "low", "high", "n")))


def nearest_counted(
    docs: DataFrame, queries: DataFrame, id_column: str, vector: str, filters: Sequence[str] = (),
    block: int = QUERY_BLOCK, share_rows: int = SHARE_ROWS,
) -> tuple[DataFrame, int]:
    """:func:`nearest`, and how many pairs of a query and a document were brought together."""
    spark = docs.sparkSession
    k = F.coalesce("k", F.raise_error(F.lit("a query needs k")).cast("int")).cast("int")
    cells = divide(
        docs.filter(F.col(vector).isNotNull()).select(id_column, F.col(vector).cast("array<double>").alias("_vector"), *filters),
        id_column, share_rows)
    state = queries.filter(F.col(vector).isNotNull()).select(
        "query_id", k.alias("k"), F.col(vector).cast("array<double>").alias("_point"),
        *[F.col(f).alias(f"_asked_{f}") for f in filters]).filter("k > 0")
    kept = state.columns
    block = grown(block, state.count(), BLOCKS, QUERY_BLOCK)
    share_rows = grown(share_rows, int(cells.count.sum()), SHARES, SHARE_ROWS)
    state = state.withColumns({"_limit": F.lit(float("inf")), "_done": F.lit(0)})
    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, k int, "
              f"{id_column} {docs.schema[id_column].dataType.simpleString()}, distance double")
    in_order = Window.partitionBy("query_id").orderBy("distance", id_column)
    size = dict(zip(cells.cell.tolist(), cells.count.tolist(), strict=True))
    best, pairs, width = spark.createDataFrame([], schema + ", rank int"), 0, 1
    while True:
        ask = F.pandas_udf(cells_to_ask(*cells[1:], width), "cells array<int>, until int")
        asking = stored(state.withColumn("_next", ask("_point", "k", "_limit", "_done")).filter("size(_next.cells) > 0")
                        .select(*kept, "_next.*"), "asking")
        wanted = {r["_cell"]: r["n"] for r in asking.select(F.explode("cells").alias("_cell")).groupBy("_cell").agg(
            F.count("*").alias("n")).collect()}
        if not wanted:
            break
        pairs += sum(n * size[c] for c, n in wanted.items())
        # One row per cell.
        pieces = F.broadcast(spark.createDataFrame(
            [(c, max(1, -(-size[c] // share_rows)), -(-n // block)) for c, n in wanted.items()], "_cell int, _shares int, _blocks int"))

        def number(column: str, pieces_of: str):
            return F.pmod(F.xxhash64(column), F.col(pieces_of)).cast("int")

        def every(pieces_of: str):
            return F.explode(F.sequence(F.lit(0), F.col(pieces_of) - 1))

        keys = ("_cell", "_share", "_block")
        left = asking.withColumn("_cell", F.explode("cells")).join(pieces, "_cell").withColumn(
            "_block", number("query_id", "_blocks")).withColumn("_share", every("_shares")).select(*keys, *kept)
        right = cells.docs.join(pieces, "_cell").withColumn("_share", number(id_column, "_shares")).withColumn(
            "_block", every("_blocks")).select(*keys, id_column, "_vector", *filters)
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            nearest_in_share(id_column, tuple(filters)), schema)
        best = stored(best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(in_order))
                      .filter(F.col("rank") <= F.col("k")), "best")
        if len(size) == 1:
            break
        last = best.filter("rank = k").select("query_id", F.col("distance").alias("_limit"))
        state = asking.join(last, "query_id", "left").select(
            *kept, F.coalesce("_limit", F.lit(float("inf"))).alias("_limit"), F.col("until").alias("_done"))
        width *= 4
    return best.drop("k"), pairs


def nearest(
    docs: DataFrame, queries: DataFrame, id_column: str, vector: str, filters: Sequence[str] = (),
    block: int = QUERY_BLOCK, share_rows: int = SHARE_ROWS,
) -> DataFrame:
    """Exact nearest neighbours by squared distance: (query_id, id, distance, rank).

    ``queries`` has query_id, vector, k and the filter columns (null for no
    condition); a query without k is refused. Null vectors take no part. Cells and
    queries are tables: a cell is dealt into shares and its queries into blocks by hash, a task gets one
    block and one share and keeps the best k of every query, and these are ranked once more.
    ``block`` and ``share_rows`` are least sizes: larger tables use larger pieces, up to ``QUERY_BLOCK`` and ``SHARE_ROWS``,
    so neither the meetings of pieces nor the copies of a row grow with the square of the tables before that. What a task holds is bounded, and a cell that cannot hold one of the best k is never joined.
    """
    return nearest_counted(docs, queries, id_column, vector, filters, block, share_rows)[0]
