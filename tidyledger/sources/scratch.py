"""Folder for intermediate tables and checkpoints that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

OPEN_FILES_KEY = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 8  # of one task that writes several folders


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Only a local-mode session that names none gets a temporary one of its own;
    on a cluster a folder on one machine would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidyledger-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def unsorted_folders(spark: SparkSession):
    """Tasks keep the files of up to ``OPEN_FILES`` folders open instead of sorting their rows by folder first."""
    before = spark.conf.get(OPEN_FILES_KEY)
    spark.conf.set(OPEN_FILES_KEY, str(max(int(before), OPEN_FILES)))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES_KEY, before)


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table once to the shared folder and read it back from there.

    For results that several jobs read: they are computed once, survive lost
    executors, and filters on ``partition_by`` columns skip whole folders. These columns should have
    few values, as the status of a row: then no task sorts its rows for them.
    """
    path = new_path(df.sparkSession, label)
    with unsorted_folders(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """Number the rows from 0 in the given order, and store them.

    A range sort puts them in order over many tasks; each task's offset is counted on the stored rows.
    """
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_task").agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per task of the sort.
    return rows.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_offset") + F.col("_row")).drop("_task", "_row", "_offset")
