"""What the operators of this folder share: scratch tables, text keys and row keys."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import zipfile
from collections.abc import Callable
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.sources.scratch import new_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
#: Empty the tables that operators keep in a worker process from task to task.
releases: list[Callable[[], None]] = []


class _Scratch(threading.local):
    """Paths that the thread has stored, so that one caller's clean-up never touches another's tables."""

    def __init__(self):
        self.paths: list[str] = []


_scratch = _Scratch()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, wherever the driver imported it from.

    Operators call it before they make a function for executors; once per application
    the driver sends its sources, as ``spark-submit --py-files`` would. Texts go to Python in
    batches of at most 8 MB, so a worker's memory does not depend on how long they are.
    """
    if spark.conf.get(BATCH_BYTES).startswith("67108864"):  # Spark's default; another choice of the user stays
        spark.conf.set(BATCH_BYTES, "8m")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / "tidyledger-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def release() -> None:
    """For functions on executors that need memory themselves: other operators' tables are given back first."""
    for empty in releases:
        empty()
    trim()


def trim() -> None:
    """Give memory that was freed back to the system; a worker process lives on beside those of other operators."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Drop the shuffle files of each query that ends inside, instead of at the driver's next full collection."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: computed once, read by several jobs, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    _scratch.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratch_mark() -> int:
    """For :func:`discard`: what is stored from here on."""
    return len(_scratch.paths)


def discard(spark: SparkSession, mark: int) -> None:
    """Delete what was stored since the mark, but for the last table. For callers whose result reads that one alone."""
    for path in _scratch.paths[mark:-1]:
        _delete(spark, path)
    del _scratch.paths[mark:-1]


def forget(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.scratch_path)
    _scratch.paths.remove(table.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """64-bit key of a text. With the document id it tells rows apart that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_text(name: str) -> Column:
    """An id on its way through pandas, which would turn the ids of a batch with a null id into doubles."""
    return F.col(name).cast("string").alias(name)


def id_back(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
