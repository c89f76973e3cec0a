"""Incremental updates fed by a stream of files: each batch is one upsert of the key partitions it touches.

Rows lie in partitions by the low bits of their key's hash. A partition that would hold more than ``part_rows`` rows is
split by one more bit (extendible hashing), so partitions keep their size however much the table grows. Every version has
one manifest with all partitions, the last batch of every stream and the states of the analytics; it is written last, which
makes the version count, and the newest one is all that an update reads of the past.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidyledger.operators import increments
from tidyledger.operators.analytics import Gold
from tidyledger.operators.clean import ROW, ROW_ID
from tidyledger.operators.updates import keep_last
from tidyledger.sources.scratch import new_path

PARTS = 8
PART_ROWS = 2_000_000
TASK_ROWS = 250_000  # about, of a full partition that one task writes
STATES = 8  # states of single batches that are merged into one
_MANIFEST = "kind string, depth int, bits long, rows long, folder string, query_id string, batch long"
_PART, _QUERY, _STATE, _SHAPE = "part", "query", "state", "shape"


class Part(NamedTuple):
    """A partition: rows whose key's hash ends in the ``depth`` bits ``bits``; the folder is empty while there are none."""

    depth: int
    bits: int
    rows: int
    folder: str


class Version(NamedTuple):
    number: int
    parts: list[Part]
    batches: dict[str, int]
    states: list[str]
    shape: increments.Shape | None


def _files(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, ascending."""
    files, at = _files(spark, f"{path}/log")
    if not files.exists(at):
        return []
    found = sorted(int(s.getPath().getName().removeprefix("version=")) for s in files.listStatus(at))
    done = lambda number: files.exists(_files(spark, f"{path}/log/version={number}/_SUCCESS")[1])
    # Only the newest may be unfinished.
    return found if not found or done(found[-1]) else found[:-1]


def read_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The manifest of a version, the newest by default: one row per partition."""
    known = versions(spark, path)
    if not known:
        return None
    number = known[-1] if number is None else number
    if number not in known:
        raise ValueError(f"{path}: no version {number}")
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/log/version={number}").collect()
    shape = [r["folder"] for r in rows if r["kind"] == _SHAPE]
    return Version(number, sorted(Part(r["depth"], r["bits"], r["rows"], r["folder"]) for r in rows if r["kind"] == _PART),
                   {r["query_id"]: r["batch"] for r in rows if r["kind"] == _QUERY},
                   [r["folder"] for r in rows if r["kind"] == _STATE], increments.Shape(*json.loads(shape[0])) if shape else None)


def _write_version(spark: SparkSession, path: str, v: Version) -> None:
    rows = ([(_PART, p.depth, p.bits, p.rows, p.folder, None, None) for p in v.parts]
            + [(_QUERY, None, None, None, None, q, b) for q, b in v.batches.items()]
            + [(_STATE, None, None, None, folder, None, None) for folder in v.states]
            + ([(_SHAPE, None, None, None, json.dumps(v.shape), None, None)] if v.shape else []))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/version={v.number}")


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _existing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Rows of some partitions; versions may have brought new columns."""
    return spark.read.option("mergeSchema", True).parquet(*folders)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows at a version, the newest by default."""
    found = read_version(spark, path, version)
    folders = [p.folder for p in found.parts if p.folder] if found else []
    if not folders:
        raise ValueError(f"{path}: no version yet")
    return _existing(spark, folders)


def gold_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Gold:
    """Rows and analytics at a version. The analytics come from the states of the batches; no row is read for them."""
    found = read_version(spark, path, version)
    if not found or not found.shape:
        raise ValueError(f"{path}: no version with analytics yet")
    states = spark.read.schema(increments.STATE).parquet(*found.states)
    return Gold(snapshot(spark, path, version), increments.statistics(states, found.shape), increments.value_counts(states),
                increments.segments(states, found.shape))


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the folders only they use; gives how many versions went."""
    known = versions(spark, path)
    kept = [read_version(spark, path, n) for n in known[-keep:]]
    used = {f for v in kept for f in [*(p.folder for p in v.parts), *v.states] if f}
    tops = {f"{path}/{kind}/version={n}" for kind in ("data", "state") for n in known}
    for old in known[:-keep]:
        _files(spark, path)[0].delete(_files(spark, f"{path}/log/version={old}")[1], True)
    for top in tops:
        files, at = _files(spark, top)
        if not files.exists(at):
            continue
        inside = {u for u in used if u == top or u.startswith(f"{top}/")}
        if not inside:
            files.delete(at, True)
        elif top not in inside:
            for depth in files.listStatus(at):
                for bits in files.listStatus(depth.getPath()) if depth.isDirectory() else []:
                    folder = f"{top}/{depth.getPath().getName()}/{bits.getPath().getName()}"
                    if folder not in inside:
                        files.delete(bits.getPath(), True)
    return len(known) - len(kept)


def _located(rows: DataFrame, key: str, directory: DataFrame, depths: list[int]) -> DataFrame:
    """Join rows with the partition of their key. The directory has one row per partition, so it is small against the rows."""
    tried = rows.withColumn("_hash", F.xxhash64(F.col(key).cast("string"))).withColumn(
        "_depth", F.explode(F.array(*map(F.lit, depths))))
    return tried.withColumn("_bits", _low_bits(F.col("_depth"))).join(F.broadcast(directory), ["_depth", "_bits"])


def _low_bits(depth: Column) -> Column:
    return F.col("_hash").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1)


def _deeper(part: Part, new_rows: int, part_rows: int) -> int:
    depth, rows = part.depth, part.rows + new_rows
    while rows > part_rows and depth < 62:
        depth, rows = depth + 1, rows / 2
    return depth


def upsert_stream(batches: DataFrame, path: str, checkpoint: str, key: str = "num_factura", order: str = ROW,
                  parts: int = PARTS, part_rows: int = PART_ROWS, analytics: bool = False) -> StreamingQuery:
    """Keep the last row per key over all batches seen, and with ``analytics`` the statistics, index and segments too.

    A batch is read once: its last row per key is stored, and all further steps read that. It reads and rewrites only the
    partitions its keys fall into; a new table starts with ``parts`` of them (a power of two). Analytics read only the rows that come and those they replace. A batch that is retried after a failure
    is known by its query and number. A stream whose checkpoint was lost has a new query id, so it goes on from the newest
    version. One stream at a time may write to a path. The batches must have an ``order`` column that says which of a
    batch's rows for a key is the last.
    """
    if order not in batches.columns:
        raise ValueError(f"the stream needs the order column {order}")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        first_depth = max(parts - 1, 0).bit_length()
        base = read_version(spark, path) or Version(-1, [Part(first_depth, b, 0, "") for b in range(1 << first_depth)], {}, [], None)
        if base.batches.get(query_id, -1) >= number:
            return
        known = {(p.depth, p.bits): p for p in base.parts}
        directory = spark.createDataFrame(list(known), "_depth int, _bits long")
        depths = sorted({p.depth for p in base.parts})
        # A batch has as few tasks as files, and every read of it would sort them again.
        kept = new_path(spark, "batch")
        last = [order, ROW_ID] if ROW_ID in batch.columns and order != ROW_ID else [order]
        keep_last(batch, key, *last).write.parquet(kept)
        came = spark.read.schema(batch.schema).parquet(kept)
        fresh = {(r["_depth"], r["_bits"]): r["count"] for r in
                 _located(came.select(key), key, directory, depths).groupBy("_depth", "_bits").count().collect()}
        if not fresh:
            _delete(spark, kept)
            return
        version = base.number + 1
        folders = [known[p].folder for p in fresh if known[p].folder]
        existing = _existing(spark, folders) if folders else came.limit(0)
        same = F.col(key).eqNullSafe(F.col("_came"))
        keys = came.select(F.col(key).alias("_came"))
        # Existing rows have one row per key already.
        after = existing.join(keys, same, "left_anti").unionByName(came, allowMissingColumns=True) if folders else came
        depth_of = {p: _deeper(known[p], n, part_rows) for p, n in fresh.items()}
        aim = spark.createDataFrame([(*p, d) for p, d in depth_of.items()], "_depth int, _bits long, _aim int")
        target = f"{path}/data/version={version}"
        rows = _located(after, key, aim, depths)
        rows = rows.withColumns({"_depth": F.col("_aim"), "_bits": _low_bits(F.col("_aim"))}).drop("_aim")
        # A folder may have several files, so that a task writes no whole partition.
        share = F.pmod(F.xxhash64("_hash"), F.lit(max(1, -(-part_rows // TASK_ROWS))))
        rows = rows.repartition("_depth", "_bits", share).drop("_hash")
        rows.write.mode("overwrite").partitionBy("_depth", "_bits").parquet(target)
        sizes = {(r["_depth"], r["_bits"]): r["count"] for r in
                 spark.read.parquet(target).groupBy("_depth", "_bits").count().collect()}
        new_parts = [p for at, p in known.items() if at not in fresh]
        for (depth, bits), aimed in depth_of.items():
            for more in range(1 << (aimed - depth)):
                at = aimed, bits | more << depth
                new_parts.append(Part(*at, sizes.get(at, 0), f"{target}/_depth={at[0]}/_bits={at[1]}" if at in sizes else ""))
        states, shape = base.states, base.shape
        if analytics:
            went = existing.join(keys, same, "left_semi")
            shape = shape or increments.shape_of(came)
            folder = f"{path}/state/version={version}"
            state = increments.changes(came, went, shape)
            if len(states) >= STATES:
                state = increments.merged(spark.read.schema(increments.STATE).parquet(*states).unionByName(state))
                states = []
            (state.repartitionByRange("kind", "field", "value").sortWithinPartitions("kind", "field", "value")
             .write.mode("overwrite").parquet(folder))
            states = [*states, folder]
        _write_version(spark, path, Version(version, new_parts, base.batches | {query_id: number}, states, shape))
        _delete(spark, kept)

    return (batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
