"""Stored layers: ingested raw data, clean tables, analytics tables, review lists, runs."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.operators.analytics import Gold
from tidyledger.operators.clean import CORRUPT, FILE
from tidyledger.schema import TableSpec
from tidyledger.sources.files import check_csv_structure, read_files
from tidyledger.sources.scratch import stored

MANIFEST = ("dataset_id string, source string, ingested_at timestamp, encoding string, row_count bigint, "
            "column_names array<string>, storage_path string, size_bytes bigint, ragged_rows bigint, "
            "files array<struct<path:string,encoding:string,row_count:bigint>>")


def ingest(spark: SparkSession, path: str, store: str, encoding: str | None = None) -> DataFrame:
    """Store raw CSV files as numbered text rows in Parquet and return the one-row manifest, also kept in the store.

    Every file is read in its own encoding unless one is given, with its own header;
    columns are matched by name. A file that fails the structure check is refused. The manifest names the
    stored columns, all encodings found, and has one entry per file.
    """
    structure = stored(check_csv_structure(spark, path), "structure")
    checked = structure.agg(
        F.bool_and("is_valid").alias("ok"), F.array_join(F.array_sort(F.collect_set("encoding")), ",").alias("encodings"),
        F.array_sort(F.collect_list(F.struct("path", "encoding"))).alias("files"),
        F.min(F.when(~F.col("is_valid"), F.concat_ws(": ", "path", F.array_join("errors", "; ")))).alias("error")).first()
    if checked["ok"] is None:
        raise ValueError(f"{path}: CSV file is empty (no header row)")
    if not checked["ok"]:
        raise ValueError(checked["error"])
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    now = datetime.now(timezone.utc)
    dataset_id = str(uuid.uuid4())
    storage = f"{store}/data/{now:%Y%m%d_%H%M%S}_{dataset_id[:8]}"
    read_files(spark, path, dataset_id, structure, encoding).write.parquet(storage)
    # What the manifest says of the rows is counted on the stored ones.
    kept = spark.read.parquet(storage)
    names = [c for c in kept.columns if not c.startswith("_")]
    counts = {r[FILE]: r for r in kept.groupBy(FILE).agg(
        F.count("*").alias("rows"), F.count(CORRUPT).alias("ragged")).collect()}
    files = [(f["path"], f["encoding"], counts[f["path"]]["rows"] if f["path"] in counts else 0) for f in checked["files"]]
    row = (dataset_id, path, now.replace(tzinfo=None), encoding or checked["encodings"], sum(r["rows"] for r in counts.values()),
           names, storage, size, sum(r["ragged"] for r in counts.values()), files)
    manifest = spark.createDataFrame([row], MANIFEST)
    manifest.write.mode("append").parquet(f"{store}/manifest")
    return manifest


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")


def read_ingested(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Raw rows of the (single) data set of a manifest row."""
    return spark.read.parquet(manifest.select("storage_path").first()[0])


def write_clean(df: DataFrame, path: str, spec: TableSpec, fmt: str = "parquet", keep: tuple[str, ...] = ()) -> None:
    """Valid records in spec column order; dates as YYYY-MM-DD in CSV. No rows still give a readable table."""
    out = df.select(*keep, *spec.names)
    if fmt == "csv":
        out.write.csv(path, header=True, dateFormat="yyyy-MM-dd", emptyValue="", ignoreLeadingWhiteSpace=False,
                      ignoreTrailingWhiteSpace=False, escape='"')
    else:
        out.write.format(fmt).save(path)


def read_clean(spark: SparkSession, path: str, spec: TableSpec, fmt: str = "parquet", na_words: bool = False,
               keep: str = "") -> DataFrame:
    """Clean records with their types; ``na_words`` reads NA, null, nan … in text as missing."""
    fields = ([f.strip() for f in keep.split(",")] if keep else []) + [
        f"`{f.name}` {f.spark_type.simpleString()}" for f in spec.fields]
    reader = spark.read.schema(", ".join(fields))
    if fmt != "csv":
        return reader.format(fmt).load(path)
    df = reader.csv(path, header=True, dateFormat="yyyy-MM-dd", escape='"')
    if not na_words:
        return df
    return df.withColumns({
        f.name: F.when(~F.col(f.name).isin(*words.NA_WORDS), F.col(f.name))
        for f in spec.fields if f.type in ("str", "enum")})


def write_gold(gold: Gold, path: str, fmt: str = "parquet") -> None:
    """Four tables: records, statistics, indexes, segments (``fmt="json"`` for JSON lines)."""
    for name, table in gold._asdict().items():
        table.write.format(fmt).save(f"{path}/{name}")


def load_gold(spark: SparkSession, path: str) -> Gold:
    return Gold(*[spark.read.parquet(f"{path}/{name}") for name in Gold._fields])


_STAT = "struct<field_name:string,count:bigint,sum:double,mean:double,median:double,min:double,max:double,std:double>"
_ENTRY = "struct<key:string,count:bigint,row_indices:array<bigint>>"
GOLD_DOCUMENT = (
    f"records array<map<string,string>>, statistics map<string,{_STAT}>, "
    f"indexes map<string,struct<field_name:string,unique_values:bigint,entries:map<string,{_ENTRY}>>>, "
    "segmented_statistics map<string,struct<segment_field:string,segments:map<string,map<string,double>>>>")


def load_gold_document(spark: SparkSession, path: str) -> Gold:
    """Analytics kept as one JSON document per run, as the four tables.

    Given a folder, the document with the highest file name is taken. Records
    are text columns named like the keys of the first record.
    """
    newest = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).agg(F.max("path")).first()[0]
    doc = spark.read.schema(GOLD_DOCUMENT).json(newest, multiLine=True)
    columns = list(doc.select(F.map_keys(F.get("records", F.lit(0)))).first()[0] or [])
    records = doc.select(F.posexplode("records").alias("_row_number", "r")).select(
        F.col("_row_number").cast("long"), *[F.col("r")[c].alias(c) for c in columns])
    statistics = doc.select(F.explode("statistics").alias("field", "s")).select(
        "field", "s.count", "s.sum", "s.mean", "s.median", "s.min", "s.max", "s.std")
    indexes = doc.select(F.explode("indexes").alias("field", "i")).select(
        "field", F.explode("i.entries").alias("k", "e")).select("field", F.col("e.key").alias("key"), "e.count")
    segments = doc.select(F.explode("segmented_statistics").alias("segment_field", "s")).select(
        "segment_field", F.explode("s.segments").alias("segment", "m")).select(
        "segment_field", "segment", F.explode("m").alias("metric", "value"))
    return Gold(records, statistics, indexes, segments)


def write_review(entries: DataFrame, path: str) -> bool:
    """Review rows as JSON lines; nothing is written when there are none."""
    if entries.isEmpty():
        return False
    entries.write.json(path)
    return True


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """File name, status, record count and time of the runs with the highest ids.

    ``runs`` has one row per event of a run: run_id, file_name, status,
    record_count, created_at; the last event of a run counts.
    """
    last = F.struct("created_at", "record_count")
    return runs.groupBy("run_id").agg(
        F.max_by("file_name", last).alias("file_name"), F.max_by("status", last).alias("status"),
        F.max_by("record_count", last).alias("record_count"), F.max("created_at").alias("created_at"),
    ).orderBy(F.col("run_id").desc()).limit(limit)
