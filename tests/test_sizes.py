"""Faults that show on larger tables only."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from test_names import sequential
from tidyledger.functions.cleaning import strip_ws
from tidyledger.operators import analytics as A, clean, dedupe, increments, search
from tidyledger.plans import ledger
from tidyledger.plans.queries_sources import bronze_row_numbers
from tidyledger.sources import files, scratch
from tidyledger.streaming import incremental


def test_rows_keep_the_order_of_their_file_whatever_the_order_they_came_in(spark, tmp_path):
    spark.range(30_000).withColumnRenamed("id", "o_orderkey").orderBy(F.xxhash64("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    wrong = bronze_row_numbers(spark, str(tmp_path)).filter(F.col("row_number") != F.floor(F.col("o_orderkey") / 7) + 2)
    assert wrong.count() == 0


def test_sums_of_many_amounts_are_exact_in_any_order(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "Gasto").otherwise("Ingreso").alias("tipo"),
        ((F.col("id") * 7919 % 50_000_011) / 100 + 250_000).alias("importe_total"))
    want = {k: sum(Decimal(i * 7919 % 50_000_011) / 100 + 250_000 for i in range(200_000) if i % 2 == k) for k in (0, 1)}
    for some in (df.repartition(3), df.orderBy(F.desc("importe_total"))):
        found = A.field_statistics(some).first()
        assert found["sum"] == float(want[0] + want[1]) and found["mean"] == pytest.approx(float(want[0] + want[1]) / 200_000, rel=1e-15)
        row = A.balance(some).first()
        assert (row["expense_total"], row["income_total"]) == (float(want[0]), float(want[1]))


def test_sums_of_other_numbers_are_kept(spark):
    values = [1e-9, 3e15, -2.5, float("inf")]
    found = [A.field_statistics(spark.createDataFrame([(v,) for v in some], "iva double")).first()["sum"]
             for some in (values[:1], values[:3], values)]
    assert found == [1e-9, 3e15 - 2.5, float("inf")]


def test_amounts_that_all_went_leave_no_deviation(spark):
    was = spark.range(5000).select(F.lit("a").alias("tipo"), ((F.col("id") * 7919 % 50_000_011) / 100).alias("importe_total"))
    paid = was.withColumn("importe_total", F.lit(0.0))
    shape = increments.shape_of(was)
    states = increments.changes(was, was.limit(0), shape).union(increments.changes(paid, was, shape))
    found, segment = increments.statistics(states, shape).first(), increments.segments(states, shape).first()
    assert (found["count"], found["sum"], found["std"], segment["importe_total_sum"]) == (5000, 0.0, 0.0, 0.0)


def test_rows_are_not_sorted_for_a_few_folders(spark, monkeypatch):
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path: (seen.append(int(spark.conf.get(key))), write(w, path))[1])
    rows = spark.range(20).select("id", F.when(F.col("id") % 3 == 0, "invalid").otherwise("valid").alias("_status"))
    stored = scratch.stored(rows, "folders", "_status")
    # With this many files open a task sorts nothing; without, it holds and sorts all its rows.
    assert seen[0] >= 4 and int(spark.conf.get(key)) == 0
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in rows.collect()}


def test_a_small_mapping_moves_no_record(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 5 == 0, "Azul").otherwise("Rojo").alias("categoria"))
    mapping = spark.range(500).groupBy(F.concat(F.lit("v"), "id").alias("value")).agg(F.max(F.lit("Rojo")).alias("canonical"))
    plan = dedupe.apply_mapping(rows, mapping, "categoria")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_blanks_are_stripped_as_by_the_pattern(spark):
    blanks = [chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    kept = ["​", "﻿", "\x00", "\x1b", "é"]
    texts = [f"{b}a{b} b{b}{b}" for b in [*blanks, *kept]] + ["", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.filter(strip_ws(F.col("t")) == F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    assert same.count() == len(texts)


def test_small_pieces_grow_with_the_tables(spark):
    docs = spark.range(2000).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("_vector"))
    cells = search.divide(docs, "id", share_rows=2)
    assert cells.count.sum() == 2000 and len(cells.cell) <= 4 * search.SHARES
    found, _ = search.nearest_counted(docs, docs.filter("id < 40").selectExpr("id query_id", "_vector", "1 k"), "id", "_vector",
                                      block=2, share_rows=2)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(i, i) for i in range(40)}


def test_the_code_of_the_rules_is_split_and_another_choice_stays(spark):
    rows = spark.createDataFrame([("x",)], "proveedor string")
    before = spark.conf.get(clean.METHOD_LIMIT)
    try:
        for given, kept in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(clean.METHOD_LIMIT, given)
            clean.clean(rows)
            assert spark.conf.get(clean.METHOD_LIMIT) == kept
    finally:
        spark.conf.set(clean.METHOD_LIMIT, before)


def test_more_invoices_are_cleaned_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ROWS_PER_TASK", 20)
    dirty = ledger.dirty_invoices(spark, "/root/testdata/sf0.001")
    sizes = dirty.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == dirty.count() > 1000 and max(sizes) <= 60


def test_a_batch_of_a_stream_is_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(key):
        read.add(1)
        return key

    schema = "_row_number long, num_factura string, tipo string, importe_total double"
    for n in range(2):
        rows = spark.range(200).select(F.col("id").alias("_row_number"), F.concat(F.lit("k"), F.col("id") + 100 * n).alias("num_factura"),
                                       F.lit("Gasto").alias("tipo"), (F.col("id") * 1.5).alias("importe_total"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        batches = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("num_factura", counted("num_factura"))
        incremental.upsert_stream(batches, str(tmp_path / "out"), str(tmp_path / "progress"), analytics=True).awaitTermination()
        assert read.value == 200 * (n + 1)
    gold = incremental.gold_snapshot(spark, str(tmp_path / "out"))
    assert (gold.records.count(), gold.statistics.first()["count"]) == (300, 300)


def test_a_partition_of_a_stream_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "TASK_ROWS", 100)
    # As on large tables, where adaptive execution has no small shuffle partitions to put together.
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.range(800).selectExpr("id _row_number", "concat('k', id) num_factura").coalesce(1).write.parquet(str(tmp_path / "in"))
        batches = spark.readStream.schema("_row_number long, num_factura string").parquet(str(tmp_path / "in"))
        incremental.upsert_stream(batches, str(tmp_path / "out"), str(tmp_path / "progress"), parts=1, part_rows=1000).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = incremental.snapshot(spark, str(tmp_path / "out"))
    assert rows.count() == 800 and len(rows.inputFiles()) >= 3


def test_names_of_few_leaders_meet_no_blocks(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("blocks of names met")

    monkeypatch.setattr(dedupe, "_in_rounds", refused)
    names = [f"Supplier#{i * 7919 % 1_000_000:09d}" for i in range(3000)]
    found = dedupe.cluster(dedupe.value_counts(spark.createDataFrame([(n,) for n in names], "s_name string"), "s_name"))
    assert {r["value"]: r["leader"] for r in found.collect()} == sequential(dict.fromkeys(names, 1), 75)


def test_numbering_rows_moves_none_of_them(spark, tmp_path):
    path, limit = f"{tmp_path}/lines", "spark.sql.autoBroadcastJoinThreshold"
    spark.range(1000).selectExpr("cast(id as string) value").repartition(3).write.text(path)
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as for a large table, whose splits Spark takes for many
    try:
        lines = files.raw_lines(spark, path)
        joins = [line for line in lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
        ends = lines.groupBy("_file").agg(F.min("row_number").alias("a"), F.max("row_number").alias("z"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.set(limit, before)
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert sum(r["n"] for r in ends) == 1000 and all((r["a"], r["z"]) == (1, r["n"]) for r in ends)
