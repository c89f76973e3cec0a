"""Single values in, single values out, for every rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidyledger.functions import cleaning as fn, vocabulary as words
from tidyledger.operators import clean as C


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("function,table", [
    (fn.strip_ws, {"  test": "test", "test  ": "test", " test\t\n": "test", "a b": "a b", "": ""}),
    (fn.normalize_currency, {
        "1000€": 1000.0, "1000 EUR": 1000.0, "1000,50": 1000.5, "1.234,56": 1234.56, "12.345": 12345.0, "1,234": 1.234,
        "3,500.00": 3500.0, "-1.234,56": -1234.56, "1.234.567": 1234567.0, "1,234,567.89": 1234567.89, "1-2": None,
        "1.2.3": None, "n/a": None, "": None, "  19002.78  ": 19002.78, "$5": 5.0, "usd 7,5": 7.5, "1.234": 1234.0,
        "1234.5": 1234.5, "12345.678": 12345.678, "1e-5": 1e-5, "1.000,00 €": 1000.0, "-5": -5.0, "3298,0": 3298.0,
        "1.23": 1.23, "0.001": 1.0, "1.2345": 1.2345, "EUR": None, "-": None, "12,34,56": None}),
    (fn.currency_unreadable, {"1-2": True, "1.2.3": True, "n/a": False, "": False, "12": False, "-": True}),
    (fn.normalize_date, {
        "15/01/2024": dt.date(2024, 1, 15), "15-01-2024": dt.date(2024, 1, 15), "2024-01-15": dt.date(2024, 1, 15),
        "15 de enero de 2024": dt.date(2024, 1, 15), "10 de MARZO de 2024 y más": dt.date(2024, 3, 10),
        "25/4/2023": dt.date(2023, 4, 25), "1-2-49": dt.date(2049, 2, 1), "1/2/50": dt.date(1950, 2, 1),
        "04/21/2025": None, "31/02/2024": None, "0000-01-01": None, "2024-1-5": dt.date(2024, 1, 5), "1/2-2024": None,
        "5 de brumario de 2024": None, "": None, "mañana": None, " 15/01/2024 ": dt.date(2024, 1, 15)}),
    (fn.normalize_type, {"ingreso": "Ingreso", "Ingrso": "Ingreso", " GASTO ": "Gasto", "Gatso": "Gasto",
                         "income": "Ingreso", " otro ": "otro", "": ""}),
    (fn.normalize_status, {"Pagda": "Pagada", "pendiete": "Pendiente", "vencda": "Vencida", "parcial": "Parcialmente Pagada",
                           "pagad": "pagad", "PDTE": "Pendiente"}),
    (fn.normalize_tax_id, {"B-12345678": "B12345678", "B 12345678": "B12345678", "b12345678": "B12345678",
                           "12345678a": "12345678A", "12345678": "12345678", " x-1 ": "x-1", "": ""}),
    (fn.normalize_invoice_number, {
        "FAC 2024 0001": "FAC-2024-0001", "FAC/2024/0001": "FAC-2024-0001", "FAC-2024-1": "FAC-2024-0001",
        "2024-0001": "FAC-2024-0001", "fac/2024/002": "FAC-2024-0002", "2024/8": "FAC-2024-0008", "20248": "FAC-2024-0008",
        "FAC-2024-12345": "FAC-2024-12345", "FAC-2024-0000123": "FAC-2024-0000123", "FAC-2024-12 bis": "FAC-2024-0012",
        " pedido 7 ": "pedido 7", "": "", "FAC--2024-1": "FAC--2024-1", "FAC20241": "FAC-2024-0001"}),
    (fn.title_case, {"MARKETING": "Marketing", "seguridad total s.l.": "Seguridad Total S.L.", "d'abc 3rd": "D'Abc 3Rd",
                     "hosting & cloud SLU": "Hosting & Cloud Slu", " ñandú-ÉTICO ": "Ñandú-Ético", "": ""}),
])
def test_rule_values(spark, function, table):
    assert dict(zip(table, run(spark, function, list(table)))) == table


def test_null_stays_null(spark):
    for function in (fn.strip_ws, fn.normalize_currency, fn.normalize_date, fn.normalize_type, fn.normalize_tax_id,
                     fn.normalize_invoice_number, fn.title_case):
        assert run(spark, function, [None]) == [None]


@pytest.mark.parametrize("status,total,pending", [
    ("Pagada", 100.0, 0.0), ("Pendiente", 1500.0, 1500.0), ("Vencida", 2000.0, 2000.0),
    ("Parcialmente Pagada", 1000.0, 500.0), ("Rara", 10.0, 0.0), (None, 10.0, 0.0), ("Pendiente", None, 0.0)])
def test_pending_amount(spark, status, total, pending):
    df = spark.createDataFrame([(status, total)], "s string, t double")
    assert df.select(fn.pending_amount(F.col("s"), F.col("t"))).first()[0] == pending


def test_consistency_warnings(spark):
    rows = [("Pagada", 10.0, 1), ("Pendiente", 0.0, 1), ("Pagada", 0.0, 0), ("Pendiente", 5.0, 0), ("Vencida", 0.0, 0)]
    df = spark.createDataFrame(rows, "s string, p double, n int")
    got = df.select(F.size(fn.consistency_warnings(F.col("s"), F.col("p"))), "n").collect()
    assert all(a == b for a, b in got)


def dirty(spark, **cells):
    base = dict(num_factura="FAC-2024-0001", fecha="2024-01-15", proveedor="Acme", nif_cif="B12345678", tipo="Ingreso",
                categoria="Marketing", importe_base="100", iva="21", importe_total="121", estado_factura="Pendiente")
    base.update(cells)
    base = {k: v for k, v in base.items() if v is not ...}
    return spark.createDataFrame([(2, *base.values())], "_row_number long, " + ", ".join(f"{k} string" for k in base))


def test_clean_adds_pending_and_logs_in_order(spark):
    row = C.clean(dirty(spark, proveedor="  acme sa ", tipo="Ingrso")).first()
    assert row["proveedor"] == "Acme Sa" and row["tipo"] == "Ingreso" and row["importe_pendiente"] == 121.0
    log = row["_cleaning_log"]
    assert log[0] == "Stripped whitespace from proveedor"
    assert any("Corrected word in tipo" in line for line in log)
    assert log[-1].startswith("Calculated importe_pendiente=121.00")


def test_given_pending_is_kept_and_warned_about(spark):
    row = C.clean(dirty(spark, importe_pendiente="0")).first()
    assert row["importe_pendiente"] == 0.0
    assert row["_cleaning_log"][-1].startswith("WARNING: Inconsistency: estado_factura='Pendiente'")


def test_unreadable_pending_is_not_replaced(spark):
    assert C.clean(dirty(spark, importe_pendiente="1-2")).first()["importe_pendiente"] is None
    assert C.clean(dirty(spark, importe_pendiente="n/d")).first()["importe_pendiente"] == 121.0


def test_custom_rule_runs_last(spark):
    rule = C.Rule("shout", lambda n: n == "categoria", F.upper, lambda old, new, f: F.lit("shouted"))
    row = C.clean(dirty(spark, categoria=" marketing "), extra_rules=[rule]).first()
    assert row["categoria"] == "MARKETING" and "shouted" in row["_cleaning_log"]


def test_numeric_columns_pass_through(spark):
    df = spark.createDataFrame([(2, "FAC-2024-1", 10.5)], "_row_number long, num_factura string, importe_total double")
    assert C.clean(df).first()["importe_total"] == 10.5


def test_word_lists_are_complete():
    assert len(words.SPANISH_MONTHS) == 12 and [len(v) for v in words.STATUS_WORDS.values()] == [5, 5, 4, 5]
