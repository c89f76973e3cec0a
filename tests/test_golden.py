"""Two small invoice files with the clean rows and statistics they must give."""

import pytest
from pyspark.sql import functions as F

from tidyledger.operators import analytics as A, clean as C, dedupe as D, validate as V
from tidyledger.plans.pipeline import run_pipeline
from tidyledger.schema import INVOICE_SPEC

HEADER = "num_factura,fecha,proveedor,nif_cif,tipo,categoria,importe_base,iva,importe_total,estado_factura"
SMALL = f"""{HEADER}
FAC-2022-0101,07/03/2022,  Talleres Nube  ,B20304050,Ingreso,Reparto,2.000,00 €,420,00 €,2.420,00 €,Pagada
fac/2022/102,20-04-2022,Faro Digital SL,A-70605040,gasto,Diseño,1500.25,315.05,1815.30,pendiente
FAC 2022 103,25 de mayo de 2022,Mesa Redonda,B31323334,Ingrso,Asesoría,"2,400.00","504.00","2,904.00",Pagda
FAC-2022-0104,2022-06-01,Puente Norte,C41424344,Gasto,Reparto,600.00,126.00,726.00,Vencida
FAC-2022-0105,05/07/2022,  huerta clara  ,B51525354,ingeso,Diseño,900 EUR,189 EUR,1089 EUR,Pendiete
"""
# The first row has unquoted decimal commas: its cells are shifted and the surplus ones dropped.
SMALL_CLEAN = """FAC-2022-0101,2022-03-07,Talleres Nube,B20304050,Ingreso,Reparto,2000.0,0.0,420.0,00 €,0.0
FAC-2022-0102,2022-04-20,Faro Digital Sl,A70605040,Gasto,Diseño,1500.25,315.05,1815.3,Pendiente,1815.3
FAC-2022-0103,2022-05-25,Mesa Redonda,B31323334,Ingreso,Asesoría,2400.0,504.0,2904.0,Pagada,0.0
FAC-2022-0104,2022-06-01,Puente Norte,C41424344,Gasto,Reparto,600.0,126.0,726.0,Vencida,726.0
FAC-2022-0105,2022-07-05,Huerta Clara,B51525354,Ingreso,Diseño,900.0,189.0,1089.0,Pendiente,1089.0
"""
LARGE = f"""{HEADER}
FAC-2021-0201,2021-10-14,almacenes rivera,D10203041,INGRESO,Herrages,30100.50 EUR,6321.11,36421.61,pendiente
FAC-2022-0202,21-08-2022,imprenta del sur,E11213141,Ingrso,Rótulos,20500.40,"4305,08",24805.48,pagad
FAC-2023-0203,5/4/2021,Vidrios Alameda,F12223242,Gasto,Obras,4200.25,882.05,5082.30,Pendiente
FAC-2021-0204,12/11/2021,Maderas Quiroga,E13233343,Gasto,Jardinería,11800.70,"2478,1",  14278.80  ,Pagada
FAC 2022 0205,20/12/2023,Pinturas Costa Verde,E14243444,Ingreso,MUDANZA,40200.60,8442.13,  48642.73  ,Vencida
FAC-2023-0206,15/06/2023,reparto ligero,15253545,INGRESO,Herrajes,35000.80,7350.17,42350.97 EUR,Parcialmente pagada
2022/28,11/09/2023,Carpintería Olmedo,E16263646,Ingreso,Mudanza,"10050,30",2110.56,12160.86,parcialmente pagada
FAC-2021-0210,03/08/2022,Maderas Quiroga,A-17273747,Gatso,JARDINERIA,3100.45,  651.09  ,"3751,54",Pendiente
FAC-2022-0211,26 de noviembre de 2021,NetPiezas Ibérica,A18283848,Ingreso,Asesoría,33000.20 EUR,6930.04,39930.24,Pendiente
FAC-2021-0219,18-04-2021,Guardia Segura S.L.,D19293949,Gasto,JARDINERIA,"21000,4",840.02,  21840.42  ,Parcialmente pagada
FAC-2022-0220,10/02/2022,almacenes rivera,F20304050,Ingrso,Herrajes,3900.15,390.02,4290.17,Parcialmente pagada
,28/11/2021,Aula Abierta Tech,D21314151,Gasto,reformas,"22000,10",2200.01,24200.11€,Pendiente
FAC-2021-0207,04/22/2023,Almacenes Rivera,B-22324252,Ingreso,Rótulos,20000.30,4200.06,  24100.36  ,Vencida
"""
LARGE_CLEAN = """FAC-2021-0201,2021-10-14,Almacenes Rivera,D10203041,Ingreso,Herrages,30100.5,6321.11,36421.61,Pendiente,36421.61
FAC-2022-0202,2022-08-21,Imprenta Del Sur,E11213141,Ingreso,Rótulos,20500.4,4305.08,24805.48,Pagad,0.0
FAC-2023-0203,2021-04-05,Vidrios Alameda,F12223242,Gasto,Obras,4200.25,882.05,5082.3,Pendiente,5082.3
FAC-2021-0204,2021-11-12,Maderas Quiroga,E13233343,Gasto,Jardinería,11800.7,2478.1,14278.8,Pagada,0.0
FAC-2022-0205,2023-12-20,Pinturas Costa Verde,E14243444,Ingreso,Mudanza,40200.6,8442.13,48642.73,Vencida,48642.73
FAC-2023-0206,2023-06-15,Reparto Ligero,15253545,Ingreso,Herrajes,35000.8,7350.17,42350.97,Parcialmente Pagada,21175.485
FAC-2022-0028,2023-09-11,Carpintería Olmedo,E16263646,Ingreso,Mudanza,10050.3,2110.56,12160.86,Parcialmente Pagada,6080.43
FAC-2021-0210,2022-08-03,Maderas Quiroga,A17273747,Gasto,Jardineria,3100.45,651.09,3751.54,Pendiente,3751.54
FAC-2022-0211,2021-11-26,Netpiezas Ibérica,A18283848,Ingreso,Asesoría,33000.2,6930.04,39930.24,Pendiente,39930.24
FAC-2021-0219,2021-04-18,Guardia Segura S.L.,D19293949,Gasto,Jardineria,21000.4,840.02,21840.42,Parcialmente Pagada,10920.21
FAC-2022-0220,2022-02-10,Almacenes Rivera,F20304050,Ingreso,Herrajes,3900.15,390.02,4290.17,Parcialmente Pagada,2145.085
"""


def cells(row):
    out = [row[n] for n in INVOICE_SPEC.names]
    return ",".join("" if v is None else str(v) for v in out)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "small.csv"
    path.write_text(SMALL, encoding="utf-8")
    store = tmp_path_factory.mktemp("store")
    return run_pipeline(spark, str(path), store=str(store)), store


def test_small_file_rows(small):
    rows = small[0].clean.orderBy("_row_number").collect()
    assert "\n".join(cells(r) for r in rows) + "\n" == SMALL_CLEAN


def test_small_file_statistics(small):
    stats = {r["field"]: r for r in small[0].gold.statistics.collect()}["importe_total"]
    assert stats["count"] == 5 and stats["median"] == 1089.0 and stats["min"] == 420.0 and stats["max"] == 2904.0
    assert stats["sum"] == pytest.approx(6954.3) and stats["mean"] == pytest.approx(1390.86)
    assert stats["std"] == pytest.approx(993.1602831366143)


def test_small_file_report_and_store(spark, small):
    result, store = small
    report = result.report.first()
    assert report["bronze"]["row_count"] == 5 and report["silver"]["valid_records"] == 5
    assert report["gold"]["record_count"] == 5 and report["silver"]["valid_rate"] == 1.0
    run = next((store / "runs").iterdir())
    assert spark.read.parquet(str(run / "gold" / "indexes")).filter("field = 'categoria'").count() == 3


def test_large_file_rows(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text(LARGE.replace("\n", "\r\n"), encoding="utf-8", newline="")
    result = run_pipeline(spark, str(path))
    rows = result.clean.orderBy("_row_number").collect()
    assert "\n".join(cells(r) for r in rows) + "\n" == LARGE_CLEAN
    bad = {r["_row_number"]: [e["field"] for e in r["_errors"]] for r in result.rejected.collect()}
    assert bad == {13: ["num_factura"], 14: ["fecha"]}
    review = {(r["canonical"], r["similarity"]) for r in D.review_table(result.silver.groups).collect()
              if r["field"] == "categoria"}
    assert ("Herrajes", 0.88) in review or ("Herrages", 0.88) in review
    assert any(s == 0.9 for _, s in review)
    assert result.silver.validated.count() == 13


def test_statistics_of_one_row_and_of_text(spark):
    df = spark.createDataFrame([("5", "x"), ("n/a", None)], "importe_total string, iva string")
    row = A.field_statistics(df).collect()
    assert [(r["field"], r["count"], r["std"], r["median"]) for r in row] == [("importe_total", 1, 0.0, 5.0)]
