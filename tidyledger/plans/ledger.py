"""Invoice tables derived from the order tables.

``invoices`` is the clean truth. ``dirty_invoices`` holds the same rows as
text, rewritten in several styles picked by the order key: amounts and dates in
different notations, misspelt words, padded blanks, gaps and bad values. It
stands for the raw CSV the cleaning operators are made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TEXT_COLUMNS = (
    "num_factura", "fecha", "proveedor", "nif_cif", "tipo", "categoria", "importe_base", "iva",
    "importe_total", "estado_factura", "importe_pendiente",
)
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
          "octubre", "noviembre", "diciembre")
INCOME_SPELLINGS = ("Ingreso", "INGRESO", "Ingrso", "ingeso", " income ")
EXPENSE_SPELLINGS = ("Gasto", "GASTO", "gatso", "gsato", " expense ")
STATUS_SPELLINGS = {
    "Pagada": ("Pagada", "pagda", " PAID "),
    "Pendiente": ("Pendiente", "pendiete", " PDTE "),
    "Vencida": ("Vencida", "vencda", " OVERDUE "),
    "Parcialmente Pagada": ("Parcialmente Pagada", "parcial", " PARTIAL "),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, choices) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), index.cast("int"))


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


ROWS_PER_TASK = 250_000  # cleaning takes some 100 to 300 microseconds a row


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal rows evenly to at least as many tasks as cores, and to more the more rows there are, so no task grows with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    status = (
        F.when(F.col("o_orderstatus") == "F", "Pagada").when(F.col("o_orderstatus") == "O", "Pendiente")
        .when(k % 2 == 0, "Vencida").otherwise("Parcialmente Pagada"))
    letter = _pick(F.col("o_custkey") % 8, "ABCDEFGH")
    # Behind the joins, as adaptive execution makes no more tasks of a join's output than there are cores. The count reads footers.
    joined = spread(orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
                    .join(part, F.col("p_partkey") == F.col("o_custkey"), "left"), orders.count())
    return (
        joined.select(
            k.alias("k"), (k + 2).alias("_row_number"),
            F.year(day).cast("string").alias("y"), day.alias("fecha"),
            F.coalesce("p_name", F.concat(F.lit("part "), F.col("o_custkey").cast("string"))).alias("p_name"),
            F.col("c_mktsegment").alias("segment"),
            letter.alias("letter"), _padded(F.col("o_custkey"), 8).alias("digits"),
            F.when(k % 2 == 1, "Gasto").otherwise("Ingreso").alias("tipo"),
            cents.alias("total_c"), F.expr("cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) div 5").alias("iva_c"),
            status.alias("estado_factura"))
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean invoices: one per order, typed, with a stable ``_row_number``."""
    total = F.col("total_c") / 100.0
    return _base(spark, sf_dir).select(
        "_row_number",
        F.concat_ws("-", F.lit("FAC"), "y", _padded(F.col("k"), 4)).alias("num_factura"),
        "fecha",
        F.initcap("p_name").alias("proveedor"),
        F.concat("letter", "digits").alias("nif_cif"),
        "tipo",
        F.initcap("segment").alias("categoria"),
        ((F.col("total_c") - F.col("iva_c")) / 100.0).alias("importe_base"),
        (F.col("iva_c") / 100.0).alias("iva"),
        total.alias("importe_total"),
        "estado_factura",
        F.when(F.col("estado_factura") == "Pagada", F.lit(0.0))
        .when(F.col("estado_factura") == "Parcialmente Pagada", total * 0.5).otherwise(total)
        .alias("importe_pendiente"),
    )


def _amount_text(cents: Column, style: Column) -> Column:
    money = (cents / F.lit(100)).cast("decimal(18,2)")
    plain = money.cast("string")
    grouped = F.format_number(money, 2)
    european = F.translate(grouped, ",.", ".,")
    return (
        F.when(style == 0, plain).when(style == 1, F.translate(plain, ".", ","))
        .when(style == 2, F.concat(european, F.lit(" €"))).when(style == 3, grouped)
        .when(style == 4, F.concat(plain, F.lit(" EUR")))
        .when(style == 5, F.concat(F.lit("  $"), plain, F.lit("  ")))
        .otherwise(F.concat(european, F.lit("€"))))


def dirty_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same invoices as raw text; every value column is a string."""
    k = F.col("k")
    y, m, d = F.col("y"), F.month("fecha"), F.dayofmonth("fecha")
    mm, dd = _padded(m, 2), _padded(d, 2)
    seq = k.cast("string")
    number = (
        F.when(k % 50 == 49, "")
        .when(k % 5 == 0, F.concat_ws("-", F.lit("FAC"), y, _padded(k, 4)))
        .when(k % 5 == 1, F.concat_ws("/", F.lit("fac"), y, seq))
        .when(k % 5 == 2, F.concat_ws(" ", F.lit("FAC"), y, _padded(k, 3)))
        .when(k % 5 == 3, F.concat_ws("/", y, seq))
        .otherwise(F.concat(F.lit("  FAC-"), y, F.lit("-"), _padded(k, 4), F.lit(" "))))
    date = (
        F.when(k % 40 == 39, F.concat_ws("/", F.lit("31"), F.lit("02"), y))
        .when(k % 7 == 0, F.concat_ws("-", y, mm, dd))
        .when(k % 7 == 1, F.concat_ws("/", dd, mm, y))
        .when(k % 7 == 2, F.concat_ws("-", dd, mm, y))
        .when(k % 7 == 3, F.concat_ws("/", d.cast("string"), m.cast("string"), F.right(y, F.lit(2))))
        .when(k % 7 == 4, F.concat_ws(" de ", d.cast("string"), _pick(m - 1, MONTHS), y))
        .when(k % 7 == 5, F.concat_ws("-", y, m.cast("string"), d.cast("string")))
        .otherwise(F.concat_ws(" DE ", dd, F.upper(_pick(m - 1, MONTHS)), y)))
    name = F.col("p_name")
    nbsp = F.lit(" ")
    supplier = (
        F.when(k % 61 == 60, "").when(k % 4 == 0, name).when(k % 4 == 1, F.upper(name))
        .when(k % 4 == 2, F.concat(nbsp, name, F.lit(" "))).otherwise(F.initcap(name)))
    letter, digits = F.col("letter"), F.col("digits")
    tax_id = (
        F.when(k % 4 == 0, F.concat_ws("-", letter, digits)).when(k % 4 == 1, F.concat(F.lower(letter), digits))
        .when(k % 4 == 2, digits).otherwise(F.concat(F.lit(" "), letter, digits)))
    income, expense = _pick(k % 5, INCOME_SPELLINGS), _pick(k % 5, EXPENSE_SPELLINGS)
    kind = F.when(k % 53 == 52, "Otro").when(F.col("tipo") == "Gasto", expense).otherwise(income)
    segment = F.col("segment")
    category = (
        F.when(k % 3 == 0, segment).when(k % 3 == 1, F.lower(segment))
        .otherwise(F.concat(F.lit(" "), F.initcap(segment), F.lit("  "))))
    state = F.lit(None).cast("string")
    for canonical, spellings in STATUS_SPELLINGS.items():
        state = F.when(F.col("estado_factura") == canonical, _pick(k % 3, spellings)).otherwise(state)
    state = F.when(k % 59 == 58, "En Disputa").otherwise(state)
    total = (
        F.when(k % 45 == 44, "12-34")
        .when(k % 44 == 43, F.concat(F.lit("-"), _amount_text(F.col("total_c"), F.lit(2))))
        .otherwise(_amount_text(F.col("total_c"), (k + 2) % 7)))
    pending = (
        F.when(k % 5 == 1, F.format_number(F.col("total_c") / 100.0, 2)).when(k % 5 == 2, "0")
        .when(k % 5 == 3, "n/d").otherwise(""))
    return _base(spark, sf_dir).select(
        "_row_number",
        number.alias("num_factura"), date.alias("fecha"), supplier.alias("proveedor"),
        tax_id.alias("nif_cif"), kind.alias("tipo"), category.alias("categoria"),
        _amount_text(F.col("total_c") - F.col("iva_c"), k % 7).alias("importe_base"),
        _amount_text(F.col("iva_c"), (k + 1) % 7).alias("iva"),
        total.alias("importe_total"), state.alias("estado_factura"), pending.alias("importe_pendiente"),
    )
