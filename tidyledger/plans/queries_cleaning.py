"""Registered queries: cleaning rules and validation over the whole dirty invoice table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidyledger.functions import cleaning as fn
from tidyledger.operators import clean as C, validate as V
from tidyledger.operators.analytics import segmented_statistics
from tidyledger.plans.ledger import dirty_invoices
from tidyledger.schema import INVOICE_SPEC, TableSpec
from tidyledger.sources.scratch import stored

ALL = ("_row_number", *INVOICE_SPEC.names)


def _validated(spark, sf_dir) -> DataFrame:
    return V.clean_and_validate(dirty_invoices(spark, sf_dir), INVOICE_SPEC)


def stored_by_status(df: DataFrame) -> DataFrame:
    """Validated rows written once, one folder per status, so each route reads its own folder."""
    return stored(df, "validated", V.STATUS)


def clean_text_fields(spark, sf_dir):
    """Stripping, words, tax ids, invoice numbers and title case, in rule order."""
    fields = ["num_factura", "proveedor", "nif_cif", "tipo", "categoria", "estado_factura"]
    return C.apply_text_rules(dirty_invoices(spark, sf_dir).select("_row_number", *fields)).drop(C.LOG)


def clean_currency(spark, sf_dir):
    return dirty_invoices(spark, sf_dir).select(
        "_row_number",
        *[fn.normalize_currency(F.col(c)).alias(c) for c in ("importe_base", "iva", "importe_total")],
        fn.currency_unreadable(F.col("importe_total")).alias("total_unreadable"))


def clean_dates(spark, sf_dir):
    return dirty_invoices(spark, sf_dir).select("_row_number", fn.normalize_date(F.col("fecha")).alias("fecha"))


def clean_table(spark, sf_dir):
    return C.clean(dirty_invoices(spark, sf_dir)).select(*ALL)


def strip_whitespace(spark, sf_dir):
    return dirty_invoices(spark, sf_dir).select(
        "_row_number", fn.strip_ws(F.col("proveedor")).alias("proveedor"),
        fn.strip_ws(F.col("categoria")).alias("categoria"))


def enum_words(spark, sf_dir):
    df = dirty_invoices(spark, sf_dir).select(
        fn.normalize_type(F.col("tipo")).alias("tipo"),
        fn.normalize_status(F.col("estado_factura")).alias("estado_factura"))
    return df.groupBy("tipo", "estado_factura").agg(F.count("*").alias("n"))


def derive_pending(spark, sf_dir):
    return C.clean(dirty_invoices(spark, sf_dir)).select("_row_number", "estado_factura", "importe_pendiente")


def consistency_warnings(spark, sf_dir):
    cleaned = C.clean(dirty_invoices(spark, sf_dir))
    warnings = fn.consistency_warnings(F.col("estado_factura"), F.col("importe_pendiente"))
    return cleaned.select("_row_number", F.size(warnings).cast("long").alias("n_warnings"))


def custom_rule(spark, sf_dir):
    shout = C.Rule("upper", lambda n: n == "categoria", F.upper, lambda old, new, f: F.lit(f"Upper case {f}"))
    snake = C.Rule("snake", lambda n: n == "proveedor", lambda c: F.replace(c, F.lit(" "), F.lit("_")),
                   lambda old, new, f: F.lit(f"No blanks in {f}"))
    cleaned = C.clean(dirty_invoices(spark, sf_dir), extra_rules=[shout, snake])
    return cleaned.groupBy("categoria", "proveedor").agg(F.count("*").alias("n"))


def validate_table(spark, sf_dir):
    return _validated(spark, sf_dir).select(
        "_row_number", F.col("_status").alias("status"), F.size("_errors").cast("long").alias("n_errors"),
        F.array_join(F.transform("_errors", lambda e: e["field"]), ",").alias("fields"))


def dynamic_spec(spark, sf_dir):
    """Constraints compiled from a plain dictionary, both type spellings."""
    spec = TableSpec.from_dict({"name": "Short", "fields": [
        {"name": "num_factura", "type": "string", "max_length": 13},
        {"name": "importe_total", "type": "float", "le": 250000},
        {"name": "estado_factura", "type": "enum", "allowed_values": ["Pagada", "Pendiente", "Vencida"]},
        {"name": "codigo", "type": "integer"},
    ]})
    cleaned = C.clean(dirty_invoices(spark, sf_dir))
    errors = V.validate(cleaned, spec).select(F.explode("_errors").alias("e"))
    return errors.groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message")).agg(
        F.count("*").alias("n"))


def route_records(spark, sf_dir):
    routed = V.split(stored_by_status(_validated(spark, sf_dir)))
    tagged = [df.select(F.lit(name).alias("route"), "_row_number") for name, df in routed._asdict().items()]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("route").agg(
        F.count("*").alias("n"), F.sum(F.col("_row_number") - 2).alias("key_sum"))


def error_log(spark, sf_dir):
    return V.error_log_long(stored_by_status(_validated(spark, sf_dir))).groupBy("field", "message").agg(
        F.count("*").alias("n"), F.min("_row_number").alias("first_row"), F.max("_row_number").alias("last_row"))


def silver_stats(spark, sf_dir):
    stats = V.silver_stats(_validated(spark, sf_dir))
    return stats.withColumn("valid_rate", F.round("valid_rate", 6))


def _replies(df: DataFrame) -> DataFrame:
    """Correction replies for every row: fenced, bare, chatty, without confidence, or no JSON at all."""
    k = F.col("_row_number") - 2
    fields = '{"corrected_fields": {"fecha": "2024-01-15"}, "corrections": [{"field": "fecha", ' \
             '"original": "31/02", "corrected": "2024-01-15", "reasoning": "calendar"}]'
    rest = F.when(k % 6 == 4, "}").when(k % 2 == 0, ', "confidence": 0.9, "reasoning": "looked {odd}"}').otherwise(
        ', "confidence": 0.6, "reasoning": "looked {odd}"}')
    body = F.concat(F.lit(fields), rest)
    reply = (
        F.when(k % 6 == 5, "I cannot help with this row.")
        .when(k % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 6 == 1, F.concat(F.lit("Here you are: "), body, F.lit(" Regards"))).otherwise(body))
    return df.select("_row_number", reply.alias("reply"))


def parse_corrections(spark, sf_dir):
    replies = _replies(dirty_invoices(spark, sf_dir))
    return V.parse_corrections(replies).select(
        "_row_number", "success", F.col("corrected_fields")["fecha"].alias("corrected_fecha"), "confidence",
        F.when(F.col("success"), F.size("corrections").cast("long")).alias("n_corrections"), "reasoning")


def apply_corrections(spark, sf_dir):
    validated = stored_by_status(_validated(spark, sf_dir))
    proposals = V.parse_corrections(_replies(dirty_invoices(spark, sf_dir)))
    fixed = V.apply_corrections(validated, proposals, INVOICE_SPEC, threshold=0.7)
    return fixed.select("_row_number", F.col("_status").alias("status"), "fecha",
                        F.size("_errors").cast("long").alias("n_errors"))


def flagship(spark, sf_dir):
    """Valid invoices after cleaning, with totals per segment."""
    valid = V.split(stored_by_status(_validated(spark, sf_dir))).clean
    return segmented_statistics(valid, scale=3).select(
        "segment_field", "segment", "count", "importe_total_sum", "importe_pendiente_sum")


QUERIES = {f.__name__: f for f in (
    clean_text_fields, clean_currency, clean_dates, clean_table, strip_whitespace, enum_words, derive_pending,
    consistency_warnings, custom_rule, validate_table, dynamic_spec, route_records, error_log, silver_stats,
    parse_corrections, apply_corrections, flagship)}
