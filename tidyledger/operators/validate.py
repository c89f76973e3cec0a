"""Validation against a table spec, routing, counters and proposed corrections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.functions.cleaning import has_amount_text
from tidyledger.operators.clean import CORRUPT, LOG, RAW, ROW, clean, row_key
from tidyledger.schema import TableSpec

STATUS, ERRORS = "_status", "_errors"
ERROR_TYPE = "struct<field:string,message:string,value:string>"


def _typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Give every spec field its type; text that the rules left alone is parsed here."""
    raw_names = df.schema[RAW].dataType.names if RAW in df.columns else []
    out = {}
    for f in spec.fields:
        if f.name not in df.columns:
            out[f.name] = F.lit(None).cast(f.spark_type)
        elif df.schema[f.name].dataType.typeName() == "string" and f.type not in ("str", "enum"):
            out[f.name] = f.parse(F.col(f"`{f.name}`"))
        elif f.type == "date" and f.name in raw_names:
            out[f.name] = F.coalesce(F.col(f"`{f.name}`"), f.parse(F.col(f"{RAW}.`{f.name}`")))
        elif df.schema[f.name].dataType != f.spark_type:
            out[f.name] = F.col(f"`{f.name}`").cast(f.spark_type)
    return df.withColumns(out) if out else df


def _raw_of(df: DataFrame, name: str) -> Column:
    if RAW in df.columns and name in df.schema[RAW].dataType.names:
        return F.col(f"{RAW}.`{name}`")
    # No raw text kept: a value speaks for itself, its absence means the field is missing.
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def validate(df: DataFrame, spec: TableSpec, ragged: str = "keep") -> DataFrame:
    """Add ``_errors`` (all of them) and ``_status`` (valid / invalid); types are those of the spec.

    Rows the CSV reader found too short are invalid; ``ragged="reject"`` also
    refuses rows with surplus cells.
    """
    raw = {f.name: _raw_of(df, f.name) for f in spec.fields}
    no_digits = {}
    if "importe_pendiente" in raw and RAW in df.columns:
        # An open amount without digits was read as "none given", not as a bad number.
        no_digits["importe_pendiente"] = ~has_amount_text(raw["importe_pendiente"])
    df = _typed(df, spec)
    found = []
    for f in spec.fields:
        text = raw[f.name]
        if f.name in no_digits:
            text = F.when(~no_digits[f.name] | (text == ""), text)
        message = f.error(F.col(f"`{f.name}`"), text)
        found.append(F.when(message.isNotNull(), F.struct(
            F.lit(f.name).alias("field"), message.alias("message"), raw[f.name].alias("value"))))
    if CORRUPT in df.columns:
        wanted = "true" if ragged == "reject" else "_missing_cells"
        if ragged == "reject" or "_missing_cells" in df.columns:
            bad = F.col(CORRUPT).isNotNull() if wanted == "true" else F.col("_missing_cells")
            found.append(F.when(bad, F.struct(
                F.lit("").alias("field"), F.lit("missing columns" if wanted != "true" else "ragged row").alias("message"),
                F.col(CORRUPT).alias("value"))))
    errors = F.array_compact(F.array(*[e.cast(ERROR_TYPE) for e in found]))
    return df.withColumn(ERRORS, errors).withColumn(
        STATUS, F.when(F.size(ERRORS) == 0, words.STATUS_VALID).otherwise(words.STATUS_INVALID))


class Routed(NamedTuple):
    clean: DataFrame
    rejected: DataFrame
    review: DataFrame


def split(df: DataFrame) -> Routed:
    """Clean, rejected and to-be-reviewed rows. Write or persist ``df`` before using more than one."""
    status = F.col(STATUS)
    return Routed(
        df.filter(status.isin(words.STATUS_VALID, words.STATUS_CORRECTED)),
        df.filter(status == words.STATUS_INVALID),
        df.filter(status == words.STATUS_REVIEW),
    )


def error_log(df: DataFrame) -> DataFrame:
    """One row per rejected record."""
    return df.filter(F.col(STATUS) == words.STATUS_INVALID).select(row_key(df), ERRORS, LOG)


def error_log_long(df: DataFrame) -> DataFrame:
    """One row per error of a rejected record."""
    key = row_key(df)
    return error_log(df).select(key, F.explode(ERRORS).alias("e")).select(key, "e.field", "e.message", "e.value")


def silver_stats(df: DataFrame) -> DataFrame:
    """Record counters of a validated table, in one pass."""
    status = F.col(STATUS)

    def n(*which: str) -> Column:
        return F.count_if(status.isin(*which))

    out = df.agg(
        F.count("*").alias("total_records"),
        n(words.STATUS_VALID, words.STATUS_CORRECTED).alias("valid_records"),
        n(words.STATUS_INVALID).alias("invalid_records"),
        n(words.STATUS_CORRECTED).alias("corrected_records"),
        n(words.STATUS_REVIEW).alias("review_records"),
    )
    return out.withColumn("valid_rate", F.when(
        F.col("total_records") > 0, F.col("valid_records") / F.col("total_records")).otherwise(F.lit(0.0)))


# --- corrections -----------------------------------------------------------

REPLY_TYPE = (
    "corrected_fields map<string,string>, "
    "corrections array<struct<field:string,original:string,corrected:string,reasoning:string>>, "
    "confidence double, reasoning string"
)


def parse_corrections(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Read correction replies: the JSON object between the first and the last brace.

    ``success`` is false where there is none or it cannot be read.
    """
    body = F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)
    parsed = df.withColumn("_reply", F.when(body != "", F.from_json(
        body, REPLY_TYPE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})))
    ok = F.col("_reply").isNotNull() & F.col("_reply._bad").isNull()
    return parsed.withColumns({
        "success": ok,
        "corrected_fields": F.when(ok, F.coalesce("_reply.corrected_fields", F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")))),
        "corrections": F.when(ok, F.coalesce("_reply.corrections", F.array().cast(
            "array<struct<field:string,original:string,corrected:string,reasoning:string>>"))),
        "confidence": F.when(ok, F.coalesce("_reply.confidence", F.lit(0.5))),
        "reasoning": F.when(ok, F.coalesce("_reply.reasoning", F.lit(""))),
    }).drop("_reply")


def apply_corrections(
    df: DataFrame, corrections: DataFrame, spec: TableSpec, threshold: float = 0.7
) -> DataFrame:
    """Overlay proposed field values on rejected rows and validate those again.

    ``corrections`` has the row key, ``corrected_fields``, ``corrections`` and
    ``confidence``; of several proposals for a record the most confident counts. Rows that still fail keep
    their old values and errors; those that pass go to review when the
    confidence is below the threshold, and else count as corrected.
    Only the rejected rows take part in the join.
    """
    routed = split(df)
    key = row_key(df, corrections)
    # Only proposals for rejected rows are looked at, and parsed where parsing comes before.
    proposal = corrections.join(routed.rejected.select(key), key, "left_semi")
    if "success" in corrections.columns:
        proposal = proposal.filter("success")
    order = F.struct("confidence", F.to_json("corrected_fields"))
    proposal = proposal.groupBy(key).agg(F.max_by(F.struct("corrected_fields", "corrections", "confidence"), order).alias(
        "p")).select(key, "p.*")
    joined = routed.rejected.join(proposal, key, "left")
    overlaid = {}
    for f in spec.fields:
        text = F.col("corrected_fields")[f.name]
        old = F.col(f"`{f.name}`")
        given = F.map_contains_key("corrected_fields", F.lit(f.name))
        overlaid[f.name] = F.when(given, f.parse(text)).otherwise(old)
    raw_names = df.schema[RAW].dataType.names
    old_raw = {n: F.col(f"{RAW}.`{n}`") for n in raw_names}
    new_raw = F.struct(*[
        F.when(F.map_contains_key("corrected_fields", F.lit(n)), F.col("corrected_fields")[n])
        .otherwise(old_raw.get(n, F.col(f"`{n}`").cast("string"))).alias(n)
        for n in dict.fromkeys([*raw_names, *spec.names])])
    again = validate(
        joined.withColumns({"_old": F.struct(*[F.col(f"`{n}`") for n in spec.names], RAW, ERRORS)})
        .withColumns(overlaid | {RAW: new_raw}).drop(ERRORS, STATUS), spec)
    passed = F.col("corrected_fields").isNotNull() & (F.col(STATUS) == words.STATUS_VALID)
    notes = F.transform("corrections", lambda c: F.concat(
        F.lit("Correction: "), c["field"], F.lit(": '"), F.coalesce(c["original"], F.lit("")),
        F.lit("' -> '"), F.coalesce(c["corrected"], F.lit("")), F.lit("'")))
    result = again.withColumn("_passed", F.coalesce(passed, F.lit(False))).select(
        *[F.when(F.col("_passed"), F.col(f"`{c}`")).otherwise(F.col(f"_old.`{c}`")).alias(c)
          if c in spec.names else
          F.when(F.col("_passed"), F.concat(LOG, F.coalesce(notes, F.array().cast("array<string>"))))
          .otherwise(F.col(LOG)).alias(LOG) if c == LOG else
          F.when(F.col("_passed"), F.array().cast(f"array<{ERROR_TYPE}>")).otherwise(F.col("_old._errors")).alias(ERRORS)
          if c == ERRORS else
          F.when(~F.col("_passed"), words.STATUS_INVALID)
          .when(F.col("confidence") < threshold, words.STATUS_REVIEW)
          .otherwise(words.STATUS_CORRECTED).alias(STATUS) if c == STATUS else
          F.col(f"_old.{RAW}").alias(RAW) if c == RAW else F.col(f"`{c}`")
          for c in df.columns])
    return df.filter(F.col(STATUS) != words.STATUS_INVALID).unionByName(result)


def clean_and_validate(df: DataFrame, spec: TableSpec, extra_rules=(), ragged: str = "keep") -> DataFrame:
    return validate(clean(df, extra_rules=extra_rules), spec, ragged)
