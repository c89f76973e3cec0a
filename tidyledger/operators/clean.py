"""Cleaning a whole table: rules per field, derived amounts, and a log per row.

All rules of a table are one chain of projections. Each rule step reads the
columns of the step before by name, so Catalyst evaluates every step once; there
is no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidyledger.functions import cleaning as fn, vocabulary as words

ROW, DATASET, RAW, LOG, CORRUPT = "_row_number", "_dataset_id", "_raw", "_cleaning_log", "_corrupt_record"
# The file of a row, and its number over all files of a read; ROW counts within the file.
FILE, ROW_ID = "_file", "_row_id"


@dataclass(frozen=True)
class Rule:
    """A text rule: which fields it applies to, the new value, and the log line.

    ``expr`` may be any Column -> Column function, a pandas UDF included.
    ``log`` gets (old value, new value, field name); it is kept where they differ.
    """

    name: str
    applies_to: Callable[[str], bool]
    expr: Callable[[Column], Column]
    log: Callable[[Column, Column, str], Column]


def _change(label: str) -> Callable[[Column, Column, str], Column]:
    def log(old: Column, new: Column, field: str) -> Column:
        return F.concat(F.lit(f"{label} in {field}: '"), fn.strip_ws(old), F.lit("' -> '"), new, F.lit("'"))

    return log


def _on(*fields: str) -> Callable[[str], bool]:
    return lambda name: name in fields


TEXT_RULES: tuple[Rule, ...] = (
    Rule("whitespace",
         lambda n: n in words.WHITESPACE_FIELDS or n.endswith(words.WHITESPACE_SUFFIX),
         fn.strip_ws, lambda old, new, f: F.lit(f"Stripped whitespace from {f}")),
    Rule("type", _on("tipo"), fn.normalize_type, _change("Corrected word")),
    Rule("status", _on("estado_factura"), fn.normalize_status, _change("Corrected word")),
    Rule("tax_id", _on("nif_cif"), fn.normalize_tax_id, _change("Normalized tax id")),
    Rule("invoice_number", _on("num_factura"), fn.normalize_invoice_number, _change("Normalized invoice number")),
    Rule("title_case", lambda n: n in words.TITLE_FIELDS, fn.title_case, _change("Normalized case")),
)


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def small_methods(df: DataFrame) -> None:
    """Have Spark split the generated code of long chains of rules.

    The JVM interprets methods of more than 8,000 bytes and never compiles them; by default Spark makes one of up to 64 KB
    of a whole stage. The limit holds when the rows are computed, so it stays set; another choice of the user stays too.
    """
    conf = df.sparkSession.conf
    if conf.get(METHOD_LIMIT) == "65535":
        conf.set(METHOD_LIMIT, "8000")


def row_key(*tables: DataFrame) -> str:
    """The column that tells rows apart: the number over all files where every table has it."""
    return ROW_ID if all(ROW_ID in t.columns for t in tables) else ROW


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


_NO_LINES = "array<string>"


def _logged(logs: Sequence[Column], has_log: bool) -> Column:
    """``_cleaning_log`` with the lines that are not null appended."""
    new = F.array_compact(F.array(*logs)) if logs else F.array().cast(_NO_LINES)
    return (F.concat(F.col(LOG), new) if has_log else new).alias(LOG)


def _steps(rules: Sequence[Rule], columns: Sequence[str]) -> list[list[tuple[str, Rule]]]:
    """Rules in order, gathered into steps in which every column changes at most once."""
    steps: list[list[tuple[str, Rule]]] = []
    last: dict[str, int] = {}
    floor = 0
    for rule in rules:
        fields = [c for c in columns if rule.applies_to(c.lower())]
        if not fields:
            continue
        # Log lines keep the order of the rules, so a rule never moves before an earlier one.
        floor = max([floor, *(last.get(c, -1) + 1 for c in fields)])
        while len(steps) <= floor:
            steps.append([])
        steps[floor] += [(c, rule) for c in fields]
        last.update({c: floor for c in fields})
    return steps


def apply_text_rules(df: DataFrame, rules: Sequence[Rule] = TEXT_RULES) -> DataFrame:
    """Run text rules over every text column they apply to, in order.

    Each step is two projections: the new values, then the columns replaced and
    the log lines appended. The second one is compiled on its own, which keeps
    every generated method small enough for the JVM to optimise.
    """
    small_methods(df)
    columns, types = df.columns, df.schema
    text = [c for c in _data_columns(df) if types[c].dataType.typeName() == "string"]
    for step in _steps(rules, text):
        old = {c: F.col(f"`{c}`") for c in columns}
        new = {c: F.col(f"`_new_{c}`") for c, _ in step}
        df = df.select("*", *[rule.expr(old[c]).alias(f"_new_{c}") for c, rule in step])
        lines = [F.when(old[c] != new[c], rule.log(old[c], new[c], c)) for c, rule in step]
        has_log = LOG in columns
        df = df.select(*[new[c].alias(c) if c in new else old[c] for c in columns if c != LOG], _logged(lines, has_log))
        columns = [*[c for c in columns if c != LOG], LOG]
    return df if LOG in columns else df.withColumn(LOG, _logged([], False))


def parse_amounts_and_dates(df: DataFrame) -> DataFrame:
    """Turn amount and date text into numbers and dates, with log lines; typed columns stay as they are."""
    small_methods(df)
    columns, types = df.columns, df.schema
    text = [c for c in _data_columns(df) if types[c].dataType.typeName() == "string"]
    amounts = [c for c in text if c.lower() in words.CURRENCY_FIELDS]
    dates = [c for c in text if c.lower() in words.DATE_FIELDS]
    old = {c: F.col(f"`{c}`") for c in columns}
    new = {c: F.col(f"`_new_{c}`") for c in amounts + dates}
    df = df.select("*", *[fn.normalize_currency(old[c]).alias(f"_new_{c}") for c in amounts],
                   *[fn.normalize_date(old[c]).alias(f"_new_{c}") for c in dates])
    lines = []
    for c in amounts + dates:
        kind, shown = ("date" if c in dates else "currency"), new[c].cast("string")
        lines.append(F.when(old[c] != shown, F.concat(F.lit(f"Normalized {kind} in {c}: '"), old[c], F.lit("' -> "), shown)))
    return df.select(*[new[c].alias(c) if c in new else old[c] for c in columns if c != LOG], _logged(lines, LOG in columns))


def derive_pending(df: DataFrame) -> DataFrame:
    """Fill a missing open amount from state and total; the column is added when absent.

    An unreadable total counts as 0; a total that is not there at all (blank
    text without digits) leaves the open amount missing.
    """
    if not {"estado_factura", "importe_total"} <= set(df.columns):
        return df
    raw_names = df.schema[RAW].dataType.names if RAW in df.columns else []

    def unreadable(name: str) -> Column:
        """The field has text that is no number, so it counts as given."""
        if name not in raw_names:
            return F.lit(False)
        return F.col(name).isNull() & F.coalesce(fn.has_amount_text(F.col(f"{RAW}.{name}")), F.lit(False))

    pending = F.lit(None).cast("double")
    gap = F.lit(True)
    if "importe_pendiente" in df.columns:
        pending = F.col("importe_pendiente")
        gap = (pending.isNull() & ~unreadable("importe_pendiente")) | F.isnan(pending)
    total_given = F.col("importe_total").isNotNull() | unreadable("importe_total")
    if "importe_total" in raw_names:
        total_given = total_given | (F.col(f"{RAW}.importe_total") == "")
    fill = F.coalesce(gap & total_given, F.lit(False))
    value = fn.pending_amount(F.col("estado_factura"), F.col("importe_total"))
    columns = [c for c in df.columns if c not in ("importe_pendiente", LOG)]
    has_log = LOG in df.columns
    df = df.select("*", fill.alias("_fill"), F.when(fill, value).otherwise(pending).alias("_value"))
    line = F.when(F.col("_fill"), F.concat(
        F.lit("Calculated importe_pendiente="), F.call_function("format_number", F.col("_value"), F.lit("0.00")),
        F.lit(" (estado="), F.coalesce(F.col("estado_factura"), F.lit("")), F.lit(")")))
    return df.select(*[F.col(f"`{c}`") for c in columns], F.col("_value").alias("importe_pendiente"),
                     _logged([line], has_log))


def warn_inconsistent(df: DataFrame) -> DataFrame:
    if not {"estado_factura", "importe_pendiente"} <= set(df.columns):
        return df
    warnings = fn.consistency_warnings(F.col("estado_factura"), F.col("importe_pendiente"))
    return df.withColumn(LOG, F.concat(F.col(LOG), F.coalesce(warnings, F.array().cast(_NO_LINES))))


def clean(df: DataFrame, rules: Sequence[Rule] = TEXT_RULES, extra_rules: Sequence[Rule] = ()) -> DataFrame:
    """All-text table in, cleaned table out.

    Adds ``_raw`` (the text every field came from) and ``_cleaning_log``.
    ``extra_rules`` run after the built-in text rules.
    """
    text = _data_columns(df)
    df = df.withColumn(RAW, F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in text]))
    df = apply_text_rules(df, (*rules, *extra_rules))
    return warn_inconsistent(derive_pending(parse_amounts_and_dates(df)))
