"""Text functions of the question-answering side: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.functions.cleaning import strip_ws


def redact(c: Column) -> Column:
    """Replace personal data and secrets by tags, in the fixed order of the patterns."""
    for pattern, tag in words.REDACTIONS:
        c = F.regexp_replace(c, "(?U)" + pattern, tag)
    return c


def sanitize(c: Column, all_patterns: bool = False) -> Column:
    """Filter prompt injections.

    Only the first pattern that occurs is replaced (everywhere), and then the
    text is not stripped; ``all_patterns=True`` replaces every pattern.
    """
    if all_patterns:
        for pattern in words.INJECTIONS:
            c = F.regexp_replace(c, "(?iU)" + pattern, "[FILTERED]")
        return c
    result = strip_ws(c)
    for pattern in reversed(words.INJECTIONS):
        flagged = "(?iU)" + pattern
        result = F.when(c.rlike(flagged), F.regexp_replace(c, flagged, "[FILTERED]")).otherwise(result)
    return result


def too_long(c: Column, max_length: int = 2000) -> Column:
    """Flag for texts :func:`sanitize` must not pass on."""
    return F.length(c) > max_length


def mask(c: Column, visible: int = 4) -> Column:
    """First ``visible`` characters and ``***``; null and short values become ``***``."""
    return F.when(F.length(c) > visible, F.concat(F.left(c, F.lit(visible)), F.lit("***"))).otherwise(
        F.lit("***")
    )


def _contains_any(c: Column, phrases) -> Column:
    found = c.contains(phrases[0])
    for phrase in phrases[1:]:
        found = found | c.contains(phrase)
    return found


def classify_question(c: Column) -> Column:
    """comparison, statistics, filter or data."""
    text = F.lower(c)
    kind = F.lit("data")
    for name, phrases in reversed(list(words.QUESTION_WORDS.items())):
        kind = F.when(_contains_any(text, phrases), F.lit(name)).otherwise(kind)
    return F.when(c.isNotNull(), kind)


def question_status(c: Column) -> Column:
    """Invoice state a question asks for, or null.

    ``parcialmente`` is tested first and spelled like the data, so questions
    about partly paid invoices find them (a recorded change of behaviour).
    """
    text = F.lower(c)
    return (
        F.when(text.contains("parcialmente"), F.lit("Parcialmente Pagada"))
        .when(text.contains("pendiente"), F.lit("Pendiente"))
        .when(text.contains("pagada"), F.lit("Pagada"))
        .when(text.contains("vencida"), F.lit("Vencida"))
    )


def question_type(c: Column) -> Column:
    """Ingreso, Gasto or null."""
    text = F.lower(c)
    return F.when(text.contains("ingreso"), F.lit("Ingreso")).when(text.contains("gasto"), F.lit("Gasto"))


def question_filter(c: Column) -> Column:
    """Struct of the conditions a question puts on the documents."""
    return F.struct(
        question_status(c).alias("estado_factura"),
        question_type(c).alias("tipo"),
        F.lit("record").alias("doc_type"),
    )


def neighbours_wanted(kind: Column, total: Column, data_limit: int) -> Column:
    """How many documents a question needs: all of them, or at most ``data_limit`` for plain data."""
    return F.when(kind == "data", F.least(total, F.lit(data_limit))).otherwise(total)


def needs_clarification(c: Column) -> Column:
    return F.coalesce(_contains_any(F.lower(c), words.UNCLEAR_PHRASES), F.lit(False))


def answer_confidence(c: Column) -> Column:
    return F.when(needs_clarification(c), F.lit(0.6)).otherwise(F.lit(0.9))
