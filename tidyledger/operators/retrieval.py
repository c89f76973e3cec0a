"""Data side of question answering: documents, filters, neighbours, contexts, conversations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidyledger.functions import text as fn, vocabulary as words
from tidyledger.operators.analytics import Gold, balance, top_k, unique_values
from tidyledger.operators.clean import ROW, row_key
from tidyledger.operators.search import nearest

__all__ = [
    "build_documents", "context_text", "conversation_tail", "index_documents", "nearest", "question_queries", "record_documents",
    "statistics_documents", "stats_context", "summary_documents", "supporting"]

METADATA = ("doc_type", "source_field", "record_id", "tipo", "categoria", "proveedor", "estado_factura", "fecha",
            "importe_base", "iva", "importe_total", "content")


def _euro(value: Column | str) -> Column:
    """Two places, rounding half to even on the exact value (``format_string`` rounds half up)."""
    two = F.call_function("format_number", F.coalesce(value, F.lit(0.0)), F.lit("0.00"))
    return F.concat(two, F.lit(" EUR"))


def _or_na(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def record_documents(df: DataFrame) -> DataFrame:
    content = _lines(
        F.concat(F.lit("Invoice "), _or_na("num_factura"), F.lit(":")),
        _labelled("- Date: ", _or_na("fecha")), _labelled("- Supplier: ", _or_na("proveedor")),
        _labelled("- Type: ", _or_na("tipo")), _labelled("- Category: ", _or_na("categoria")),
        _labelled("- Base amount: ", _euro(F.col("importe_base"))), _labelled("- VAT: ", _euro(F.col("iva"))),
        _labelled("- Total: ", _euro(F.col("importe_total"))), _labelled("- Status: ", _or_na("estado_factura")))
    return df.select(
        F.lit("record").alias("doc_type"), F.lit(None).cast("string").alias("source_field"),
        F.coalesce("num_factura", F.col(ROW).cast("string")).alias("record_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
          for c in ("tipo", "categoria", "proveedor", "estado_factura", "fecha")],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("importe_base", "iva", "importe_total")],
        content.alias("content"))


def _other_documents(df: DataFrame, kind: str, field: Column, content: Column) -> DataFrame:
    typed = {"importe_base": "double", "iva": "double", "importe_total": "double"}
    values = {"doc_type": F.lit(kind), "source_field": field, "content": content}
    return df.select(*[values.get(c, F.lit(None).cast(typed.get(c, "string"))).alias(c) for c in METADATA])


def statistics_documents(statistics: DataFrame) -> DataFrame:
    content = _lines(
        F.concat(F.lit("Statistics for "), F.col("field"), F.lit(":")),
        F.concat(F.lit("- Count: "), F.col("count").cast("string"), F.lit(" records")),
        *[_labelled(f"- {label}: ", _euro(F.col(c))) for label, c in (
            ("Sum", "sum"), ("Average", "mean"), ("Median", "median"), ("Min", "min"), ("Max", "max"), ("Std Dev", "std"))])
    return _other_documents(statistics, "statistics", F.col("field"), content)


def summary_documents(df: DataFrame) -> DataFrame:
    """The data set in one text, whatever its size; categories in order of appearance."""
    whole = balance(df)
    # The balance is one row, so it enters as a single value and not by a join.
    figures = whole.select(F.struct(*whole.columns)).scalar()
    seen = df.groupBy(F.coalesce("categoria", F.lit("Unknown")).alias("categoria")).agg(
        F.count("*").alias("n"), F.min(row_key(df)).alias("first"))
    listed = seen.agg(
        F.sort_array(F.collect_list(F.struct("first", "categoria", "n"))).alias("items"))
    names = F.array_join(F.transform("items", lambda c: F.concat(
        c["categoria"], F.lit(" ("), c["n"].cast("string"), F.lit(")"))), ", ")
    joined = listed.withColumn("b", figures)

    def side(label: str, name: str) -> Column:
        return F.concat(F.lit(f"- {label} records: "), F.col(f"b.{name}_count").cast("string"), F.lit(", total: "),
                        _euro(F.col(f"b.{name}_total")))

    content = _lines(
        "Dataset Summary:", _labelled("- Total records: ", F.col("b.records").cast("string")),
        side("Income (Ingreso)", "income"), side("Expense (Gasto)", "expense"),
        _labelled("- Net balance: ", _euro(F.col("b.net"))), F.concat(F.lit("- Categories: "), names, F.lit("\n")))
    return _other_documents(joined, "summary", F.lit(None).cast("string"), content)


def index_documents(indexes: DataFrame, k: int = 10) -> DataFrame:
    """One text per index field: number of values and the k most frequent ones."""
    best = top_k(indexes, k).groupBy("field").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "count"))).alias("items"))
    entries = F.transform("items", lambda e: F.concat(
        F.lit("  - "), F.coalesce(e["key"], F.lit("None")), F.lit(": "), e["count"].cast("string"), F.lit(" records")))
    content = _lines(
        F.concat(F.lit("Index for "), F.col("field"), F.lit(":")),
        F.concat(F.lit("- "), F.col("unique_values").cast("string"), F.lit(" unique values")),
        "- Top values:", F.array_join(entries, "\n"))
    return _other_documents(best.join(unique_values(indexes), "field"), "index", F.col("field"), content)


def build_documents(gold: Gold) -> DataFrame:
    """One text per record, statistic, data set and index, each with its metadata."""
    return reduce(DataFrame.unionByName, [
        record_documents(gold.records), statistics_documents(gold.statistics), summary_documents(gold.records),
        index_documents(gold.indexes)])


def stats_context(gold: Gold, total: DataFrame | None = None) -> DataFrame:
    """All statistics, segments and index counts as text lines.

    One row per line with the columns to sort by (section, field, order_key,
    key, line_no), so the text may have any number of lines;
    :func:`context_text` puts them in order.
    """
    def rows(df: DataFrame, section: int, field: Column, order: Column, key: Column, texts: Sequence[Column]) -> DataFrame:
        numbered = F.posexplode(F.array_compact(F.array(*texts))).alias("line_no", "line")
        return df.select(F.lit(section).alias("section"), field.alias("field"), order.alias("order_key"),
                         key.alias("key"), numbered)

    none, zero = F.lit("").alias("x"), F.lit(0).cast("long")
    low, high = (F.lit(sign * 2**62).cast("long") for sign in (-1, 1))
    count = gold.records.agg(F.count("*").alias("n"))
    head = rows(count, 0, none, zero, none, [
        F.lit("## PRECOMPUTED STATISTICS (COMPLETE DATASET):"),
        F.concat(F.lit("Total records in dataset: "), F.col("n").cast("string")), F.lit("")])
    middle = rows(count, 2, none, zero, none, [F.lit("## SEGMENTED STATISTICS (BY CATEGORY):"), F.lit("")])
    stats = rows(gold.statistics, 1, F.col("field"), zero, none, [
        F.concat(F.lit("### "), F.col("field"), F.lit(":")),
        _labelled("  - Count: ", F.col("count").cast("string")),
        *[_labelled(f"  - {label}: ", _euro(F.col(c))) for label, c in (
            ("Sum", "sum"), ("Mean", "mean"), ("Median", "median"), ("Min", "min"), ("Max", "max"), ("Std Dev", "std"))],
        F.lit("")])
    metrics = [c for c in gold.segments.columns if c not in ("segment_field", "segment", "count")]
    segments = rows(gold.segments, 2, F.col("segment_field"), -F.col("count"), F.col("segment"), [
        F.concat(F.lit("  "), F.col("segment"), F.lit(":")),
        F.concat(F.lit("    - Count: "), F.col("count").cast("string"), F.lit(" records")),
        *[F.when(F.col(m).isNotNull(), F.concat(F.lit(f"    - {m}: "), _euro(F.col(m)))) for m in metrics]])
    segment_fields = gold.segments.select("segment_field").distinct()
    titles = rows(segment_fields, 2, F.col("segment_field"), low, none,
                  [F.concat(F.lit("### Statistics by "), F.col("segment_field"), F.lit(":"))])
    segment_ends = rows(segment_fields, 2, F.col("segment_field"), high, none, [F.lit("")])
    shown = F.coalesce("key", F.lit("None"))
    keys = rows(gold.indexes, 3, F.col("field"), -F.col("count"), F.coalesce("key", F.lit("\U0010ffff")), [
        F.concat(F.lit("  - "), shown, F.lit(": "), F.col("count").cast("string"), F.lit(" records"))])
    unique = unique_values(gold.indexes)
    index_heads = rows(unique, 3, F.col("field"), low, none, [
        F.concat(F.lit("### Index: "), F.col("field")),
        F.concat(F.lit("  - Unique values: "), F.col("unique_values").cast("string"))])
    index_ends = rows(unique, 3, F.col("field"), high, none, [F.lit("")])
    return reduce(DataFrame.unionByName, [
        head, stats, middle, titles, segments, segment_ends, index_heads, keys, index_ends])


def _place(names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("field"))


def context_text(lines: DataFrame) -> DataFrame:
    """The lines of :func:`stats_context` in reading order."""
    place = (F.when(F.col("section") == 1, _place(words.MONEY_FIELDS))
             .when(F.col("section") == 2, _place(words.SEGMENT_FIELDS)).otherwise(_place(words.INDEX_FIELDS)))
    return lines.orderBy("section", place, "field", "order_key", "key", "line_no").select("line")


# --- search ----------------------------------------------------------------


def question_queries(questions: DataFrame, question: str, total_documents: int, data_limit: int) -> DataFrame:
    """Add kind, k and the filter columns a question implies, ready for :func:`nearest`.

    Questions for plain data get at most ``data_limit`` documents. Those for statistics
    are about all of them and are answered from the statistics; their k is the number of documents.
    """
    text = F.col(question)
    kind = fn.classify_question(text)
    return questions.withColumns({
        "kind": kind, "k": fn.neighbours_wanted(kind, F.lit(total_documents), data_limit).cast("int"),
        "estado_factura": fn.question_status(text), "tipo": fn.question_type(text), "doc_type": F.lit("record")})


def supporting(found: DataFrame, limit: int = 5, length: int = 200) -> DataFrame:
    """First record documents per query, cut to ``length`` characters.

    ``found`` has query_id, rank, doc_type, record_id and content.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        found.filter(F.col("doc_type") == "record").withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("query_id", "position", F.lit("record").alias("type"), "record_id",
                F.left("content", F.lit(length)).alias("content")))


def conversation_tail(messages: DataFrame, n: int = 10, conv: str = "conv_id", turn: str = "turn",
                      role: str = "role", text: str = "text") -> DataFrame:
    """Last n messages of each conversation as one text; every role but user shows as Assistant."""
    latest = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    line = F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.col(text))
    last = messages.select(conv, turn, line.alias("line")).withColumn("_rank", F.row_number().over(latest)).filter(
        F.col("_rank") <= n)
    return last.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "line"))).alias("lines")).select(
        conv, F.size("lines").cast("long").alias("messages"),
        F.array_join(F.transform("lines", lambda m: m["line"]), "\n").alias("history"))
