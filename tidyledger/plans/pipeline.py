"""The whole way from raw CSV to analytics, with hooks around each layer."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from enum import Enum
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidyledger.functions import vocabulary as words
from tidyledger.operators import analytics as A, clean as C, dedupe as D, validate as V
from tidyledger.schema import INVOICE_SPEC, TableSpec
from tidyledger.sources import store as S
from tidyledger.sources.scratch import new_path, stored


class Signal(Enum):
    """What a hook may return instead of a table."""

    SKIP = "skip"
    ABORT = "abort"


class PipelineAborted(RuntimeError):
    """A hook asked to stop."""


Hook = Callable[[DataFrame], "DataFrame | Signal | None"]
LAYERS = ("bronze", "silver", "gold")


class Hooks:
    """Functions run before and after a layer, in the order they were registered.

    A hook gets the layer's table and returns a new one, None to keep it,
    ``Signal.SKIP`` or ``Signal.ABORT``. After a skip no later hook of that
    phase runs; a skip before a layer leaves the layer empty.
    """

    def __init__(self) -> None:
        self._hooks: dict[tuple[str, str], list[tuple[str, Hook]]] = defaultdict(list)

    def register(self, layer: str, phase: str, fn: Hook, name: str | None = None) -> None:
        if layer not in LAYERS or phase not in ("pre", "post"):
            raise ValueError(f"No such place for a hook: {phase} {layer}")
        self._hooks[layer, phase].append((name or getattr(fn, "__name__", "hook"), fn))

    def unregister(self, layer: str, phase: str, name: str) -> bool:
        before = self._hooks[layer, phase]
        self._hooks[layer, phase] = [h for h in before if h[0] != name]
        return len(self._hooks[layer, phase]) < len(before)

    def names(self, layer: str, phase: str) -> list[str]:
        return [name for name, _ in self._hooks[layer, phase]]

    def clear(self, layer: str | None = None, phase: str | None = None) -> None:
        for place in list(self._hooks):
            if layer in (None, place[0]) and phase in (None, place[1]):
                del self._hooks[place]

    def run(self, layer: str, phase: str, df: DataFrame) -> tuple[DataFrame, bool]:
        """(table, skipped)."""
        for name, fn in self._hooks.get((layer, phase), ()):
            answer = fn(df)
            if answer is Signal.ABORT:
                raise PipelineAborted(f"{layer} layer processing aborted by {phase} hook {name!r}")
            if answer is Signal.SKIP:
                return df, True
            if answer is not None:
                df = answer
        return df, False


def totals_match(tolerance: float = 0.01) -> Hook:
    """Example post-silver hook: log rows whose base and tax do not add up to the total."""
    def check(df: DataFrame) -> DataFrame:
        off = F.abs(F.col("importe_base") + F.col("iva") - F.col("importe_total")) > tolerance
        note = F.when(off, F.lit("WARNING: importe_base + iva is not importe_total"))
        return df.withColumn(C.LOG, F.concat(F.col(C.LOG), F.array_compact(F.array(note))))

    return check


class Silver(NamedTuple):
    validated: DataFrame
    groups: DataFrame | None
    members: DataFrame | None


class PipelineResult(NamedTuple):
    raw: DataFrame
    silver: Silver
    clean: DataFrame
    rejected: DataFrame
    review: DataFrame
    gold: A.Gold
    report: DataFrame


def silver_layer(
    raw: DataFrame, spec: TableSpec = INVOICE_SPEC, rules: Sequence[C.Rule] = C.TEXT_RULES,
    extra_rules: Sequence[C.Rule] = (), dedupe_fields: Sequence[str] = words.DEDUPE_FIELDS,
    corrections: DataFrame | None = None, threshold: float = 0.7, ragged: str = "keep",
) -> Silver:
    """Clean, merge names, validate and correct.

    Cleaned rows are stored once, because counting names and merging them read
    them several times; validated rows are stored by status for the routes.
    """
    cleaned = stored(C.clean(raw, rules, extra_rules), "cleaned")
    groups = members = None
    if any(f in cleaned.columns for f in dedupe_fields):
        merged = D.dedupe(cleaned, dedupe_fields)
        cleaned, groups, members = merged
    validated = stored(V.validate(cleaned, spec, ragged), "validated", V.STATUS)
    if corrections is not None:
        validated = stored(V.apply_corrections(validated, corrections, spec, threshold), "corrected", V.STATUS)
    return Silver(validated, groups, members)


def pipeline_report(raw: DataFrame, silver: Silver, gold: A.Gold) -> DataFrame:
    """One row with a struct of counters per layer, computed when it is asked for.

    One aggregate per layer: a field has statistics if any of its values is a number, so
    the analytics themselves are not computed for it.
    """
    stats = V.silver_stats(silver.validated)
    money = sorted(f for f in words.MONEY_FIELDS if f in gold.records.columns)
    indexed = sorted(f for f in words.INDEX_FIELDS if f in gold.records.columns)
    facts = gold.records.agg(F.struct(F.count("*").alias("n"), *[
        F.count(F.col(f).try_cast("double")).alias(f) for f in money]).alias("facts")).scalar()
    columns = F.array(*[F.lit(c) for c in raw.columns if not c.startswith("_")])
    graded = {grade: F.lit(0).cast("long") if silver.groups is None else silver.groups.agg(
        F.count_if(F.col("grade") == grade)).scalar() for grade in (D.MERGE_GRADE, D.REVIEW_GRADE)}
    with_facts = stats.withColumn("facts", facts)
    return with_facts.select(
        F.struct(raw.agg(F.count("*")).scalar().alias("row_count"), columns.alias("column_names")).alias("bronze"),
        F.struct(*stats.columns, graded[D.MERGE_GRADE].alias("merged_groups"),
                 graded[D.REVIEW_GRADE].alias("review_groups")).alias("silver"),
        F.struct(
            F.col("facts.n").alias("record_count"),
            F.array_compact(F.array(*[F.when(F.col(f"facts.{f}") > 0, F.lit(f)) for f in money])).alias("statistics_fields"),
            F.when(F.col("facts.n") > 0, F.array(*[F.lit(f) for f in indexed])).otherwise(F.array().cast("array<string>"))
            .alias("index_fields")).alias("gold"))


def _row_columns(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in (C.ROW, C.FILE, C.ROW_ID) if c in df.columns)


def run_layers(raw: DataFrame, spec: TableSpec = INVOICE_SPEC, hooks: Hooks | None = None, **silver) -> PipelineResult:
    """Silver and gold over raw text rows that are already a table."""
    hooks = hooks or Hooks()

    def around(layer: str, df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        df, skipped = hooks.run(layer, "pre", df)
        return hooks.run(layer, "post", step(df.limit(0) if skipped else df))[0] if not skipped else step(df.limit(0))

    raw = around("bronze", raw, lambda df: df)
    made: list[Silver] = []

    def silver_step(df: DataFrame) -> DataFrame:
        made.append(silver_layer(df, spec, **silver))
        return made[0].validated

    validated = around("silver", raw, silver_step)
    routed = V.split(validated)
    records = around("gold", routed.clean.select(*_row_columns(routed.clean), *spec.names), lambda df: df)
    gold = A.aggregate(records)
    result = Silver(validated, made[0].groups, made[0].members)
    return PipelineResult(raw, result, *routed, gold, pipeline_report(raw, result, gold))


def run_pipeline(spark: SparkSession, path: str, spec: TableSpec = INVOICE_SPEC, hooks: Hooks | None = None,
                 store: str | None = None, **silver) -> PipelineResult:
    """Raw CSV files to analytics tables. Everything is kept under ``store`` when given."""
    manifest = S.ingest(spark, path, store or new_path(spark, "bronze"))
    result = run_layers(S.read_ingested(spark, manifest), spec, hooks, **silver)
    if store:
        run = f"{store}/runs/{manifest.first()['dataset_id']}"
        S.write_clean(result.clean, f"{run}/clean", spec, keep=_row_columns(result.clean))
        result.rejected.write.parquet(f"{run}/rejected")
        V.error_log_long(result.rejected).write.parquet(f"{run}/errors")
        S.write_gold(result.gold, f"{run}/gold")
        if result.silver.members is not None:
            S.write_review(D.review_entries(result.silver.members), f"{run}/review")
    return result
