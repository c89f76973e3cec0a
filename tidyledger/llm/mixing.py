"""Mixing sources to target weights by temperature.

Every source's share of the tokens is raised to an exponent and normalised. The
exponent is bisected: flat enough for the target entropy, but never so flat that
the smallest source would repeat more often than allowed. The weights times the
token budget give each source its tokens. They are realised as permutations of
blocks: documents are dealt into blocks by hash, the blocks of a source stand in
a random order, and the source is read round after round until its tokens are
used up; inside the last block a random order of documents decides.

The block table has at most ``blocks`` rows per source whatever the input, and a
source that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyledger.llm.common import stored, text_key

BLOCKS = 1024
MAX_SOURCES = 100_000
SEED = 20


def _weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raised = {s: p ** exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = math.fsum(raised.values())
    return {s: r / total for s, r in raised.items()} if total else raised


def _entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(ok_at_high, low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """The border between exponents where the test fails (left) and holds (right)."""
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if ok_at_high(middle) else (middle, high)
    return low, high


def temperature(tokens: dict[str, int], budget: int, target_entropy: float, max_repeats: float) -> float:
    """Exponent in 0..1: the largest whose entropy reaches the target (a share of the highest possible one),
    or, if a source would then be read more than ``max_repeats`` times, the smallest at which none is."""
    shares = {s: t / sum(tokens.values()) for s, t in tokens.items() if t > 0}
    if len(shares) < 2:
        return 1.0
    goal = target_entropy * math.log(len(shares))
    if _entropy(_weights(shares, 1.0)) >= goal:
        by_entropy = 1.0
    else:
        by_entropy = _bisect(lambda x: _entropy(_weights(shares, x)) < goal)[0]

    def fits(x: float) -> bool:
        weights = _weights(shares, x)
        return all(weights[s] * budget <= max_repeats * tokens[s] for s in shares)

    if fits(by_entropy):
        return by_entropy
    return _bisect(fits, by_entropy)[1] if fits(1.0) else 1.0


def allotments(tokens: dict[str, int], budget: int | None = None, target_entropy: float = 0.95,
               max_repeats: float = 4.0) -> dict[str, tuple[float, int]]:
    """Weight and token allotment of each source. The budget is the tokens there are unless another is given."""
    budget = sum(tokens.values()) if budget is None else budget
    exponent = temperature(tokens, budget, target_entropy, max_repeats)
    total = sum(tokens.values())
    weights = _weights({s: t / total for s, t in tokens.items()} if total else dict.fromkeys(tokens, 0.0), exponent)
    return {s: (w, int(w * budget)) for s, w in weights.items()}


def word_count(text):
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "))
    return F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")) == "", 0).otherwise(words)


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows packed in one column, with source, tokens, block and the random place inside the block."""
    packed = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text")
    order = F.xxhash64(F.lit(SEED), F.col("row.doc_id"), text_key(text))
    return packed.select(
        "row", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("source"),
        word_count(text).cast("long").alias("tokens"), order.alias("place"),
        F.pmod(F.xxhash64(F.lit("block"), order), F.lit(blocks)).cast("int").alias("block"))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = 0.95, max_repeats: float = 4.0,
        blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` packed in ``row``, with source, tokens, block, weight and copies (0: not in the mixture).

    Tokens are whitespace-separated words. A null source is the empty source. Texts without
    words (null ones too) cost nothing and stay at least once. Rows that repeat id and text are
    interchangeable. No documents give no rows. More than 100,000 sources raise an error.
    """
    spark = docs.sparkSession
    sizes = stored(_dealt(docs, blocks).groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")), "blocks")
    totals = sizes.groupBy("source").agg(F.sum("block_tokens").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: r["t"] for r in totals}
    given = allotments(tokens, budget, target_entropy, max_repeats)
    plan = spark.createDataFrame(
        [(s, w, a // tokens[s] if tokens[s] else 0, a % tokens[s] if tokens[s] else 0) for s, (w, a) in given.items()],
        "source string, weight double, rounds long, rest long")
    shuffled = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED), "source", "block"), "block")
    before = stored(sizes.withColumn("before", F.sum("block_tokens").over(shuffled) - F.col("block_tokens"))
                    .join(plan, "source"), "block-order")
    inside = Window.partitionBy("source", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("before") + F.sum("tokens").over(inside)
    dealt = _dealt(docs, blocks).join(before, ["source", "block"])
    return dealt.withColumn("used", used).select(
        "row", "source", "tokens", "block", "weight",
        (F.col("rounds") + (F.col("used") <= F.col("rest")).cast("long")).alias("copies"))


def mixture_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, tokens, block, weight, copies. Texts stay out of the shuffle."""
    lean = docs.select("doc_id", "text", "source")
    return mix(lean, **how).select(F.col("row.doc_id").alias("doc_id"), "source", "tokens", "block", "weight", "copies")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every row as often as it is read, with the columns of ``docs``."""
    return (mix(docs, **how).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*"))
