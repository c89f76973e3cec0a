"""Windows that repeat in a corpus, found through a sample of their places.

A window is a fixed number of units, bytes or words. Every window names one place
inside it: the first least hash among its short grams. Equal windows name the same
place, so windows can only repeat where these places repeat, and those are a few
in a hundred units. The windows of a document that name one place are a segment: a
run of neighbouring windows. Segments go through rounds:

1. Segments meet by the rank of their gram. Grams that stand alone drop out.
2. Among segments with the same gram, those with the same whole text are one class;
   all but the first of a class are repeats and are settled.
3. First ones of grams with several classes are cut into shorter runs of windows,
   and these meet in the next round by a longer gram that all windows of the run share.

Gram names are 64-bit hashes that are doubled in length by pairing the names of two
halves. Counting is by map-side aggregates, so a gram or a class that holds a third of
all rows reaches no task as a whole; only the firsts are compared further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import id_text, ship, stored, text_key

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(17).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
UNITS_PER_CALL = 50_000  # so that a step's arrays stay in the processor's cache
SEGMENT = "doc long, key long, lo int, n int, at int, core long, cls long"
LAST = (1 << 63) - 1  # order of a null id: behind all others


class Units(NamedTuple):
    """What a window is made of: how a text is split, and the 64-bit names of some of the pieces."""

    split: Callable[[str], Sequence]
    named: Callable[[Sequence], np.ndarray]


def words_of(text: str) -> list[bytes]:
    """Words between white space (space, tab to carriage return)."""
    return text.encode("utf-8", "surrogatepass").split()


def _word_names(words: Sequence[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


BYTES = Units(lambda text: np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), lambda part: _BYTE[part])
WORDS = Units(words_of, _word_names)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of two neighbouring grams."""
    out = left * _A
    out += right * _B
    out ^= out >> np.uint64(31)
    return out


class Names:
    """Names of the grams of one text or several joined ones, doubled in length as far as asked."""

    def __init__(self, units: np.ndarray):
        self.levels = [units]

    def of(self, length: int) -> np.ndarray:
        """Name of the gram of this length at every place where one fits."""
        level = length.bit_length() - 1
        while len(self.levels) <= level:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(pair(last[:-half], last[half:]) if len(last) > half else last[:0])
        rest = length - (1 << level)
        last = self.levels[level]
        return last if not rest else pair(last[:len(last) - rest], last[rest:])


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least of each ``width`` neighbouring values."""
    place, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        later = values[step:] < values[:-step]
        place = np.where(later, place[step:], place[:-step])
        values = np.minimum(values[step:], values[:-step])
        span += step
    return place


def class_name(whole: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return pair(whole[lo], whole[lo + n - 1]) + n.astype(np.uint64) * _B


def segments(units: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, lo, n, at, core, cls) of the segments of joined texts; places count in the joined units."""
    if len(units) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    names = Names(units)
    grams, whole = names.of(gram), names.of(length)
    place = first_least(grams, length - gram + 1)
    ends = np.append(starts[1:], len(units))
    inside = np.zeros(len(place) + 1, bool)
    for start, end in zip(starts.tolist(), ends.tolist()):
        if end - start >= length:
            inside[start:end - length + 1] = True
    inside = inside[:-1]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    lo = np.flatnonzero(new)
    if not len(lo):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = np.add.reduceat(inside.astype(np.int64), lo)
    text = np.searchsorted(starts, lo, "right") - 1
    at = place[lo].astype(np.int64)
    return text, lo, n, at, grams[at], class_name(whole, lo, n)


def shorter_runs(names: Names, length: int, gram: int, lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple:
    """(source, lo, n, core, cls): the runs of a segment whose windows all hold one gram of the given length.

    Runs are cut at fixed distances from the segment's place, so equal windows fall
    into runs with the same gram wherever their segments begin and end.
    """
    width = length - gram + 1
    least, most = (at - lo - n + 1) // width, (at - lo) // width
    count = most - least + 1
    source = np.repeat(np.arange(len(lo)), count)
    block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least, count)
    new_lo = np.maximum(lo[source], at[source] - block * width - width + 1)
    new_hi = np.minimum(lo[source] + n[source] - 1, at[source] - block * width)
    new_n = new_hi - new_lo + 1
    core = names.of(gram)[at[source] - block * width] + block.astype(np.uint64) * _B
    return source, new_lo, new_n, core, class_name(names.of(length), new_lo, new_n)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, a null one behind all others), key (of the text), doc_id, text (null: empty)."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_key(text).alias("key"),
                       F.col("doc_id"), text.alias("text"))


def _frame(doc, key, lo, n, at, core, cls) -> pd.DataFrame:
    return pd.DataFrame({"doc": doc, "key": key, "lo": lo.astype(np.int32), "n": n.astype(np.int32),
                         "at": at.astype(np.int32), "core": core.view(np.int64), "cls": cls.view(np.int64)})


def all_segments(texts: DataFrame, units: Units, length: int, gram: int) -> DataFrame:
    """The segments of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(rows):
            starts = np.cumsum([0] + [len(r[3]) for r in rows[:-1]])
            text, lo, n, at, core, cls = segments(np.concatenate([r[3] for r in rows]), starts, length, gram)
            shift = starts - np.array([r[2] for r in rows])
            return _frame(np.array([r[0] for r in rows])[text], np.array([r[1] for r in rows])[text],
                          lo - shift[text], n, at - shift[text], core, cls)

        def parts(batch):
            rows, size = [], 0
            for doc, key, text in zip(batch["doc"], batch["key"], batch["text"], strict=True):
                own = units.named(units.split(text))
                # A very long text is gone through in parts that overlap by a window less one.
                for start in range(0, max(1, len(own) - length + 1), UNITS_PER_CALL):
                    part = own[start:start + UNITS_PER_CALL + length - 1]
                    rows.append((doc, key, start, part))
                    size += len(part)
                    if size > UNITS_PER_CALL:
                        yield joined(rows)
                        rows, size = [], 0
            if rows:
                yield joined(rows)

        for batch in batches:
            yield from _gathered(parts(batch))

    return texts.select("doc", "key", "text").mapInPandas(run, SEGMENT)


def _gathered(frames: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Fewer and larger frames."""
    some, size = [], 0
    for frame in frames:
        some.append(frame)
        size += len(frame)
        if size > rows:
            yield pd.concat(some, ignore_index=True)
            some, size = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


def _spans(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans (start, end) of sorted intervals, and the span that each interval lies in."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return lo[first], reach[np.append(first[1:], len(lo)) - 1], np.cumsum(new) - 1


def cut_segments(texts: DataFrame, asked: DataFrame, units: Units, length: int, gram: int) -> DataFrame:
    """The segments of ``asked`` (doc, key, lo, n, at) cut into runs that share a gram of the given length.

    Only the parts of a text that these segments cover are named again.
    """
    lists = asked.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("lo", "n", "at"))).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(rows):
            units_of, docs, keys, wanted, shifts = zip(*rows, strict=True)
            starts = np.cumsum([0] + [len(u) for u in units_of[:-1]])
            sizes = [len(w) for w in wanted]
            shift = np.concatenate([s - at for s, at in zip(shifts, starts, strict=True)])
            lo, n, at = np.concatenate(wanted).T
            source, new_lo, new_n, core, cls = shorter_runs(
                Names(np.concatenate(units_of)), length, gram, lo - shift, n, at - shift)
            return _frame(np.repeat(docs, sizes)[source], np.repeat(keys, sizes)[source], new_lo + shift[source], new_n,
                          at[source], core, cls)

        def parts(batch):
            rows, size = [], 0
            for doc, key, text, some in zip(batch["doc"], batch["key"], batch["text"], batch["asked"], strict=True):
                wanted = np.array([(r["lo"], r["n"], r["at"]) for r in some], np.int64).reshape(-1, 3)
                start, end, span = _spans(wanted[:, 0], wanted[:, 0] + wanted[:, 1] - 1 + length)
                split = units.split(text)
                own = np.concatenate([units.named(split[s:e]) for s, e in zip(start.tolist(), end.tolist())])
                # Place in the text less place in the named parts.
                shift = (start - np.concatenate([[0], np.cumsum(end - start)[:-1]]))[span]
                rows.append((own, doc, key, wanted, shift))
                size += len(own)
                if size > UNITS_PER_CALL:
                    yield joined(rows)
                    rows, size = [], 0
            if rows:
                yield joined(rows)

        for batch in batches:
            yield from _gathered(parts(batch))

    return stored(texts.select("doc", "key", "text").join(lists, ["doc", "key"]).mapInPandas(run, SEGMENT), "runs")


class Rounds:
    """Settled repeats so far, and the segments that the next round has to look at."""

    def __init__(self, within_document: bool):
        self.within_document = within_document
        self.settled: list[DataFrame] = []
        self.open: DataFrame | None = None

    def meet(self, items: DataFrame) -> Rounds:
        """One round: drop what stands alone, settle all but the first of each class, keep the firsts that have rivals."""
        groups = stored(items.groupBy("core").agg(
            F.count("*").alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high"))
            .filter("n > 1").selectExpr("core", "low <> high AS rivals"), "repeated-grams")
        alive = stored(items.join(groups, "core"), "alive")
        place = F.struct("doc", "lo") if self.within_document else F.struct("doc")
        firsts = stored(alive.groupBy("core", "cls").agg(F.min(place).alias("first")), "firsts")
        marked = alive.join(firsts, ["core", "cls"]).withColumn("later", place > F.col("first"))
        marked = stored(marked.select("doc", "key", "lo", "n", "at", "rivals", "later"), "marked")
        self.settled.append(marked.filter("later").select("doc", "key", "lo", "n"))
        self.open = marked.filter("NOT later AND rivals").select("doc", "key", "lo", "n", "at")
        return self

    def repeats(self) -> DataFrame:
        """(doc, key, lo, n): runs of windows that repeat an earlier one."""
        out = self.settled[0]
        for more in self.settled[1:]:
            out = out.unionAll(more)
        return out


def covered(flags_of: int, runs, length: int) -> np.ndarray:
    """Which of a text's units lie in a window that starts in one of the runs (lo, n)."""
    edges = np.zeros(flags_of + 1, np.int64)
    if runs is not None and len(runs):
        lo, n = np.array([(r["lo"], r["n"]) for r in runs], np.int64).T
        np.add.at(edges, lo, 1)
        np.add.at(edges, np.minimum(lo + n - 1 + length, flags_of), -1)
    return np.cumsum(edges)[:-1] > 0


def with_runs(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """doc_id (as text), text and the different repeated runs of every row."""
    runs = repeats.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "n")).alias("runs"))
    return texts.join(runs, ["doc", "key"], "left").select(id_text("doc_id"), "text", "runs")
