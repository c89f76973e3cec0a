"""Whitening of vectors by shifted CholeskyQR.

The centred rows A (n x d) are never factored in one place. Each pass is one distributed Gram matrix:
tasks divide their rows by the triangular factors found so far (triangular solves) and add up d x d products; the products are
summed in a tree of tasks, and one d x d matrix reaches the driver. The first factor comes from a shifted matrix, so that it
exists whatever the condition of the data; the next passes make the rows orthonormal to double precision. With R the
product of the factors and G the last Gram matrix, ``A'A = R' G R`` holds, so the singular values and right vectors of
``G^(1/2) R`` are those of A: the components, from the largest variance down.

Vectors are scaled to whole numbers first, so counts, sums and distances from the mean are exact.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidyledger.llm.common import ship

SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0 ** 52  # entries from here on have no whole-number form in 64 bits
SAFE = 1 << 62
PASSES = 8
SETTLED = 1e-12  # how far the Gram matrix may be from a projection
RANK = 1e-12  # singular values below this part of the largest are zero
PARTIAL = "width int, n long, data binary"
TREE = (16, 1)  # tasks of the levels that add up what map tasks found


def usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix as double) of the vectors of a batch whose entries are all known and finite."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        values = flat.reshape(len(rows), width) if len(rows) * width == len(flat) else flat[starts[rows][:, None] + np.arange(width)]
        good = (np.abs(values) < LARGEST).all(axis=1)  # false for NaN too
        if good.any():
            yield width, rows[good], values[good]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def from_mean(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they hold it, else Python's."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, total), default=0))
    if largest < SAFE // 2:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def squares(y: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    largest, width = int(np.abs(y).max(initial=0)), y.shape[1]
    if largest * largest * width < SAFE:
        return (y * y).sum(axis=1).tolist()
    if largest * width < 1 << 50:
        high, low = y >> 24, y & 0xFFFFFF
        return [(int(h) << 48) + (int(m) << 25) + int(s) for h, m, s in zip(
            (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))]
    return squares(y.astype(object))


def divided(a: np.ndarray, r: np.ndarray, panel: int = 16) -> np.ndarray:
    """``a R^-1`` for upper triangular R, by substitution in panels of columns."""
    q = np.empty_like(a)
    for start in range(0, len(r), panel):
        stop = min(start + panel, len(r))
        rest = a[:, start:stop] - q[:, :start] @ r[:start, start:stop]
        for j in range(start, stop):
            q[:, j] = (rest[:, j - start] - q[:, start:j] @ r[start:j, j]) / r[j, j]
    return q


# --- sums over all rows ------------------------------------------------------------


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "width": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()),
        "data": pa.array([r[2] for r in rows], pa.binary())})


def _added(vectors: DataFrame, start: Callable, add: Callable, pack: Callable, unpack: Callable) -> dict[int, tuple]:
    """{width: (n, total)} over all usable vectors.

    Every task holds one total per width; totals are added in a stream, level by level, so the driver gets one of each.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = defaultdict(int), {}
        for batch in batches:
            for width, _, values in usable(batch.column(0)):
                counts[width] += len(values)
                part = start(width, values)
                if part is not None:
                    totals[width] = part if width not in totals else add(totals[width], part)
        yield _packed([(w, counts[w], pack(t)) for w, t in totals.items()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = defaultdict(int), {}
        for batch in batches:
            for width, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                counts[width] += n
                totals[width] = unpack(data) if width not in totals else add(totals[width], unpack(data))
        yield _packed([(w, counts[w], pack(t)) for w, t in totals.items()])

    parts = vectors.mapInArrow(found, PARTIAL)
    for tasks in TREE:
        parts = parts.repartition(tasks).mapInArrow(merged, PARTIAL)
    return {r["width"]: (r["n"], unpack(bytes(r["data"]))) for r in parts.collect()}


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{width: (n, per-dimension sums of the whole numbers)}, exact."""

    def start(_, values):
        x = whole_numbers(values)
        exact = int(np.abs(x).max()) * len(x) < SAFE
        return [int(v) for v in (x if exact else x.astype(object)).sum(axis=0)]

    return _added(vectors, start, lambda a, b: [p + q for p, q in zip(a, b)], lambda t: json.dumps(t).encode(), json.loads)


def _gram(vectors: DataFrame, rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of the products of all rows that ``rows`` makes of a matrix of vectors."""

    def start(found, values):
        if found != width:
            return None
        made = rows(values)
        return made.T @ made

    def unpack(data):
        flat = np.frombuffer(data, np.float64)
        return flat.reshape(int(len(flat) ** 0.5), -1)

    return _added(vectors, start, lambda a, b: a + b, lambda t: np.ascontiguousarray(t).tobytes(), unpack)[width][1]


# --- the factorisation ----------------------------------------------------------------


class Whitening(NamedTuple):
    """What is learned: number of vectors, their sums, components (rows) with their variances, and the total variance."""

    n: int
    total: list[int]
    components: np.ndarray
    variances: np.ndarray
    all_variance: float

    def centred(self, values: np.ndarray) -> np.ndarray:
        return from_mean(whole_numbers(values), self.n, self.total).astype(np.float64) / self.n

    def whitened(self, values: np.ndarray) -> np.ndarray:
        return self.centred(values) @ (self.components / np.sqrt(self.variances)[:, None]).T


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with ``R'R = gram + shift``; the shift grows until the matrix is positive definite to working precision."""
    scale = float(np.trace(gram))
    while True:
        try:
            r = np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
            if np.diag(r).min() ** 2 > 1e-15 * scale:
                return r
        except np.linalg.LinAlgError:
            pass
        shift = max(10 * shift, 1e-14 * scale)


def factored(n: int, width: int, gram_of: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (rows) of n centred rows, given the Gram matrix of the rows divided by factors."""
    factors, composed = [], np.eye(width)
    for number in range(PASSES):
        gram = gram_of(factors)
        gram = (gram + gram.T) / 2
        if not np.trace(gram) > 0:
            return np.zeros(0), np.zeros((0, width))
        if number and np.abs(gram @ gram - gram).max() < SETTLED:
            break
        # The first shift is that of the published bound, with the trace for the squared norm, kept small against the trace.
        shift = min(11 * (n * width + width * (width + 1)) * 2.0 ** -53, 1e-3) * np.trace(gram) if not number else 0.0
        r = cholesky(gram, shift)
        factors.append(r)
        composed = r @ composed
    values, vectors = np.linalg.eigh(gram)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    _, singular, right = np.linalg.svd(root @ composed)
    return singular, right


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Learn from all vectors (one array column). Vectors of another length than most (ties: the longer) take no part."""
    sums = _sums(vectors)
    if not sums:
        return None
    width = max(sums, key=lambda w: (sums[w][0], w))
    n, total = sums[width]
    mean = Whitening(n, total, np.eye(width), np.ones(width), 1.0)

    def gram_of(factors):
        def rows(values):
            made = mean.centred(values)
            for r in factors:
                made = divided(made, r)
            return made

        return _gram(vectors, rows, width)

    singular, right = factored(n, width, gram_of)
    kept = singular[:components] > RANK * singular.max(initial=0)
    right = right[:components][kept]
    signs = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)]) if len(right) else np.zeros(0)
    return Whitening(n, total, right * signs[:, None], singular[:components][kept] ** 2 / n, float((singular ** 2).sum()) / n)


def identity_error(vectors: DataFrame, learned: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over all vectors."""
    k = len(learned.components)
    gram = _gram(vectors, lambda v: np.hstack([learned.whitened(v), np.ones((len(v), 1))]), len(learned.total)) / learned.n
    return float(np.abs(gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k]) - np.eye(k)).max())


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_digits string")


def whitening_report(embeddings: DataFrame, components: int = 8, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: see RESULT.

    Vectors that are null or empty, or hold null or non-finite entries (or entries of 2^52 and more), take no part, nor do
    vectors of another length than most. Repeated rows count each; a null id stays null. Only components with a variance
    above zero exist, so equal vectors (or a single one) give no rows, as no vectors do. ``deviation`` is null where the
    exact number, always in ``deviation_digits``, exceeds 64 bits. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col(vector).cast("array<double>"))
    learned = fit(vectors, components)
    k = 0 if learned is None else len(learned.components)
    if not k:
        return spark.createDataFrame([], RESULT)
    error, width = identity_error(vectors, learned), len(learned.total)
    explained = learned.variances / learned.all_variance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, rows, values in usable(batch.column(1)):
                if found != width:
                    continue
                exact = squares(from_mean(whole_numbers(values), learned.n, learned.total))
                size, at = len(rows), np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column(0).take(pa.array(rows[at])),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    "n": pa.array(np.full(size * k, learned.n)),
                    "deviation": pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()).take(pa.array(at)),
                    "whitened": pa.array(learned.whitened(values).ravel()),
                    "explained": pa.array(np.tile(explained, size)),
                    "identity_error": pa.array(np.full(size * k, error)),
                    "deviation_digits": pa.array([str(d) for d in exact]).take(pa.array(at))})

    return embeddings.select(F.col(id_column).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, RESULT)
