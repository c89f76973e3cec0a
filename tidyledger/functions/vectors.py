"""Nearest neighbours inside a task: one block of queries against one share of the documents."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_AT_ONCE = 128


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.float64)


def nearest_pivot(pivots: np.ndarray):
    """Function of a column of vectors: the pivot that is nearest to each, and its distance."""

    def run(vectors: pd.Series) -> pd.DataFrame:
        x = _matrix(vectors)
        at = ((pivots ** 2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
        return pd.DataFrame({"pivot": at.astype(np.int32), "far": np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))})

    return run


def cells_to_ask(pivots: np.ndarray, cell: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray,
                 count: np.ndarray, width: int):
    """Function of points, k, limits (the squared distance of the k-th so far) and cells done.

    Cells are taken by the least distance their documents can have: ``width`` more, or as many
    as hold k documents, without those beyond the limit. Gives them and how many are done then.
    """

    def some(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(cell) == 1:
            return np.zeros((len(points), 1)), np.zeros((len(points), 1), np.int64)
        far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots], axis=1)[:, pivot]
        # Rounding must not rule out a document at the border.
        bound = np.maximum(np.maximum(far - high, low - far) - 1e-9 * (1 + far + high), 0) ** 2
        return bound, np.argsort(bound, axis=1, kind="stable")

    def run(points: pd.Series, k: pd.Series, limit: pd.Series, done: pd.Series) -> pd.DataFrame:
        cells, until = [], []
        for at in range(0, len(points), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            for bound, order, wanted, border, first in zip(
                    *some(_matrix(points.iloc[part])), k.iloc[part], limit.iloc[part], done.iloc[part], strict=True):
                enough = 1 + int(np.searchsorted(np.cumsum(count[order]), wanted))
                last = min(len(order), max(first + width, enough))
                new = order[first:last]
                cells.append(cell[new[bound[new] <= border]].astype(np.int32))
                until.append(last)
        return pd.DataFrame({"cells": cells, "until": pd.Series(until, dtype="int32")})

    return run


def nearest_in_share(id_column: str, filters: tuple[str, ...]):
    """Cogroup function over (query_id, k, point, asked filters) and (id, vector, filters).

    Gives (query_id, k, id, distance) of the best k documents per query by (squared
    distance, id). A filter value that is missing puts no condition. Queries that ask for
    the same filter values share one matrix product, which picks the candidates; their distances
    are then summed pair by pair.
    """

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "k", id_column, "distance"]
        if queries.empty or docs.empty:
            return pd.DataFrame(columns=columns)
        matrix, ids = np.stack(list(docs["_vector"])).astype(np.float64), docs[id_column].to_numpy()
        squares = (matrix ** 2).sum(axis=1)
        asked = [f"_asked_{f}" for f in filters]
        groups = queries.groupby(asked, dropna=False, sort=False) if asked else [((), queries)]
        out = []
        for values, some in groups:
            keep = np.ones(len(docs), dtype=bool)
            for name, value in zip(filters, values if isinstance(values, tuple) else (values,), strict=True):
                if not pd.isna(value):
                    keep &= (docs[name] == value).to_numpy(dtype=bool, na_value=False)
            rows = np.flatnonzero(keep)
            for at in range(0, len(some) if len(rows) else 0, ROWS_AT_ONCE):
                part = some.iloc[at:at + ROWS_AT_ONCE]
                points = np.stack(list(part["_point"])).astype(np.float64)
                rough = squares[rows] - 2 * points @ matrix[rows].T
                for query_id, wanted, point, line in zip(part["query_id"], part["k"], points, rough, strict=True):
                    k = min(int(wanted), len(rows))
                    if not k:
                        continue
                    border = np.partition(line, k - 1)[k - 1]
                    # Rounding of the product must not lose a document at the border.
                    near = rows[line <= border + 1e-9 * (1 + abs(border) + (point ** 2).sum())]
                    distance = ((matrix[near] - point) ** 2).sum(axis=1)
                    first = np.lexsort((ids[near], distance))[:k]
                    out.append(pd.DataFrame({"query_id": query_id, "k": int(wanted), id_column: ids[near][first],
                                             "distance": distance[first]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=columns)

    return run
