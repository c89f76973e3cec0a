"""Sets of row positions of one id range: a list while they are few, a bitmap beyond."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BITS = 15
SPAN = 1 << RANGE_BITS
DENSE = SPAN // 16  # so many two-byte positions are as long as the bitmap


def bitmap(positions: pd.Series) -> pd.Series:
    """The bitmap of each list of positions; none for a null list."""
    out = []
    for some in positions:
        mask = np.zeros(SPAN, bool)
        if some is not None:
            mask[np.asarray(some, np.int64)] = True
        out.append(None if some is None else np.packbits(mask, bitorder="little").tobytes())
    return pd.Series(out, dtype=object)


def matching_rows(clauses: Sequence[Sequence[tuple[str, str | None]]]):
    """applyInPandas function over the entries of one id range: the rows that meet one condition of every clause."""

    def run(entries: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for field, key, positions, bits in zip(entries["field"], entries["key"], entries["positions"], entries["bits"], strict=True):
            mask = np.zeros(SPAN, bool)
            if bits is not None:
                mask = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
            else:
                mask[np.asarray(positions, np.int64)] = True
            sets[field, None if pd.isna(key) else key] = mask
        every = np.ones(SPAN, bool)
        for clause in clauses:
            either = np.zeros(SPAN, bool)
            for condition in clause:
                if tuple(condition) in sets:
                    either |= sets[tuple(condition)]
            every &= either
        return pd.DataFrame({"row": np.flatnonzero(every) + (int(entries["id_range"].iloc[0]) << RANGE_BITS)})

    return run
