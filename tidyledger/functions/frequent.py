"""Summary of the most frequent keys of a task, with the most that any key can have lost in it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def summaries(capacity: int):
    """mapInPandas function over (key): (key, low, lost) for at most ``capacity`` keys of a task.

    Counts of a batch are added to those kept. Beyond the capacity the largest count left out is taken off
    every key, so a key's true count lies between ``low`` and ``low`` plus what was taken off in all. That sum
    stands in one more row, without a key, and is at most the task's rows divided by the capacity.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, lost = pd.Series([], dtype="int64", index=pd.Index([], dtype=object)), 0
        for batch in batches:
            new = batch["key"].astype(object).value_counts(dropna=False)
            kept = pd.concat([kept, new]).groupby(level=0, dropna=False, sort=False).sum()
            if len(kept) > capacity:
                border = len(kept) - capacity - 1
                cut = int(np.partition(kept.to_numpy(), border)[border])
                kept, lost = kept[kept > cut] - cut, lost + cut
        keys = [None if pd.isna(k) else k for k in kept.index]
        yield pd.DataFrame({"key": pd.Series([*keys, None], dtype=object), "low": [*kept.tolist(), 0], "lost": [0] * len(kept) + [lost]})

    return run
