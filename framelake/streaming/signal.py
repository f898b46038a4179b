"""The previous-sample difference and fixed-threshold segments over unbounded signals.

State is the last sample and the open run of each series, so it stays constant
however long a stream runs. Samples of a series arrive in order, batch by batch.
Adaptive thresholds need percentiles of the whole signal and have no streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _diff(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("i")
    before = rows["x"].shift(1)
    before.iloc[0] = rows["x"].iloc[0] if last is None else last
    state.update((float(rows["x"].iloc[-1]),))
    yield pd.DataFrame({"g": key[0], "i": rows["i"], "diff": (rows["x"] - before).abs()})


def lag_diff(signal: DataFrame) -> DataFrame:
    """(g, i, diff) of a stream (g, i, x): change from the previous sample, 0 for a series' first."""
    return signal.groupBy("g").applyInPandasWithState(_diff, "g string, i long, diff double", "last double", "append", GroupStateTimeout.NoTimeout)


def _runs(threshold: float, least: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values("i")
        i, still = rows["i"].to_numpy(), (rows["x"] <= threshold).to_numpy()
        # a run may be open from before; where the mask rises one begins, where it falls one has ended
        turns = np.diff(np.concatenate([[a >= 0], still]).astype(np.int8))
        before = np.concatenate([[b], i[:-1]])
        begin, end = np.concatenate([[a] if a >= 0 else [], i[turns == 1]]).astype(np.int64), before[turns == -1]
        open_ = len(begin) > len(end)
        state.update((int(begin[-1]), int(i[-1])) if open_ else (-1, -1))
        begin = begin[: len(end)]
        long = end - begin + 1 >= least
        yield pd.DataFrame({"g": key[0], "a": begin[long], "b": end[long]})

    return step


def segments(signal: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """(g, a, b) of a stream (g, i, x): runs at or below ``threshold`` of ``least`` samples, sent on when they end."""
    return signal.groupBy("g").applyInPandasWithState(_runs(threshold, least), "g string, a long, b long", "a long, b long", "append", GroupStateTimeout.NoTimeout)
