"""Grey pictures in batches: what costs most on pictures, as column functions that numpy works out for many rows at a time.

A picture is an array as in ``grids``; inside a task a batch of them is a stack (n, h, w). Each row still maps to one row. A null
picture gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import grids as gr

#: Pixels that are worked on at a time: some 4 MB for each of a kernel's intermediate stacks.
PIXELS = 1 << 19


def mapped(kernel: Callable[..., dict[str, np.ndarray]], schema: str, w: int, h: int, *pictures: Column) -> Column:
    """``kernel`` of one or more pictures of ``w`` x ``h`` as a struct column; a kernel takes stacks and gives an array for each field, NaN for null."""
    out = T.StructType.fromDDL(schema)
    rows = max(1, PIXELS // (w * h))

    def stack(v: pd.Series) -> np.ndarray:
        flat = np.full((len(v), w * h), np.nan)
        for k, x in enumerate(v):
            if x is not None:
                flat[k, : len(x)] = x[: w * h]
        return flat.reshape(-1, h, w)

    def run(*columns: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame(kernel(*[stack(c.iloc[at : at + rows]) for c in columns])) for at in range(0, len(columns[0]), rows)]
        found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f.name: [] for f in out})
        return pd.DataFrame({f.name: found[f.name].astype("Int64" if isinstance(f.dataType, (T.LongType, T.IntegerType)) else "float64") for f in out})

    present = pictures[0].isNotNull()
    for p in pictures[1:]:
        present = present & p.isNotNull()
    # called nondeterministic so that a filter on its result neither moves it before a deal of rows nor works it out twice
    return F.when(present, F.pandas_udf(run, out).asNondeterministic()(*[p.cast("array<double>") for p in pictures]))


def separable(p: np.ndarray, weights: list[float]) -> np.ndarray:
    """Filtered along rows, then columns; borders mirror."""
    by = len(weights) // 2
    wide = np.pad(p, ((0, 0), (0, 0), (by, by)), "reflect")
    p = sum(wide[:, :, k : k + p.shape[2]] * x for k, x in enumerate(weights))
    high = np.pad(p, ((0, 0), (by, by), (0, 0)), "reflect")
    return sum(high[:, k : k + p.shape[1]] * x for k, x in enumerate(weights))


def cropped(p: np.ndarray, left: int, top: int) -> np.ndarray:
    wide, high = gr.inner_size(p.shape[2], p.shape[1], left, top)
    return p if (high, wide) == p.shape[1:] else p[:, top : top + high, left : left + wide]


def resampled(p: np.ndarray, to_w: int, to_h: int) -> np.ndarray:
    _, h, w = p.shape
    return np.array(gr.area_weights(h, to_h)) @ p @ np.array(gr.area_weights(w, to_w)).T


def moved(p: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Each picture moved so that what lay at (x + dx, y + dy) lies at (x, y); edges repeat."""
    n, h, w = p.shape
    ys, xs = np.clip(np.arange(h) + dy[:, None], 0, h - 1), np.clip(np.arange(w) + dx[:, None], 0, w - 1)
    return p[np.arange(n)[:, None, None], ys[:, :, None], xs[:, None, :]]


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of pictures, to nine places; 0 where one of them is flat."""
    da, db = a - a.mean((1, 2), keepdims=True), b - b.mean((1, 2), keepdims=True)
    size = lambda d, p: np.where((d * d).sum((1, 2)) > 1e-20 * (p * p).sum((1, 2)), (d * d).sum((1, 2)), np.nan)
    return np.nan_to_num(np.round((da * db).sum((1, 2)) / np.sqrt(size(da, a) * size(db, b)), 9))


def dilated(p: np.ndarray, by: int, how: Callable = np.maximum) -> np.ndarray:
    """The greatest (least, with ``np.minimum``) of the pixels up to ``by`` away; borders repeat."""
    _, h, w = p.shape
    for axis, n in ((1, h), (2, w)):
        wide = np.pad(p, [(by, by) if k == axis else (0, 0) for k in range(3)], "edge")
        p = how.reduce([wide.take(range(k, k + n), axis) for k in range(2 * by + 1)])
    return p
