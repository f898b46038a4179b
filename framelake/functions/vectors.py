"""Vectors of a group compared with kept ones before them, by hash and product, in batches that numpy works out inside tasks.

Rows are (i, h, v): place, hash and vector. A pair counts by the hashes' distance and by how far apart its places are.
Its score is the sum of products in order, from the first on, so that it is the same wherever it is worked out.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are rounded to so many places, and rows compared so many at a time.
PLACES, STEP = 6, 128
#: Scores further apart than this are in the same order after rounding.
APART = 2 * 10.0**-PLACES


@dataclass
class Limits:
    """As ``DedupParams``."""

    window: int
    far_hash: int
    max_hash: int
    same: float
    flag: float


@dataclass
class Rows:
    """Rows in order of place. ``v`` has a line for each component; shorter vectors end in zeros, and vectors of other lengths,
    or with nulls, have no score together."""

    i: np.ndarray
    h: np.ndarray
    v: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        t = table.select(["i", "h", "v"]).sort_by("i").combine_chunks()
        lists = pa.concat_arrays(t.column("v").chunks) if t.num_rows else pa.array([], pa.list_(pa.float64()))
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
        length = n.astype(np.int64)
        length[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
        length[pc.is_null(lists).to_numpy(zero_copy_only=False)] = -1
        v = np.zeros((n.max(initial=0), len(n)))
        v[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
        return cls(t.column("i").to_numpy().astype(np.int64), t.column("h").to_numpy().astype(np.int64).view(np.uint64), v, length)

    def take(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.i[at], self.h[at], self.v[:, at], self.length[at])


def at_least(score: np.ndarray, limit: float) -> np.ndarray:
    """Whether scores, rounded half up in decimal as ``round`` of a data frame does it, reach a limit; NaN is greater than any number."""
    out = ~(score < limit)
    for k in np.flatnonzero(np.abs(score - limit) < APART):
        out[k] = float(Decimal(repr(float(score[k]))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP)) >= limit
    return out


def pairs(refs: Rows, rows: Rows, p: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, reference and score of each row with each reference before it that the hashes let through, in order of rows."""
    dist = np.bitwise_count(rows.h[:, None] ^ refs.h[None, :])
    near = dist <= min(p.far_hash, p.max_hash)
    if p.window and p.max_hash > p.far_hash and len(refs.i):
        # references up to ``window`` places before a row are few: they lie together
        lo, hi = np.searchsorted(refs.i, rows.i - p.window), np.searchsorted(refs.i, rows.i)
        b = np.repeat(np.arange(len(rows.i)), hi - lo)
        a = np.arange(len(b)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
        near[b, a] = dist[b, a] <= p.max_hash
    b, a = np.nonzero(near)
    some = (refs.i[a] < rows.i[b]) & (refs.length[a] == rows.length[b]) & (rows.length[b] >= 0)
    b, a = b[some], a[some]
    score = np.zeros(len(b))
    for x, y in zip(refs.v, rows.v):
        score += x[a] * y[b]
    return b, a, score


def kept(table: pa.Table, p: Limits) -> np.ndarray:
    """Of a table of rows in order of place, whether each is kept: no kept row before it scores ``same`` or more with it."""
    order = np.argsort(table.column("i").to_numpy(), kind="stable")
    rows = Rows.of(table)
    stays = np.zeros(len(rows.i), bool)
    for at in range(0, len(rows.i), STEP):
        part = rows.take(slice(at, at + STEP))
        b, _, score = pairs(rows.take(np.flatnonzero(stays)), part, p)
        open_ = np.ones(len(part.i), bool)
        open_[b[at_least(score, p.same)]] = False
        some = np.flatnonzero(open_)
        part = part.take(some)
        b, a, score = pairs(part, part, p)
        alike, here = at_least(score, p.same), np.ones(len(some), bool)
        for row, ref in zip(b[alike].tolist(), a[alike].tolist()):
            # rows come in order: a reference is settled before the rows after it
            if here[ref]:
                here[row] = False
        stays[at + some] = here
    out = np.zeros(len(stays), bool)
    out[order] = stays
    return out


def best(refs: pa.Table, rows: pa.Table, p: Limits) -> pa.Table:
    """(j, i, far, score): the references of each row that can be its best after rounding, those of ``flag`` or more. Of equal
    scores the first far reference stands for all, else the first."""
    refs, rows = Rows.of(refs), Rows.of(rows)
    found = []
    for at in range(0, len(rows.i), STEP):
        part = rows.take(slice(at, at + STEP))
        b, a, score = pairs(refs, part, p)
        some = ~(score < p.flag - APART)
        b, a, score = b[some], a[some], score[some]
        key = np.where(np.isnan(score), np.inf, score)
        top = np.full(len(part.i), -np.inf)
        np.maximum.at(top, b, key)
        some = ~(key < top[b] - APART)
        b, a, score, key = b[some], a[some], score[some], key[some]
        far, real = part.i[b] - refs.i[a] > p.window, ~np.isnan(score)
        order = np.lexsort((a, ~far, real, -key, b))
        b, a, score, key, far, real = (x[order] for x in (b, a, score, key, far, real))
        first = np.append(True, (b[1:] != b[:-1]) | (key[1:] != key[:-1]) | (real[1:] != real[:-1])) if len(b) else np.zeros(0, bool)
        found.append((part.i[b[first]], refs.i[a[first]], far[first], score[first]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)]
    return pa.table(dict(zip(("j", "i", "far", "score"), columns)))
