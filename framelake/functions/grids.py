"""Grey pictures as arrays: stencils, blurs, resampling and transforms as column expressions.

A picture is an array of ``h`` rows of ``w`` numbers, row by row. Widths and heights are those of the whole
table: pictures are brought to one size first (``resampled``). Everything here maps one row to one
row, so nothing is shuffled and no pixel becomes a row. A picture that is looked at in many places is bound by ``let`` first, as
the optimizer may put the expression that makes it wherever its name stands.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Taps = list[tuple[int, int, float]]

#: Weights of the neighbours (dy, dx, weight) in the four-neighbour and the eight-neighbour Laplacian and the Sobel gradients.
LAPLACE_4: Taps = [(-1, 0, 1.0), (0, -1, 1.0), (0, 0, -4.0), (0, 1, 1.0), (1, 0, 1.0)]
LAPLACE_8: Taps = [(-1, -1, 2.0), (-1, 1, 2.0), (0, 0, -8.0), (1, -1, 2.0), (1, 1, 2.0)]
SOBEL_X: Taps = [(-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)]
SOBEL_Y: Taps = [(dx, dy, v) for dy, dx, v in SOBEL_X]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def mirrored(i: Column, n: int) -> Column:
    """A place inside 0 to n - 1 for one up to n - 1 beyond it: borders mirror without repeating the edge."""
    return F.lit(n - 1) - F.abs(F.lit(n - 1) - F.abs(i)) if n > 1 else F.lit(0)


def repeated(i: Column, n: int) -> Column:
    """The nearest place inside 0 to n - 1: borders repeat the edge."""
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def padded(v: Column, w: int, h: int, by: int, border=mirrored) -> Column:
    """A picture with ``by`` more pixels on every side."""
    wide = w + 2 * by
    return let(v, lambda p: F.transform(_places(wide * (h + 2 * by)), lambda k: F.get(p, border(_div(k, wide) - by, h) * w + border(k % wide - by, w))))


def stencil(v: Column, w: int, h: int, taps: Taps, border=mirrored) -> Column:
    """Weighted sums of each pixel's neighbours (dy, dx, weight)."""
    by = max(max(abs(dy), abs(dx)) for dy, dx, _ in taps)
    wide = w + 2 * by
    # each place finds its neighbours at fixed distances in the padded picture
    bases = F.transform(_places(w * h), lambda k: _div(k, w) * wide + k % w)

    def total(p: Column, base: Column) -> Column:
        terms = [F.get(p, base + ((dy + by) * wide + dx + by)) * weight for dy, dx, weight in taps]
        out = terms[0]
        for x in terms[1:]:
            out = out + x
        return out

    return let(padded(v, w, h, by, border), lambda p: F.transform(bases, lambda base: total(p, base)))


def separable(v: Column, w: int, h: int, weights: list[float], border=mirrored) -> Column:
    """A picture filtered along its rows, then its columns, by an odd number of weights."""
    by = len(weights) // 2
    along = stencil(v, w, h, [(0, k - by, x) for k, x in enumerate(weights)], border)
    return let(along, lambda rows: stencil(rows, w, h, [(k - by, 0, x) for k, x in enumerate(weights)], border))


def gauss(size: int, sigma: float) -> list[float]:
    """Weights of a Gaussian window."""
    raw = [math.exp(-((k - (size - 1) / 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    return [x / sum(raw) for x in raw]


def blurred(v: Column, w: int, h: int, size: int, sigma: float) -> Column:
    return separable(v, w, h, gauss(size, sigma))


def box_mean(v: Column, w: int, h: int, size: int) -> Column:
    return separable(v, w, h, [1 / size] * size)


def extreme(v: Column, w: int, h: int, by: int, how: Callable[[Column], Column]) -> Column:
    """``how`` (``array_max``, ``array_min``) of the pixels up to ``by`` away: a picture dilated or eroded by a square."""
    wide = w + 2 * by
    line = lambda p, base: how(F.array(*[F.get(p, base + (dy * wide + dx)) for dy in range(2 * by + 1) for dx in range(2 * by + 1)]))
    bases = F.transform(_places(w * h), lambda k: _div(k, w) * wide + k % w)
    return let(padded(v, w, h, by, repeated), lambda p: F.transform(bases, lambda base: line(p, base)))


def closed(v: Column, w: int, h: int, by: int) -> Column:
    """Gaps narrower than the square are closed."""
    return extreme(extreme(v, w, h, by, F.array_max), w, h, by, F.array_min)


def cropped(v: Column, w: int, h: int, left: int, top: int) -> Column:
    """A picture without ``left`` columns and ``top`` rows on either side; see ``inner_size``."""
    wide, high = inner_size(w, h, left, top)
    if (wide, high) == (w, h):
        return v
    return let(v, lambda p: F.transform(_places(wide * high), lambda k: F.get(p, (_div(k, wide) + top) * w + k % wide + left)))


def inner_size(w: int, h: int, left: int, top: int) -> tuple[int, int]:
    """Width and height inside borders; the whole picture if nothing lies inside."""
    inside = w - 2 * left, h - 2 * top
    return inside if min(inside) > 0 else (w, h)


def shifted(v: Column, w: int, h: int, dx: Column, dy: Column) -> Column:
    """The picture moved so that what lay at (x + dx, y + dy) lies at (x, y); edges repeat."""
    at = lambda s, k: F.get(s["v"], repeated(_div(k, w) + s["dy"], h) * w + repeated(k % w + s["dx"], w))
    return let(F.struct(v.alias("v"), dx.alias("dx"), dy.alias("dy")), lambda s: F.transform(_places(w * h), lambda k: at(s, k)))


def product(matrix: list[list[float]], v: Column, w: int) -> Column:
    """The rows of a fixed matrix times a picture of width ``w``."""
    cell = lambda p, row, x: _sum([F.get(p, F.lit(j * w) + x) * m for j, m in enumerate(row) if m])
    line = lambda p, row: F.transform(_places(w), lambda x: cell(p, row, x))
    return let(v, lambda p: F.concat(*[line(p, row) for row in matrix]))


def _sum(terms: list[Column]) -> Column:
    """A sum as a balanced tree, so that expressions stay flat."""
    while len(terms) > 1:
        terms = [x + y for x, y in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0] if terms else F.lit(0.0)


def transposed(v: Column, w: int, h: int) -> Column:
    return let(v, lambda p: F.transform(_places(w * h), lambda k: F.get(p, k % h * w + _div(k, h))))


def both_sides(rows: list[list[float]], columns: list[list[float]], v: Column, w: int, h: int) -> Column:
    """rows * picture * columns', for fixed matrices: any separable transform. Its width is the number of ``columns``."""
    down = product(rows, v, w)
    turned = let(down, lambda d: transposed(d, w, len(rows)))
    across = let(turned, lambda t: product(columns, t, len(rows)))
    return let(across, lambda a: transposed(a, len(rows), len(columns)))


def area_weights(n: int, to: int) -> list[list[float]]:
    """Share of each of ``n`` pixels in each of ``to`` pixels over the same length."""
    step = n / to
    return [[max(0.0, min((i + 1) * step, j + 1) - max(i * step, j)) / step for j in range(n)] for i in range(to)]


def resampled(v: Column, w: int, h: int, to_w: int, to_h: int) -> Column:
    """A picture of another size: each pixel is the mean of the area it covers."""
    if (w, h) == (to_w, to_h):
        return v
    return both_sides(area_weights(h, to_h), area_weights(w, to_w), v, w, h)


def cosines(n: int, some: int) -> list[list[float]]:
    """The first rows of the orthonormal discrete cosine transform of ``n`` numbers."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * j + 1) * k / (2 * n)) for j in range(n)] for k in range(some)]


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.nullif(F.size(v), F.lit(0)))


def variance(v: Column) -> Column:
    return let(F.struct(v.alias("v"), mean(v).alias("m")), lambda s: mean(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"]))))


def quantile(v: Column, q: float) -> Column:
    """Interpolated quantile of an array."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        return F.get(s, low) + (place - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low))

    return let(F.array_sort(v), at)


def hash_bits(v: Column) -> Column:
    """64 bits as a long: entries above the median of all entries but the first."""
    middle = F.get(F.array_sort(F.slice(v, 2, 63)), F.lit(31))
    bit = lambda p, m: F.transform(p, lambda x, i: F.when(x > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return let(F.struct(v.alias("v"), middle.alias("m")), lambda s: F.aggregate(bit(s["v"], s["m"]), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
