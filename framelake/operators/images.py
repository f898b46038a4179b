"""Grey pictures of pages: sharpness, hashes, similarity, comparison, and one picture from several frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import grids as gr
from framelake.functions import stacks as sk

#: Side of the picture that is hashed, and of its block of low frequencies.
HASH_SIDE, HASH_BLOCK = 32, 8
#: Fixed values of the structural similarity of pictures of 0 to 255: two constants, window, its deviation.
SSIM_C1, SSIM_C2, SSIM_SIZE, SSIM_SIGMA = (0.01 * 255) ** 2, (0.03 * 255) ** 2, 7, 1.5


def detail(v: Column, w: int, h: int) -> Column:
    """Mean size of the eight-neighbour Laplacian: how much fine detail a frame has."""
    return gr.mean(F.transform(gr.stencil(v, w, h, gr.LAPLACE_8), F.abs))


def sharpness(v: Column, w: int, h: int, side: int = 1000) -> Column:
    """Variance of the four-neighbour Laplacian of a picture of at most ``side`` pixels a side."""
    scale = min(1.0, side / max(w, h))
    to = (int(w * scale), int(h * scale)) if scale < 1 else (w, h)
    return gr.let(gr.resampled(v, w, h, *to), lambda s: gr.variance(gr.stencil(s, *to, gr.LAPLACE_4)))


def gradient(v: Column, w: int, h: int) -> Column:
    """Size of the Sobel gradient at every pixel."""
    return gr.let(v, lambda p: F.zip_with(gr.stencil(p, w, h, gr.SOBEL_X), gr.stencil(p, w, h, gr.SOBEL_Y), F.hypot))


def edge_sharpness(v: Column, w: int, h: int, outline: Column) -> Column:
    """Median gradient along an outline, an array of (x, y) of all its pixels; a pixel's is the largest around it.

    Pixels within two of the picture's border do not count; a large number if fewer than a tenth are left.
    """
    near = lambda g, x, y: F.array_max(F.array(*[F.get(g, gr.repeated(y + dy, h) * w + gr.repeated(x + dx, w)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    inside = F.filter(outline, lambda p: (p["x"] > 2) & (p["x"] < w - 3) & (p["y"] > 2) & (p["y"] < h - 3))
    along = gr.let(gradient(v, w, h), lambda g: gr.quantile(F.transform(inside, lambda p: near(g, p["x"], p["y"])), 0.5))
    return F.when(F.size(inside) < 0.1 * F.size(outline), F.lit(1e9)).otherwise(along / 4)


def perceptual_hash(v: Column, w: int, h: int) -> Column:
    """64 bits of a picture as a long: which of its lowest frequencies, to six places, are above their median."""
    low = np.array(gr.cosines(HASH_SIDE, HASH_BLOCK))
    # one product each way: the transform of a resampled picture is one matrix
    rows, columns = low @ np.array(gr.area_weights(h, HASH_SIDE)), low @ np.array(gr.area_weights(w, HASH_SIDE))

    def kernel(p: np.ndarray) -> dict[str, np.ndarray]:
        c = np.round(rows @ p @ columns.T, 6).reshape(len(p), -1)
        high = c > np.sort(c[:, 1:], 1)[:, [31]]
        return {"hash": np.packbits(high, axis=1, bitorder="little").view("<i8")[:, 0]}

    return sk.mapped(kernel, "hash long", w, h, v)["hash"]


def ssim_map(a: Column, b: Column, w: int, h: int) -> Column:
    """Structural similarity of two pictures at every pixel."""
    return gr.let(F.struct(a.alias("a"), b.alias("b")), lambda s: _ssim(s["a"], s["b"], w, h))


def _ssim(a: Column, b: Column, w: int, h: int) -> Column:
    blur = lambda x: gr.blurred(x, w, h, SSIM_SIZE, SSIM_SIGMA)
    times = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    stats = F.arrays_zip(blur(a).alias("a"), blur(b).alias("b"), blur(times(a, a)).alias("aa"), blur(times(b, b)).alias("bb"), blur(times(a, b)).alias("ab"))
    part = lambda s, i: s[["a", "b", "aa", "bb", "ab"][i]]

    def cell(s: Column) -> Column:
        ma, mb = part(s, 0), part(s, 1)
        va, vb, ab = part(s, 2) - ma * ma, part(s, 3) - mb * mb, part(s, 4) - ma * mb
        return ((ma * mb * 2 + SSIM_C1) * (ab * 2 + SSIM_C2)) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))

    return F.transform(stats, cell)


def _ssim_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    blur = lambda x: sk.separable(x, gr.gauss(SSIM_SIZE, SSIM_SIGMA))
    ma, mb = blur(a), blur(b)
    va, vb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return ((ma * mb * 2 + SSIM_C1) * (ab * 2 + SSIM_C2)) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))


def quick_similarity(a: Column, b: Column, w: int, h: int) -> Column:
    """Mean structural similarity of two small pictures as they lie."""
    return sk.mapped(lambda p, q: {"ssim": _ssim_stack(p, q).mean((1, 2))}, "ssim double", w, h, a, b)["ssim"]


#: Pictures wider than this are registered at half their size first.
COARSE = 48


def registered(a: Column, b: Column, w: int, h: int, max_shift: float) -> Column:
    """(dx, dy) in whole pixels that moves ``b`` onto ``a``: the shift of the highest correlation, the smallest of equals.

    Shifts of up to ``max_shift`` of each side are tried at a size of at most ``COARSE`` pixels; twice that size tries
    those around the best, and so on. Correlations are of the part that no such shift leaves.
    """
    return sk.mapped(lambda p, q: dict(zip(("dx", "dy"), _registered(p, q, max_shift))), "dx int, dy int", w, h, a, b)


def _registered(a: np.ndarray, b: np.ndarray, max_shift: float) -> tuple[np.ndarray, np.ndarray]:
    n, h, w = a.shape
    far = lambda n: max(0, int(max_shift * n))
    left, top = far(w) + 1, far(h) + 1
    zero = np.zeros(n, int)
    if 2 * left >= w or 2 * top >= h:
        return zero, zero
    if max(w, h) <= COARSE or min(w, h) < 16:
        tried = [(zero + x, zero + y) for y in range(-far(h), far(h) + 1) for x in range(-far(w), far(w) + 1)]
    else:
        small = w // 2, h // 2
        dx, dy = _registered(sk.resampled(a, *small), sk.resampled(b, *small), max_shift)
        tried = [(np.clip(dx * 2 + x, -far(w), far(w)), np.clip(dy * 2 + y, -far(h), far(h))) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    inner, best = sk.cropped(a, left, top), None
    for dx, dy in tried:
        c = sk.correlation(inner, sk.cropped(sk.moved(b, dx, dy), left, top))
        key = np.stack([-c, abs(dx) + abs(dy), dx, dy])
        if best is None:
            best = key
            continue
        # the first place in which two keys differ decides
        differs = np.argmax(np.vstack([key != best, np.ones((1, n), bool)]), 0)
        less = (differs < 4) & np.where(np.take_along_axis(key, differs[None].clip(0, 3), 0) < np.take_along_axis(best, differs[None].clip(0, 3), 0), True, False)[0]
        best = np.where(less, key, best)
    return best[2].astype(int), best[3].astype(int)


def compare(a: Column, b: Column, w: int, h: int, max_shift: float = 0.06) -> Column:
    """(ssim, local, peak, spread, dx, dy): how alike two pictures are once ``b`` lies on ``a``.

    ``ssim`` is the mean similarity after a light blur, ``local`` the least mean of it over small windows; ``peak`` and
    ``spread`` are the largest and the 95th percentile of mean differences over smaller windows. The borders that
    any allowed shift could reach are left out.
    """
    return sk.mapped(lambda p, q: _compared(p, q, max_shift), "ssim double, local double, peak double, spread double, dx int, dy int", w, h, a, b)


def _compared(a: np.ndarray, b: np.ndarray, max_shift: float) -> dict[str, np.ndarray]:
    _, h, w = a.shape
    # window sides: an odd share of the width
    odd = lambda share, least: max(least, round(share * w) | 1)
    k, k2 = odd(0.04, 5), odd(0.015, 3)
    dx, dy = _registered(a, b, max_shift)
    soft = lambda v: sk.cropped(sk.separable(v, gr.gauss(9, 1.0)), int(max_shift * w) + 3, int(max_shift * h) + 3)
    inner = lambda v: sk.cropped(v, k // 2, k // 2)
    x, y = soft(a), soft(sk.moved(b, dx, dy))
    alike, gap = _ssim_stack(x, y), inner(sk.separable(abs(x - y), [1 / k2] * k2))
    return {
        "ssim": alike.mean((1, 2)), "local": inner(sk.separable(alike, [1 / k] * k)).min((1, 2)), "peak": gap.max((1, 2)),
        "spread": np.quantile(gap.reshape(len(gap), -1), 0.95, axis=1), "dx": dx, "dy": dy,
    }


def frame_stats(frames: DataFrame, w: int, h: int) -> DataFrame:
    """(g, i, brightness, diff, detail) of frames (g, i, v): mean value, mean change from the frame before, and fine detail."""
    before = F.lag("v").over(Window.partitionBy("g").orderBy("i"))
    f = frames.withColumn("v", F.col("v").cast("array<double>")).withColumn("_before", before)
    change = F.zip_with("v", "_before", lambda x, y: F.abs(x - y))
    return f.select("g", "i", gr.mean(F.col("v")).alias("brightness"), F.coalesce(gr.mean(change), F.lit(0.0)).alias("diff"), detail(F.col("v"), w, h).alias("detail"))


def sharpest(frames: DataFrame, w: int, h: int) -> DataFrame:
    """(g, i, sharpness): the sharpest of each group's frames (g, i, v), the first of equals."""
    scored = frames.select("g", "i", sharpness(F.col("v").cast("array<double>"), w, h).alias("sharpness"))
    return scored.groupBy("g").agg(F.min(F.struct((-F.col("sharpness")).alias("s"), "i")).alias("b")).select("g", "b.i", (-F.col("b.s")).alias("sharpness"))


#: Least and relative slack above the noise of still frames, and the least tolerance.
ALIGN, SLACK, LEAST = 1.6, 0.35, 0.5
#: A shot is still if at least so many of its frames are.
STILL = 3


def combine(frames: DataFrame, calm: DataFrame, w: int, h: int, max_frames: int = 9, compare_width: int = 256, align: float = ALIGN) -> DataFrame:
    """(g, v, used, moving): one picture for each group of frames (g, i, v) around its calm frame (g, calm).

    A frame's drift is its mean difference from the calm one, at ``compare_width``; the noise is the least drift of the others. If
    enough frames drift no more than the noise allows, the picture is the lower median of them at every pixel, of the
    ``max_frames`` nearest the calm one at most; else the shot moves, and it is the sharpest of the three that drift least.

    Groups are a segment's candidate frames, a few dozen; only those used are brought together. Of several frames with one
    number any counts; a group whose calm frame is missing gives no row, null pictures do not count.
    """
    small = (w, h) if w <= compare_width else (compare_width, max(1, round(h * compare_width / w)))
    f = frames.select("g", "i", F.col("v").cast("array<double>").alias("v")).where("v is not null").withColumn("_s", gr.resampled(F.col("v"), w, h, *small))
    ref = f.join(calm.select("g", F.col("calm").alias("i")), ["g", "i"]).select("g", F.col("i").alias("calm"), F.col("_s").alias("_ref"))
    gap = gr.mean(F.zip_with("_s", "_ref", lambda x, y: F.abs(x - y)))
    d = f.join(ref, "g").withColumn("drift", gap).drop("_s", "_ref")
    every = Window.partitionBy("g")
    noise = F.coalesce(F.min(F.when(F.col("i") != F.col("calm"), F.col("drift"))).over(every), F.lit(0.0))
    d = d.withColumn("_noise", noise).withColumn("_n", F.count(F.lit(1)).over(every))
    d = d.withColumn("_ok", F.col("drift") <= F.greatest(F.col("_noise") * align, F.col("_noise") + SLACK, F.lit(LEAST)))
    d = d.withColumn("moving", (F.sum(F.col("_ok").cast("int")).over(every) < STILL) & (F.col("_n") >= STILL))
    nearest = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("_ok"), F.abs(F.col("i") - F.col("calm")), "i"))
    least = F.row_number().over(Window.partitionBy("g").orderBy("drift", "i"))
    d = d.withColumn("_near", nearest).withColumn("_least", least)
    used = d.where(F.when(F.col("moving"), F.col("_least") <= 3).otherwise(F.col("_ok") & (F.col("_near") <= max_frames)))
    score = F.when(F.col("moving"), sharpness(F.col("v"), w, h)).otherwise(F.lit(0.0))
    used = used.withColumn("_best", F.when(F.col("moving"), F.row_number().over(Window.partitionBy("g").orderBy(F.desc(F.round(score, 9)), "_least"))).otherwise(1)).where("_best = 1")
    few = used.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("f"), F.first("moving").alias("moving"))
    middle = F.call_function("div", F.size("f") - 1, F.lit(2)).cast("int")
    median = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda k: F.get(F.array_sort(F.transform("f", lambda x: F.get(x["v"], k))), middle))
    return few.select("g", median.alias("v"), F.transform("f", lambda x: x["i"]).alias("used"), "moving")
