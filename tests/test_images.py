"""Picture kernels against plain loops, and verdicts on planted pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import grids as gr
from framelake.operators import dedup as dd
from framelake.operators import images as im


def grid(spark, *pictures):
    """A row for each tuple of pictures, as columns a, b, ..."""
    names = "abcd"[: len(pictures[0])]
    return spark.createDataFrame([tuple([float(x) for x in p.ravel()] for p in row) for row in pictures], ", ".join(f"{c} array<double>" for c in names))


def conv(p, kernel, mode="reflect"):
    by = len(kernel) // 2
    q = np.pad(p, by, mode=mode)
    return sum(kernel[i][j] * q[i : i + p.shape[0], j : j + p.shape[1]] for i in range(len(kernel)) for j in range(len(kernel)))


def window(size, sigma):
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return np.outer(k, k) / k.sum() ** 2


def ssim(a, b):
    g, c1, c2 = window(7, 1.5), 6.5025, 58.5225
    ma, mb = conv(a, g), conv(b, g)
    va, vb, ab = conv(a * a, g) - ma**2, conv(b * b, g) - mb**2, conv(a * b, g) - ma * mb
    return (2 * ma * mb + c1) * (2 * ab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def test_stencils_and_transforms(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((9, 13)) * 255, rng.random((9, 13)) * 255
    w, h = 13, 9
    A, B = F.col("a"), F.col("b")
    row = grid(spark, (a, b)).select(
        gr.stencil(A, w, h, gr.LAPLACE_8).alias("l8"), im.detail(A, w, h).alias("detail"), im.sharpness(A, w, h).alias("sharp"), im.gradient(A, w, h).alias("grad"),
        gr.blurred(A, w, h, 5, 1.2).alias("blur"), im.ssim_map(A, B, w, h).alias("ssim"), gr.resampled(A, w, h, 5, 4).alias("area"), gr.both_sides(gr.cosines(h, 3), gr.cosines(w, 4), A, w, h).alias("dct"),
        gr.shifted(A, w, h, F.lit(2), F.lit(-1)).alias("shift"), gr.quantile(A, 0.95).alias("q"), gr.cropped(A, w, h, 3, 2).alias("crop"), gr.stencil(A, w, h, gr.SOBEL_X, gr.repeated).alias("edge"),
    ).first()
    l8, l4 = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]]), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
    sx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    close = lambda got, want: np.testing.assert_allclose(np.array(got), np.asarray(want).ravel(), rtol=1e-9, atol=1e-9)
    close(row["l8"], conv(a, l8))
    assert row["detail"] == pytest.approx(np.abs(conv(a, l8)).mean()) and row["sharp"] == pytest.approx(conv(a, l4).var())
    close(row["grad"], np.hypot(conv(a, sx), conv(a, sx.T)))
    close(row["blur"], conv(a, window(5, 1.2)))
    close(row["ssim"], ssim(a, b))
    fine = np.kron(a, np.ones((4, 5)))  # 36 x 65
    close(row["area"], fine.reshape(4, 9, 5, 13).mean((1, 3)))
    dct = lambda n, k: np.array([[np.sqrt((1 if i == 0 else 2) / n) * np.cos(np.pi * (2 * j + 1) * i / (2 * n)) for j in range(n)] for i in range(k)])
    close(row["dct"], dct(9, 3) @ a @ dct(13, 4).T)
    ys, xs = np.clip(np.arange(9) - 1, 0, 8), np.clip(np.arange(13) + 2, 0, 12)
    close(row["shift"], a[np.ix_(ys, xs)])
    assert row["q"] == pytest.approx(np.percentile(a, 95))
    close(row["crop"], a[2:-2, 3:-3])
    close(row["edge"], conv(a, sx, "edge"))


def test_hash_of_resampled_pictures(spark):
    rng = np.random.default_rng(1)
    p = rng.random((16, 16)) * 255
    big = np.kron(p, np.ones((4, 4)))  # 64 x 64: halves to the same 32 x 32 as 16 x 16 doubles to
    h = [grid(spark, (x,)).select(im.perceptual_hash(F.col("a"), x.shape[1], x.shape[0])).first()[0] for x in (p, big, 300 - p)]
    assert h[0] == h[1] and bin((h[0] ^ h[2]) & (1 << 64) - 1).count("1") > 50


def page(seed, size=32, cell=4):
    return np.kron(np.random.default_rng(seed).random((size // cell, size // cell)) * 200 + 20, np.ones((cell, cell)))


def moved(p, dx, dy):
    n = np.arange(len(p))
    return p[np.ix_(np.clip(n + dy, 0, len(p) - 1), np.clip(n + dx, 0, len(p) - 1))]


def test_verdicts_on_planted_pages(spark):
    noise = lambda seed: np.random.default_rng(seed).normal(0, 1.0, (64, 64))
    p = page(1, 64, 8)
    spot = p.copy()
    spot[30, 30] += 200
    pairs = [(p, p + noise(1)), (p + noise(2), moved(p, 1, -1) + noise(3)), (p, page(2, 64, 8)), (p, spot + noise(4)), (p, p * 0 + 7)]
    m = im.compare(F.col("a"), F.col("b"), 64, 64)
    rows = grid(spark, *pairs).select(m.alias("m")).select("m.*", dd.classify(F.col("m.ssim"), F.col("m.local"), F.col("m.peak"), F.col("m.spread")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["duplicate", "duplicate", "unique", "possible", "unique"]
    assert (rows[1]["dx"], rows[1]["dy"]) == (-1, 1) and (rows[0]["dx"], rows[0]["dy"]) == (0, 0)


def test_registration_of_larger_pictures(spark):
    p = np.kron(np.random.default_rng(3).random((24, 24)) * 255, np.ones((5, 5)))  # 120 x 120, halved twice to register
    r = grid(spark, (p, moved(p, -5, 3))).select(im.registered(F.col("a"), F.col("b"), 120, 120, 0.06).alias("s")).first()["s"]
    assert (r["dx"], r["dy"]) == (5, -3)


def test_sequences_of_pages(spark):
    noise = lambda k: np.random.default_rng(100 + k).normal(0, 0.8, (32, 32))
    shown = {"again": [0, 1, 2, 1, 3], "inactive": [0, 1, 0], "far": [*range(8), 0], "thrice": [5, 6, 5, 5]}
    rows = [(g, k, [float(x) for x in (page(s) + noise(k)).ravel()], (g, k) != ("inactive", 0)) for g, pages in shown.items() for k, s in enumerate(pages)]
    d = dd.picture_descriptors(spark.createDataFrame(rows, "g string, id int, v array<double>, active boolean"), 32, 32)
    got = {(r["g"], r["j"]): (r["status"], r["i"]) for r in dd.resolve(dd.compared(d, 32, 32, dd.PictureParams(window=3))).collect()}
    # a repeat of a repeat goes back to the first; far ones are found by their hashes
    assert got == {("again", 3): ("duplicate", 1), ("far", 8): ("duplicate", 0), ("thrice", 2): ("duplicate", 0), ("thrice", 3): ("duplicate", 0)}


def plain_combine(frames, calm):
    drift = [np.abs(f - frames[calm]).mean() for f in frames]
    others = [d for i, d in enumerate(drift) if i != calm]
    noise = min(others) if others else 0.0
    ok = [i for i, d in enumerate(drift) if d <= max(1.6 * noise, noise + 0.35, 0.5)]
    if len(ok) < 3 <= len(frames):
        near = sorted(range(len(frames)), key=lambda i: drift[i])[:3]
        lap = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
        best = max(near, key=lambda i: conv(frames[i], lap).var())
        return frames[best], [best], True
    ok = sorted(sorted(ok, key=lambda i: abs(i - calm))[:9])
    stack = np.sort(np.stack([frames[i] for i in ok]), 0)
    return stack[(len(ok) - 1) // 2], ok, False


def test_combine_against_a_loop(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g, (n, kind) in enumerate([(14, "still"), (6, "still"), (8, "moves"), (2, "still"), (1, "still"), (3, "moves"), (12, "glitch")]):
        base = rng.random((6, 5)) * 255
        frames = [base + rng.normal(0, 0.5, (6, 5)) if kind != "moves" else rng.random((6, 5)) * 255 for _ in range(n)]
        if kind == "glitch":
            frames[2] = rng.random((6, 5)) * 255
        groups[g] = frames, n // 2
    rows = [(g, i, [float(x) for x in f.ravel()]) for g, (frames, _) in groups.items() for i, f in enumerate(frames)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    calm = spark.createDataFrame([(g, c) for g, (_, c) in groups.items()] + [(99, 0), (50, 3)], "g int, calm int")
    got = {r["g"]: r for r in im.combine(df, calm, 5, 6).collect()}
    assert set(got) == set(groups)
    for g, (frames, c) in groups.items():
        v, used, moving = plain_combine(frames, c)
        assert (list(got[g]["used"]), got[g]["moving"]) == (used, moving)
        np.testing.assert_allclose(got[g]["v"], v.ravel())
    assert im.combine(df.limit(0), calm, 5, 6).count() == 0


@pytest.mark.parametrize("distance", [0, 3, 10, 12, 22])
def test_far_pairs_of_any_radius(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2, 64)
    bits = [np.where(rng.random(64) < rng.choice([0.02, 0.1, 0.2, 0.5]), 1 - base, base) for _ in range(80)]
    h = [int("".join(map(str, b)), 2) - (1 << 64 if b[0] else 0) for b in bits]
    d = spark.createDataFrame([(k % 2, i, x) for k in (0, 1) for i, x in enumerate(h)], "g int, i int, h long")
    got = sorted((r["g"], r["i"], r["j"]) for r in dd.far_pairs(d, 5, distance).collect())
    assert got == [(g, i, j) for g in (0, 1) for i in range(80) for j in range(i + 6, 80) if (bits[i] != bits[j]).sum() <= distance]


def test_the_usual_radius_meets_few_pairs(spark):
    rng = np.random.default_rng(9)
    d = spark.createDataFrame([(0, i, int(x)) for i, x in enumerate(rng.integers(-(1 << 63), 1 << 63, 2000))], "g int, i int, h long")
    parts = dd.hash_parts(10)
    keys = sum(1 + width for _, width in parts) if 10 // len(parts) == 1 else None
    met = sum((1 + width) / 2**width for _, width in parts)
    assert met < 0.1 and (keys is None or keys < 100) and dd.hash_parts(22) is None
    assert dd.far_pairs(d, 20, 10).count() == 0
