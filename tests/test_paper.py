"""Thresholds, connected regions and sheets against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from framelake.functions import grids as gr
from framelake.operators import paper


def flood(mask):
    """Sets of set pixels that touch, corners too."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            seen.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(seen)
    return out


def test_regions_and_the_largest(spark):
    rng = np.random.default_rng(0)
    masks = {k: rng.random((14, 17)) < share for k, share in enumerate([0.1, 0.3, 0.4, 0.45, 0.5, 0.7, 0.9])}
    snake = np.zeros((14, 17), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True  # one region as long as can be
    masks |= {10: snake, 11: np.ones((14, 17), bool)}
    px = spark.createDataFrame([(0, k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)], "g int, id int, y int, x int")
    runs = paper.regions(px)
    got = {}
    for r in runs.collect():
        got.setdefault(r["id"], {}).setdefault((r["region"]["y"], r["region"]["x0"]), set()).update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
    for k, m in masks.items():
        assert sorted(map(sorted, got[k].values())) == sorted(map(sorted, flood(m)))
        assert all(min(s) == name for name, s in got[k].items())
    best = {r["id"]: r for r in paper.largest_region(runs).collect()}
    for k, m in masks.items():
        area = max(map(len, flood(m)))
        first = min(min(s) for s in flood(m) if len(s) == area)
        s = next(s for s in flood(m) if min(s) == first)
        ys, xs = [y for y, _ in s], [x for _, x in s]
        assert (best[k]["area"], best[k]["x0"], best[k]["y0"], best[k]["x1"], best[k]["y1"]) == (area, min(xs), min(ys), max(xs) + 1, max(ys) + 1)
    assert paper.regions(px.limit(0)).count() == 0


def test_otsu(spark):
    rng = np.random.default_rng(1)
    pictures = {0: np.concatenate([rng.normal(60, 10, 200), rng.normal(180, 15, 90)]), 1: rng.integers(0, 3, 50), 2: np.full(9, 7), 3: np.array([0, 255])}
    pictures = {k: np.clip(np.round(v), 0, 255).astype(int) for k, v in pictures.items()}
    px = spark.createDataFrame([(0, k, int(x)) for k, v in pictures.items() for x in v], "g int, id int, v int")
    got = {r["id"]: r["level"] for r in paper.otsu(px).collect()}

    def level(v):
        apart = lambda t: (v <= t).sum() * (v > t).sum() * (v[v <= t].mean() - v[v > t].mean()) ** 2
        return min(sorted(set(v))[:-1], key=lambda t: (-round(apart(t), 6), t))

    assert got == {k: level(v) for k, v in pictures.items() if k != 2}


def test_sheets(spark):
    def picture(y0, y1, x0, x1, holes=()):
        p = np.full((40, 50), 50.0) + np.random.default_rng(2).normal(0, 3, (40, 50))
        p[y0:y1, x0:x1] += 150
        for y, x in holes:
            p[y, x] = 60
        return p

    shown = {"sheet": picture(6, 33, 10, 41, [(15, 20), (15, 21), (25, 30)]), "full": picture(0, 40, 0, 50), "small": picture(5, 12, 5, 12), "touching": picture(0, 40, 0, 30)}
    corner = picture(5, 35, 8, 42)
    corner[np.add.outer(np.arange(40), np.arange(50)) < 42] = 50
    shown["corner"] = corner
    df = spark.createDataFrame([(0, k, [float(x) for x in v.ravel()]) for k, v in shown.items()] + [(0, "null", None), (0, "flat", [7.0] * 2000)], "g int, id string, v array<double>")
    got = {r["id"]: r for r in paper.find_paper(df, 50, 40).collect()}
    assert {k: r["paper"] for k, r in got.items() if k != "full"} == {"sheet": True, "small": False, "touching": False, "corner": False}
    assert tuple(got["sheet"][c] for c in ("x0", "y0", "x1", "y1")) == (10, 6, 41, 33)


def test_gaps_are_closed(spark):
    m = np.zeros((7, 9))
    m[2:5, 2:7] = 1
    m[3, 4] = 0
    row = spark.createDataFrame([([float(x) for x in m.ravel()],)], "v array<double>").select(gr.closed(F.col("v"), 9, 7, 1).alias("c")).first()["c"]
    m[3, 4] = 1
    assert row == m.ravel().tolist()
