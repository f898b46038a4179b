"""Recordings and their truth: schedules by a loop, and detection that meets them."""

import pytest

from framelake.operators import generated as ge
from framelake.operators import signal as sg


def plan(spark, holds, kinds=("slide", "fade"), level=0.02):
    rows = [("v", k, float(h), kinds[k % len(kinds)], level) for k, h in enumerate(holds)]
    return ge.schedule(spark.createDataFrame(rows, "g string, k int, hold double, kind string, level double"))


def test_schedule_and_samples(spark):
    p = plan(spark, [1.0, 0.5, 2.0]).orderBy("k").collect()
    assert [(r["a"], r["b"], r["to"]) for r in p] == [(0, 29, 41), (42, 56, 68), (69, 128, 128)]
    x = ge.recorded(plan(spark, [1.0, 0.5, 2.0]), height=8.0, noise=0.0).orderBy("i").collect()
    assert [r["i"] for r in x] == list(range(129)) and x[30]["t"] == pytest.approx(1.0)
    ease = lambda q: q * q * (3 - 2 * q)
    assert [r["x"] for r in x[30:42]] == pytest.approx([8 * 12 * (ease((j + 1) / 12) - ease(j / 12)) for j in range(12)])
    # either way of changing moves as much in all
    assert sum(r["x"] for r in x[30:42]) == pytest.approx(96) and sum(r["x"] for r in x[57:69]) == pytest.approx(96)
    assert {r["x"] for r in x[:30]} == {0.02}


@pytest.mark.parametrize("more", [{}, {"scale": 8.0}, {"noise": 0.1}])
def test_detection_meets_the_truth(spark, more):
    p = plan(spark, [1.5, 0.5, 3, 0.8, 2.2, 0.45, 4, 1])
    got = ge.met(p.select("g", "a", "b"), sg.detect(ge.recorded(p, **more))[2]).first()
    assert (got["truth"], got["detected"], got["matched"]) == (8, 8, 8)


def test_misses_are_counted(spark):
    seg = lambda *ab: spark.createDataFrame([("v", a, b) for a, b in ab], "g string, a long, b long")
    got = ge.met(seg((0, 50), (100, 150), (200, 260)), seg((7, 44), (109, 150), (195, 268), (300, 400))).first()
    assert (got["truth"], got["detected"], got["matched"]) == (3, 4, 2)
    none = ge.met(seg((0, 50)), seg((0, 1)).limit(0)).first()
    assert (none["truth"], none["detected"], none["matched"]) == (1, 0, 0)


def test_samples_of_a_recording_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sg, "BLOCK", 64)
    rows = [(g, k, float(h), ("slide", "fade")[k % 2], 0.02) for g, holds in (("v", [1.0, 0.5, 2.0, 9.0, 0.03]), ("w", [0.03]), ("u", [5.3])) for k, h in enumerate(holds)]
    p = ge.schedule(spark.createDataFrame(rows, "g string, k int, hold double, kind string, level double"))
    made = sg.smoothed_parts(ge.recorded_parts(ge.in_blocks(p, 64, sg.halo(sg.SegmentParams())), noise=0.1))
    names = ["g", "i", "t", "s", "_l", "_r"]
    want = sg.smoothed(ge.recorded(p, noise=0.1)).select(*names)
    key = lambda r: r[:2]
    assert sorted(map(tuple, sg.samples(made).select(*names).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    # between the samples, made where parts are dealt, and their smoothing no rows move
    steps = [line.strip(" +-:*()0123456789") for line in made._jdf.queryExecution().executedPlan().toString().splitlines()]
    at = next(k for k, line in enumerate(steps) if line.startswith("MapInArrow"))
    assert "transform(sequence(" in " ".join(steps[at : next(k for k, line in enumerate(steps) if line.startswith("Exchange"))])
