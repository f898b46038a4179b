import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import catalog as ct
from framelake.operators import signal as sg


def signal(spark, x, detail=40.0):
    return spark.createDataFrame([("v", i, i / 30, float(v), float(detail)) for i, v in enumerate(x)], "g string, i long, t double, x double, detail double")


def ramps(holds, still=0.02, step=16, height=6.0):
    """Flat stretches of so many seconds with a little deterministic ripple, joined by triangular bumps of ``step`` samples."""
    bump = height * (1 - np.abs(2 * (np.arange(step) + 0.5) / step - 1)) + 0.4
    parts = []
    for k, seconds in enumerate(holds):
        n = round(seconds * 30)
        parts += [bump] * (k > 0) + [still * (1 + np.sin(1.7 * np.arange(n) + k)) / 2]
    return np.concatenate(parts)


def count(spark, x, **kw):
    return sg.detect(signal(spark, x), sg.SegmentParams(**kw))[2].count()


def test_irregular_holds(spark):
    assert count(spark, ramps([1.5, 0.5, 3, 0.8, 2.2, 0.45, 4, 1])) == 8


def test_spikes_do_not_split(spark):
    x = ramps([3, 3])
    x[30] = 15
    x[60:62] = 12
    assert count(spark, x) == 2


def test_short_holds_need_the_duration(spark):
    x = ramps([2, 0.15, 2])
    assert count(spark, x, min_duration=0.5) == 2
    assert count(spark, x, min_duration=0.1) == 3


def test_published_threshold(spark):
    row = spark.range(1).select(sg.threshold(F.lit(0.02), F.lit(24.2), F.lit(0.5)).alias("t")).first()
    assert math.isclose(row["t"], 1.69, abs_tol=0.01)


def test_manual_threshold_wins(spark):
    assert count(spark, ramps([1] * 6), threshold=100.0) == 1


def test_median_repeats_edges(spark):
    x = [4, 1, 7, 7, 2, 8, 3, 0, 5, 9]
    got = [r["s"] for r in sg.running_median(signal(spark, x), 5).orderBy("i").collect()]
    at = lambda k: x[min(max(k, 0), len(x) - 1)]
    assert got == [sorted(at(k + j) for j in range(-2, 3))[2] for k in range(len(x))]


def test_peaks_of_short_series_and_stretches(spark):
    s = spark.createDataFrame([("one", 0, 5.0), ("two", 0, 1.0), ("two", 1, 5.0)], "g string, i long, s double").withColumn("h", F.lit(0.5))
    assert sg.local_peaks(s, 3).count() == 0
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 400).astype(float)
    d = 6
    order = sorted((k for k in range(400) if x[k] >= 20 and (k == 0 or x[k] >= x[k - 1]) and (k == 399 or x[k] > x[k + 1])), key=lambda k: (-x[k], k))
    want = []
    for k in order:
        if all(abs(k - j) > d for j in want):
            want.append(k)
    s = spark.createDataFrame([("v", i, float(v)) for i, v in enumerate(x)], "g string, i long, s double").withColumn("h", F.lit(20.0))
    assert sorted(r["i"] for r in sg.local_peaks(s, d).collect()) == sorted(want)


def test_sweep_counts_as_detect_does(spark):
    x = signal(spark, ramps([1.2, 0.5, 2, 0.2, 1, 0.9]))
    counts = {r["step"]: r["segments"] for r in sg.sweep(x, steps=5).collect()}
    for k in range(5):
        assert counts[k] == sg.detect(x, sg.SegmentParams(sensitivity=k / 4))[2].count()


def test_refine_divides_where_content_differs(spark):
    """Three hidden bumps of one height in a segment, content changes at the second.

    The last bump comes first: the calmest samples on its sides differ, and on those of the second; on those of the first they do not.
    """
    x = np.full(300, 0.01)
    x[75:80] = x[150:155] = x[225:230] = 0.12
    x = np.concatenate([ramps([2, 2]), np.full(14, 6.0), x])
    s, thr, q = sg.detect(signal(spark, x), sg.SegmentParams(threshold=1.0))
    last = q.orderBy(F.desc("a")).limit(1).collect()[0]
    start = last["a"]
    content = lambda c: F.col(c) < start + 152
    differs = lambda rows: rows.where(content("left") != content("right"))
    got = sorted((r["a"] - start, r["b"] - start) for r in sg.refine(s, q, thr, differs, sg.SegmentParams(threshold=1.0)).collect() if r["a"] >= start)
    assert got == [(0, 149), (155, 224), (230, last["b"] - start)]
    same = sg.refine(s, q, thr, lambda rows: rows.limit(0), sg.SegmentParams(threshold=1.0))
    assert same.count() == q.count()


def test_asof_ties_and_ends(spark):
    s = signal(spark, [0, 0, 0])
    r = spark.createDataFrame([("v", -1.0), ("v", 1 / 60), ("v", 9.0)], "g string, r double")
    assert sorted(x["i"] for x in sg.asof(s, r, "nearest").collect()) == [0, 0, 2]
    assert sorted(x["i"] for x in sg.asof(s, r, "forward").collect()) == [0, 1, 2]


def test_empty_signal(spark):
    assert sg.detect(signal(spark, []).limit(0))[2].count() == 0


def test_selection_text(spark):
    rows = spark.createDataFrame([("3, 5,11-9",), (" 7 ",), ("1.5-2",)], "t string").select(ct.ranges(F.col("t")).alias("r")).collect()
    assert [[tuple(x) for x in r["r"]] for r in rows] == [[(3, 3), (5, 5), (9, 11)], [(7, 7)], [(1.5, 2)]]
    for bad in ("abc", "", "3-"):
        with pytest.raises(Exception, match="not a selection"):
            spark.createDataFrame([(bad,)], "t string").select(ct.ranges(F.col("t")).alias("r")).collect()


@pytest.mark.parametrize("title,series,want", [("Lost Harbour (Chapter 14)", "Lost Harbour", (14, 14)), ("Lost Harbour 2 (Chapter 5)", "Lost Harbour", None), ("【Lost Harbour】Chapter 7~9", "lost harbour", (7, 9)), ("The Lost Harbour! ep. 3", "Lost Harbour", (3, 3)), ("Ålost Harbour Ch 4", "Lost Harbour", None), ("Été perdu : Chapter 8 & 2024", "ETE PERDU", (8, 8)), (None, "x", None), ("a (b Chapter 2", "a (b", (2, 2))])
def test_chapters_of_a_series(spark, title, series, want):
    r = spark.createDataFrame([(title, series)], "t string, s string").select(ct.parse_chapter(F.col("t"), F.col("s")).alias("r")).first()["r"]
    assert (tuple(r) if r else None) == want


def test_upsert_ties_and_playable(spark):
    new = spark.createDataFrame([("a", "done", 1), ("a", "done", 9), ("a", "done", 4)], "label string, status string, pages int")
    assert [r["pages"] for r in ct.upsert(new.limit(0), new, ["pages"]).collect()] == [9]
    f = spark.createDataFrame([("x", 720, 1280, "vp9", None, None, None, 5.0, 0), ("x", 720, 1280, "avc1.4", "none", "storyboard", None, 9.0, 1), ("x", 720, 1280, "av01", "opus", None, False, 7.0, 2), ("x", 720, 1280, "avc1", "opus", None, True, 7.0, 3), ("x", None, None, "avc1", None, None, None, 8.0, 4)], "id string, width int, height int, vcodec string, acodec string, format_note string, has_drm boolean, tbr double, pos int")
    assert [r["pos"] for r in ct.choose_format(ct.playable(f), 720, ["pos"]).collect()] == [0]


@pytest.mark.parametrize("title,want", [("Miss A (Chapter 142)", (142, 142)), ("Miss A - Ch. 12-13", (12, 13)), ("Chapter 10 & 11", (10, 11)), ("Ep 5 & 2024", (5, 5)), ("Prologue", None), ("episode 3.5", (3.5, 3.5))])
def test_parse(spark, title, want):
    r = spark.createDataFrame([(title,)], "t string").select(ct.parse(F.col("t")).alias("r")).first()["r"]
    assert (tuple(r) if r else None) == want


def test_labels(spark):
    rows = spark.createDataFrame([(7.0, 7.0), (12.5, 12.5), (10.0, 11.0), (1234.0, 1234.0)], "a double, b double").select(ct.label(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["007", "012.5", "010-011", "1234"]
