"""Signals in blocks: what a plain loop gives, in more than one task, and rounds that read only what is left."""

import numpy as np
from pyspark.sql import functions as F
from test_signal import ramps, signal

from framelake.operators import signal as sg


def smooth(x):
    at = lambda k: x[min(max(k, 0), len(x) - 1)]
    s = [sorted(at(k + j) for j in range(-2, 3))[2] for k in range(len(x))] if len(x) > 2 else list(x)
    return [s[1] if len(x) > 1 else 0.0, *s[1:]]


def test_blocks_of_a_series(spark, monkeypatch):
    monkeypatch.setattr(sg, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = {f"v{n}": rng.random(n) for n in (1, 2, 3, 15, 16, 17, 33, 400)}
    d = spark.createDataFrame([(g, i, i / 30, float(v)) for g, all_ in x.items() for i, v in enumerate(all_)], "g string, i long, t double, x double")
    # tasks of so few rows would be joined
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sg.smoothed(d).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, values in x.items():
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["i"])
        want = smooth(values)
        assert [r["s"] for r in mine] == want
        assert [r["_l"] for r in mine] == [None, *want[:-1]] and [r["_r"] for r in mine] == [*want[1:], None]
    # a long series is not one task's
    assert len({r["task"] for r in rows if r["g"] == "v400"}) > 1


def written(monkeypatch):
    sizes, keep = [], sg.materialise

    def noted(df, name):
        out = keep(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(sg, "materialise", noted)
    return sizes


def hidden():
    x = np.full(300, 0.01)
    x[75:80] = x[150:155] = x[225:230] = 0.12
    return np.concatenate([ramps([2, 2]), np.full(14, 6.0), x])


def test_rounds_of_refine_read_only_divided_segments(spark, monkeypatch):
    p = sg.SegmentParams(threshold=1.0)
    s, thr, q = sg.detect(signal(spark, hidden()), p)
    sizes = written(monkeypatch)
    segs = sorted((r["a"], r["b"]) for r in q.collect())
    start, end = segs[-1]
    assert sg.refine(s, q, thr, lambda rows: rows.where((F.col("left") < start + 152) & (F.col("right") >= start + 152)), p).count() == len(segs) + 2
    read = [n for name, n in sizes if name == "refine-samples"]
    # all segments; the last one without a bump of five samples; of that, the half which is divided again
    assert read[0] == sum(b - a + 1 for a, b in segs) and read[1] == end - start + 1 - 5 and read[2] < read[1]


def test_verified_suggestion_smooths_once(spark, monkeypatch):
    sizes = written(monkeypatch)
    x = signal(spark, hidden())
    expected = spark.createDataFrame([("v", 3, 0, 0)], "g string, expected long, hidden int, manual int")
    assert sg.verified_suggestion(x, expected, lambda rows: rows.limit(0)).first()["pages"] == 3
    # one signal is written, and only samples inside segments go with each sensitivity
    assert [name for name, n in sizes if n == x.count()] == ["verify-signal"]
