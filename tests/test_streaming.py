import tempfile

from framelake.streaming import signal as st


def drained(spark, make, rows):
    """Feeds the rows in two batches and returns what the stream wrote."""
    top = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, "g string, i long, x double").coalesce(1).write.mode("append").parquet(f"{top}/in")
        source = spark.readStream.schema("g string, i long, x double").parquet(f"{top}/in")
        q = make(source).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{top}/out").collect()


def test_lag_diff_keeps_the_last_sample(spark):
    rows = [("v", i, float(x)) for i, x in enumerate([1, 4, 4, 9, 2, 2])]
    got = sorted((r["i"], r["diff"]) for r in drained(spark, st.lag_diff, rows))
    assert got == [(0, 0.0), (1, 3.0), (2, 0.0), (3, 5.0), (4, 7.0), (5, 0.0)]


def test_segments_cross_batches(spark):
    rows = [("v", i, float(x)) for i, x in enumerate([0, 0, 9, 0, 0, 0, 0, 9, 0, 9])]
    got = sorted((r["a"], r["b"]) for r in drained(spark, lambda s: st.segments(s, 1.0, 2), rows))
    assert got == [(0, 1), (3, 6)]


def test_segments_against_a_loop(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 3, 200)
    rows = [("v", i, float(v)) for i, v in enumerate(x)]
    want, a = [], None
    for i, v in enumerate(x):
        if v <= 1 and a is None:
            a = i
        if v > 1 and a is not None:
            want += [(a, i - 1)] * (i - a >= 3)
            a = None
    assert sorted((r["a"], r["b"]) for r in drained(spark, lambda s: st.segments(s, 1.0, 3), rows)) == want
