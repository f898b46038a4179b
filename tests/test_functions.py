import hashlib

import pytest
from pyspark.sql import functions as F

from framelake.functions import geometry as ge
from framelake.operators import pages as pg
from framelake.sources import files


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_sizes_and_turns(spark):
    assert value(spark, ge.quarter_turns(F.lit(-90))) == 3
    assert tuple(value(spark, ge.analysis_size(F.lit(720), F.lit(1280), 160))) == (160, 284)
    assert tuple(value(spark, ge.analysis_size(F.lit(4), F.lit(4), 160))) == (8, 8)
    assert value(spark, ge.quality(F.lit(720), F.lit(1280))) == 720
    assert value(spark, ge.quality(F.lit(None).cast("int"), F.lit(480))) == 480
    assert value(spark, ge.clock(F.lit(65.25))) in ("01:05.3", "01:05.2")


def test_fingerprint(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a.bin").write_bytes(data)
    n, c = len(data), 1000
    want = hashlib.sha1(str(n).encode())
    for at in (0, n // 2 - c // 2, n - c):
        want.update(data[at : at + c])
    assert files.fingerprints(spark, f"file://{tmp_path}", c).first()["fingerprint"] == want.hexdigest()[:16]


def test_boxes(spark):
    from framelake.operators import pages as pg

    box = value(spark, pg.manual_crop(F.lit(0.9), F.lit(0.75), F.lit(0.1), F.lit(0.25), F.lit(100), F.lit(200)))
    assert tuple(box) == (10, 50, 90, 150)
    assert value(spark, ge.fill_fraction(F.lit(1.0), F.lit(2.0))) == 0.5
    assert tuple(value(spark, pg.parse_crop(F.lit("0, 0.5,1,1")))) == ("manual", [0, 0.5, 1, 1]) and value(spark, pg.parse_crop(F.lit("none")))["mode"] == "none"
    for bad in ("0,0,1", "0,0,1,2", "x"):
        with pytest.raises(Exception, match="a crop is"):
            value(spark, pg.parse_crop(F.lit(bad)))


def test_still_pages_have_no_border(spark):
    from framelake.operators import pages as pg

    rows = [("still", i, [1.0] * 64) for i in range(3)] + [("few", i, [float(i)] * 64) for i in range(2)] + [("sizes", i, [float(90 * i)] * (64 if i else 56)) for i in range(4)] + [("moves", i, [0.0] * 8 + [float(90 * i)] * 56) for i in range(3)]
    got = pg.static_border(pg.pixels(spark.createDataFrame(rows, "g string, id int, v array<double>"), 8)).collect()
    assert [(r["g"], r["top"], r["bottom"], r["left"], r["right"]) for r in got] == [("moves", 1, 0, 0, 0)]


def test_stride(spark):
    assert [r["idx"] for r in files.stride(spark.range(10).withColumnRenamed("id", "idx"), 4).collect()] == [0, 4, 8]


def test_duplicates_against_a_loop(spark, monkeypatch):
    import numpy as np

    from framelake.operators import dedup as dd

    rng = np.random.default_rng(5)
    rows = [("g", j, int(i), int(rng.integers(0, 3)), float(np.round(rng.random(), 3)), bool(rng.random() < 0.3)) for j in range(1, 80) for i in rng.choice(j, min(j, 4), replace=False)]
    s = spark.createDataFrame(rows, "g string, j int, i int, rank int, score double, far boolean")
    want, gone = {}, set()
    for j in range(1, 80):
        open_ = sorted(((-r, -x, not f, i) for _, k, i, r, x, f in rows if k == j and r > 0 and i not in gone))
        if open_:
            want[j] = ("duplicate" if open_[0][0] == -2 else "possible", open_[0][3])
            if open_[0][0] == -2:
                gone.add(j)
    for settle in (dd.resolve, dd.resolved_in_rounds):
        assert {r["j"]: (r["status"], r["i"]) for r in settle(s).collect()} == want
    monkeypatch.setattr(dd, "FOLD_ROWS", 100)
    both = s.unionByName(s.where("j < 20").withColumn("g", F.lit("small")))
    got = {(r["g"], r["j"]): (r["status"], r["i"]) for r in dd.resolve(both).collect()}
    assert got == {("g", j): w for j, w in want.items()} | {("small", j): w for j, w in want.items() if j < 20}


def test_far_pairs_against_all(spark):
    import numpy as np

    from framelake.operators import dedup as dd

    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, 64)
    bits = [np.where(rng.random(64) < rng.choice([0.05, 0.2, 0.5]), 1 - base, base) for _ in range(60)]
    h = [int("".join(map(str, b)), 2) - (1 << 64 if b[0] else 0) for b in bits]
    d = spark.createDataFrame([("g", i, x) for i, x in enumerate(h)], "g string, i int, h long")
    got = [(r["i"], r["j"]) for r in dd.far_pairs(d, 5, 22).collect()]
    assert sorted(got) == [(i, j) for i in range(60) for j in range(i + 6, 60) if (bits[i] != bits[j]).sum() <= 22]
    near = [(r["i"], r["j"]) for r in dd.near_pairs(d, 5).collect()]
    assert sorted(near) == [(i, j) for i in range(60) for j in range(i + 1, min(60, i + 6))]


def test_extents_of_long_profiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    made = {n: rng.integers(0, 9, n).astype(float) * (np.abs(np.arange(n) - n / 3) < n / 4) for n in (1, 2, 5, 149, 1000)}
    df = spark.createDataFrame([(n, i, float(x)) for n, v in made.items() for i, x in enumerate(v)], "g long, i long, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in pg.profile_extent(df, 0.6).collect()}
    for n, v in made.items():
        win = max(3, int(np.rint(n * 0.02)) | 1)
        s = np.array([v[max(0, i - win // 2) : i + win // 2 + 1].sum() / win for i in range(n)])
        ref = np.percentile(s, 90)
        on = np.flatnonzero((s >= 0.6 * ref) & (ref > 0))
        assert got[n] == ((on[0], on[-1] + 1) if len(on) else (0, n)), n


def test_pages_of_a_size(spark):
    page = ge.page_size(F.col("m"), F.col("a"))
    rows = spark.createDataFrame([("uniform", 2.0), ("uniform", None), ("letter", 9.0), ("fit", 1.0), ("a5", 1.0)], "m string, a double")
    got = [r[0] and (round(r[0]["w"], 2), round(r[0]["h"], 2)) for r in rows.select(page).collect()]
    assert got == [(841.89, 420.94), (595.28, 841.89), (612.0, 792.0), None, None]
    i = lambda x: F.lit(x)
    pad = spark.range(1).select(ge.padded(i(10), i(7), F.lit(1.0)).alias("a"), ge.padded(i(7), i(10), F.lit(1.0)).alias("b"), ge.padded(i(8), i(4), F.lit(2.0)).alias("c")).first()
    assert [tuple(x) for x in pad] == [(10, 10, 0, 1), (10, 10, 1, 0), (8, 4, 0, 0)]
    letter = F.struct(F.lit(612.0).alias("w"), F.lit(792.0).alias("h"))
    fit = spark.range(1).select(ge.fitted(i(1700), i(1000), letter, 100.0).alias("a"), ge.fitted(i(80), i(90), letter, 100.0).alias("b")).first()
    assert [tuple(x) for x in fit] == [(850, 500), (80, 90)]
