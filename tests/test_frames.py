"""Raw frames: written in parallel, read by offset, and only the bytes of the stride."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import frames as fr


def test_frames_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    made = {(g, i): rng.integers(0, 256, 12, np.uint8).tobytes() for g in ("a", "b-1") for i in range(5, 65) if (g, i) != ("a", 30)}
    df = spark.createDataFrame([(g, i, bytearray(v)) for (g, i), v in made.items()], "g string, i int, v binary").repartition(7)
    path = f"file://{tmp_path}/frames"
    fr.write_frames(df, path, 4, 3)
    assert not [p for p in (tmp_path / "frames").iterdir() if p.name.startswith("_")]
    for stride, per in ((1, 1000), (1, 7), (4, 7), (100, 3)):
        got = {(r["g"], r["i"]): bytes(r["v"]) for r in fr.read_frames(spark, path, 4, 3, stride, per).collect()}
        assert got == {k: v for k, v in made.items() if k[1] % stride == 0}


def test_only_strided_bytes_are_read(tmp_path):
    (tmp_path / "s-10.raw").write_bytes(bytes(range(200)) * 3)  # 60 frames of 10 bytes, from number 10 on
    r = fr.RawFramesReader({"path": str(tmp_path), "width": "5", "height": "2", "stride": "8", "frames_per_partition": "25"})
    read = []
    r.frame = lambda f, at: read.append((at, len(x := fr.RawFramesReader.frame(r, f, at)))) or x
    runs = r.partitions()
    assert [(p.first, p.last, p.base) for p in runs] == [(10, 34, 0), (35, 59, 250), (60, 69, 500)]
    rows = [x for p in runs for x in r.read(p)]
    assert [x[1] for x in rows] == [16, 24, 32, 40, 48, 56, 64] and read == [(60 + 80 * k, 10) for k in range(7)]
    assert all(v == (bytes(range(200)) * 3)[at : at + 10] for _, _, v, at in rows)


def test_odd_frames(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, bytearray(b"abc"))], "g string, i int, v binary")
    with pytest.raises(Exception, match="bytes instead of"):
        fr.write_frames(df, f"file://{tmp_path}/wrong", 2, 2)
    assert not [p for p in (tmp_path / "wrong").iterdir() if p.name.endswith(".raw")]
    fr.write_frames(df.limit(0), f"file://{tmp_path}/none", 2, 2)
    (tmp_path / "none").mkdir(exist_ok=True)
    assert fr.read_frames(spark, f"file://{tmp_path}/none", 2, 2).count() == 0
    v = spark.createDataFrame([([-3.0, 0.5, 254.6, 300.0],)], "v array<double>").select(fr.to_bytes(F.col("v")).alias("b")).first()["b"]
    assert bytes(v) == bytes([0, 0, 255, 255])
