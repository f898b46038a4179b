"""Archives and books: every byte where other readers look for it, whatever the split into tasks."""

import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import archives as ar


def _pages(spark, sizes):
    rng = np.random.default_rng(1)
    made = {(g, i): rng.integers(0, 256, s, np.uint8).tobytes() for g, n in sizes.items() for i, s in zip(range(0, 3 * n, 3), rng.integers(0, 400, n), strict=True)}
    return made, spark.createDataFrame([(g, i, bytearray(v), "x") for (g, i), v in made.items()], "g string, i int, v binary, at string")


def test_zips_are_read_by_others_and_by_ranges(spark, tmp_path):
    sizes = {"a": 1203, "b/c": 1, "d": 40}
    made, df = _pages(spark, sizes)
    ar.write_files(df.repartition(9), f"file://{tmp_path}/out", ar.Zip("png"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.zip", "b c.zip", "d.zip"]
    for g, n in sizes.items():
        with zipfile.ZipFile(tmp_path / "out" / f"{g.replace('/', ' ')}.zip") as z:
            assert z.testzip() is None
            assert z.namelist() == [f"page_{k + 1:04d}.png" for k in range(n)]
            assert [z.read(x) for x in z.namelist()] == [made[g, 3 * k] for k in range(n)]
    for per in (100_000, 7):
        got = ar.read_zips(spark, f"{tmp_path}/out", per).collect()
        assert {(r["archive"], r["k"]): bytes(r["v"]) for r in got} == {(f"{g.replace('/', ' ')}.zip", i // 3): v for (g, i), v in made.items()}
        assert len(got) == len(made)


def test_long_archives(spark, tmp_path):
    n = 70_000
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.col("id").cast("string").cast("binary").alias("v"))
    ar.write_files(df, f"{tmp_path}/out", ar.Zip("txt"))
    with zipfile.ZipFile(tmp_path / "out" / "a.zip") as z:
        assert len(z.namelist()) == n and z.namelist()[-1] == f"page_{n}.txt"
        assert z.read("page_0001.txt") == b"0" and z.read("page_69999.txt") == b"69998"
    got = ar.read_zips(spark, f"{tmp_path}/out", 20_000)
    assert got.where(F.col("v").cast("string").cast("long") == F.col("k")).count() == n


def test_places_beyond_four_gigabytes(spark):
    p = spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(3).cast("long").alias("n"), F.lit(5).cast("long").alias("size"), F.lit(7).cast("long").alias("crc"), F.lit(1 << 33).alias("at"))
    form = ar.Zip("png")
    e = bytes(p.select(form.entry(ar._page()).alias("b")).first()[0])
    assert e[42:46] == b"\xff" * 4 and e[30:32] == b"\x0c\x00" and e[-12:] == b"\x01\x00\x08\x00" + (1 << 33).to_bytes(8, "little")
    far = F.lit(1 << 33)
    end = bytes(p.select(form.end(F.col("n"), far, far, F.lit(100).cast("long")).alias("b")).first()[0])
    assert end[:4] == b"PK\x06\x06" and end[48:56] == (1 << 33).to_bytes(8, "little") and end[-22:-18] == b"PK\x05\x06" and end[-6:-2] == b"\xff" * 4


def test_other_writers_and_damage(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.txt", b"1" * 1000)
        z.comment = b"of others"
    assert bytes(ar.read_zips(spark, str(tmp_path)).first()["v"]) == b"1" * 1000
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[data.index(b"PK\x01\x02") + 16] ^= 1
    (tmp_path / "x.zip").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        ar.read_zips(spark, str(tmp_path)).collect()


def test_odd_pages(spark, tmp_path):
    rows = [(None, 1, None), ("", None, bytearray(b"n")), ("..", 2, bytearray(b"same")), ("..", 2, bytearray(b"same"))]
    df = spark.createDataFrame(rows, "g string, i int, v binary")
    ar.write_files(df, f"{tmp_path}/odd", ar.Zip("bin"))
    with zipfile.ZipFile(tmp_path / "odd" / "untitled.zip") as z:
        assert [z.read(x) for x in z.namelist()] == [b"n", b"", b"same", b"same"]
    with pytest.raises(FileExistsError):
        ar.write_files(df, f"{tmp_path}/odd", ar.Zip("bin"))
    ar.write_files(df.limit(0), f"{tmp_path}/none", ar.Zip("bin"))
    assert not list((tmp_path / "none").iterdir())
    assert ar.read_zips(spark, f"{tmp_path}/none").count() == 0


def test_a_lost_job_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("v"))
    with pytest.raises(Exception, match="lost"):
        ar.write_files(df, f"{tmp_path}/out", ar.Zip("bin"))
    assert not list(tmp_path.iterdir())


def test_books_resolve_object_by_object(spark, tmp_path):
    n, w, h = 600, 4, 3
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 256, w * h, np.uint8).tobytes() for _ in range(n)]
    df = spark.createDataFrame([("a", i, bytearray(v)) for i, v in enumerate(made)] + [("b", 0, bytearray(made[0]))], "g string, i int, v binary").repartition(5)
    ar.write_files(df, f"{tmp_path}/out", ar.Book(w, h, 100.0))
    for per in (10_000, 7):
        got = {(r["book"], r["k"]): bytes(r["v"]) for r in ar.read_books(spark, f"{tmp_path}/out", per).collect()}
        assert got == {("a.pdf", k): v for k, v in enumerate(made)} | {("b.pdf", 0): made[0]}
    for g, n in (("a", n), ("b", 1)):
        data = (tmp_path / "out" / f"{g}.pdf").read_bytes()
        assert data.startswith(b"%PDF-1.4\n") and data.endswith(b"%%EOF\n")
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
        head = re.match(rb"xref\n0 (\d+)\n", data[start:])
        lines = data[start + head.end() :]
        assert int(head[1]) == 4 * n + 3
        places = {}
        for k in range(4 * n + 3):
            at, _, kind = lines[20 * k : 20 * k + 20].split()
            if kind == b"n":
                places[k] = int(at)
        assert lines[20 * (4 * n + 3) :].startswith(b"trailer")

        def obj(k):
            text = data[places[k] :]
            assert text.startswith(b"%d 0 obj\n" % k)
            return text[: text.index(b"endobj")]

        refs = lambda k, key: [int(x) for x in re.findall(rb"(\d+) 0 R", re.search(key + rb"\[([^\]]*)\]", obj(k))[1])]
        assert b"/Pages 2 0 R" in obj(1) and b"/Count %d/" % n in obj(2)
        leaves = [(p, x) for p in refs(2, rb"/Kids") for x in refs(p, rb"/Kids")]
        assert len(leaves) == n
        for i, (parent, leaf) in enumerate(leaves):
            page = obj(leaf)
            assert b"/Parent %d 0 R" % parent in page and b"MediaBox[0 0 2.880 2.160]" in page
            picture = data[places[int(re.search(rb"/P (\d+) 0 R", page)[1])] :]
            body = picture[picture.index(b"stream\n") + 7 :]
            assert body[: w * h] == made[i] and body[w * h :].startswith(b"\nendstream\nendobj\n")
            inside = data[places[int(re.search(rb"/Contents (\d+) 0 R", page)[1])] :]
            size = int(re.search(rb"/Length (\d+)", inside)[1])
            assert inside[inside.index(b"stream\n") + 7 + size :].startswith(b"\nendstream")
