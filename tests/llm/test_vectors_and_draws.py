"""Neighbours, codes and importance draws against brute force, and on odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import codes, forest, resampling
from framelake.llm.words import encode

VECTORS = "vec_id long, embedding array<float>, label int, rank int, part string, `a.b` int"
nan, inf = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "x", 1) for i, v, label in rows], VECTORS)


ODD_VECTORS = [None, [], [None, 1.0, 1.0, 1.0], [nan, 1.0, 1.0, 1.0], [inf, 1.0, 1.0, 1.0], [1.0, 2.0]]


def exact_neighbours(rows, k=10):
    """Of (id, vector) rows: {query: [(distance, id)]} by the definition."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good:
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), i) for i, b in good if i != q)[:k]
    return out


def found_neighbours(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    grid = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    rows = grid + [(1000 + i, v) for i, v in enumerate(ODD_VECTORS)] + [(None, [1.0, 1.0, 1.0, 1.0]), (900, [0.0, 0.0, 0.0, 0.0]), grid[5], grid[100], (400, [-0.0, 1.0, 2.0, 0.0])]
    got = found_neighbours(forest.nearest_neighbours(vectors(spark, [(i, v, 0) for i, v in rows]), F.col("vec_id") % 100 == 0))
    # a few hundred rows on a grid: many ties, one leaf or a few, all of which are looked at
    assert got == exact_neighbours(rows)


def test_neighbours_of_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0])]
    got = found_neighbours(forest.nearest_neighbours(vectors(spark, [(i, v, 0) for i, v in few]), F.col("vec_id") % 100 == 0))
    assert got == {0: [(0.0, 100), (math.sqrt(2), 7)], 100: [(0.0, 0), (math.sqrt(2), 7)]}
    for rows in ([], [(0, None, 0)], [(0, [1.0, 1.0, 1.0, 1.0], 0)]):
        assert forest.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect() == []


def test_neighbours_among_copies_and_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.float32(centres[rng.integers(0, 30, 6000)] + 0.3 * rng.normal(size=(6000, 16)))
    x[2000:4000] = x[0]  # a third of the rows are one vector
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    df = vectors(spark, rows)
    got = found_neighbours(forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0))
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        assert len(got[q]) == 10
        assert all(abs(s - d[i]) < 1e-12 for s, i in got[q])
        if 2000 <= q < 4000:
            assert [i for _, i in got[q]] == [i for i in [0, *range(2000, 2012)] if i != q][:10]
        hit += len({i for _, i in want} & {i for _, i in got[q]})
    assert hit >= 0.95 * 600


def test_forest_routes_and_searches_alike():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    f = forest.Forest(x, 3, 5)
    leaves = f.leaves(x)
    assert leaves.min() >= 0 and leaves.max() < 32
    rows = np.stack([np.bincount(leaves[:, t], minlength=32) for t in range(3)])
    assert rows.min() > 60  # medians split evenly
    for i, probes in enumerate(f.probes(x[:20], np.full(20, 1e-9), rows, 1)):
        # a query that reaches nowhere else looks at its own leaf first
        t, leaf, _ = probes[0]
        assert leaves[i, t] == leaf
    every = f.probes(x[:1], np.full(1, 1e9), rows, 1, miss=-1.0)[0]
    assert {(t, leaf) for t, leaf, _ in every} == {(t, leaf) for t in range(3) for leaf in range(32)}


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = vectors(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(1500, 4)))])
    whole = found_neighbours(forest.nearest_neighbours(df, F.col("vec_id") % 5 == 0))
    monkeypatch.setattr(forest, "BLOCK_NUMBERS", 4)  # blocks of 64 rows and queries
    monkeypatch.setattr(forest, "LEAF_ROWS", 400)
    assert found_neighbours(forest.nearest_neighbours(df, F.col("vec_id") % 5 == 0)).keys() == whole.keys()


def exact_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    q = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows]
    width = len(q[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted((i, v) for i, v, _ in q if i is not None)[:entries]
    books = [[cut(v, p) for _, v in seeds] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in q:
            best = [min((sum((a - b) ** 2 for a, b in zip(cut(v, p), w, strict=True)), e) for e, w in enumerate(books[p])) for p in range(parts)]
            out.append(([e for _, e in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), (code, _) in zip(q, found, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, bytes(code), error) for (i, _, _), (code, error) in zip(q, assign(), strict=True)], books


@pytest.mark.parametrize("entries", [3, 40])
def test_codes_against_brute_force(spark, entries):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3) if i % 7 else None) for i, v in enumerate(rng.normal(size=(150, 8)))]
    rows += [rows[3], rows[3], (None, [0.5] * 8, 1), (5, [0.25] * 8, 1)]
    rows += [(900 + i, v, 0) for i, v in enumerate([None, [], [None] * 8, [nan] * 8, [inf] * 8, [1.0, 2.0]])]
    want, books = exact_codes(rows[:-6], entries=entries)
    got, made = codes.lloyd_codes(vectors(spark, rows), entries=entries)
    assert made.tolist() == books
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, bytes(r["code"]), r["error"]) for r in got.collect()) == sorted((i is None, i or 0, c, e) for i, c, e in want)
    back = codes.decoded(got, made).collect()
    assert all(np.allclose(r["embedding"], [(b + 0.5) / 1024 for p in range(4) for b in books[p][r["code"][p]]]) for r in back)


def test_codes_of_large_components_and_odd_tables(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(5).integers(-60000, 60000, (60, 4)))]
    want, books = exact_codes(rows, entries=5)
    got, made = codes.lloyd_codes(vectors(spark, rows), entries=5)
    assert made.tolist() == books and sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in got.collect()) == sorted(want)
    for odd in ([], [(1, None, 0)], [(None, [1.0] * 4, 0)]):
        found, made = codes.lloyd_codes(vectors(spark, odd))
        assert found.collect() == [] and made.shape[1] == 0
    with pytest.raises(ValueError):
        codes.lloyd_codes(vectors(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(Exception, match="or more"):
        codes.lloyd_codes(vectors(spark, [(1, [1e6] * 4, 0)]))[0].collect()


def test_only_changed_parts_are_sent(spark):
    changed = []
    rng = np.random.default_rng(6)
    q = rng.integers(0, 50, (400, 8)).astype(np.int32)
    books = np.stack([q[:9, :4], q[:9, 4:]]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([0] * 400), pa.array(list(q), pa.list_(pa.int32())), pa.nulls(400, pa.binary())], names=["vec_id", "label", "q", "code"])
    sums = {}
    for _ in range(12):
        batch = next(codes._assign(books, False)(iter([batch])))
        for out in codes._changes(2, 9)(iter([batch])):
            changed.append(out.num_rows)
            for r in out.to_pylist():
                n, s = sums.get((r["part"], r["entry"]), (0, np.zeros(4, np.int64)))
                sums[r["part"], r["entry"]] = (n + r["n"], s + np.array(r["s"]))
        code = codes._code(batch.column("code"), 2)
        for p in range(2):
            for e in range(9):
                mine = q[code[:, p] == e][:, p * 4 : p * 4 + 4]
                n, s = sums.get((p, e), (0, 0))
                assert n == len(mine) and (n == 0 or (mine.sum(0) == s).all())
                if n:
                    books[p, e] = s // n
    assert changed[0] == 18 and changed[-1] < 9


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def exact_features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


TEXTS = [None, "", " \n!", "one", "Two words", "Ab aB AB ab ab ab", "naïve Ünï-cödé 12 日本 x", "x" * 5000 + " y " + "é" * 300, "a\x00b a\x00b", "same words here " * 30, "w " * 4000, "İstanbul ΑΒ"]


def test_features_of_whole_parts():
    want = [Counter(zlib.crc32(g.encode()) % 10000 for g in exact_features(t)[1]) for t in TEXTS]
    got = [Counter() for _ in TEXTS]
    for part, rows in encode(pa.array(TEXTS, pa.string())):
        for doc, bucket in resampling.features(part):
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                got[rows.start + d][b] += 1
    assert got == want


def test_features_do_not_depend_on_chunks(monkeypatch):
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(7).integers(0, 30, 500)), "a b c", "d"]
    count = lambda: sorted((int(d), int(b)) for part, _ in encode(pa.array(texts)) for doc, bucket in resampling.features(part) for d, b in zip(doc, bucket, strict=True))
    whole = count()
    monkeypatch.setattr(resampling, "CHUNK", 7)
    assert count() == whole


def test_joined_checksums():
    rng = np.random.default_rng(8)
    pairs = [(rng.bytes(a), rng.bytes(b)) for a, b in ((0, 0), (1, 0), (0, 5), (7, 63), (7, 64), (3, 65), (9, 1000), (2, 131072))]
    a, b = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    assert resampling.joined_crc(a, b, np.array([len(p[1]) for p in pairs])).tolist() == [zlib.crc32(x + y) for x, y in pairs]


DOCS = "doc_id long, text string, rank int, weight string, `a.b` int"


def exact_draw(docs, target, per_cent=5):
    import hashlib

    s, t = Counter(), Counter()
    for texts, into in ((docs, s), (target, t)):
        for _, text in texts:
            into.update(zlib.crc32(g.encode()) % 10000 for g in exact_features(text)[1])
    every, aim = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        w, grams = exact_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (aim + 10000)))) for b in (zlib.crc32(g.encode()) % 10000 for g in grams))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[: len(able) * per_cent // 100]


def test_draw_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = lambda n, lo, hi: [" ".join(f"W{x}" for x in rng.integers(lo, hi, rng.integers(1, 60))) for _ in range(n)]
    docs = list(enumerate([*TEXTS, *texts(300, 0, 400), *texts(60, 350, 500)])) + [(None, "null id " * 20), (None, None), (15, "again " * 25), (15, "again " * 25)]
    target = list(enumerate([*texts(40, 350, 500), None, ""]))
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS)
    aim = spark.createDataFrame([(i, t) for i, t in target], "item_id long, text string")
    want, drawn = exact_draw(docs, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.importance(df, aim).collect()]
    assert sorted((g[:5] for g in got), key=key) == sorted(want, key=key)
    assert [g[:5] for g in sorted((g for g in got if g[5]), key=lambda g: g[5])] == drawn
    assert sorted(g[5] for g in got if g[5]) == list(range(1, len(drawn) + 1))
    # documents like the target are drawn before others
    assert sum(r[0] is not None and r[0] >= len(TEXTS) + 300 for r in drawn) >= 0.8 * len(drawn)
    monkeypatch.setattr(resampling, "ROWS_PER_RANGE", 20)
    ranges = [(r["doc_id"], r["score"], r["rank"]) for r in resampling.importance(df, aim).where("rank is not null").orderBy("rank").collect()]
    assert ranges == [(r[0], r[4], k + 1) for k, r in enumerate(drawn)]
    texts_drawn = resampling.resampled(df, aim)
    assert texts_drawn.columns == df.columns and texts_drawn.count() == len(drawn)


def test_draw_of_odd_tables(spark):
    empty, no_target = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resampling.importance(empty, no_target).collect() == []
    some = spark.createDataFrame([(i, "word " * 30, 0, "", 0) for i in range(40)], DOCS)
    got = resampling.importance(some, no_target).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
