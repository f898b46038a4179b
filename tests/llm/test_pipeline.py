"""The pipeline's stages, one after the other, against what they must leave of a planted corpus."""

import numpy as np

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    clean = [" ".join(words(150)) for _ in range(30)]
    near = clean[3].split()
    near[70] = "changed"
    item = " ".join(words(40))
    texts = [*clean, "too short", None, "a b c " * 60, clean[5], " ".join(near), " ".join(words(90)) + " " + item + " " + " ".join(words(90))]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [set(range(30)) | {33, 34, 35}, set(range(30)) | {35}, set(range(30))]
    got = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/stage{k}"
        stage(spark, got, str(tmp_path)).write.parquet(out)
        got = spark.read.parquet(out)
        if k < 4:
            assert got.columns == docs.columns
        if k < 3:
            assert sorted(r["doc_id"] for r in got.collect()) == sorted(want[k])
    rows = got.collect()
    assert {r["doc_id"] for r in rows} <= want[2]
    by_source = [sum(r["doc_id"] % 2 == k for r in rows) for k in range(2)]
    # equal sources weigh 1 and 2: twice the words of the second, about the same words in all
    assert 1.5 < by_source[1] / by_source[0] < 2.7 and 25 <= len(rows) <= 35
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in sorted({r["shard"] for r in rows}) for i in range(sum(r["shard"] == s for r in rows))]


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"
    text = " ".join(f"w{i * i}" for i in range(90))
    rows = [(None, text, None, None, 1, 1, "a"), (5, text, "en", "s", 1, 2, None), (5, text, "en", "s", 1, 2, None), (6, None, "en", "s", None, 3, "b")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("empty", []), ("odd", rows)):
        got = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{tmp_path}/{name}{k}"
            stage(spark, got, str(tmp_path)).write.parquet(out)
            got = spark.read.parquet(out)
            if k < 4:
                assert got.columns == [c.split()[0] for c in schema.split(", ")]
            if k == 2:
                assert sorted(str(r["doc_id"]) for r in got.collect()) == (["5", "None"] if data else [])
        assert bool(got.count()) == bool(data)
