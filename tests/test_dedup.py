"""Scores of far pairs, worked out where their blocks meet, against a loop; rows settled in stretches, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.operators import dedup as dd
from framelake.plans import page_queries, review_queries


@pytest.mark.parametrize("distance", [22, 4])
def test_far_pairs_with_scores(spark, monkeypatch, distance):
    monkeypatch.setattr(dd, "BLOCK", 16)
    v = np.random.default_rng(3).normal(size=(60, 64))
    v[40:] = v[:20] + np.random.default_rng(4).normal(size=(20, 64)) * (0.3 if distance == 22 else 0.001)
    d = dd.descriptors(spark.createDataFrame([(k // 50, k, x.tolist()) for k, x in enumerate(v)], "label int, vec_id long, embedding array<double>")).cache()
    rows = {(r["g"], r["i"]): r for r in d.collect()}
    apart = lambda a, b: bin((a["h"] ^ b["h"]) & (1 << 64) - 1).count("1")
    want = {(g, i, j): (apart(a, b), float(np.dot(a["v"], b["v"]))) for (g, i), a in rows.items() for (h, j), b in rows.items() if g == h and j - i > 5 and apart(a, b) <= distance}
    got = {(r["g"], r["i"], r["j"]): (r["dist"], r["score"]) for r in dd.far_pairs(d, 5, distance, score=True).collect()}
    assert set(got) == set(want) and want
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in want)


def rows_of(df):
    return sorted(map(tuple, df.select("g", "j", "status", "i").collect()))


@pytest.mark.parametrize("window, same", [(5, 0.3), (3, 0.9), (1, 0.5)])
def test_resolved_as_all_pairs(spark, monkeypatch, window, same):
    monkeypatch.setattr(dd, "STRETCH", 16)
    rng = np.random.default_rng(window)
    v = rng.normal(size=(150, 64)) / 8
    v[60:] = v[rng.integers(0, 60, 90)] + rng.normal(size=(90, 64)) / rng.choice([8, 16, 400], 90)[:, None]
    v[70] = v[90] = v[10]
    odd = [v[3].tolist()[:63] + [None], v[3].tolist()[:40], [], None, v[3].tolist() + [1.0], [0.0] * 64]
    some = [x.tolist() for x in v[:100]] + odd + odd + [x.tolist() for x in v[100:]]
    rows = [(None if k % 50 == 7 else k % 2, k, x) for k, x in enumerate(some)]
    d = dd.descriptors(spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>").repartition(4)).withColumn("active", F.col("id") % 7 != 0)
    p = dd.DedupParams(window=window, same=same)
    d.cache()
    want = rows_of(dd.resolve(dd.scored(d, p)))
    got = dd.resolved(d, p)
    assert rows_of(got) == want and {x[2] for x in want} == {"duplicate", "possible"}
    assert got.dtypes == dd.resolve(dd.scored(d, p)).dtypes
    assert rows_of(dd.resolved(d.limit(0), p)) == []


@pytest.mark.parametrize("query", [page_queries.dedup_greedy, review_queries.dedup_active])
def test_copies_are_not_paired_with_each_other(spark, monkeypatch, tmp_path, query):
    spark.createDataFrame([(k, [float(x % 5) for x in range(64)], 1) for k in range(700)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made, write = [], dd.materialise

    def counted(df, name):
        out = write(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(dd, "materialise", counted)
    found = query(spark, str(tmp_path)).count()
    # of copies the first is kept, and others meet it alone
    assert found == (699 if query is page_queries.dedup_greedy else 599) and max(made) <= 700


def test_scores_are_rounded_as_in_data_frames(spark):
    x = np.array([0.3, 0.2999995, 0.29999949999999997, 0.2999994, 0.29999950000000003, 0.5, 0.0, np.nan, np.inf, -np.inf])
    rounded = [r["x"] for r in spark.createDataFrame([(float(y),) for y in x], "x double").select((F.round("x", 6) >= 0.3).alias("x")).collect()]
    assert vectors.at_least(x, 0.3).tolist() == rounded
