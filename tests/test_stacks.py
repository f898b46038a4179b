"""Pictures worked out in batches: in Arrow batches, dealt over tasks, null for null."""

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import images as im
from framelake.operators import pages as pg
from framelake.operators import paper
from framelake.plans import image_queries as iq
from framelake.plans import review_queries as rq

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparisons_are_worked_out_in_batches(spark):
    p = np.random.default_rng(1).random((24, 24)) * 255
    df = spark.createDataFrame([(k, p.ravel().tolist() if k != 1 else None, (p + k).ravel().tolist()) for k in range(3)], "id int, a array<double>, b array<double>")
    x = df.select("id", im.compare(F.col("a"), F.col("b"), 24, 24).alias("m"), im.quick_similarity(F.col("a"), F.col("b"), 24, 24).alias("q"), im.perceptual_hash(F.col("a"), 24, 24).alias("h"))
    assert "ArrowEvalPython" in plan(x)
    rows = {r["id"]: r for r in x.collect()}
    assert rows[1]["m"] is None and rows[1]["q"] is None and rows[1]["h"] is None
    assert rows[0]["q"] == 1.0 and rows[0]["m"]["peak"] == 0.0 and 1.9 < rows[2]["m"]["peak"] < 2.1


def test_pages_are_drawn_after_they_are_dealt(spark):
    # one label alone still gives work to every task
    sizes = iq._pages(spark, SF).where("g = (select min(label) from parquet.`%s/embeddings.parquet`)" % SF).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in sizes) > 1


def test_sheets_are_found_where_pictures_are(spark):
    found = paper.find_paper(iq._sheets(spark, SF), iq.SIDE, iq.SIDE)
    # a deal of what pictures are drawn from and the numbering of labels: no pixel is shuffled, and each picture is worked out once
    assert plan(found).count("Exchange") == 2 and plan(found).count("ArrowEvalPython") == 1


def test_bars_are_trimmed_where_pictures_are(spark):
    assert "Exchange" not in plan(rq.trim_bars(spark, SF))
    flat, ring = np.full((9, 12), 7.0), np.random.default_rng(2).random((9, 12)) * 200
    ring[:2], ring[-1], ring[:, :3], ring[:, -2:] = 5, 9, 40, 60
    df = spark.createDataFrame([(0, flat.ravel().tolist()), (1, ring.ravel().tolist()), (2, None)], "id int, v array<double>")
    got = {r["id"]: r["b"] and tuple(r["b"]) for r in df.select("id", pg.trim_uniform(F.col("v"), 12, 9, least=2).alias("b")).collect()}
    assert got[1] == (3, 0, 10, 9)
    assert got[2] is None and got[0][2] - got[0][0] == 2 and got[0][3] - got[0][1] == 2
