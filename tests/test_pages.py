"""Page tables: what their operators decide where times are equal, and what they read."""

import re

from framelake.operators import pages as pg


def test_new_pages_of_one_time_go_by_id(spark):
    # more partitions than one, so that the order in which rows arrive is not theirs
    old = spark.createDataFrame([("p", 1, 0, 1.0), ("p", 2, 1, 2.0)], "project string, id long, ord long, t double")
    new = spark.createDataFrame([("p", 100 - k, 1.0) for k in range(40)], "project string, id long, t double").repartition(8)
    got = [r["id"] for r in pg.insert_by_time(old, new).orderBy("ord").collect()]
    assert got == [1, *range(61, 101), 2]


def test_equal_aspects_meet_candidates_once(spark):
    few = spark.createDataFrame([("g", 0.5 + k % 5 / 10) for k in range(1000)], "g string, aspect double")
    best = pg.best_aspect(few)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"keys=\[g#\d+, aspect#\d+\], functions=\[(partial_)?count\(1\)\]", plan)
    r = best.first()
    assert r["aspect"] == 0.7 and r["cost"] == round(200 * sum(1 - min(x, 0.7) / max(x, 0.7) for x in (0.5, 0.6, 0.8, 0.9)), 6)
