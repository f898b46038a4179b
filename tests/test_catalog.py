"""Catalogs: titles are parsed after their rows are dealt, and once."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import catalog as ct
from framelake.plans import page_queries as pq
from framelake.plans import review_queries as rq

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chapter_parse", "sort_items", "item_names", "series_chapters", "series_latest"])
def test_titles_are_parsed_after_they_are_dealt(spark, name):
    plan = {**pq.QUERIES, **rq.QUERIES}[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    parsing = [k for k, line in enumerate(plan.split("\n")) if "ArrowEvalPython" in line]
    dealt = [k for k, line in enumerate(plan.split("\n")) if "REPARTITION_BY_NUM" in line]
    scans = [k for k, line in enumerate(plan.split("\n")) if "FileScan" in line]
    assert parsing and all(any(p < d < min(s for s in scans if s > p) for d in dealt) for p in parsing)


def test_numbers_of_titles(spark):
    titles = ["X Chapter 7", "X ch. 12-10", "X ep 3 & 4.5", "X chapter 1-99", "none", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, t string").select("k", ct.parse(F.col("t")).alias("r")).orderBy("k").collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [(7.0, 7.0), (12.0, 12.0), (3.0, 4.5), (1.0, 1.0), None, None]
