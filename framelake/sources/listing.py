"""Paged listings of many sources at once, of which each stops being read when it has shown enough."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import catalog as ct
from framelake.tables import discard, materialise


def listed(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], n: int, extra: int = 30, limit: int = 5000, series: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that ``catalog.scanned`` keeps, without reading the pages after them, and (source, pages): how many pages each source had read.

    ``fetch`` takes (source, page) and returns rows (source, idx, title, ...) of those pages, pages of a source in order of ``idx``; a page
    without rows ends a source. A source is done ``extra`` usable rows after its ``n``-th distinct number (of a ``series``), at
    ``limit`` usable rows, or when it ends. Each round reads the next page of all sources that are not done, in one job.

    Between rounds a row a source is kept (usable rows, distinct numbers, where the n-th was), and the numbers seen, so
    a round costs what its pages hold. Repeated sources are one; null sources are not asked for.
    """
    number = ct.parse(F.col("title")) if series is None else ct.parse_chapter(F.col("title"), series)
    state = materialise(sources.select("source").where("source is not null").distinct().select("source", F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("keys"), F.lit(None).cast("long").alias("found"), F.lit(0).cast("long").alias("pages"), F.lit(False).alias("done")), "list-state")
    known, kept, page = None, [], 0
    stop = lambda: F.least(F.coalesce(F.col("found") + extra, F.lit(limit)), F.lit(limit))
    while True:
        open_ = state.where("not done")
        if open_.isEmpty():
            break
        rows = materialise(fetch(open_.select("source", F.lit(page).alias("page"))), "list-page")
        use = rows.where(ct.usable(F.col("title"))).withColumn("_r", number)
        if known is not None:
            use = use.join(known.select(F.col("source").alias("_s"), F.col("_r").alias("_k")).withColumn("_old", F.lit(True)), (F.col("source") == F.col("_s")) & (F.col("_r") == F.col("_k")), "left").drop("_s", "_k")
        else:
            use = use.withColumn("_old", F.lit(None).cast("boolean"))
        w = Window.partitionBy("source").orderBy("idx")
        first = F.row_number().over(Window.partitionBy("source", "_r").orderBy("idx")) == 1
        use = use.withColumn("_new", (F.col("_r").isNotNull() & F.col("_old").isNull() & first).cast("int"))
        use = use.withColumn("_p", F.row_number().over(w)).withColumn("_sum", F.sum("_new").over(w)).join(open_.select("source", "seen", "keys", "found"), "source")
        use = materialise(use.withColumn("_p", F.col("_p") + F.col("seen")), "list-usable")
        got = use.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_new").alias("_keys"), F.min(F.when(F.col("keys") + F.col("_sum") >= n, F.col("_p"))).alias("_at"))
        any_ = rows.groupBy("source").agg(F.lit(1).alias("_any"))
        now = state.join(any_, "source", "left").join(got, "source", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = now.select("source", (F.col("seen") + zero("_rows")).alias("seen"), (F.col("keys") + zero("_keys")).alias("keys"), F.coalesce("found", F.when(~F.col("done"), F.col("_at"))).alias("found"), (F.col("pages") + zero("_any")).alias("pages"), "done", "_any")
        now = now.withColumn("done", F.col("done") | F.col("_any").isNull() | (F.col("seen") >= stop())).drop("_any")
        old, state = state, materialise(now, "list-state")
        fresh = use.where("_new = 1").select("source", "_r")
        known = materialise(fresh if known is None else known.unionByName(fresh), "list-known")
        kept.append(use.select(*rows.columns, "_p"))
        discard(old)
        discard(rows)
        page += 1
    if not kept:
        empty = fetch(state.select("source", F.lit(0).alias("page")))
        return empty.where("false"), state.select("source", "pages")
    every = reduce(DataFrame.unionByName, kept).join(state.select("source", stop().alias("_stop")), "source")
    return every.where(F.col("_p") <= F.col("_stop")).drop("_p", "_stop"), state.select("source", "pages")
