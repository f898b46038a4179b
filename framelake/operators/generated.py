"""Motion signals of made-up recordings, with the segments that are true of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eased(p: Column) -> Column:
    """Smooth way from 0 to 1."""
    return p * p * (F.lit(3.0) - p * 2)


def schedule(pages: DataFrame, rate: float = 30.0, change: float = 0.4) -> DataFrame:
    """(g, k, kind, level, a, b, to): pages (g, k, hold, kind, level) shown one after another for ``hold`` seconds, with ``change`` seconds
    from each to the next. ``a`` to ``b`` are the samples of the hold, the true segment; those up to ``to`` change to the next page. Other columns stay."""
    still, n = F.greatest(F.floor(F.col("hold") * rate), F.lit(1)), round(change * rate)
    before = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    a = F.coalesce(F.sum(still + n).over(before), F.lit(0)).cast("long")
    last = F.lead("k").over(Window.partitionBy("g").orderBy("k")).isNull()
    s = pages.withColumn("a", a).withColumn("b", (F.col("a") + still - 1).cast("long")).withColumn("_last", last)
    more = [c for c in pages.columns if c not in ("g", "k", "hold", "kind", "level")]
    return s.select("g", "k", "kind", "level", *more, "a", "b", F.when(F.col("_last"), F.col("b")).otherwise(F.col("b") + n).alias("to"))


def in_blocks(plan: DataFrame, block: int, beside: int) -> DataFrame:
    """The parts of a ``schedule``, ``_from`` to ``_until``, that lie in each block ``_k`` of so many samples or ``beside`` it, sorted inside tasks.

    What is dealt are these parts: ``recorded_parts`` then makes the samples of a block in one task and in order, and none is shuffled.
    """
    k = lambda c: F.floor(F.greatest(c, F.lit(0)) / block)
    parts = plan.select("*", F.explode(F.sequence(k(F.col("a") - beside), k(F.col("to") + beside))).alias("_k"))
    parts = parts.withColumn("_from", F.greatest(F.col("a"), F.col("_k") * block - beside)).withColumn("_until", F.least(F.col("to"), (F.col("_k") + 1) * block - 1 + beside))
    # the parts weigh little, their samples much: as many tasks as the session has for shuffles, none joined
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "g", "_k").sortWithinPartitions("g", "_k", "_from")


def _motion(i: Column, height: float, noise: float | Column, scale: float | Column) -> Column:
    """Motion of sample ``i`` of a row of a ``schedule``."""
    n, j = (F.col("to") - F.col("b")).cast("double"), i - F.col("b")
    slide = (eased(j / n) - eased((j - 1) / n)) * n * height
    fade = (F.lit(1.0) - F.abs((j - 0.5) / n * 2 - 1)) * 2 * height
    noisy = F.abs(F.xxhash64(F.col("g"), i) % 1000) / 1000 * noise
    moves = F.when(i <= F.col("b"), F.col("level")).when(F.col("kind") == "fade", fade).otherwise(slide)
    return (moves + noisy) * scale


def recorded(plan: DataFrame, height: float = 8.0, rate: float = 30.0, noise: float | Column = 0.03, scale: float | Column = 1.0) -> DataFrame:
    """(g, i, t, x, detail): the motion of a ``schedule``, in one row a sample.

    A held page moves by its ``level`` and by noise that its place decides. A ``slide`` moves as fast as its eased way is steep, a ``fade`` rises and falls
    evenly; both reach ``height`` on average. All of it is multiplied by ``scale``.
    """
    x = plan.select("*", F.explode(F.sequence("a", "to")).alias("i"))
    return x.select("g", "i", (F.col("i") / F.lit(rate)).alias("t"), _motion(F.col("i"), height, noise, scale).alias("x"), F.lit(40.0).alias("detail"))


def recorded_parts(parts: DataFrame, height: float = 8.0, noise: float | Column = 0.03, scale: float | Column = 1.0) -> DataFrame:
    """(g, _k, i, x): as ``recorded``, of a schedule ``in_blocks``: the samples of each part from ``i`` on as an array."""
    return parts.select("g", "_k", F.col("_from").alias("i"), F.transform(F.sequence("_from", "_until"), lambda i: _motion(i, height, noise, scale)).alias("x"))


def met(truth: DataFrame, found: DataFrame, slack: int = 8) -> DataFrame:
    """(g, truth, detected, matched): true segments (g, a, b), those found, and how many true ones a found one meets within ``slack`` samples at both ends."""
    near = (F.abs(F.col("a") - F.col("_a")) <= slack) & (F.abs(F.col("b") - F.col("_b")) <= slack)
    # segments that meet begin in the same or the next stretch of slack samples
    block = lambda c: F.floor(F.col(c) / (slack + 1))
    t = truth.select("g", "a", "b", F.explode(F.array(block("a") - 1, block("a"), block("a") + 1)).alias("_k"))
    f = found.select("g", F.col("a").alias("_a"), F.col("b").alias("_b"), block("a").alias("_k"))
    hit = t.join(f, ["g", "_k"]).where(near).groupBy("g").agg(F.count_distinct("a").alias("matched"))
    n = lambda d, c: d.groupBy("g").agg(F.count(F.lit(1)).alias(c))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n(truth, "truth").join(n(found, "detected"), "g", "left").join(hit, "g", "left").select("g", "truth", zero("detected"), zero("matched"))
