"""Motion signals: smoothing, levels, thresholds and stable segments, as DataFrame transformations.

A signal has rows (g, i, t, x): series, sample number from 0 without gaps, seconds, motion.
Smoothing goes by blocks of a series, what lies inside segments by segment; statistics are aggregates by series.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import blocks
from framelake.tables import materialise


@dataclass(frozen=True)
class SegmentParams:
    rate: float = 30.0
    smooth: float = 0.15
    sensitivity: float = 0.5
    threshold: float | None = None
    min_duration: float = 0.3
    short_flag: float = 0.6


#: Noise floor, lowest threshold, blank detail, lowest split height, most splits, kept share of detail.
NOISE_FLOOR, MIN_THRESHOLD, BLANK_DETAIL, SPLIT_MIN, MAX_SPLITS, DETAIL_KEEP = 0.02, 0.15, 1.5, 0.08, 4, 0.7


#: Samples of a block, and the most series whose levels are broadcast.
BLOCK, FEW = 1024, 1 << 14


def series():
    return Window.partitionBy("g").orderBy("i")


def planted(events: DataFrame) -> DataFrame:
    """A deterministic test signal over ``events``: strong and weak transitions every 40 samples."""
    n = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = events.select(F.col("event_type").alias("g"), (F.row_number().over(n) - 1).cast("long").alias("i"), "value")
    amp = F.element_at(F.array(*[F.lit(a) for a in (0.1, 0.3, 1.0, 2.0, 4.0)]), (F.floor(F.col("i") / 40) % 5 + 1).cast("int"))
    x = F.when(F.col("i") % 40 < 12, amp * (F.lit(20.0) + F.col("value"))).otherwise(F.lit(0.01) * F.col("value"))
    return e.select("g", "i", (F.col("i") / F.lit(30.0)).alias("t"), x.alias("x"), (F.lit(40.0) + F.col("value") / 100).alias("detail"))


def sample_rate(frames: DataFrame, fps: float, step: int = 1) -> DataFrame:
    """(g, rate): samples a second by first and last time; ``fps / step`` where there is no time between them."""
    span = F.max("t") - F.min("t")
    measured = F.when((F.count(F.lit(1)) > 1) & (span > 0), (F.count(F.lit(1)) - 1) / span)
    return frames.groupBy("g").agg(F.coalesce(measured, F.lit(fps / max(1, step))).alias("rate"))


def lag_diff(frames: DataFrame, value: str = "x") -> DataFrame:
    """Absolute change from the previous sample, 0 for the first."""
    return frames.withColumn("diff", F.coalesce(F.abs(F.col(value) - F.lag(value).over(series())), F.lit(0.0)))


def frame_stats(frames: DataFrame) -> DataFrame:
    """(g, i, brightness, diff) of frames (g, i, v) given as arrays: mean value, and mean change from the previous frame, 0 for the first."""
    before = F.lag("v").over(series())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x, lambda acc: acc / F.greatest(F.size(a), F.lit(1)))
    change = F.zip_with("v", "_before", lambda x, y: F.abs(x - y).cast("double"))
    f = frames.withColumn("v", F.col("v").cast("array<double>")).withColumn("_before", before)
    return f.select("g", "i", mean(F.col("v")).alias("brightness"), F.coalesce(mean(change), F.lit(0.0)).alias("diff"))


def _padded(value: str, k: int, w) -> list[Column]:
    """``k`` neighbours of a sample; beyond the ends the first or last value repeats."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    h = k // 2
    before = [F.coalesce(F.lag(value, j).over(w), first) for j in range(h, 0, -1)]
    return [*before, F.col(value), *[F.coalesce(F.lead(value, j).over(w), last) for j in range(1, h + 1)]]


def running_median(signal: DataFrame, k: int, value: str = "x", out: str = "s", w=None) -> DataFrame:
    """Median of ``k`` (made odd) neighbours with repeated edges; the value itself for short series."""
    k, w = k | 1, w or series()
    n = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return signal.withColumn(out, F.when(n < 3, F.col(value)).otherwise(F.get(F.array_sort(F.array(*_padded(value, k, w))), F.lit(k // 2)))) if k > 1 else signal.withColumn(out, F.col(value))


def running_mean(signal: DataFrame, k: int, value: str = "x", out: str = "m", w=None) -> DataFrame:
    """Mean of ``k`` (made odd) neighbours with repeated edges."""
    k, w = k | 1, w or series()
    if k <= 1:
        return signal.withColumn(out, F.col(value))
    cols = _padded(value, k, w)
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return signal.withColumn(out, total / k)


def window(p: SegmentParams) -> int:
    """Samples over which motion is smoothed."""
    return max(3, round(p.smooth * p.rate) | 1)


def halo(p: SegmentParams) -> int:
    """Samples beside a block that its own ones and their neighbours are smoothed from."""
    return window(p) // 2 + 1


def _block(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK)


def dealt(signal: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Samples with their block ``_k``, sorted inside tasks; those near a block's edge are in the next block too."""
    at = F.array_distinct(F.array(_block(F.greatest(F.col("i") - halo(p), F.lit(0))), _block("i"), _block(F.col("i") + halo(p))))
    return signal.withColumn("_k", F.explode(at)).repartition("g", "_k").sortWithinPartitions("g", "_k", "i")


def smoothed_blocks(rows: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """``smoothed`` of samples that are in blocks already, as ``dealt`` gives them. Nothing is shuffled."""
    out = rows.drop("_k").withColumns({c: F.lit(None).cast("double") for c in ("s", "_l", "_r")}).schema
    return rows.withColumns({"i": F.col("i").cast("long"), "_k": F.col("_k").cast("long")}).mapInArrow(blocks.smoother(window(p), BLOCK), out)


def smoothed_parts(parts: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, i, s, _l, _r) a row a block: smoothed samples from ``i`` on and those beside the block.

    ``parts`` are rows (g, _k, i, x) with the samples from ``i`` on as an array, sorted inside tasks by (g, _k, i), all of a block in one task.
    """
    return parts.select("g", F.col("_k").cast("long").alias("_k"), F.col("i").cast("long").alias("i"), "x").mapInArrow(blocks.smoother(window(p), BLOCK, blocks.smooth_parts), "g string, i long, s array<double>, _l double, _r double")


def samples(rows: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, i, t, s, _l, _r): a row a sample of ``smoothed_parts``."""
    n = F.size("s") - 1
    zipped = F.arrays_zip(F.sequence("i", F.col("i") + n).alias("i"), F.col("s").alias("s"), F.concat(F.array("_l"), F.slice("s", F.lit(1), n)).alias("_l"), F.concat(F.slice("s", F.lit(2), n), F.array("_r")).alias("_r"))
    return rows.select("g", F.inline(zipped)).toDF("g", "i", "s", "_l", "_r").withColumn("t", F.col("i") / F.lit(p.rate))


def smoothed(signal: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Running median ``s`` of the motion, and that of the samples before and after (``_l``, ``_r``); the first sample takes the second one's value."""
    return smoothed_blocks(dealt(signal.withColumn("i", F.col("i").cast("long")), p), p)


def _beside(s: DataFrame, value: str = "s") -> DataFrame:
    """``s`` with the values before and after each sample."""
    return s if "_l" in s.columns and value == "s" else s.withColumn("_l", F.lag(value).over(series())).withColumn("_r", F.lead(value).over(series()))


def _by_series(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with a written table of a row a series, which is broadcast if there are few."""
    return rows.join(F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table, "g")


def local_peaks(signal: DataFrame, distance: int, height: str = "h", value: str = "s") -> DataFrame:
    """(g, i, value) of local maxima of at least ``height``, the highest first, none within ``distance`` of a kept one.

    Equal heights go by the lower sample; series of fewer than three samples have none.
    Candidates further apart than ``distance`` say nothing of each other: a series is cut
    there, and each stretch is folded in height order by itself.
    """
    n = signal.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("g")
    return _highest(_local_maxima(_beside(signal, value), height, value).join(n, "g", "left_semi"), distance, value)


def _local_maxima(signal: DataFrame, height: str, value: str = "s") -> DataFrame:
    here = F.col(value)
    top = (F.col("_l").isNotNull() | F.col("_r").isNotNull()) & F.coalesce(here >= F.col("_l"), F.lit(True)) & F.coalesce(here > F.col("_r"), F.lit(True))
    return signal.where(top & (here >= F.col(height))).select("g", "i", value)


def _highest(c: DataFrame, distance: int, value: str = "s") -> DataFrame:
    """Local maxima (g, i, value), the highest first, without those within ``distance`` of a kept one."""
    w, here = series(), F.col(value)
    apart = F.coalesce(F.col("i") - F.lag("i").over(w) > distance, F.lit(True)).cast("int")
    c = c.withColumn("_far", apart).withColumn("_stretch", F.sum("_far").over(w))
    ranked = c.groupBy("g", "_stretch").agg(F.array_sort(F.collect_list(F.struct((-here).alias("h"), F.col("i").alias("i")))).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<struct<h:double,i:bigint>>"), lambda acc, z: F.when(F.exists(acc, lambda k: F.abs(k["i"] - z["i"]) <= distance), acc).otherwise(F.concat(acc, F.array(z))))
    return ranked.select("g", F.explode(kept).alias("k")).select("g", F.col("k.i").alias("i"), (-F.col("k.h")).alias(value))


def levels(s: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, base, top, peak): still level and typical transition height of smoothed signals."""
    lv = s.groupBy("g").agg(F.expr("percentile(s, array(0.5, 0.995))").alias("_q"), F.count(F.lit(1)).alias("_count"))
    lv = lv.select("g", F.greatest(F.get("_q", F.lit(0)), F.lit(NOISE_FLOOR)).alias("base"), F.get("_q", F.lit(1)).alias("_top"), "_count")
    lv = materialise(lv.select("g", "base", F.greatest("_top", F.col("base") * 4).alias("top"), "_count"), "signal-levels")
    # series of fewer than three samples have no peaks
    high = _by_series(_beside(s), lv.select("g", F.when(F.col("_count") >= 3, F.sqrt(F.col("base") * F.col("top"))).alias("h")))
    peaks = _highest(_local_maxima(high, "h"), max(1, round(0.5 * p.rate))).groupBy("g").agg(F.expr("percentile(s, 0.5)").alias("_med"), F.count(F.lit(1)).alias("_n"))
    return lv.join(peaks, "g", "left").select("g", "base", "top", F.greatest(F.when(F.col("_n") >= 2, F.col("_med")).otherwise(F.col("top")), F.col("base") * 4).alias("peak"))


def alpha(sensitivity: Column) -> Column:
    """Place of the threshold between still level (0) and peak (1), on a log scale."""
    s = F.least(F.greatest(sensitivity, F.lit(0.0)), F.lit(1.0))
    return F.when(s <= 0.5, F.lit(0.9) - F.lit(0.55) * s).otherwise(F.lit(0.625) - F.lit(0.85) * (s - 0.5))


def threshold(base: Column, peak: Column, sensitivity: Column, manual: float | None = None) -> Column:
    if manual is not None and manual > 0:
        return F.lit(float(manual))
    t = base * F.pow(peak / base, alpha(sensitivity))
    return F.least(F.greatest(t, F.lit(2.5) * base, F.lit(MIN_THRESHOLD)), F.lit(0.8) * peak)


def islands(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Adds ``island``, equal for neighbouring samples of one run, to the rows where ``flag`` holds."""
    w = Window.partitionBy(*keys, flag).orderBy("i")
    return rows.withColumn("island", F.col("i") - F.row_number().over(w)).where(flag)


def _runs(s: DataFrame, lists: DataFrame, p: SegmentParams) -> DataFrame:
    """(g, step, a, b, t_start, t_end): runs of samples at or below each of a series' thresholds ``_ts`` (step, thr) that last long enough.

    A sample gives a row only for the thresholds that the signal crosses beside it, where a run begins or ends.
    """
    still = lambda x: F.col("s") <= x["thr"]
    edge = lambda other, kind: F.transform(F.filter("_ts", lambda x: still(x) & F.coalesce(F.col(other) > x["thr"], F.lit(True))), lambda x: F.struct(x["step"].alias("step"), F.lit(kind).alias("k")))
    thr = F.transform("_ts", lambda x: x["thr"])
    beside = _by_series(_beside(s).select("g", "i", "t", "s", "_l", "_r"), lists.withColumn("_lo", F.array_min(thr)).withColumn("_hi", F.array_max(thr)))
    crossed = lambda other: F.coalesce(F.col(other) > F.greatest("s", "_lo"), F.lit(True))
    events = beside.where((F.col("s") <= F.col("_hi")) & (crossed("_l") | crossed("_r"))).select("g", "i", "t", F.inline(F.concat(edge("_l", 0), edge("_r", 1))))
    run = Window.partitionBy("g", "step").orderBy("i", "k")
    ends = events.withColumn("b", F.lead("i").over(run)).withColumn("_t", F.lead("t").over(run)).where("k = 0")
    until = F.col("_t") + F.lit(1.0 / p.rate)
    return ends.where(until - F.col("t") >= p.min_duration).select("g", "step", F.col("i").alias("a"), "b", F.col("t").alias("t_start"), until.alias("t_end"))


def segments(s: DataFrame, thresholds: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, a, b, t_start, t_end): runs of samples at or below the threshold (g, thr), a written table, that last long enough."""
    return _runs(s, thresholds.select("g", F.array(F.struct(F.lit(0).alias("step"), "thr")).alias("_ts")), p).drop("step")


def detected(s: DataFrame, p: SegmentParams = SegmentParams()) -> tuple[DataFrame, DataFrame]:
    """Thresholds per series and stable segments of a smoothed signal, which is read for levels, peaks and runs in turn."""
    thr = materialise(levels(s, p).withColumn("thr", threshold(F.col("base"), F.col("peak"), F.lit(p.sensitivity), p.threshold)), "detect-thresholds")
    return thr, segments(s, thr, p)


def detect(signal: DataFrame, p: SegmentParams = SegmentParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Smoothed signal as a written table, thresholds per series and stable segments."""
    s = materialise(smoothed(signal, p), "detect-signal")
    return s, *detected(s, p)


def in_segments(s: DataFrame, segs: DataFrame) -> DataFrame:
    """Samples of each segment: the last segment begun at or before a sample, if it lasts. One sort of both sides by blocks; no pairs."""
    bounds = ["a", "b", "t_start", "t_end"]
    held = segs.select("g", F.struct(*bounds).alias("_q"), F.explode(F.sequence(_block("a"), _block("b"))).alias("_k"))
    begun = held.select("g", "_k", F.greatest(F.col("_q.a"), F.col("_k") * BLOCK).alias("i"), "_q", F.lit(0).alias("_n"))
    both = s.withColumn("_k", _block("i")).withColumn("_n", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    last = F.last("_q", ignorenulls=True).over(Window.partitionBy("g", "_k").orderBy("i", "_n").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_q", last).where("_n = 1 and i <= _q.b").select(*s.columns, *[F.col(f"_q.{c}").alias(c) for c in bounds])


def flags(s: DataFrame, segs: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Segments with the flags ``short`` and ``blank``."""
    ref = s.groupBy("g").agg(F.expr("percentile(detail, 0.5)").alias("ref"))
    d = in_segments(s, segs).groupBy("g", "a", "b", "t_start", "t_end").agg(F.expr("percentile(detail, 0.5)").alias("d"))
    short = F.when(F.col("t_end") - F.col("t_start") < p.short_flag, "short")
    blank = F.when(F.col("d") < F.greatest(F.lit(BLANK_DETAIL), F.lit(0.05) * F.col("ref")), "blank")
    return d.join(ref, "g").select("g", "a", "b", F.array_compact(F.array(short, blank)).alias("flags"))


def _scored(x: DataFrame, keys: list[str], p: SegmentParams) -> DataFrame:
    """Samples (keys, a, b, i, s, detail) of segments with their running mean ``ma``, ``sharp``, and ``score``, lowest for the calmest sharp sample."""
    m = running_mean(x, max(1, round(0.2 * p.rate)), "s", "ma", Window.partitionBy(*keys).orderBy("i"))
    m = m.withColumn("sharp", F.col("detail") >= F.lit(DETAIL_KEEP) * F.expr("percentile(detail, 0.95)").over(Window.partitionBy(*keys)))
    n = F.col("b") - F.col("a") + 1
    return m.withColumn("score", F.round(F.col("ma") + F.lit(1e-3) * F.abs(F.col("i") - F.col("a") - (n - 1) / F.lit(2.0)) / n + F.when(F.col("sharp"), 0.0).otherwise(1e6), 9))


def calm_core(s: DataFrame, segs: DataFrame, thr: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, a, b, core_a, core_b, calm, motion): the calmest sharp sample and the calm run around it."""
    m = _scored(in_segments(s, segs), ["g", "a"], p)
    m = _by_series(m, thr.select("g", "thr", "base"))
    best = m.groupBy("g", "a").agg(F.min_by(F.struct(F.col("i").alias("calm"), F.col("ma").alias("cma")), F.struct("score", "i")).alias("c"))
    m = m.join(best.select("g", "a", "c.calm", "c.cma"), ["g", "a"])
    bad = ~((F.round("ma", 9) <= F.round(F.greatest(F.lit(3.0) * F.col("cma"), F.lit(0.12) * F.col("thr"), F.col("base")), 9)) & F.col("sharp"))
    lim = m.groupBy("g", "a", "b", "calm").agg(
        F.coalesce(F.max(F.when(bad & (F.col("i") < F.col("calm")), F.col("i"))) + 1, F.first("a")).alias("core_a"),
        F.coalesce(F.min(F.when(bad & (F.col("i") > F.col("calm")), F.col("i"))) - 1, F.first("b")).alias("core_b"),
    )
    return m.select("g", "a", "i", "s").join(lim, ["g", "a"]).where(F.col("i").between(F.col("core_a"), F.col("core_b"))).groupBy("g", "a", "b", "core_a", "core_b", "calm").agg(F.expr("percentile(s, 0.5)").alias("motion"))


def split_candidates(s: DataFrame, segs: DataFrame, thr: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, a, i0, i1, height): at most four bumps inside a segment that may hide a transition."""
    x = _by_series(in_segments(s, segs), thr.select("g", "thr"))
    return _bumps(x, p).select("g", "a", "i0", "i1", "height", "rank")


def _bumps(x: DataFrame, p: SegmentParams) -> DataFrame:
    """(g, a, b, i0, i1, height, rank) from the samples (g, a, b, i, s, thr) of segments."""
    lvl = F.expr("percentile(s, 0.5)").over(Window.partitionBy("g", "a"))
    x = x.withColumn("up", F.col("s") > F.greatest(F.lit(6.0) * lvl, F.lit(0.06) * F.col("thr"), F.lit(SPLIT_MIN)))
    need = max(1, round(p.min_duration * p.rate))
    runs = islands(x, ["g", "a"], "up").groupBy("g", "a", "b", "island").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.max("s").alias("height"))
    runs = runs.where((F.col("i0") - F.col("a") >= need) & (F.col("b") - F.col("i1") >= need))
    top = Window.partitionBy("g", "a").orderBy(F.desc("height"), F.desc("i0"), F.desc("i1"))
    return runs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= MAX_SPLITS).select("g", "a", "b", "i0", "i1", "height", "rank")


def sweep(signal: DataFrame, steps: int = 41, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, step, sensitivity, segments): segment counts for every sensitivity, in one job.

    Samples are not repeated for every threshold; thresholds reach them as one array per series.
    """
    s = materialise(smoothed(signal, p), "sweep-signal")
    return _swept(s, materialise(levels(s, p), "sweep-levels"), steps, p)


def _swept(s: DataFrame, lv: DataFrame, steps: int, p: SegmentParams) -> DataFrame:
    at = F.col("step") / F.lit(float(steps - 1))
    lv = lv.select("g", "base", "peak", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    thr = lv.select("g", "step", at.alias("sensitivity"), threshold(F.col("base"), F.col("peak"), at).alias("thr"))
    n = _runs(s, _listed(thr), p).groupBy("g", "step").agg(F.count(F.lit(1)).alias("segments"))
    return thr.select("g", "step", "sensitivity").join(n, ["g", "step"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)).cast("long"))


def _listed(thr: DataFrame) -> DataFrame:
    """(g, _ts): thresholds (g, step, thr) as one array per series."""
    return thr.groupBy("g").agg(F.collect_list(F.struct("step", "thr")).alias("_ts"))


def suggest(counts: DataFrame, target: int, current: float = 0.5) -> DataFrame:
    """The sensitivity whose count is nearest the target; ties go towards the current one, then up the steps."""
    key = F.struct(F.abs(F.col("segments") - target), F.round(F.abs(F.col("sensitivity") - current), 9), "step")
    return counts.groupBy("g").agg(F.min_by(F.struct("step", "sensitivity", "segments"), key).alias("b")).select("g", "b.step", "b.sensitivity", "b.segments")


def nearest_by_count(counts: DataFrame, current: float = 0.5) -> DataFrame:
    """(g, segments, step, sensitivity): for each count of a sweep the sensitivity nearest the current one, the lower of equals."""
    key = F.struct(F.round(F.abs(F.col("sensitivity") - current), 9), "step")
    return counts.groupBy("g", "segments").agg(F.min_by(F.struct("step", "sensitivity"), key).alias("b")).select("g", "segments", "b.step", "b.sensitivity")


#: So many counts nearest the wanted one are verified.
CHECKS = 6


def verified_suggestion(signal: DataFrame, expected: DataFrame, differs, current: float = 0.5, p: SegmentParams = SegmentParams(), checks: int = CHECKS) -> DataFrame:
    """(g, expected, step, sensitivity, pages): the sensitivity whose pages come nearest to what is expected, hidden transitions divided.

    ``expected`` has (g, expected, hidden, manual). The sweep's counts only say which ``checks`` sensitivities to try, one a count, those nearest
    first; these are detected and refined anew, all series and sensitivities in one set of jobs. In the order of
    trial the first that gives the expected pages is taken, else the nearest. ``differs``: see ``refine``; its ``g`` is (g, step).
    """
    s = materialise(smoothed(signal, p).select("g", "i", "t", "s", "_l", "_r", "detail"), "verify-signal")
    lv = materialise(levels(s, p), "verify-levels")
    counts = nearest_by_count(_swept(s, lv, 41, p), current)
    want = F.col("expected") - F.col("manual") + F.col("hidden")
    away = F.round(F.abs(F.col("sensitivity") - current), 9)
    order = Window.partitionBy("g").orderBy(F.abs(F.col("segments") - want), away, "step")
    tried = counts.join(expected, "g").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= checks)
    tried = materialise(tried.select("g", "step", "sensitivity", "expected", "hidden", "manual", away.alias("away"), "_n"), "verify-tried")
    thr = threshold(F.col("base"), F.col("peak"), F.col("sensitivity"), p.threshold)
    lists = materialise(_listed(lv.join(tried.select("g", "step", "sensitivity"), "g").select("g", "step", thr.alias("thr"))), "verify-thresholds")
    key = F.struct("g", "step").alias("g")
    segs = materialise(_runs(s, lists, p).select(key, "a", "b", "t_start", "t_end"), "verify-segments")
    each = _by_series(s.select("g", "i", "t", "s", "detail"), lists).select("g", "i", "t", "s", "detail", F.inline("_ts")).select(key, "i", "t", "s", "detail", "thr")
    n = _divided(in_segments(each, segs), segs, differs, p).groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g.g", "g.step", "n")
    pages = F.coalesce("n", F.lit(0)) - F.col("hidden") + F.col("manual")
    checked = tried.join(n, ["g", "step"], "left").withColumn("pages", pages)
    off = F.abs(F.col("pages") - F.col("expected"))
    best = F.min_by(F.struct("step", "sensitivity", "pages"), F.struct(off, F.when(off == 0, F.col("_n")).otherwise(0), "away", "_n"))
    return checked.groupBy("g", "expected").agg(best.alias("b")).select("g", "expected", "b.step", "b.sensitivity", "b.pages")


def asof(samples: DataFrame, requests: DataFrame, how: str) -> DataFrame:
    """(g, r, i): for each request time ``r`` the sample that ``how`` picks.

    ``forward``: the first at or after it, else the last of the series. ``nearest``:
    the closer neighbour, the earlier on a tie. One sort of both sides by series and
    time; no pair of request and sample is formed.
    """
    both = samples.select("g", "t", "i", F.lit(0).alias("req")).unionByName(requests.select("g", F.col("r").alias("t"), F.lit(None).cast("long").alias("i"), F.lit(1).alias("req")))
    # the next sample is the last one met in falling order: frames that grow, so that time stays linear
    back = Window.partitionBy("g").orderBy("t", "req", "i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("g").orderBy(F.desc("t"), "req", F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("req") == 0, F.struct("i", "t"))
    b = both.withColumn("p", F.last(at, ignorenulls=True).over(back)).withColumn("n", F.last(at, ignorenulls=True).over(ahead)).where("req = 1")
    if how == "forward":
        pick = F.coalesce("n.i", "p.i")
    else:
        pick = F.when(F.col("n.i").isNull() | (F.col("t") - F.col("p.t") <= F.col("n.t") - F.col("t")), F.col("p.i")).otherwise(F.col("n.i"))
    return b.select("g", F.col("t").alias("r"), pick.alias("i"))


def split_segment(segs: DataFrame, bumps: DataFrame, s: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """(g, a, b, i0, i1, half, ha, hb, duration): the parts before (0) and after (1) each bump of a segment that last long enough.

    ``bumps`` are rows (g, a, i0, i1) as ``split_candidates`` gives them. A bump of which either part is too short gives neither.
    """
    return _parts(bumps.select("g", "a", "i0", "i1").join(segs.select("g", "a", "b"), ["g", "a"]), p).select("g", "a", "b", "i0", "i1", "half", "ha", "hb", "duration")


def _parts(x: DataFrame, p: SegmentParams) -> DataFrame:
    """Rows (g, a, b, i0, i1) once for each part of their segment, with its ``half``, ``ha``, ``hb`` and ``duration``."""
    seconds = lambda lo, hi: (hi - lo + 1) / F.lit(p.rate)
    fits = (seconds(F.col("a"), F.col("i0") - 1) >= p.min_duration) & (seconds(F.col("i1") + 1, F.col("b")) >= p.min_duration)
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("a").alias("ha"), (F.col("i0") - 1).alias("hb")), F.struct(F.lit(1).alias("half"), (F.col("i1") + 1).alias("ha"), F.col("b").alias("hb")))
    return x.where(fits).select("*", F.inline(halves)).withColumn("duration", seconds(F.col("ha"), F.col("hb")))


#: Segments are divided so often at most.
MAX_DEPTH = 6


def refine(s: DataFrame, segs: DataFrame, thr: DataFrame, differs, p: SegmentParams = SegmentParams()) -> DataFrame:
    """``segs`` divided at hidden transitions: at the first of a segment's bumps on whose two sides the calmest samples differ.

    ``differs`` takes rows (g, a, rank, left, right), samples of a series, and returns the (g, a, rank) of
    those that show different content. Each round divides all segments at once, ``MAX_DEPTH`` rounds at most;
    only segments divided in the round before are looked at again.
    """
    x = in_segments(s.select("g", "i", "t", "s", "detail"), segs)
    return _divided(_by_series(x, materialise(thr.select("g", "thr"), "refine-levels")), segs, differs, p)


def _divided(x: DataFrame, segs: DataFrame, differs, p: SegmentParams) -> DataFrame:
    """``segs`` divided, by their samples x (g, a, b, i, t, s, detail, thr). A round leaves only the samples of segments that it divides."""
    bounds = ["g", "a", "b", "t_start", "t_end"]
    columns = ["g", "a", "b", "i", "t", "s", "detail", "thr"]
    x, open_, done = materialise(x.select(*columns), "refine-samples"), materialise(segs.select(*bounds), "refine-open"), []
    for _ in range(MAX_DEPTH + 1):
        bumps = materialise(_bumps(x, p), "refine-bumps")
        if bumps.isEmpty():
            break
        # halves of different bumps overlap: each half is a series of its own
        keys = ["g", "a", "rank", "half"]
        parts = _parts(bumps, p).select(*keys, "ha", "hb")
        inside = x.drop("b").join(parts, ["g", "a"]).where("i between ha and hb")
        own = _scored(inside.withColumns({"_a": F.col("a"), "a": F.col("ha"), "b": F.col("hb")}), ["g", "_a", "rank", "half"], p)
        calm = own.groupBy("g", "_a", "rank", "half").agg(F.min_by("i", F.struct("score", "i")).alias("calm"), F.min("a").alias("ha"), F.min("b").alias("hb"), F.min_by("t", "i").alias("t_start"), (F.max_by("t", "i") + F.lit(1.0 / p.rate)).alias("t_end"))
        calm = materialise(calm.withColumnRenamed("_a", "a"), "refine-calm")
        both = calm.groupBy("g", "a", "rank").agg(F.max(F.when(F.col("half") == 0, F.col("calm"))).alias("left"), F.max(F.when(F.col("half") == 1, F.col("calm"))).alias("right"))
        first = materialise(differs(both).groupBy("g", "a").agg(F.min("rank").alias("rank")), "refine-first")
        done.append(open_.join(first, ["g", "a"], "left_anti").select(*bounds))
        halves = calm.join(first, ["g", "a", "rank"])
        open_ = materialise(halves.select("g", F.col("ha").alias("a"), F.col("hb").alias("b"), "t_start", "t_end"), "refine-open")
        x = materialise(x.drop("b").join(halves.select("g", "a", "ha", "hb"), ["g", "a"]).where("i between ha and hb").drop("a").withColumnsRenamed({"ha": "a", "hb": "b"}).select(*columns), "refine-samples")
    return reduce(DataFrame.unionByName, [*done, open_])


def candidate_samples(cores: DataFrame, n: int) -> DataFrame:
    """(g, a, i): ``n`` samples spread evenly over each calm core (core_a, core_b), and its calmest one."""
    lo, hi = F.col("core_a"), F.col("core_b")
    last = F.least(F.lit(n), hi - lo + 1) - 1
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long")), lambda k: F.rint(lo + k * (hi - lo) / F.greatest(last, F.lit(1))).cast("long"))
    return cores.select("g", "a", F.explode(F.array_distinct(F.concat(spread, F.array(F.col("calm").cast("long"))))).alias("i"))


def neighbor_times(pages: DataFrame, signal: DataFrame, n: int = 8, margin: float = 0.4) -> DataFrame:
    """(g, id, i): samples nearest to ``n`` times spread from a little before a page (g, id, t_start, t_end) to a little after it."""
    end = signal.groupBy("g").agg(F.max("t").alias("_end"))
    lo, hi = F.greatest(F.lit(0.0), F.col("t_start") - margin), F.least(F.col("_end"), F.col("t_end") + margin)
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: lo + k * (hi - lo) / F.lit(max(1, n - 1)))
    asked = pages.join(end, "g").select("g", "id", F.explode(times).alias("r"))
    found = asof(signal, asked.select("g", "r").distinct(), "nearest")
    return asked.join(found, ["g", "r"]).select("g", "id", "i").distinct()


def time_to_pts(t: Column, start: Column, base: Column) -> Column:
    """Seconds as a time stamp of a stream that starts at ``start``; ``base`` is the seconds of a unit."""
    return F.rint(start + t / base).cast("long")


def pts_to_time(pts: Column, base: Column) -> Column:
    return pts * base


def downsample(signal: DataFrame, blocks: int = 2500) -> DataFrame:
    """(g, block, t, x): first time and greatest motion of each block of equal length; an incomplete last block is left out."""
    n = signal.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.ceil(F.col("n") / blocks))
    b = signal.join(n, "g").withColumn("block", F.floor(F.col("i") / F.col("size")).cast("long"))
    return b.where((F.col("block") + 1) * F.col("size") <= F.col("n")).groupBy("g", "block").agg(F.min("t").alias("t"), F.greatest(F.max("x"), F.lit(1e-3)).alias("x"))
