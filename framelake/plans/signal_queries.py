"""Queries over the planted signal of ``events``, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import signal as sg

P = sg.SegmentParams()


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return sg.planted(spark.read.parquet(f"{sf}/events.parquet"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request every seven tenths of a second, shifted by a third of a sample, and one past each end."""
    s = _signal(spark, sf)
    some = s.where("i % 21 = 0").select("g", (F.col("t") + F.lit(1.0) / 90).alias("r"))
    ends = s.groupBy("g").agg(F.max("t").alias("m")).select("g", F.explode(F.array(F.lit(-1.0), F.col("m") + 1, F.lit(0.05))).alias("r"))
    return some.unionByName(ends)


def motion_lag_diff(spark, sf):
    return sg.lag_diff(_signal(spark, sf)).select("g", "i", "diff")


def running_median_edge(spark, sf):
    return sg.running_median(_signal(spark, sf), 5).select("g", "i", "s")


def running_mean_edge(spark, sf):
    return sg.running_mean(_signal(spark, sf), 6).select("g", "i", F.round("m", 6).alias("m"))


def signal_levels(spark, sf):
    return sg.levels(sg.smoothed(_signal(spark, sf))).select("g", *[F.round(c, 6).alias(c) for c in ("base", "top", "peak")])


def local_peaks_nms(spark, sf):
    s = sg.smoothed(_signal(spark, sf)).withColumn("h", F.lit(1.0))
    return sg.local_peaks(s, 15).select("g", "i", "s")


def threshold_auto(spark, sf):
    lv = sg.levels(sg.smoothed(_signal(spark, sf)))
    return lv.select("g", F.round(sg.threshold(F.col("base"), F.col("peak"), F.lit(0.5)), 6).alias("thr"))


def _seg_out(segs: DataFrame) -> DataFrame:
    return segs.select("g", "a", "b", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


def threshold_manual_segments(spark, sf):
    return _seg_out(sg.detect(_signal(spark, sf), sg.SegmentParams(threshold=5.0))[2])


def stable_segments(spark, sf):
    return _seg_out(sg.detect(_signal(spark, sf))[2])


def segment_flags(spark, sf):
    s, _, q = sg.detect(_signal(spark, sf))
    return sg.flags(s, q).select("g", "a", "b", F.array_join("flags", ",").alias("flags"))


def calm_core(spark, sf):
    s, thr, q = sg.detect(_signal(spark, sf))
    return sg.calm_core(s, q, thr).withColumn("motion", F.round("motion", 6))


def split_candidates(spark, sf):
    s, thr, q = sg.detect(_signal(spark, sf), sg.SegmentParams(sensitivity=0.0))
    return sg.split_candidates(s, q, thr).withColumn("height", F.round("height", 6)).withColumn("rank", F.col("rank").cast("long"))


def sensitivity_sweep(spark, sf):
    return sg.sweep(_signal(spark, sf)).select("g", F.col("step").cast("long").alias("step"), "segments")


def suggest_sensitivity(spark, sf):
    return sg.suggest(sg.sweep(_signal(spark, sf)), target=35).select("g", F.col("step").cast("long").alias("step"), "segments")


def nearest_asof(spark, sf):
    return sg.asof(_signal(spark, sf), _requests(spark, sf), "nearest").select("g", F.round("r", 6).alias("r"), "i")


def forward_asof(spark, sf):
    return sg.asof(_signal(spark, sf), _requests(spark, sf), "forward").select("g", F.round("r", 6).alias("r"), "i")


def block_downsample(spark, sf):
    return sg.downsample(_signal(spark, sf), 50).select("g", "block", F.round("t", 6).alias("t"), F.round("x", 6).alias("x"))


QUERIES = {f.__name__: f for f in (
    motion_lag_diff, running_median_edge, running_mean_edge, signal_levels, local_peaks_nms, threshold_auto,
    threshold_manual_segments, stable_segments, segment_flags, calm_core, split_candidates, sensitivity_sweep,
    suggest_sensitivity, nearest_asof, forward_asof, block_downsample,
)}

_SIGNAL = """
e as (select event_type g, (row_number() over (partition by event_type order by ts, event_id) - 1)::bigint i, value v from events),
p as (select g, i, i / 30.0::double t, 40.0::double + v / 100 detail,
  case when i % 40 < 12 then ([0.1, 0.3, 1, 2, 4]::double[])[((i // 40) % 5 + 1)::int] * (20.0::double + v) else 0.01::double * v end x from e)"""
_MEDIAN = """
m as (select *, list_sort([coalesce(lag(x, 2) over w, first_value(x) over f), coalesce(lag(x, 1) over w, first_value(x) over f), x,
  coalesce(lead(x, 1) over w, last_value(x) over f), coalesce(lead(x, 2) over w, last_value(x) over f)])[3] s0 from p
  window w as (partition by g order by i), f as (partition by g order by i rows between unbounded preceding and unbounded following)),
s as (select g, i, t, x, detail, case when i = 0 then coalesce(lead(s0) over (partition by g order by i), 0) else s0 end s from m)"""


def _nms(height: str, distance: int = 15) -> str:
    return f"""
c as (select g, i, s from (select s.g, s.i, s.s, {height} h, lag(s) over w l, lead(s) over w r from s {'' if height.replace('.', '').isdigit() else 'join lv using (g)'}
  window w as (partition by g order by i)) where s >= h and (l is null or s >= l) and (r is null or s > r)),
k as (select g, list_reduce(list([i] order by s desc, i), lambda a, q:
  case when len(list_filter(a, lambda z: abs(z - q[1]) <= {distance})) > 0 then a else list_concat(a, q) end) ks from c group by g),
pk as (select k.g, u.i, s.s from (select g, unnest(ks) i from k) u join k using (g) join s on s.g = u.g and s.i = u.i)"""


_LEVELS = """
l0 as (select g, greatest(quantile_cont(s, 0.5), 0.02::double) base, quantile_cont(s, 0.995) tp from s group by g),
lv as (select g, base, greatest(tp, base * 4) as top, sqrt(base * greatest(tp, base * 4)) hh from l0),""" + _nms("lv.hh") + """,
pl as (select lv.g, lv.base, lv.top, greatest(case when count(pk.s) >= 2 then quantile_cont(pk.s, 0.5) else lv.top end, lv.base * 4) peak
  from lv left join pk using (g) group by lv.g, lv.base, lv.top)"""


def _thr(sens: str) -> str:
    a = f"case when {sens} <= 0.5 then 0.9::double - 0.55::double * {sens} else 0.625::double - 0.85::double * ({sens} - 0.5::double) end"
    return f"least(greatest(base * pow(peak / base, {a}), 2.5::double * base, 0.15::double), 0.8::double * peak)"


def _segments(keys: str, thr: str = "th") -> str:
    return f"""
q as (select {thr}.*, s.i, s.t, s.s, s.s <= {thr}.thr still from s join {thr} using (g)),
r as (select *, i - row_number() over (partition by {keys}, still order by i) isl from q),
sg as (select {keys}, min(i) a, max(i) b, min(t) t_start, max(t) + 1.0::double / 30 t_end from r where still group by {keys}, isl
  having max(t) + 1.0::double / 30 - min(t) >= 0.3::double)"""


_BASE = f"with {_SIGNAL}, {_MEDIAN}"
_AUTO = f"{_BASE}, {_LEVELS}, th as (select *, {_thr('0.5::double')} thr from pl), {_segments('g')}"
_CALM0 = f"{_BASE}, {_LEVELS}, th as (select *, {_thr('0.0::double')} thr from pl), {_segments('g')}"
_SEGS = "select g, a, b, round(t_start, 6) t_start, round(t_end, 6) t_end from sg"
_SWEEP = f"""{_BASE}, {_LEVELS}, th as (select g, k step, {_thr("(k / 40.0::double)")} thr from pl, range(41) x(k)), {_segments('g, step')},
sw as (select th.g, th.step, count(sg.a)::bigint segments from th left join sg on sg.g = th.g and sg.step = th.step group by 1, 2)"""
_REQ = f"""with {_SIGNAL}, rq as (select g, t + 1.0::double / 90 r from p where i % 21 = 0 union all
  select g, unnest([-1.0::double, m + 1, 0.05::double]) r from (select g, max(t) m from p group by g)),
pr as (select rq.g, rq.r, p.i pi, p.t pt from rq asof left join p on rq.g = p.g and rq.r >= p.t),
nx as (select rq.g, rq.r, p.i ni, p.t nt from rq asof left join p on rq.g = p.g and rq.r <= p.t),
bo as (select pr.g, pr.r, pi, pt, ni, nt from pr join nx on pr.g = nx.g and pr.r = nx.r)"""

ORACLE_SQL = {
    "motion_lag_diff": f"with {_SIGNAL} select g, i, coalesce(abs(x - lag(x) over (partition by g order by i)), 0) diff from p",
    "running_median_edge": f"{_BASE} select g, i, s0 s from m",
    "running_mean_edge": f"""with {_SIGNAL} select g, i, round((coalesce(lag(x, 3) over w, first_value(x) over f) + coalesce(lag(x, 2) over w, first_value(x) over f)
  + coalesce(lag(x, 1) over w, first_value(x) over f) + x + coalesce(lead(x, 1) over w, last_value(x) over f) + coalesce(lead(x, 2) over w, last_value(x) over f)
  + coalesce(lead(x, 3) over w, last_value(x) over f)) / 7, 6) m from p
  window w as (partition by g order by i), f as (partition by g order by i rows between unbounded preceding and unbounded following)""",
    "signal_levels": f"{_BASE}, {_LEVELS} select g, round(base, 6) base, round(top, 6) as top, round(peak, 6) peak from pl",
    "local_peaks_nms": f"{_BASE}, {_nms('1.0')} select g, i, s from pk",
    "threshold_auto": f"{_BASE}, {_LEVELS} select g, round({_thr('0.5::double')}, 6) thr from pl",
    "threshold_manual_segments": f"{_BASE}, th as (select distinct g, 5.0::double thr from s), {_segments('g')} {_SEGS}",
    "stable_segments": f"{_AUTO} {_SEGS}",
    "segment_flags": f"""{_AUTO}, rf as (select g, quantile_cont(detail, 0.5) ref from s group by g),
d as (select sg.g, a, b, t_start, t_end, quantile_cont(detail, 0.5) d from sg join s on s.g = sg.g and s.i between a and b group by all)
select g, a, b, array_to_string(list_filter([case when t_end - t_start < 0.6::double then 'short' end,
  case when d < greatest(1.5::double, 0.05::double * ref) then 'blank' end], lambda z: z is not null), ',') flags from d join rf using (g)""",
    "calm_core": f"""{_AUTO}, y as (select s.g, s.i, s.s, s.detail, a, b, thr, base from sg join s on s.g = sg.g and s.i between a and b join th on th.g = sg.g),
y1 as (select *, (coalesce(lag(s, 3) over w, first_value(s) over f) + coalesce(lag(s, 2) over w, first_value(s) over f) + coalesce(lag(s, 1) over w, first_value(s) over f)
  + s + coalesce(lead(s, 1) over w, last_value(s) over f) + coalesce(lead(s, 2) over w, last_value(s) over f) + coalesce(lead(s, 3) over w, last_value(s) over f)) / 7 ma,
  quantile_cont(detail, 0.95) over (partition by g, a) p95 from y
  window w as (partition by g, a order by i), f as (partition by g, a order by i rows between unbounded preceding and unbounded following)),
y2 as (select *, detail >= 0.7::double * p95 sharp from y1),
y3 as (select *, round(ma + 1e-3::double * abs(i - a - (b - a) / 2.0::double) / (b - a + 1) + case when sharp then 0 else 1e6::double end, 9) score from y2),
bs as (select g, a, arg_min(i, (score, i)) calm, arg_min(ma, (score, i)) cma from y3 group by g, a),
y4 as (select y3.*, calm, not (round(ma, 9) <= round(greatest(3.0::double * cma, 0.12::double * thr, base), 9) and sharp) bad from y3 join bs using (g, a)),
lm as (select g, a, b, calm, coalesce(max(case when bad and i < calm then i end) + 1, a) core_a, coalesce(min(case when bad and i > calm then i end) - 1, b) core_b from y4 group by g, a, b, calm)
select lm.g, lm.a, lm.b, core_a, core_b, lm.calm, round(quantile_cont(s, 0.5), 6) motion from lm join y4 on y4.g = lm.g and y4.a = lm.a and y4.i between core_a and core_b group by all""",
    "split_candidates": f"""{_CALM0}, y as (select s.g, s.i, s.s, a, b, thr, median(s.s) over (partition by s.g, a) lvl from sg join s on s.g = sg.g and s.i between a and b join th on th.g = sg.g),
y1 as (select *, s > greatest(6.0::double * lvl, 0.06::double * thr, 0.08::double) up from y),
y2 as (select *, i - row_number() over (partition by g, a, up order by i) isl from y1),
y3 as (select g, a, min(i) i0, max(i) i1, max(s) height from y2 where up group by g, a, b, isl having min(i) - a >= 9 and b - max(i) >= 9)
select g, a, i0, i1, round(height, 6) height, rank from (select *, row_number() over (partition by g, a order by height desc, i0 desc, i1 desc) rank from y3) where rank <= 4""",
    "sensitivity_sweep": f"{_SWEEP} select g, step::bigint step, segments from sw",
    "suggest_sensitivity": f"""{_SWEEP} select g, step::bigint step, segments from (select *, row_number() over (partition by g
  order by abs(segments - 35), round(abs(step / 40.0::double - 0.5::double), 9), step) n from sw) where n = 1""",
    "nearest_asof": f"{_REQ} select g, round(r, 6) r, case when ni is null then pi when pi is null then ni when r - pt <= nt - r then pi else ni end i from bo",
    "forward_asof": f"{_REQ} select g, round(r, 6) r, coalesce(ni, pi) i from bo",
    "block_downsample": f"""with {_SIGNAL}, n as (select g, count(*) n, ceil(count(*) / 50.0)::bigint z from p group by g)
select p.g, i // z as block, round(min(t), 6) t, round(greatest(max(x), 1e-3::double), 6) x from p join n using (g) where (i // z + 1) * z <= n group by p.g, i // z""",
}
