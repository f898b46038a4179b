"""Queries on page reviews, series, formats, crops and streams over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import geometry as ge
from framelake.operators import catalog as ct
from framelake.operators import dedup as dd
from framelake.operators import pages as pg
from framelake.operators import signal as sg
from framelake.plans import signal_queries as sq
from framelake.sources import files
from framelake.streaming import signal as st
from framelake.tables import shared_path


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sample_rate(spark, sf):
    s = sq._signal(spark, sf).where("g <> 'click' or i = 0")
    return sg.sample_rate(s, 30.0, 2).select("g", F.round("rate", 6).alias("rate"))


def pts_round_trip(spark, sf):
    start, base = F.lit(900), F.lit(1 / 12500)
    e = _t(spark, sf, "events").select("event_id", sg.time_to_pts(F.col("value") / 7, start, base).alias("pts"))
    return e.select("event_id", "pts", F.round(sg.pts_to_time(F.col("pts"), base), 6).alias("t"))


def _calm0(spark, sf):
    s, thr, q = sg.detect(sq._signal(spark, sf), sg.SegmentParams(sensitivity=0.0))
    return s, thr, q


def split_segment(spark, sf):
    s, thr, q = _calm0(spark, sf)
    halves = sg.split_segment(q, sg.split_candidates(s, q, thr), s)
    return halves.select("g", "a", "i0", F.col("half").cast("long").alias("half"), "ha", "hb", F.round("duration", 6).alias("duration"))


def candidate_samples(spark, sf):
    s, thr, q = sg.detect(sq._signal(spark, sf))
    return sg.candidate_samples(sg.calm_core(s, q, thr), 7)


def neighbor_times(spark, sf):
    s, _, q = sg.detect(sq._signal(spark, sf))
    return sg.neighbor_times(q.select("g", F.col("a").alias("id"), "t_start", "t_end"), s, 8)


def frame_difference(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    return sg.frame_stats(v).select("g", "i", F.round("brightness", 6).alias("brightness"), F.round("diff", 6).alias("diff"))


def frame_stride(spark, sf):
    s = sq._signal(spark, sf).withColumnRenamed("i", "idx")
    return files.stride(s, 7).select("g", "idx")


def content_fingerprint(spark, sf):
    return _t(spark, sf, "pages").select("page_id", files.fingerprint(F.col("url").cast("binary"), 12).alias("f"))


def dedup_active(spark, sf):
    d = dd.descriptors(_t(spark, sf, "embeddings")).withColumn("active", F.col("id") % 7 != 0)
    return dd.resolved(d, dd.DedupParams(window=5))


def _review(spark, sf):
    """Orders as pages of a project per customer group, with times, flags and a page that each may repeat."""
    k = F.col("o_orderkey")
    flags = F.array_compact(F.array(F.when(k % 4 == 0, "possible_duplicate"), F.when(k % 6 == 0, "short"), F.when(k % 9 == 0, "moving"), F.when(k % 8 == 3, "picked")))
    o = _t(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")).alias("project"), k.alias("id"), k.alias("ord"), (F.col("o_totalprice") % 600).alias("t"),
        F.when(k % 7 == 0, "duplicate").when(k % 7 == 1, "blank").when(k % 7 == 2, "deleted").otherwise("keep").alias("status"), F.when(k % 5 == 0, "manual").otherwise("auto").alias("source"), flags.alias("flags"),
        (F.col("o_totalprice") % 600).alias("t_start"), (F.col("o_totalprice") % 600 + (k % 30) / 10).alias("t_end"))
    first = F.first("id").over(Window.partitionBy("project").orderBy("ord"))
    return o.withColumn("dup_of", F.when(F.col("id") % 3 == 0, first))


def needs_look(spark, sf):
    p = _review(spark, sf)
    return p.select("id", pg.needs_look(F.col("status"), F.col("flags")).alias("look"), pg.view(F.col("status"), F.col("flags")).alias("shown"))


def page_badges(spark, sf):
    return pg.badges(pg.page_numbers(_review(spark, sf))).select("project", "id", F.array_join("badges", "; ").alias("badges"))


def pages_by_time(spark, sf):
    return pg.by_time(_review(spark, sf)).select("project", "id", F.col("ord").cast("long").alias("ord"))


def page_insert(spark, sf):
    r = _review(spark, sf)
    new = r.where("id % 50 = 0").select("project", (F.col("id") + 10_000_000).alias("id"), (F.col("t") / 2).alias("t"))
    return pg.insert_by_time(pg.by_time(r.where("id % 50 <> 0")), new).select("project", "id", F.col("ord").cast("long").alias("ord"))


def pages_with_manual(spark, sf):
    r = _review(spark, sf)
    return pg.with_manual(r.where("source = 'auto' and id % 2 = 0"), r).select("project", "id", "source", F.col("ord").cast("long").alias("ord"))


def expected_pages(spark, sf):
    r = _review(spark, sf)
    expected = r.select("project").distinct().select("project", (F.substring("project", 2, 9).cast("long") % 40 + 5).alias("expected"))
    step = F.explode(F.sequence(F.lit(0), F.lit(40))).alias("step")
    counts = r.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", "n", step).select("project", (F.col("step") / 40).alias("sensitivity"), F.floor(F.col("n") * F.col("step") / 40).alias("segments"))
    return pg.check_expected(r, expected, counts).select("project", "expected", "detected", "ok", "sensitivity", F.col("predicted").cast("long").alias("predicted"))


def project_state(spark, sf):
    """Pages saved as a line of JSON each, and read back for the projects of which every image is present."""
    r = _review(spark, sf)
    saved = pg.saved(r.select("project", "ord", "id", "t", "status", "source"))
    images = r.where("id % 997 <> 0").select("project", "id")
    back = pg.loaded(saved, "project string, ord long, id long, t double, status string, source string", images)
    return back.select("project", "id", F.round("t", 6).alias("t"), "status")


def sharpest_frame(spark, sf):
    x = _t(spark, sf, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("i"), (F.col("p_retailprice") % 50).alias("sharpness"))
    return pg.sharpest(x)


def job_tallies(spark, sf):
    o = _t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("name"), F.when(F.col("o_orderstatus") == "O", "exists").when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    return ct.tallies(o)


def run_report(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("pages"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("error"))
    return o.select("pages", ct.run_report(o).alias("line"))


def _titles(spark, sf):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    name = F.translate("p_name", "aei", "áéï")
    title = F.when(k == 0, F.concat(name, F.lit(" (Chapter "), n, F.lit(")"))).when(k == 1, F.concat(F.lit("【"), F.upper("p_name"), F.lit("】Chapter "), n, F.lit("–"), (F.col("p_size") + 2).cast("string")))
    title = title.when(k == 2, F.concat("p_name", F.lit(" 2 (Chapter "), n, F.lit(")"))).when(k == 3, F.concat("p_name", F.lit(" - Ch. "), n, F.lit(" & 2024"))).when(k == 4, F.concat(F.lit("All of "), name, F.lit("! ep. "), n, F.lit(".5"))).when(k == 5, F.concat(F.lit("pre"), "p_name", F.lit(" Chapter "), n)).otherwise(F.concat("p_name", F.lit(" Prologue")))
    series = F.when(F.col("p_partkey") % 5 == 0, F.initcap("p_name")).when(F.col("p_partkey") % 5 == 1, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    return _t(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("idx"), title.alias("title"), series.alias("series"))


def title_normalised(spark, sf):
    return _titles(spark, sf).select("idx", ct.normalise(F.col("title")).alias("n"))


def series_chapters(spark, sf):
    return ct.spread(_titles(spark, sf)).withColumn("r", ct.parse_chapter(F.col("title"), F.col("series"))).select("idx", "r.first", "r.last")


def series_latest(spark, sf):
    t = _titles(spark, sf).withColumn("source", F.concat_ws("/", "source", F.substring_index("series", " ", -1)))
    return ct.latest_chapters(t, F.col("series"), 3, extra=4).select("source", "idx", "first", "last")


def select_ranges_column(spark, sf):
    spec = F.concat(F.col("idx") % 9, F.lit(", "), F.col("idx") % 30 + 20, F.lit("-"), F.col("idx") % 30)
    it = ct.items(_titles(spark, sf)).where("first is not null")
    return ct.select_ranges(it, spec).select("source", "idx")


def _sources(spark, sf):
    k = F.col("p_partkey")
    pid = F.concat(F.lit("PL"), F.lpad(k.cast("string"), 12, "0"))
    s = F.when(k % 6 == 0, pid).when(k % 6 == 1, F.concat(F.lit("https://www.youtube.com/watch?v=x"), k.cast("string"), F.lit("&list="), pid, F.lit("#t"))).when(k % 6 == 2, F.concat(F.lit("@user."), k.cast("string")))
    s = s.when(k % 6 == 3, F.concat(F.lit(" https://www.youtube.com/@user"), k.cast("string"), F.lit("/streams?list= "))).when(k % 6 == 4, F.concat(F.lit("youtube.com/playlist?list="), pid)).otherwise(F.concat(F.lit("https://youtu.be/x"), k.cast("string"), F.lit("/")))
    return _t(spark, sf, "part").select("p_partkey", s.alias("source"))


def playlist_id(spark, sf):
    return _sources(spark, sf).select("p_partkey", ct.playlist_id(F.col("source")).alias("pid"), ct.source_url(F.col("source")).alias("url"), ct.listing_key(F.col("source")).alias("key"))


def item_names(spark, sf):
    it = ct.spread(ct.items(_titles(spark, sf)))
    first, last, idx = F.col("first"), F.col("last"), F.col("idx")
    return it.select("idx", ct.display(first, last, idx).alias("display"), ct.pdf_name(F.col("source"), first, last, idx, F.col("title")).alias("file_name"))


def choose_playable(spark, sf):
    li, k = _t(spark, sf, "lineitem"), F.col("l_partkey")
    f = li.select(
        F.col("l_orderkey").alias("id"), F.when(k % 11 != 0, F.col("l_quantity").cast("int") * 20).alias("width"), (F.col("l_suppkey") % 9 * 120).cast("int").alias("height"),
        F.when(k % 5 == 0, "none").when(k % 5 == 1, "avc1.64").when(k % 5 == 2, "vp9").when(k % 5 == 3, "av01.0").alias("vcodec"), F.when(F.col("l_linestatus") == "O", "none").otherwise("opus").alias("acodec"),
        F.when(k % 13 == 0, "storyboard").alias("format_note"), (k % 17 == 0).alias("has_drm"), F.col("l_extendedprice").alias("tbr"), "l_partkey", "l_suppkey", "l_linenumber")
    return ct.choose_format(ct.playable(f), 360, ["l_partkey", "l_suppkey", "l_linenumber"]).select("id", "quality", "codec", "tbr")


def sizes_and_turns(spark, sf):
    p, k, z = _t(spark, sf, "part"), F.col("p_partkey").cast("int"), F.col("p_size")
    size, page = ge.analysis_size(z * 37, k % 900 + 1, 160), ge.uniform_page(z / (k % 40 + 10))
    return p.select(
        "p_partkey", ge.quarter_turns((k % 9 - 4) * 90).alias("turns"), ge.rotated((k % 4) * 90, F.lit(-90)).alias("rotation"), size["w"].alias("w"), size["h"].alias("h"),
        ge.quality(F.when(k % 3 != 0, z), k % 50).alias("quality"), ge.clock(k * 7 / 10).alias("clock"), F.round(ge.fill_fraction(z / 10, k % 30 + 1), 6).alias("fill"),
        F.round(page["w"], 6).alias("pw"), F.round(page["h"], 6).alias("ph"))


def crop_boxes(spark, sf):
    p, c = _t(spark, sf, "part"), F.col
    f = lambda x: (c("p_partkey") * x % 101) / 100.0
    box = pg.manual_crop(f(3), f(7), f(11), f(13), c("p_size") + 100, F.lit(200))
    scaled = pg.box_scale(F.struct((c("p_size") % 9).alias("x0"), F.lit(1).alias("y0"), (c("p_size") + 20).alias("x1"), F.lit(37).alias("y1")), F.lit(0.3), F.lit(150), F.lit(120))
    text = F.when(c("p_partkey") % 4 == 0, "auto").otherwise(F.concat_ws(", ", F.lit("0"), F.lit("0.25"), (c("p_size") / 100).cast("string"), F.lit("1")))
    mode = pg.parse_crop(text)
    cols = [b[x].alias(n + x) for n, b in (("m_", box), ("s_", scaled)) for x in ("x0", "y0", "x1", "y1")]
    return p.select("p_partkey", *cols, mode["mode"].alias("mode"), F.get(mode["box"], F.lit(2)).alias("right"))


def quad_order(spark, sf):
    k = F.col("p_partkey")
    pt = lambda a, b: F.struct((k * a % 97).alias("x"), (k * b % 89).alias("y"))
    q = pg.order_quad(F.array(pt(3, 5), pt(7, 11), pt(13, 17), pt(19, 23)))
    return _t(spark, sf, "part").select("p_partkey", *[F.get(q, F.lit(i))[x].alias(f"{x}{i}") for i in range(4) for x in ("x", "y")])


def _images(spark, sf):
    """Vectors as 16 x 4 images with flat bars at the top and left of some."""
    bar = lambda k: (F.floor(k / 4) < F.col("vec_id") % 5) | (k % 4 < F.col("vec_id") % 2)
    v = F.transform("embedding", lambda x, k: F.when(bar(k), F.lit(7.0)).otherwise(x.cast("double") * 100))
    return _t(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), v.alias("v"))


def trim_bars(spark, sf):
    b = _images(spark, sf).select("g", "id", pg.trim_uniform(F.col("v"), 4, 16, least=1).alias("b")).select("g", "id", "b.*")
    return b.select("g", "id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def profile_extent(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("g"), F.posexplode("embedding").alias("i", "v"))
    p = v.select("g", F.col("i").cast("long").alias("i"), F.greatest(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    return pg.profile_extent(p, 0.6).select("g", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def stream_lag_diff(spark, sf):
    """The events as a stream, drained: changes of value from one event of a type to the next."""
    top = shared_path(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    signal = events.select(F.col("event_type").alias("g"), F.col("event_id").alias("i"), F.col("value").alias("x"))
    q = st.lag_diff(signal).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("g string, i long, diff double").parquet(f"{top}/out").select("g", "i", F.round("diff", 6).alias("diff"))


QUERIES = {f.__name__: f for f in (
    sample_rate, pts_round_trip, split_segment, candidate_samples, neighbor_times, frame_difference, frame_stride, content_fingerprint, dedup_active, needs_look, page_badges, pages_by_time,
    page_insert, pages_with_manual, expected_pages, project_state, sharpest_frame, job_tallies, run_report, title_normalised, series_chapters, series_latest, select_ranges_column, playlist_id,
    item_names, choose_playable, sizes_and_turns, crop_boxes, quad_order, trim_bars, profile_extent, stream_lag_diff,
)}

_REVIEW = """
r0 as (select 'c' || (o_custkey % 100) project, o_orderkey id, o_orderkey ord, o_totalprice % 600 t, case o_orderkey % 7 when 0 then 'duplicate' when 1 then 'blank' when 2 then 'deleted' else 'keep' end status,
  case when o_orderkey % 5 = 0 then 'manual' else 'auto' end source, o_orderkey % 4 = 0 pd, o_orderkey % 6 = 0 sh, o_orderkey % 9 = 0 mv, o_orderkey % 8 = 3 pk,
  o_totalprice % 600 t_start, o_totalprice % 600 + (o_orderkey % 30) / 10.0::double t_end from orders),
r as (select *, case when id % 3 = 0 then first_value(id) over (partition by project order by ord) end dup_of, status = 'keep' as kept from r0)"""
_TITLES = r"""
t0 as (select p_brand source, p_partkey idx, p_partkey % 7 k, translate(p_name, 'aei', 'áéï') nm, p_name, p_size z, case p_partkey % 5 when 0 then array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')
  when 1 then split_part(p_name, ' ', 1) else p_name end series from part),
t1 as (select *, case k when 0 then nm || ' (Chapter ' || z || ')' when 1 then '【' || upper(p_name) || '】Chapter ' || z || '–' || (z + 2) when 2 then p_name || ' 2 (Chapter ' || z || ')' when 3 then p_name || ' - Ch. ' || z || ' & 2024'
  when 4 then 'All of ' || nm || '! ep. ' || z || '.5' when 5 then 'pre' || p_name || ' Chapter ' || z else p_name || ' Prologue' end title from t0),
t2 as (select *, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(title)), '[‐-―−]', '-', 'g'), '[()\[\]{}【】「」『』〈〉《》|:·•,;/_#]', ' ', 'g'), '\s+', ' ', 'g')) n,
  '(?:^|[^a-z0-9])' || array_to_string(list_transform(string_split(lower(series), ' '), lambda w: w), '\s*') || '[\s\-''.!?]*' as pre from t1)"""
_CHAPTER = r"(?:chapter|chap|ch|episode|ep)\.?\s*(\d+(?:\.\d+)?)(?:\s*(?:-|~|to|&|and|\+)\s*(?:chapter|ch\.?)?\s*(\d+(?:\.\d+)?))?(?:[^0-9]|$)"
_PARSED = f"""
t3 as (select *, try_cast(nullif(regexp_extract(n, pre || '{_CHAPTER}', 1), '') as double) a, try_cast(nullif(regexp_extract(n, pre || '{_CHAPTER}', 2), '') as double) b,
  try_cast(nullif(regexp_extract(n, '(?:^|[^a-z0-9]){_CHAPTER}', 1), '') as double) a1, try_cast(nullif(regexp_extract(n, '(?:^|[^a-z0-9]){_CHAPTER}', 2), '') as double) b1 from t2),
t4 as (select *, a as first, case when b is null or b < a or b - a > 20 then a else b end as last, a1 as any_first, case when b1 is null or b1 < a1 or b1 - a1 > 20 then a1 else b1 end as any_last from t3)"""
_NAMES = f"""with {_TITLES}, {_PARSED},
it as (select source, min(idx) idx, any_first f, any_last l, arg_min(title, idx) title from t4 where any_first is not null group by 1, 3, 4 union all select source, idx, null, null, title from t4 where any_first is null)"""


def _label(x: str) -> str:
    return f"lpad(floor({x})::bigint::varchar, greatest(3, len(floor({x})::bigint::varchar))::int, '0') || case when {x} > floor({x}) then '.5' else '' end"


ORACLE_SQL = {
    "sample_rate": f"with {sq._SIGNAL}, q as (select g, count(*) n, max(t) - min(t) d from p where g <> 'click' or i = 0 group by g) select g, round(case when n > 1 and d > 0 then (n - 1) / d else 15.0::double end, 6) rate from q",
    "pts_round_trip": "with q as (select event_id, round_even(900 + value / 7 / (1 / 12500.0::double), 0)::bigint pts from events) select event_id, pts, round(pts * (1 / 12500.0::double), 6) t from q",
    "split_segment": f"""{sq._CALM0}, y as (select s.g, s.i, s.s, a, b, thr, median(s.s) over (partition by s.g, a) lvl from sg join s on s.g = sg.g and s.i between a and b join th on th.g = sg.g),
y1 as (select *, s > greatest(6.0::double * lvl, 0.06::double * thr, 0.08::double) up from y),
y2 as (select *, i - row_number() over (partition by g, a, up order by i) isl from y1),
y3 as (select g, a, b, min(i) i0, max(i) i1, max(s) height from y2 where up group by g, a, b, isl having min(i) - a >= 9 and b - max(i) >= 9),
y4 as (select * from (select *, row_number() over (partition by g, a order by height desc, i0 desc, i1 desc) rank from y3) where rank <= 4),
y5 as (select *, unnest([0, 1]) half from y4 where (i0 - a) / 30.0::double >= 0.3::double and (b - i1) / 30.0::double >= 0.3::double)
select g, a, i0, half::bigint half, case half when 0 then a else i1 + 1 end ha, case half when 0 then i0 - 1 else b end hb, round((case half when 0 then i0 - a else b - i1 end) / 30.0::double, 6) duration from y5""",
    "candidate_samples": f"""with c as ({sq.ORACLE_SQL["calm_core"]}), d as (select *, least(7, core_b - core_a + 1) - 1 m from c),
e as (select g, a, calm, unnest(list_transform(range(greatest(m, 0) + 1), lambda k: round_even(core_a + k * (core_b - core_a) / greatest(m, 1)::double, 0)::bigint)) i from d)
select g, a, i from e union select g, a, calm from c""",
    "neighbor_times": f"""{sq._AUTO}, ed as (select g, max(t) m from s group by g), lo as (select sg.g, a, greatest(0, t_start - 0.4::double) lo, least(m, t_end + 0.4::double) hi from sg join ed on ed.g = sg.g),
rq as (select g, a id, unnest(list_transform(range(8), lambda k: lo + k * (hi - lo) / 7)) r from lo),
pr as (select rq.g, id, rq.r, s.i pi, s.t pt from rq asof left join s on rq.g = s.g and rq.r >= s.t),
nx as (select rq.g, id, rq.r, s.i ni, s.t nt from rq asof left join s on rq.g = s.g and rq.r <= s.t)
select distinct pr.g, pr.id, case when ni is null then pi when pi is null then ni when pr.r - pt <= nt - pr.r then pi else ni end i from pr join nx on pr.g = nx.g and pr.id = nx.id and pr.r = nx.r""",
    "frame_difference": """with e as (select label g, vec_id i, embedding::double[] v, lag(embedding::double[]) over (partition by label order by vec_id) l from embeddings)
select g, i, round(list_avg(v), 6) brightness, round(case when l is null then 0 else list_avg(list_transform(range(1, 65), lambda k: abs(v[k] - l[k]))) end, 6) diff from e""",
    "frame_stride": f"with {sq._SIGNAL} select g, i idx from p where i % 7 = 0",
    "content_fingerprint": "with u as (select page_id, url, len(url) n from pages where url is not null) select page_id, left(sha1(n || substr(url, 1, 12) || substr(url, greatest(0, n // 2 - 6)::int + 1, 12) || substr(url, greatest(0, n - 12)::int + 1, 12)), 16) f from u union all select page_id, null from pages where url is null",
    "dedup_active": """with recursive d0 as (select label g, (row_number() over (partition by label order by vec_id) - 1)::int i, vec_id id, embedding::double[] v, list_sort(embedding[2:])[32] md, embedding e from embeddings),
d as (select g, i, v, list_transform(e, lambda x: x > md) h from d0 where id % 7 <> 0),
pr as (select a.g, a.i, b.i j, len(list_filter(range(1, 65), lambda k: a.h[k] <> b.h[k])) dist, b.i - a.i > 5 far, a.v va, b.v vb from d a join d b on a.g = b.g and a.i < b.i),
sc as (select g, i, j, far, round(list_inner_product(va, vb), 6) score from pr where (not far or dist <= 22) and dist <= 40),
rk as (select *, case when score >= 0.3::double then 2 when score >= 0.22::double then 1 else 0 end rank from sc), mj as (select g, max(j) m from rk where rank > 0 group by g),
st(g, j, dups, bi, br) as (select g, 0, []::int[], null::int, null::int from mj union all
  select st.g, st.j + 1, case when b.r.rank = 2 then list_append(st.dups, (st.j + 1)::int) else st.dups end, b.r.i, b.r.rank from st join mj using (g)
  left join lateral (select first({'i': i, 'rank': rank} order by rank desc, score desc, far desc, i) r from rk where rk.g = st.g and rk.j = st.j + 1 and rank > 0 and not list_contains(st.dups, rk.i)) b on true
  where st.j < mj.m)
select g, j, case br when 2 then 'duplicate' else 'possible' end status, bi i from st where bi is not null""",
    "needs_look": f"with {_REVIEW} select id, kept and (pd or sh or mv) look, case when not kept then 'hidden' when pd or sh or mv then 'look' else 'all' end shown from r",
    "page_badges": f"""with {_REVIEW}, n as (select *, case when kept then (count(*) filter (kept) over (partition by project order by ord)) end num from r),
b as (select n.*, f.num as ref from n left join n f on f.project = n.project and f.id = n.dup_of)
select project, id, concat_ws('; ', case when status = 'duplicate' then 'repeat of p. ' || coalesce(ref::varchar, 'None') || ' (hidden)' when status = 'blank' then 'blank frame (hidden)' when status = 'deleted' then 'deleted' end,
  case when kept and pd then coalesce('looks like p. ' || ref, 'possible repeat') end, case when kept and sh then 'brief (' || printf('%.1f', t_end - t_start) || 's)' end, case when kept and mv then 'moving shot' end,
  case when pk and source <> 'manual' then 'frame picked' end, case when source = 'manual' then 'added by you' end) badges from b""",
    "pages_by_time": f"with {_REVIEW} select project, id, (row_number() over (partition by project order by t, ord) - 1)::bigint ord from r",
    "page_insert": f"""with {_REVIEW}, o as (select project, id, t, row_number() over (partition by project order by t, ord) - 1 ord from r where id % 50 <> 0), n as (select project, id + 10000000 id, t / 2 t from r where id % 50 = 0),
b as (select project, id, t, 0 nw, ord from o union all select project, id, t, 1, null from n)
select project, id, (row_number() over (partition by project order by t, nw, ord) - 1)::bigint ord from b""",
    "pages_with_manual": f"""with {_REVIEW}, b as (select project, id, source, t, 0 od, ord from r where source = 'auto' and id % 2 = 0 union all select project, id, source, t, 1, ord from r where source = 'manual')
select project, id, source, (row_number() over (partition by project order by t, od, ord) - 1)::bigint ord from b""",
    "expected_pages": f"""with {_REVIEW}, h as (select project, substr(project, 2)::bigint % 40 + 5 expected, count(*) filter (kept) detected, count(*) filter (source = 'auto' and not kept) hid, count(*) filter (source <> 'auto' and kept) man, count(*) n from r group by 1, 2),
g as (select h.*, k / 40.0::double sens, floor(n * k / 40.0::double)::bigint - hid + man pred from h, range(41) x(k)),
b as (select project, expected, detected, arg_min(sens, (abs(pred - expected), round(abs(sens - 0.5::double), 9), sens)) sens, arg_min(pred, (abs(pred - expected), round(abs(sens - 0.5::double), 9), sens)) pred from g group by 1, 2, 3),
c as (select *, detected <> expected and abs(pred - expected) < abs(detected - expected) and abs(sens - 0.5::double) > 1e-6 tell from b)
select project, expected, detected, detected = expected ok, case when tell then sens end sensitivity, case when tell then pred::bigint end predicted from c""",
    "project_state": f"with {_REVIEW} select project, id, round(t, 6) t, status from r where project not in (select project from r where id % 997 = 0)",
    "sharpest_frame": "with x as (select p_brand g, p_partkey i, p_retailprice % 50 s from part) select g, arg_min(i, (-s, i)) i, max(s) sharpness from x group by g",
    "job_tallies": "select o_custkey % 50 as name, count(*) filter (o_orderstatus = 'F') done, count(*) filter (o_orderstatus = 'O') already, count(*) filter (o_orderstatus not in ('O', 'F')) failed from orders group by 1",
    "run_report": """select o_orderkey pages, '{"pages":' || o_orderkey || ',"status":"' || o_orderstatus || '","error":' || case when o_orderkey % 3 = 0 then '"' || o_orderpriority || '"' else 'null' end || '}' line from orders""",
    "title_normalised": f"with {_TITLES} select idx, n from t2",
    "series_chapters": f"with {_TITLES}, {_PARSED} select idx, first, last from t4",
    "series_latest": f"""with {_TITLES}, {_PARSED}, v as (select source || '/' || split_part(series, ' ', -1) source, idx, first, last from t4),
p as (select *, row_number() over (partition by source order by idx) p, case when first is not null and row_number() over (partition by source, first, last order by idx) = 1 then 1 else 0 end nw from v),
k as (select *, sum(nw) over (partition by source order by idx) k from p), z as (select *, least(coalesce(min(p) filter (k >= 3) over (partition by source) + 4, 5000), 5000) stop from k),
f as (select source, first, last, min(idx) idx from z where p <= stop and first is not null group by source, first, last)
select source, idx, first, last from (select *, row_number() over (partition by source order by first desc, last desc) n from f) where n <= 3""",
    "select_ranges_column": f"""{_NAMES}, x as (select *, idx % 9 a, idx % 30 b, idx % 30 + 20 c from it where f is not null) select source, idx from x where (f <= a and l >= a) or (f <= c and l >= b)""",
    "playlist_id": """with s as (select p_partkey, p_partkey % 6 k, 'PL' || lpad(p_partkey::varchar, 12, '0') pid from part),
u as (select p_partkey, case when k in (0, 1, 4) then pid end pid, case when k in (0, 1, 4) then 'https://www.youtube.com/playlist?list=' || pid when k = 2 then 'https://www.youtube.com/@user.' || p_partkey || '/videos'
  when k = 3 then 'https://www.youtube.com/@user' || p_partkey || '/videos' else 'https://youtu.be/x' || p_partkey || '/videos' end url from s)
select p_partkey, pid, url, right(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), 80) as key from u""",
    "item_names": rf"""{_NAMES}, y as (select *, case when f = l then {_label('f')} else {_label('f')} || '-' || {_label('l')} end lb, lpad((idx + 1)::varchar, greatest(3, len((idx + 1)::varchar))::int, '0') pl,
  regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') sf from it)
select idx, case when f is not null then 'Chapter ' || lb else 'Video ' || (idx + 1) end display, case when f is not null then source || ' - Chapter ' || lb else source || ' - ' || pl || ' - ' || sf end || '.pdf' file_name from y""",
    "choose_playable": """with f as (select l_orderkey id, case when l_partkey % 11 <> 0 then l_quantity::int * 20 end w, (l_suppkey % 9 * 120)::int h, case l_partkey % 5 when 1 then 3 when 2 then 2 when 3 then 1 else 0 end codec, l_linestatus = 'O' vo, l_extendedprice tbr, l_partkey, l_suppkey, l_linenumber
  from lineitem where l_partkey % 5 in (1, 2, 3) and l_partkey % 13 <> 0 and l_partkey % 17 <> 0),
q as (select *, case when w is not null and w <> 0 and h <> 0 then least(w, h) else nullif(h, 0) end quality from f)
select id, quality, codec, tbr from (select *, row_number() over (partition by id order by case when quality = 360 then 0 when quality > 360 then 1 else 2 end, abs(quality - 360), vo desc, codec desc, tbr desc, l_partkey, l_suppkey, l_linenumber) n from q where quality > 0) where n = 1""",
    "sizes_and_turns": """with p as (select p_partkey k, p_size z, p_partkey * 7 / 10.0::double c, least(1, 160.0::double / greatest(p_size * 37, 1)) sc, p_size / (p_partkey % 40 + 10)::double ar from part)
select k p_partkey, ((k % 9 - 4) % 4 + 4) % 4 turns, ((k % 4) * 90 + 270) % 360 rotation, greatest(8, round_even(z * 37 * sc, 0)::int) w, greatest(8, round_even((k % 900 + 1) * sc, 0)::int) h,
  case when k % 3 <> 0 and z <> 0 and k % 50 <> 0 then least(z, k % 50) else nullif(k % 50, 0) end quality, printf('%02d:%04.1f', floor(c / 60)::int, c - floor(c / 60) * 60) clock,
  round(1 - least(z / 10.0::double, k % 30 + 1) / greatest(z / 10.0::double, k % 30 + 1), 6) fill, round(case when ar <= 1 then 297 / 25.4::double * 72 * ar else 297 / 25.4::double * 72 end, 6) pw, round(case when ar <= 1 then 297 / 25.4::double * 72 else 297 / 25.4::double * 72 / ar end, 6) ph from p""",
    "crop_boxes": """with f as (select p_partkey k, p_size z, (p_partkey * 3 % 101) / 100.0::double a, (p_partkey * 7 % 101) / 100.0::double b, (p_partkey * 11 % 101) / 100.0::double c, (p_partkey * 13 % 101) / 100.0::double d, p_size + 100 w from part),
g as (select *, least(greatest(round_even(least(a, c) * w, 0), 0), w - 1)::int x0, least(greatest(round_even(least(b, d) * 200, 0), 0), 199)::int y0, least(round_even(greatest(a, c) * w, 0), w)::int x1, least(round_even(greatest(b, d) * 200, 0), 200)::int y1 from f)
select k p_partkey, x0 m_x0, y0 m_y0, greatest(x1, x0 + 1) m_x1, greatest(y1, y0 + 1) m_y1, greatest(floor((z % 9) / 0.3::double), 0)::int s_x0, 3 s_y0, least(ceil((z + 20) / 0.3::double), 150)::int s_x1, 120 s_y1,
  case when k % 4 = 0 then 'auto' else 'manual' end as mode, case when k % 4 <> 0 then z / 100.0::double end as "right" from g""",
    "quad_order": """with p as (select p_partkey k, unnest([{'i': 0, 'x': p_partkey * 3 % 97, 'y': p_partkey * 5 % 89}, {'i': 1, 'x': p_partkey * 7 % 97, 'y': p_partkey * 11 % 89}, {'i': 2, 'x': p_partkey * 13 % 97, 'y': p_partkey * 17 % 89}, {'i': 3, 'x': p_partkey * 19 % 97, 'y': p_partkey * 23 % 89}]) q from part),
m as (select k, arg_min(q, (q.x + q.y, q.i)) a, arg_min(q, (q.y - q.x, q.i)) b, arg_min(q, (-q.x - q.y, q.i)) c, arg_min(q, (q.x - q.y, q.i)) d from p group by k)
select k p_partkey, a.x x0, a.y y0, b.x x1, b.y y1, c.x x2, c.y y2, d.x x3, d.y y3 from m""",
    "trim_bars": """with recursive px as (select label g, vec_id id, k // 4 y, k % 4 x, case when k // 4 < vec_id % 5 or k % 4 < vec_id % 2 then 7.0::double else v * 100 end v from (select label, vec_id, unnest(range(64)) k, unnest(embedding)::double v from embeddings)),
b0 as (select g, id, 0 x0, 0 y0, 4 x1, 16 y1 from px group by g, id),
t0 as (select px.g, px.id, y k, 16 n, avg(v) m, stddev_pop(v) sd from px group by 1, 2, 3), c0 as (select g, id, greatest(least(coalesce(min(k) filter (sd >= 5 or abs(m - m0) > 12), 16), 15), 0) c from (select *, max(m) filter (k = 0) over (partition by g, id) m0 from t0) group by g, id),
b1 as (select g, id, x0, y0 + c y0, x1, y1 from b0 join c0 using (g, id)),
t1 as (select g, id, y1 - 1 - y k, y1 - y0 n, avg(v) m, stddev_pop(v) sd from px join b1 using (g, id) where y >= y0 and y < y1 group by 1, 2, 3, 4), c1 as (select g, id, greatest(least(coalesce(min(k) filter (sd >= 5 or abs(m - m0) > 12), n), n - 1), 0) c from (select *, max(m) filter (k = 0) over (partition by g, id) m0 from t1) group by g, id, n),
b2 as (select g, id, x0, y0, x1, y1 - c y1 from b1 join c1 using (g, id)),
t2 as (select g, id, x k, 4 n, avg(v) m, stddev_pop(v) sd from px join b2 using (g, id) where y >= y0 and y < y1 group by 1, 2, 3), c2 as (select g, id, greatest(least(coalesce(min(k) filter (sd >= 5 or abs(m - m0) > 12), n), n - 1), 0) c from (select *, max(m) filter (k = 0) over (partition by g, id) m0 from t2) group by g, id, n),
b3 as (select g, id, x0 + c x0, y0, x1, y1 from b2 join c2 using (g, id)),
t3 as (select g, id, x1 - 1 - x k, x1 - x0 n, avg(v) m, stddev_pop(v) sd from px join b3 using (g, id) where y >= y0 and y < y1 and x >= x0 and x < x1 group by 1, 2, 3, 4), c3 as (select g, id, greatest(least(coalesce(min(k) filter (sd >= 5 or abs(m - m0) > 12), n), n - 1), 0) c from (select *, max(m) filter (k = 0) over (partition by g, id) m0 from t3) group by g, id, n)
select g, id, x0, y0, x1 - c x1, y1 from b3 join c3 using (g, id)""",
    "profile_extent": """with p as (select vec_id g, k i, greatest(v, 0) v from (select vec_id, unnest(range(64)) k, unnest(embedding)::double v from embeddings)),
s as (select g, i, (coalesce(lag(v) over w, 0) + v + coalesce(lead(v) over w, 0)) / 3 s from p window w as (partition by g order by i)), f as (select g, quantile_cont(s, 0.9) ref from s group by g)
select g, coalesce(min(i) filter (ref > 0 and s >= 0.6::double * ref), 0)::bigint lo, coalesce(max(i) filter (ref > 0 and s >= 0.6::double * ref) + 1, 64)::bigint hi from s join f using (g) group by g""",
    "stream_lag_diff": "select event_type g, event_id i, round(coalesce(abs(value - lag(value) over (partition by event_type order by event_id)), 0), 6) diff from events",
}
