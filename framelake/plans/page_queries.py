"""Queries on descriptors, pages and catalogs over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import catalog as ct
from framelake.operators import dedup as dd
from framelake.operators import pages as pg


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _desc(spark, sf):
    return dd.descriptors(_t(spark, sf, "embeddings"))


def hash_hamming_pairs(spark, sf):
    return dd.pairs(_desc(spark, sf)).select("g", "i", "j", F.col("dist").cast("long").alias("dist"))


def dedup_candidates(spark, sf):
    return dd.scored(_desc(spark, sf)).select("g", "i", "j", "far", "score")


def dedup_classify(spark, sf):
    return dd.scored(_desc(spark, sf)).groupBy("g", "rank").agg(F.count(F.lit(1)).alias("n"))


def dedup_best_match(spark, sf):
    return dd.best_match(dd.scored(_desc(spark, sf))).select("g", "j", "i", "rank", "score")


def dedup_greedy(spark, sf):
    return dd.resolved(_desc(spark, sf))


def match_classify(spark, sf):
    m = _t(spark, sf, "part").select("p_partkey", (F.lit(0.7) + F.col("p_size") % 31 / 100).alias("ssim"), (F.col("p_partkey") % 11 / 11).alias("local"), (F.col("p_partkey") % 17 * 1.0).alias("peak"), (F.col("p_size") % 5 * 1.0).alias("spread"))
    return m.select("p_partkey", dd.classify(F.col("ssim"), F.col("local"), F.col("peak"), F.col("spread")).alias("verdict"))


def exact_repeats(spark, sf):
    return dd.exact_repeats(_t(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


def _pages(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey") % 7
    return o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")).alias("project"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"),
                    F.when(k == 0, "duplicate").when(k == 1, "blank").when(k == 2, "deleted").otherwise("keep").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "manual").otherwise("auto").alias("source"))


def page_numbers(spark, sf):
    return pg.page_numbers(_pages(spark, sf)).select("project", "id", "number")


def project_summary(spark, sf):
    return pg.summary(_pages(spark, sf))


def page_move(spark, sf):
    first = F.col("ord") == F.min("ord").over(Window.partitionBy("project"))
    p = _pages(spark, sf).withColumn("_f", first)
    return pg.move(p, F.when(F.col("_f"), F.col("id")).otherwise(F.lit(-1)), 3).select("project", "id", F.col("ord").cast("long").alias("ord"))


def best_aspect(spark, sf):
    a = _t(spark, sf, "part").select(F.col("p_brand").alias("g"), (F.col("p_size") / (F.lit(20.0) + F.col("p_partkey") % 13)).alias("aspect"))
    return pg.best_aspect(a).select("g", F.round("aspect", 4).alias("aspect"), F.round("cost", 4).alias("cost"))


def _grid(spark, sf):
    return pg.pixels(_t(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8)


def static_border(spark, sf):
    g = _grid(spark, sf).withColumn("v", F.when(F.col("y").isin(0, 7) | (F.col("x") < 2), F.lit(5.0)).otherwise(F.col("v").cast("double")))
    b = pg.static_border(g, 0.1)
    return b.select("g", *[F.col(c).cast("long").alias(c) for c in ("top", "bottom", "left", "right")])


def temporal_median(spark, sf):
    g = _grid(spark, sf).withColumn("g", F.floor(F.col("id") / 9))
    return pg.temporal_median(g).select("g", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("m").cast("double").alias("m"))


def box_iou(spark, sf):
    c = F.col
    a = F.struct((c("p_size") % 10).alias("x0"), (c("p_partkey") % 7).alias("y0"), (c("p_size") % 10 + 8).alias("x1"), (c("p_partkey") % 7 + 6).alias("y1"))
    b = F.struct((c("p_partkey") % 12).alias("x0"), F.lit(2).alias("y0"), (c("p_partkey") % 12 + 5).alias("x1"), F.lit(9).alias("y1"))
    return _t(spark, sf, "part").select("p_partkey", F.round(pg.iou(a, b), 6).alias("iou"))


def _catalog(spark, sf):
    n, k, k2 = F.col("p_size").cast("string"), F.col("p_partkey") % 6, (F.col("p_size") + 1).cast("string")
    name = F.col("p_name")
    title = F.when(k == 0, F.concat(name, F.lit(" (Chapter "), n, F.lit(")"))).when(k == 1, F.concat(name, F.lit(" - Ch. "), n, F.lit("-"), k2)).when(k == 2, F.concat(name, F.lit(": Ep "), n, F.lit(" & "), k2))
    title = title.when(k == 3, F.concat(F.lit("Prologue of "), name)).when(k == 4, F.concat(F.lit("EPISODE "), n, F.lit(".5"))).otherwise(F.lit("[Deleted video] "))
    return _t(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("idx"), title.alias("title"))


def chapter_parse(spark, sf):
    return ct.spread(_catalog(spark, sf)).withColumn("r", ct.parse(F.col("title"))).select("idx", "r.first", "r.last")


def chapter_first_wins(spark, sf):
    return ct.items(_catalog(spark, sf)).where("first is not null").select("source", "first", "last", "idx", "alternates")


def sort_items(spark, sf):
    return ct.sort_items(ct.items(_catalog(spark, sf))).select("source", "idx", "pos")


def select_ranges(spark, sf):
    return ct.select_ranges(ct.items(_catalog(spark, sf)), F.lit("3, 12-10, 40-45")).select("source", "idx")


def select_latest(spark, sf):
    return ct.select_latest(ct.sort_items(ct.items(_catalog(spark, sf))), 5).select("source", "idx")


def latest_early_stop(spark, sf):
    seen = ct.scanned(_catalog(spark, sf), 10, extra=7)
    return ct.select_latest(ct.sort_items(ct.items(seen).where("first is not null")), 10).select("source", "idx")


def choose_format(spark, sf):
    li = _t(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quality"), (F.col("l_linestatus") == "O").alias("video_only"),
                  F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1).alias("codec"), F.col("l_extendedprice").alias("tbr"), "l_partkey", "l_suppkey", "l_linenumber")
    return ct.choose_format(f, 25, ["l_partkey", "l_suppkey", "l_linenumber"]).select("id", "quality", "tbr")


def _reports(spark, sf):
    o = _t(spark, sf, "orders").withColumn("label", F.floor(F.col("o_orderkey") / 2).cast("string"))
    row = [F.col("label"), F.when(F.col("o_orderstatus") == "O", "exists").otherwise("done").alias("status"), F.col("o_orderkey").alias("pages")]
    w = F.col("o_orderkey") % 2
    return o.where(w == 0).select(*row), o.where(w == 1).select(*row)


def report_upsert(spark, sf):
    return ct.upsert(*_reports(spark, sf), ["pages"])


def skip_existing(spark, sf):
    old, new = _reports(spark, sf)
    return ct.unfinished(new, old).select("label", "pages")


def url_canonical(spark, sf):
    return _t(spark, sf, "pages").select("page_id", ct.videos_url(F.col("url")).alias("u"))


def playlist_param(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"[?&]page=([^&#]*)", 1), F.lit("")).alias("p"))


def safe_filename(spark, sf):
    return _t(spark, sf, "pages").select("page_id", ct.safe_filename(F.col("url")).alias("f"))


def parse_time(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(s, F.lit(",5"))).when(k % 4 == 1, F.concat(s, F.lit(":"), s, F.lit(".25"))).when(k % 4 == 2, F.concat(F.lit("1:"), s, F.lit(":"), s)).otherwise(F.concat(s, F.lit("m")))
    return _t(spark, sf, "part").select("p_partkey", ct.parse_time(text).alias("seconds"))


def chapter_label(spark, sf):
    a = F.col("p_size") * 25 + F.when(F.col("p_partkey") % 3 == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return _t(spark, sf, "part").select("p_partkey", ct.label(a, a + F.col("p_partkey") % 2).alias("label"))


def content_key(spark, sf):
    j = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("pts")))
    return _t(spark, sf, "events").select("event_id", F.left(F.sha1(j), F.lit(20)).alias("k"))


QUERIES = {f.__name__: f for f in (
    hash_hamming_pairs, dedup_candidates, dedup_classify, dedup_best_match, dedup_greedy, match_classify, exact_repeats, page_numbers, project_summary, page_move,
    best_aspect, static_border, temporal_median, box_iou, chapter_parse, chapter_first_wins, sort_items, select_ranges, select_latest, latest_early_stop,
    choose_format, report_upsert, skip_existing, url_canonical, playlist_param, safe_filename, parse_time, chapter_label, content_key,
)}

_DESC = """
d0 as (select label g, (row_number() over (partition by label order by vec_id) - 1)::int i, vec_id id, embedding::double[] v, list_sort(embedding[2:])[32] md, embedding e from embeddings),
d as (select g, i, v, list_transform(e, lambda x: x > md) h from d0),
pr as (select a.g, a.i, b.i j, len(list_filter(range(1, 65), lambda k: a.h[k] <> b.h[k])) dist, b.i - a.i > 20 far, a.v va, b.v vb from d a join d b on a.g = b.g and a.i < b.i),
ps as (select * from pr where (not far or dist <= 22) and dist <= 40),
sc as (select g, i, j, dist, far, round(list_inner_product(va, vb), 6) score from ps),
rk as (select *, case when score >= 0.3::double then 2 when score >= 0.22::double then 1 else 0 end rank from sc)"""
_PAGES = """pages_ as (select 'c' || (o_custkey % 100) project, o_orderkey ord, o_orderkey id, case o_orderkey % 7 when 0 then 'duplicate' when 1 then 'blank' when 2 then 'deleted' else 'keep' end status,
  case when o_orderkey % 5 = 0 then 'manual' else 'auto' end source from orders)"""
_CAT = r"""
ca as (select p_brand source, p_partkey idx, case p_partkey % 6 when 0 then p_name || ' (Chapter ' || p_size || ')' when 1 then p_name || ' - Ch. ' || p_size || '-' || (p_size + 1)
  when 2 then p_name || ': Ep ' || p_size || ' & ' || (p_size + 1) when 3 then 'Prologue of ' || p_name when 4 then 'EPISODE ' || p_size || '.5' else '[Deleted video] ' end title from part),
cb as (select *, trim(regexp_replace(regexp_replace(lower(title), '[()\[\]{}|:·•,;/_#]', ' ', 'g'), '\s+', ' ', 'g')) n from ca),
cc as (select *, regexp_extract(n, '(?:^|[^a-z0-9])(?:chapter|chap|ch|episode|ep)\.?\s*(\d+(?:\.\d+)?)(?:\s*(?:-|~|to|&|and|\+)\s*(?:chapter|ch\.?)?\s*(\d+(?:\.\d+)?))?(?:[^0-9]|$)', ['a', 'b']) m from cb),
cd as (select *, try_cast(nullif(m.a, '') as double) a, coalesce(try_cast(nullif(m.b, '') as double), try_cast(nullif(m.a, '') as double)) b from cc),
ce as (select source, idx, title, a as first, case when b < a or b - a > 20 then a else b end as last from cd)"""
_ITEMS = _CAT + """,
us as (select * from ce where lower(trim(title)) not in ('[deleted video]', '[private video]', '[unavailable video]')),
it as (select source, min(idx) idx, first, last, (count(*) - 1)::bigint alternates from us where first is not null group by source, first, last
  union all select source, idx, null, null, 0 from us where first is null)"""
_SORT = """,
ia as (select *, case when first is not null then (first, last) end fl, last_value(case when first is not null then (first, last) end ignore nulls) over (partition by source order by idx) prev from it),
so as (select source, idx, first, (row_number() over (partition by source order by coalesce(fl, prev) asc nulls first, first is null, idx) - 1)::bigint pos from ia)"""
_REP = """o as (select (o_orderkey // 2)::varchar as label, case when o_orderstatus = 'O' then 'exists' else 'done' end status, o_orderkey as pages, o_orderkey % 2 w from orders)"""

ORACLE_SQL = {
    "hash_hamming_pairs": f"with {_DESC} select g, i, j, dist::bigint dist from ps",
    "dedup_candidates": f"with {_DESC} select g, i, j, far, score from sc",
    "dedup_classify": f"with {_DESC} select g, rank, count(*) n from rk group by g, rank",
    "dedup_best_match": f"with {_DESC} select g, j, i, rank, score from (select *, row_number() over (partition by g, j order by rank desc, score desc, far desc, i) n from rk) where n = 1 and rank > 0",
    "dedup_greedy": f"""with recursive {_DESC}, mj as (select g, max(j) m from rk where rank > 0 group by g),
st(g, j, dups, bi, br) as (select g, 0, []::int[], null::int, null::int from mj union all
  select st.g, st.j + 1, case when b.r.rank = 2 then list_append(st.dups, (st.j + 1)::int) else st.dups end, b.r.i, b.r.rank from st join mj using (g)
  left join lateral (select first({{'i': i, 'rank': rank}} order by rank desc, score desc, far desc, i) r from rk where rk.g = st.g and rk.j = st.j + 1 and rank > 0 and not list_contains(st.dups, rk.i)) b on true
  where st.j < mj.m)
select g, j, case br when 2 then 'duplicate' else 'possible' end status, bi i from st where bi is not null""",
    "match_classify": """with m as (select p_partkey, 0.7::double + p_size % 31 / 100.0::double ssim, p_partkey % 11 / 11.0::double loc, (p_partkey % 17)::double peak, (p_size % 5)::double spread from part)
select p_partkey, case when ssim >= 0.88::double then case when peak >= 6 and peak / greatest(spread, 1) >= 4 then 'possible' when loc >= 0.5 then 'duplicate' else 'possible' end
  when ssim >= 0.8::double and loc >= 0.3::double then 'possible' else 'unique' end verdict from m""",
    "exact_repeats": "select min(doc_id) as first, count(*) - 1 repeats from documents group by text",
    "page_numbers": f"with {_PAGES} select project, id, case when status = 'keep' then (count(*) filter (status = 'keep') over (partition by project order by ord))::bigint end number from pages_",
    "project_summary": f"""with {_PAGES} select project, count(*) total, count(*) filter (status = 'keep') kept, count(*) filter (status = 'duplicate') duplicates, count(*) filter (status = 'blank') blanks,
  count(*) filter (status = 'deleted') deleted, count(*) filter (source = 'manual') manual from pages_ group by project""",
    "page_move": f"""with {_PAGES}, n as (select *, row_number() over (partition by project order by ord) - 1 k from pages_)
select project, id, (row_number() over (partition by project order by case when k = 0 then 2.5 + 1e-9 when k <= 3 then k - 1 else k end, k) - 1)::bigint ord from n""",
    "best_aspect": """with a as (select p_brand g, p_size / (20.0::double + p_partkey % 13) x from part where p_size > 0),
n as (select g, count(*) n, quantile_cont(x, list_transform(range(201), lambda k: k / 200.0::double)) q from a group by g),
c as (select distinct a.g, round(x, 4) c from a join n using (g) where n <= 400 union all select distinct g, unnest(q) from n where n > 400),
k as (select g, c, round(sum(1 - least(x, c) / greatest(x, c)), 6) cost from a join c using (g) group by g, c)
select g, round(arg_min(c, (cost, c)), 4) aspect, round(min(cost), 4) as cost from k group by g""",
    "static_border": """with p as (select label g, unnest(range(64)) k, unnest(embedding) v from embeddings), q as (select g, k // 8 y, k % 8 x, case when k // 8 in (0, 7) or k % 8 < 2 then 5.0::double else v end v from p),
c as (select g, y, x, max(v) - min(v) < 0.1::double st from q group by g, y, x having count(*) >= 3),
yy as (select g, y, avg(st::int) >= 0.9::double s from c group by g, y), xx as (select g, x, avg(st::int) >= 0.9::double s from c group by g, x),
a as (select g, coalesce(min(y) filter (not s), max(y)) as top, coalesce(max(y) - max(y) filter (not s), 0) bottom from yy group by g),
b as (select g, coalesce(min(x) filter (not s), max(x)) as "left", coalesce(max(x) - max(x) filter (not s), 0) as "right" from xx group by g) select * from a join b using (g) where 8 - top - bottom >= 1.6 and 8 - "left" - "right" >= 1.6""",
    "temporal_median": """with p as (select vec_id // 9 g, unnest(range(64)) k, unnest(embedding)::double v from embeddings)
select g, k // 8 y, k % 8 x, list_sort(list(v))[(count(*) - 1) // 2 + 1] m from p group by g, k""",
    "box_iou": """with b as (select p_partkey, p_size % 10 x0, p_partkey % 7 y0, p_size % 10 + 8 x1, p_partkey % 7 + 6 y1, p_partkey % 12 u0, 2 v0, p_partkey % 12 + 5 u1, 9 v1 from part),
i as (select p_partkey, greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0) i, (x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) s from b)
select p_partkey, round(i / (s - i)::double, 6) iou from i""",
    "chapter_parse": f"with {_CAT} select idx, first, last from ce",
    "chapter_first_wins": f"with {_ITEMS} select source, first, last, idx, alternates from it where first is not null",
    "sort_items": f"with {_ITEMS}{_SORT} select source, idx, pos from so",
    "select_ranges": f"with {_ITEMS} select source, idx from it where first is not null and ((first <= 3 and last >= 3) or (first <= 12 and last >= 10) or (first <= 45 and last >= 40))",
    "select_latest": f"with {_ITEMS}{_SORT} select source, idx from (select *, row_number() over (partition by source order by pos desc) n from so) where n <= 5",
    "latest_early_stop": f"""with {_ITEMS}, p as (select *, row_number() over (partition by source order by idx) p, case when first is not null and row_number() over (partition by source, first, last order by idx) = 1 then 1 else 0 end nw from us),
k as (select *, sum(nw) over (partition by source order by idx) k from p), z as (select *, least(coalesce(min(p) filter (k >= 10) over (partition by source) + 7, 5000), 5000) stop from k),
f as (select source, first, last, min(idx) idx from z where p <= stop and first is not null group by source, first, last)
select source, idx from (select *, row_number() over (partition by source order by first desc, last desc) n from f) where n <= 10""",
    "choose_format": """select l_orderkey id, l_quantity quality, l_extendedprice tbr from (select *, row_number() over (partition by l_orderkey order by case when l_quantity = 25 then 0 when l_quantity > 25 then 1 else 2 end,
  abs(l_quantity - 25), l_linestatus = 'O' desc, case l_returnflag when 'A' then 3 when 'N' then 2 else 1 end desc, l_extendedprice desc, l_partkey, l_suppkey, l_linenumber) n from lineitem) where n = 1""",
    "report_upsert": f"with {_REP} select label, status, pages from (select *, row_number() over (partition by label order by case when w = 0 then 1 when status = 'exists' then 0 else 2 end desc) n from o) where n = 1",
    "skip_existing": f"with {_REP} select label, pages from o where w = 1 and label not in (select label from o where w = 0 and status = 'done')",
    "url_canonical": "select page_id, regexp_replace(regexp_replace(split_part(trim(url), '?', 1), '/+$', ''), '/(videos|shorts|streams|featured|playlists|community|about|search)$', '') || '/videos' u from pages",
    "playlist_param": "select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') p from pages",
    "safe_filename": r"""select page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled') f from pages""",
    "parse_time": """select p_partkey, case p_partkey % 4 when 0 then p_size + 0.5::double when 1 then p_size * 60 + p_size + 0.25::double when 2 then (3600 + p_size * 60 + p_size)::double end as seconds from part""",
    "chapter_label": """with a as (select p_partkey, p_size * 25 + case when p_partkey % 3 = 0 then 0.5 else 0 end a, p_partkey % 2 d from part),
b as (select *, lpad(floor(a)::int::varchar, greatest(3, len(floor(a)::int::varchar))::int, '0') || case when a > floor(a) then '.5' else '' end l1,
  lpad((floor(a)::int + d)::varchar, greatest(3, len((floor(a)::int + d)::varchar))::int, '0') || case when a > floor(a) then '.5' else '' end l2 from a)
select p_partkey, case when d = 0 then l1 else l1 || '-' || l2 end as label from b""",
    "content_key": """select event_id, left(sha1('{"kind":"' || event_type || '","pts":' || event_id || '}'), 20) k from events""",
}
