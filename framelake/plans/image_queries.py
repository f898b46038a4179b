"""Queries on pictures made from ``embeddings``, with their DuckDB oracles.

A vector is a frame of 8 x 8 pixels, or the source of a page of ``SIDE`` x ``SIDE``. Pages of a label are shown in order of id;
some are shown again two places later, moved by a pixel and with noise, some of these with one spot changed, and
some again far later. The oracles work on tables of pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import grids as gr
from framelake.operators import dedup as dd
from framelake.operators import images as im
from framelake.operators import paper as pr
from framelake.sources import frames as fr
from framelake.tables import shared_path

SIDE = 24


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("g"), F.col("vec_id").alias("id"), n.alias("n"), F.col("embedding").cast("array<double>").alias("e"))


def _frames(spark, sf):
    """(g, i, id, v): frames of 8 x 8, grey levels around 128."""
    return _ordered(spark, sf).select("g", F.col("n").alias("i"), "id", F.transform("e", lambda x: x * 200 + 128).alias("v"))


def _page_sources(spark, sf):
    """(g, id, n, page): what each page is drawn from, its planted repeats among them."""
    w = Window.partitionBy("g").orderBy("n")
    o = _ordered(spark, sf)
    again, late = F.col("n") % 6 == 5, F.col("n") % 31 == 30
    source = F.when(late, F.lag("e", 28).over(w)).when(again, F.lag("e", 2).over(w)).otherwise(F.col("e"))
    page = F.struct("n", source.alias("e"), (again & ~late).cast("int").alias("again"), (again | late).cast("int").alias("noise"))
    return o.select("g", "id", "n", page.alias("page"))


def _drawn(page):
    """A page's pixels."""

    def pixel(k):
        y, x, again, n = gr._div(k, SIDE), k % SIDE, page["again"], page["n"]
        sy, sx = gr.repeated(y + again, SIDE), gr.repeated(x - again, SIDE)
        ink = F.get(page["e"], gr._div(sy, 4) * 6 + gr._div(sx, 4)) * 400 + 128
        spot = F.when((n % 12 == 11) & (gr._div(y, 2) == 6) & (gr._div(x, 2) == 6), 90.0).otherwise(0.0)
        return ink + page["noise"] * ((y * 5 + x * 3 + n) % 3 - 1) + spot

    return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly: a window leaves them in as many tasks as there are labels, and pictures cost far more than their bytes say."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def _pages(spark, sf):
    """(g, id, n, v): pages with planted repeats."""
    return _spread(_page_sources(spark, sf)).select("g", "id", "n", _drawn(F.col("page")).alias("v"))


def frame_detail(spark, sf):
    return im.frame_stats(_frames(spark, sf), 8, 8).select("g", "i", *[F.round(c, 5).alias(c) for c in ("brightness", "diff", "detail")])


def sharpest_frames(spark, sf):
    f = _frames(spark, sf).withColumn("g", F.col("g") * 10000 + F.floor(F.col("i") / 10))
    return im.sharpest(f, 8, 8).select("g", "i", F.round("sharpness", 4).alias("sharpness"))


def edge_sharpness(spark, sf):
    """Along the diagonal of each page, and round its second pixel, where nothing counts."""
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    line = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: point(k, k))
    corner = F.array(*[point(F.lit(x), F.lit(y)) for x, y in ((1, 1), (2, 1), (2, 2), (1, 2))])
    s = lambda outline: F.round(im.edge_sharpness(F.col("v"), SIDE, SIDE, outline), 4)
    return _pages(spark, sf).select("id", s(line).alias("line"), s(corner).alias("corner"))


def perceptual_hash(spark, sf):
    return _pages(spark, sf).select("id", im.perceptual_hash(F.col("v"), SIDE, SIDE).alias("hash"))


def quick_similarity(spark, sf):
    """Each frame against the one before it, as they are and half as different."""
    w = Window.partitionBy("g").orderBy("i")
    f = _frames(spark, sf).withColumn("b", F.lag("v").over(w)).where("b is not null")
    soft = F.zip_with("v", "b", lambda x, y: (x + y * 3) / 4)
    s = lambda v: F.round(im.quick_similarity(v, F.col("b"), 8, 8), 5)
    return f.select("g", "i", s(F.col("v")).alias("whole"), s(soft).alias("mixed"))


def compare_pages(spark, sf):
    """Each page against the one two places before it."""
    w = Window.partitionBy("g").orderBy("n")
    x = _spread(_page_sources(spark, sf).withColumn("before", F.lag("page", 2).over(w)).where("before is not null"))
    x = x.select("g", "n", im.compare(_drawn(F.col("before")), _drawn(F.col("page")), SIDE, SIDE).alias("m")).select("g", "n", "m.*")
    verdict = dd.classify(F.col("ssim"), F.col("local"), F.col("peak"), F.col("spread"))
    return x.select("g", "n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("ssim", "local", "peak", "spread")], "dx", "dy", verdict.alias("verdict"))


def page_repeats(spark, sf):
    d = dd.picture_descriptors(_pages(spark, sf).select("g", "id", F.col("n").alias("i"), "v"), SIDE, SIDE)
    return dd.resolve(dd.compared(d, SIDE, SIDE))


def _shots(spark, sf):
    """Frames of shots of 12: still ones (even) repeat the first frame with noise, but for a frame of its own; others move."""
    f = _frames(spark, sf).select((F.col("g") * 10000 + F.floor(F.col("i") / 12)).alias("g"), (F.col("i") % 12).alias("i"), "v")
    first = F.first("v").over(Window.partitionBy("g").orderBy("i"))
    noisy = F.transform("_first", lambda x, k: x + ((k * 7 + F.col("i") * 3) % 5 - 2) * 0.3)
    f = f.withColumn("_first", first)
    return f.select("g", "i", F.when((F.col("g") % 2 == 0) & (F.col("i") != 10), noisy).otherwise(F.col("v")).alias("v"))


def combined_pages(spark, sf):
    s = _shots(spark, sf)
    calm = s.groupBy("g").agg(F.max(F.when(F.col("i") <= 6, F.col("i"))).alias("calm"))
    c = im.combine(s, calm, 8, 8)
    return c.select("g", "moving", F.array_join("used", ",").alias("used"), F.round(gr.mean(F.col("v")), 5).alias("mean"), F.round(F.array_max("v"), 5).alias("most"))


def frame_files(spark, sf):
    """Frames written as raw files and every seventh read back: its number of pixels, its sum and its first and last pixel."""
    path = shared_path(spark, "frames")
    fr.write_frames(_frames(spark, sf).select("g", "i", fr.to_bytes(F.col("v")).alias("v")), path, 8, 8)
    back = fr.read_frames(spark, path, 8, 8, stride=7, frames_per_partition=50)
    pixel = lambda k: F.conv(F.substring(F.hex("v"), k * 2 + 1, 2), 16, 10).cast("int")
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.conv(F.substring(F.hex("v"), (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")), F.lit(0), lambda a, x: a + x)
    return back.select("g", F.col("i").cast("int").alias("i"), F.octet_length("v").alias("n"), total.alias("total"), pixel(0).alias("first"), pixel(63).alias("last"))


def _sheets(spark, sf):
    """A bright rectangle of ``SIDE`` x ``SIDE`` pictures, of which some fill all, some have a corner missing and some a spot beside it."""
    o = _spread(_ordered(spark, sf))

    def pixel(k):
        y, x, n = gr._div(k, SIDE), k % SIDE, F.col("n")
        inside = (x >= n % 4 + 3) & (x < n % 4 + 13 + n % 6) & (y >= n % 5 + 2) & (y < n % 5 + 14 + n % 4)
        missing = (n % 6 == 5) & (x - n % 4 + y - n % 5 < 14)
        spot = (n % 3 == 1) & (x >= SIDE - 3) & (y >= SIDE - 4)
        bright = (n % 11 == 10) | (inside & ~missing) | spot
        return F.when(bright, 190.0).otherwise(60.0) + F.get("e", (k % 64).cast("int")) * 60

    return o.select("g", "id", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel).alias("v"))


def find_paper(spark, sf):
    f = pr.find_paper(_sheets(spark, sf), SIDE, SIDE)
    return f.select("g", "id", *[F.col(c).cast("long").alias(c) for c in ("level", "area", "filled", "x0", "y0", "x1", "y1")], "paper")


QUERIES = {f.__name__: f for f in (find_paper, frame_files, frame_detail, sharpest_frames, edge_sharpness, perceptual_hash, quick_similarity, compare_pages, page_repeats, combined_pages)}


def _mirror(c: str, n: str) -> str:
    return f"({n} - 1 - abs({n} - 1 - abs({c})))"


_FRAME = """o as (select label g, vec_id id, (row_number() over (partition by label order by vec_id) - 1)::int n, embedding::double[] e from embeddings),
fr as (select g, n i, id, k // 8 y, k % 8 x, e[k + 1] * 200 + 128 v from o, range(64) r(k))"""
_PAGE = f"""o as (select label g, vec_id id, (row_number() over (partition by label order by vec_id) - 1)::int n, embedding::double[] e from embeddings),
s as (select g, id, n, n % 31 = 30 late, n % 6 = 5 again, case when n % 31 = 30 then lag(e, 28) over w when n % 6 = 5 then lag(e, 2) over w else e end e from o window w as (partition by g order by n)),
k as (select (r.k // {SIDE})::int y, (r.k % {SIDE})::int x from range({SIDE * SIDE}) r(k)),
m as (select g, id, n, late, again, e, y, x, case when again and not late then least(y + 1, {SIDE - 1}) else y end sy, case when again and not late then greatest(x - 1, 0) else x end sx from s, k),
pg as materialized (select g, id, n, y, x, e[(sy // 4) * 6 + sx // 4 + 1] * 400 + 128 + case when late or again then (y * 5 + x * 3 + n) % 3 - 1 else 0 end
  + case when n % 12 = 11 and y // 2 = 6 and x // 2 = 6 then 90.0 else 0.0 end::double v from m)"""


def _taps(name: str, rows: list[tuple[int, int, float]]) -> str:
    return f"{name} as (select * from (values {', '.join(f'({y}, {x}, {v}::double)' for y, x, v in rows)}) t(dy, dx, wt))"


def _gauss(name: str, size: int, sigma: float) -> str:
    """Two-dimensional window from its formula; ``name`` with x and y: the same along one axis."""
    by = size // 2
    line = lambda end, dy, dx: f"{name}{end} as (select {dy} dy, {dx} dx, exp(-(k * k) / {2 * sigma**2}::double) / sum(exp(-(k * k) / {2 * sigma**2}::double)) over () wt from range({-by}, {by + 1}) a(k))"
    return f"{line('x', 0, 'k')}, {line('y', 'k', 0)}, " + f"{name} as (select dy, dx, exp(-(dy * dy + dx * dx) / {2 * sigma**2}::double) / sum(exp(-(dy * dy + dx * dx) / {2 * sigma**2}::double)) over () wt from range({-by}, {by + 1}) a(dy), range({-by}, {by + 1}) b(dx))"


def _box(name: str, size: int) -> str:
    by = size // 2
    return f"{name} as (select dy, dx, 1 / {size * size}::double wt from range({-by}, {by + 1}) a(dy), range({-by}, {by + 1}) b(dx))"


def _around(src: str, key: str, taps: str, w: str, h: str, sums: dict[str, str]) -> str:
    """Sums over the neighbours of each pixel of ``src``, whose borders mirror."""
    keys = key.split(", ")
    on = " and ".join(f"q.{c} = p.{c}" for c in keys)
    made = ", ".join(f"sum(wt * {v}) {c}" for c, v in sums.items())
    return f"(select {', '.join('p.' + c for c in keys)}, p.y, p.x, {made} from {src} p, {taps} t, {src} q where {on} and q.y = {_mirror('p.y + dy', h)} and q.x = {_mirror('p.x + dx', w)} group by {', '.join('p.' + c for c in keys)}, p.y, p.x)"


def _ssim(name: str, src: str, key: str, w: str, h: str) -> str:
    """Similarity of (a, b) at each pixel of ``src``."""
    sums = {"ma": "q.a", "mb": "q.b", "aa": "q.a * q.a", "bb": "q.b * q.b", "ab": "q.a * q.b"}
    c1, c2 = f"{(0.01 * 255) ** 2}::double", f"{(0.03 * 255) ** 2}::double"
    return f"""{name} as (select {key}, y, x, ((2 * ma * mb + {c1}) * (2 * (ab - ma * mb) + {c2})) / ((ma * ma + mb * mb + {c1}) * (aa - ma * ma + bb - mb * mb + {c2})) v
  from {_around(src, key, 'g7', w, h, sums)})"""


_HASH = f"""c32 as (select k, j, sqrt(case when k = 0 then 1 else 2 end / 32.0::double) * cos(pi() * (2 * j + 1) * k / 64) v from range(8) a(k), range(32) b(j)),
ar as (select i, j, greatest(0, least((i + 1) * {SIDE} / 32.0::double, j + 1) - greatest(i * {SIDE} / 32.0::double, j)) / ({SIDE} / 32.0::double) v from range(32) a(i), range({SIDE}) b(j)),
tf as (select k, ar.j, sum(c32.v * ar.v) v from c32 join ar on ar.i = c32.j group by k, ar.j),
lo as (select id, a.k u, b.k v, round(sum(a.v * b.v * pg.v), 6) + 0.0 c from pg join tf a on a.j = pg.y join tf b on b.j = pg.x group by id, a.k, b.k),
ls as (select id, list(c order by u, v) c from lo group by id),
hs as materialized (select id, list_transform(c, lambda z: z > list_sort(c[2:])[32]) h from ls)"""
#: Pairs pp(p, y, x, a, b) laid on each other and measured.
_COMPARED = f"""
sh as (select p, dx, dy, round(coalesce(nullif(corr(a.a, b.b), 'nan'::double), 0), 9) c from (select p, y, x, a from pp where y between 2 and {SIDE - 3} and x between 2 and {SIDE - 3}) a, range(-1, 2) d(dx), range(-1, 2) f(dy), (select p bp, y by_, x bx, b from pp) b
  where bp = p and by_ = y + dy and bx = x + dx group by p, dx, dy),
sb as (select p, min((-c, abs(dx) + abs(dy), dx, dy)) s from sh group by p),
la as (select pp.p, pp.y, pp.x, pp.a, q.b from pp join sb using (p) join pp q on q.p = pp.p and q.y = greatest(0, least({SIDE - 1}, pp.y + s[4])) and q.x = greatest(0, least({SIDE - 1}, pp.x + s[3]))),
{_gauss('g9', 9, 1.0)}, {_gauss('g7', 7, 1.5)}, {_box('b5', 5)}, {_box('b3', 3)},
s1 as materialized {_around('la', 'p', 'g9x', str(SIDE), str(SIDE), {'a': 'q.a', 'b': 'q.b'})}, so as {_around('s1', 'p', 'g9y', str(SIDE), str(SIDE), {'a': 'q.a', 'b': 'q.b'})},
cr as materialized (select p, y - 4 y, x - 4 x, a, b, abs(a - b) d from so where y between 4 and {SIDE - 5} and x between 4 and {SIDE - 5}),
{_ssim('sm', 'cr', 'p', str(SIDE - 8), str(SIDE - 8))},
lc as (select p, min(l) as "local" from {_around('sm', 'p', 'b5', str(SIDE - 8), str(SIDE - 8), {'l': 'q.v'})} where y between 2 and {SIDE - 11} and x between 2 and {SIDE - 11} group by p),
df as (select p, max(d) peak, quantile_cont(d, 0.95) spread from {_around('cr', 'p', 'b3', str(SIDE - 8), str(SIDE - 8), {'d': 'q.d'})} where y between 2 and {SIDE - 11} and x between 2 and {SIDE - 11} group by p),
me as (select p, avg(v) ssim from sm group by p),
cm as materialized (select p, ssim, "local", peak, spread, s[3]::int dx, s[4]::int dy, case when ssim >= 0.88 then case when peak >= 6 and peak / greatest(spread, 1) >= 4 then 'possible' when "local" >= 0.5 then 'duplicate' else 'possible' end
  when ssim >= 0.8 and "local" >= 0.3 then 'possible' else 'unique' end verdict from me join lc using (p) join df using (p) join sb using (p))"""
_SOBEL_Y = [(x, y, v) for y, x, v in gr.SOBEL_X]

ORACLE_SQL = {
    "find_paper": f"""with recursive o as (select label g, vec_id id, (row_number() over (partition by label order by vec_id) - 1)::int n, embedding::double[] e from embeddings),
k as (select (r.k // {SIDE})::int y, (r.k % {SIDE})::int x from range({SIDE * SIDE}) r(k)),
sh as materialized (select g, id, y, x, case when n % 11 = 10 or (x >= n % 4 + 3 and x < n % 4 + 13 + n % 6 and y >= n % 5 + 2 and y < n % 5 + 14 + n % 4 and not (n % 6 = 5 and x - n % 4 + y - n % 5 < 14)) or (n % 3 = 1 and x >= {SIDE - 3} and y >= {SIDE - 4}) then 190.0 else 60.0 end::double
  + e[(y * {SIDE} + x) % 64 + 1] * 60 v from o, k),
{_taps('tx', [(0, k - 2, v) for k, v in enumerate([0.0625, 0.25, 0.375, 0.25, 0.0625])])}, {_taps('ty', [(k - 2, 0, v) for k, v in enumerate([0.0625, 0.25, 0.375, 0.25, 0.0625])])},
h1 as materialized {_around('sh', 'id', 'tx', str(SIDE), str(SIDE), {'v': 'q.v'})}, h2 as materialized (select id, y, x, round(v)::bigint v from {_around('h1', 'id', 'ty', str(SIDE), str(SIDE), {'v': 'q.v'})}),
hi as (select id, v, count(*) n from h2 group by id, v), cu as (select id, v, sum(n) over u n0, sum(n * v) over u s0, sum(n) over w n, sum(n * v) over w s from hi window u as (partition by id order by v), w as (partition by id)),
ot as (select id, arg_min(v, (-round(n0::double * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2), 6), v)) level from cu where n > n0 group by id),
mk as (select id, y, x, case when v > level then 1 else 0 end v from h2 join ot using (id)),
di as materialized (select p.id, p.y, p.x, max(q.v) v from mk p join mk q on q.id = p.id and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 group by p.id, p.y, p.x),
er as (select p.id, p.y, p.x, min(q.v) v from di p join di q on q.id = p.id and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 group by p.id, p.y, p.x),
ru as materialized (select id, y, min(x) x0, max(x) x1, y * 1000 + min(x) r from (select id, y, x, x - row_number() over (partition by id, y order by x) i from er where v = 1) group by id, y, i),
li as materialized (select a.id, a.r a, b.r b from ru a join ru b on a.id = b.id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and a.x1 >= b.x0 - 1),
cl as (select id, r a, r b from ru union select cl.id, cl.a, li.b from cl join li on li.id = cl.id and li.a = cl.b),
rg as (select id, a r, min(b) region from cl group by id, a),
ln as (select id, region, y, sum(x1 - x0 + 1) n, min(x0) x0, max(x1) x1 from ru join rg using (id, r) group by id, region, y),
bx as (select id, region, sum(n) area, sum(x1 - x0 + 1) filled, min(x0) x0, min(y) y0, max(x1) + 1 x1, max(y) + 1 y1 from ln group by id, region),
lg as (select * from (select *, row_number() over (partition by id order by area desc, region) k from bx) where k = 1)
select g, id, level::bigint level, area::bigint area, filled::bigint filled, x0::bigint x0, y0::bigint y0, x1::bigint x1, y1::bigint y1, area between {0.15 * SIDE * SIDE} and {0.97 * SIDE * SIDE}
  and (x0 <= 2)::int + (y0 <= 2)::int + (x1 >= {SIDE - 2})::int + (y1 >= {SIDE - 2})::int <= 2 and filled >= 0.85 * (x1 - x0) * (y1 - y0) paper from lg join ot using (id) join o using (id)""",
    "frame_files": f"""with {_FRAME}, b as (select g, i, y * 8 + x k, greatest(0, least(255, round_even(v, 0)))::int v from fr where i % 7 = 0)
select g::varchar g, i, count(*)::int n, sum(v)::int total, max(v) filter (k = 0) as first, max(v) filter (k = 63) as last from b group by g, i""",
    "frame_detail": f"""with {_FRAME}, {_taps('l8', gr.LAPLACE_8)},
st as (select fr.g, fr.i, avg(fr.v) brightness, coalesce(avg(abs(fr.v - b.v)), 0) diff from fr left join fr b on b.g = fr.g and b.i = fr.i - 1 and b.y = fr.y and b.x = fr.x group by fr.g, fr.i),
de as (select g, i, avg(abs(l)) detail from {_around('fr', 'g, i', 'l8', '8', '8', {'l': 'q.v'})} group by g, i)
select g, i::int i, round(brightness, 5) brightness, round(diff, 5) diff, round(detail, 5) detail from st join de using (g, i)""",
    "sharpest_frames": f"""with {_FRAME}, {_taps('l4', gr.LAPLACE_4)}, sc as (select g, i, var_pop(l) s from {_around('fr', 'g, i', 'l4', '8', '8', {'l': 'q.v'})} group by g, i)
select g, i, round(s, 4) sharpness from (select *, row_number() over (partition by g order by s desc, i) r from (select g * 10000 + i // 10 g, i, s from sc)) where r = 1""",
    "edge_sharpness": f"""with {_PAGE}, {_taps('sx', gr.SOBEL_X)}, {_taps('sy', _SOBEL_Y)},
gx as {_around('pg', 'id', 'sx', str(SIDE), str(SIDE), {'a': 'q.v'})}, gy as {_around('pg', 'id', 'sy', str(SIDE), str(SIDE), {'b': 'q.v'})},
ma as (select id, y, x, sqrt(a * a + b * b) m from gx join gy using (id, y, x)),
nr as (select p.id, p.y, max(q.m) m from ma p join ma q on q.id = p.id and abs(q.y - p.y) <= 1 and abs(q.x - p.x) <= 1 where p.x = p.y and p.x > 2 and p.x < {SIDE - 3} group by p.id, p.y)
select id, round(median(m) / 4, 4) line, 1e9::double corner from nr group by id""",
    "perceptual_hash": f"with {_PAGE}, {_HASH} select id, list_sum(list_transform(range(63), lambda b: case when h[b + 1] then 1::bigint << b else 0 end))::bigint + case when h[64] then -9223372036854775808 else 0 end hash from hs",
    "quick_similarity": f"""with {_FRAME}, {_gauss('g7', 7, 1.5)},
pw as (select fr.g, fr.i, fr.y, fr.x, fr.v a, b.v b from fr join fr b on b.g = fr.g and b.i = fr.i - 1 and b.y = fr.y and b.x = fr.x), pm as (select g, i, y, x, (a + b * 3) / 4 a, b from pw),
{_ssim('sw', 'pw', 'g, i', '8', '8')}, {_ssim('sm', 'pm', 'g, i', '8', '8')}
select g, i::int i, round(w, 5) whole, round(m, 5) mixed from (select g, i, avg(v) w from sw group by g, i) join (select g, i, avg(v) m from sm group by g, i) using (g, i)""",
    "compare_pages": f"""with {_PAGE}, pp as materialized (select b.id p, b.y, b.x, a.v a, b.v b from pg b join pg a on a.g = b.g and a.n = b.n - 2 and a.y = b.y and a.x = b.x), {_COMPARED}
select o.g, o.n, round(ssim, 4) + 0.0 ssim, round("local", 4) + 0.0 as "local", round(peak, 4) peak, round(spread, 4) spread, dx, dy, verdict from cm join o on o.id = cm.p""",
    "page_repeats": f"""with recursive {_PAGE}, {_HASH},
hp as (select a.g, a.n i, b.n j, b.n - a.n > 20 far, a.id ia, b.id ib, len(list_filter(range(1, 65), lambda k: x.h[k] <> z.h[k])) dist from o a join o b on a.g = b.g and a.n < b.n join hs x on x.id = a.id join hs z on z.id = b.id),
cd as (select row_number() over () p, * from hp where (not far or dist <= 10) and dist <= 26),
pq as materialized (select p, a.y, a.x, a.v a, b.v b from cd join pg a on a.id = ia join pg b on b.id = ib and b.y = a.y and b.x = a.x),
pr as (select p, y // 3 y, x // 3 x, avg(a) a, avg(b) b from pq group by p, y // 3, x // 3),
{_gauss('g7q', 7, 1.5)}, {_ssim('sq', 'pr', 'p', '8', '8').replace(', g7 t,', ', g7q t,')},
ok as (select p from sq group by p having round(avg(v), 9) >= 0.65), pp as materialized (select * from pq where p in (select p from ok)), {_COMPARED},
rk as materialized (select g, i, j, far, round(ssim, 6) score, case verdict when 'duplicate' then 2 when 'possible' then 1 else 0 end rank from cm join cd using (p)), mj as (select g, max(j) m from rk where rank > 0 group by g),
st(g, j, dups, bi, br) as (select g, 0, []::int[], null::int, null::int from mj union all
  select st.g, st.j + 1, case when b.r.rank = 2 then list_append(st.dups, (st.j + 1)::int) else st.dups end, b.r.i, b.r.rank from st join mj using (g)
  left join lateral (select first({{'i': i, 'rank': rank}} order by rank desc, score desc, far desc, i) r from rk where rk.g = st.g and rk.j = st.j + 1 and rank > 0 and not list_contains(st.dups, rk.i)) b on true
  where st.j < mj.m)
select g, j, case br when 2 then 'duplicate' else 'possible' end status, bi i from st where bi is not null""",
    "combined_pages": f"""with {_FRAME}, f0 as (select g * 10000 + i // 12 g, i % 12 i, y * 8 + x k, v from fr), ff as (select g, k, v from f0 where i = 0),
sh as (select f0.g, f0.i, f0.k, case when f0.g % 2 = 0 and f0.i <> 10 then ff.v + ((f0.k * 7 + f0.i * 3) % 5 - 2) * 0.3::double else f0.v end v from f0 join ff using (g, k)),
ca as (select g, max(i) calm from sh where i <= 6 group by g),
dr as (select s.g, s.i, calm, avg(abs(s.v - c.v)) d from sh s join ca using (g) join sh c on c.g = s.g and c.i = calm and c.k = s.k group by s.g, s.i, calm),
no as (select g, coalesce(min(d) filter (i <> calm), 0) noise, count(*) n from dr group by g),
ok as (select dr.*, n, d <= greatest(1.6::double * noise, noise + 0.35::double, 0.5::double) still from dr join no using (g)),
mv as (select *, count(*) filter (still) over (partition by g) < 3 and n >= 3 moving, row_number() over (partition by g order by d, i) least_, row_number() over (partition by g order by still desc, abs(i - calm), i) near_ from ok),
{_taps('l4', gr.LAPLACE_4)}, s2 as (select g, i, k // 8 y, k % 8 x, v from sh),
sc as (select g, i, var_pop(l) s from {_around('s2', 'g, i', 'l4', '8', '8', {'l': 'q.v'})} group by g, i),
us as (select mv.*, row_number() over (partition by g order by round(s, 9) desc, least_) best from mv join sc using (g, i) where case when moving then least_ <= 3 else still and near_ <= 9 end),
u2 as (select * from us where not moving or best = 1),
md as (select g, k, list_sort(list(v))[(count(*) - 1) // 2 + 1] v from u2 join sh using (g, i) group by g, k)
select g, moving, used, mean, most from (select g, any_value(moving) moving, string_agg(i::varchar, ',' order by i) used from u2 group by g) join (select g, round(avg(v), 5) mean, round(max(v), 5) most from md group by g) using (g)""",
}
