"""Pages written to archives and books and read back, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import geometry as ge
from framelake.sources import archives as ar
from framelake.sources.frames import to_bytes
from framelake.tables import shared_path


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def page_archives(spark, sf):
    """Texts of each language as one archive."""
    pages = _t(spark, sf, "documents").select(F.col("lang").alias("g"), F.col("doc_id").alias("i"), F.col("text").alias("v"))
    path = shared_path(spark, "archives")
    ar.write_files(pages, path, ar.Zip("txt"))
    return ar.read_zips(spark, path).select("archive", "k", "name", "at", F.octet_length("v").cast("long").alias("n_bytes"), F.sha2("v", 256).alias("digest"))


def page_books(spark, sf):
    """Vectors of each label as a book of pictures of eight pixels a side."""
    pixels = to_bytes(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((x + 1) * 127.5)))
    pages = _t(spark, sf, "embeddings").select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("g"), F.col("vec_id").alias("i"), pixels.alias("v"))
    path = shared_path(spark, "books")
    ar.write_files(pages, path, ar.Book(8, 8))
    return ar.read_books(spark, path).select("book", "k", F.hex("v").alias("pixels"))


def page_layouts(spark, sf):
    """Pages of pictures of the parts: their size by mode, the picture padded to the page's shape, and what is left of it at 20 dpi."""
    p, k, z = _t(spark, sf, "part"), F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("uniform", "a4", "letter", "fit")]), k % 4 + 1)
    p = p.select("p_partkey", mode.alias("mode"), (z * 7).alias("w"), (k % 300 + 50).alias("h"), F.when(k % 3 != 0, z / (k % 40 + 10)).alias("aspect"))
    p = p.withColumn("page", ge.page_size(F.col("mode"), F.col("aspect")))
    p = p.withColumn("pad", F.when(F.col("page").isNotNull(), ge.padded(F.col("w"), F.col("h"), F.col("page.w") / F.col("page.h"))))
    p = p.withColumn("fit", ge.fitted(F.coalesce("pad.w", "w"), F.coalesce("pad.h", "h"), F.col("page"), 20.0))
    return p.select("p_partkey", "mode", F.round("page.w", 6).alias("page_w"), F.round("page.h", 6).alias("page_h"), F.col("pad.w").alias("pad_w"), F.col("pad.h").alias("pad_h"), F.col("pad.left").alias("pad_left"), F.col("pad.top").alias("pad_top"), F.col("fit.w").alias("fit_w"), F.col("fit.h").alias("fit_h"))


QUERIES = {f.__name__: f for f in (page_archives, page_books, page_layouts)}

ORACLE_SQL = {
    "page_archives": """with d as (select coalesce(nullif(lang, ''), 'untitled') g, encode(coalesce(text, '')) v, octet_length(encode(coalesce(text, '')))::bigint n, row_number() over (partition by coalesce(nullif(lang, ''), 'untitled') order by doc_id nulls first) - 1 k from documents),
e as (select *, 'page_' || lpad((k + 1)::varchar, greatest(4, length((k + 1)::varchar))::int, '0') || '.txt' name from d)
select g || '.zip' archive, k, name, coalesce(sum(30 + length(name) + n) over (partition by g order by k rows between unbounded preceding and 1 preceding), 0)::bigint "at", n n_bytes, sha256(v) digest from e""",
    "page_layouts": """with p as (select p_partkey, ['uniform', 'a4', 'letter', 'fit'][p_partkey % 4 + 1] as mode, p_size * 7 w, p_partkey % 300 + 50 h, coalesce(case when p_partkey % 3 <> 0 then nullif(p_size / (p_partkey % 40 + 10)::double, 0) end, 210 / 297.0::double) ar from part),
q as (select *, 297 / 25.4::double * 72 long from p),
s as (select *, case mode when 'uniform' then case when ar <= 1 then long * ar else long end when 'a4' then 210 / 25.4::double * 72 when 'letter' then 8.5::double * 72 end pw,
  case mode when 'uniform' then case when ar <= 1 then long else long / ar end when 'a4' then long when 'letter' then 11.0::double * 72 end ph from q),
d as (select *, case when w / h::double < pw / ph then round_even(h * (pw / ph), 0)::int when pw is not null then w end dw, case when w / h::double < pw / ph then h when pw is not null then round_even(w / (pw / ph), 0)::int end dh from s),
f as (select *, coalesce(dw, w) fw, coalesce(dh, h) fh, least(1.0::double, pw / 72 * 20.0::double / coalesce(dw, w), ph / 72 * 20.0::double / coalesce(dh, h)) sc from d)
select p_partkey, mode, round(pw, 6) page_w, round(ph, 6) page_h, dw::int pad_w, dh::int pad_h, ((dw - w) // 2)::int pad_left, ((dh - h) // 2)::int pad_top,
  case when pw is null or sc >= 1 then fw else greatest(1, floor(fw * sc)) end::int fit_w, case when pw is null or sc >= 1 then fh else greatest(1, floor(fh * sc)) end::int fit_h from f""",
    "page_books": """select 'label ' || label || '.pdf' book, row_number() over (partition by label order by vec_id) - 1 k,
  array_to_string(list_transform(embedding, lambda x: printf('%02X', greatest(least(floor((x::double + 1) * 127.5::double), 255), 0)::int)), '') pixels from embeddings""",
}
