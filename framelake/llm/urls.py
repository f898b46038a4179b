"""URL filters: domain rules, then a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

#: (host, path, verdict) of the fixed rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Parts of host names whose pages make up the list of the query.
LISTED_HOSTS = r"casino-win|free-bets|cheap-pills|ads-track|spam-farm|adult-x"
#: Query parameters that do not identify a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: A block is 512 bits (eight longs); the filter never takes more than this many blocks (16 MB).
MAX_BLOCKS = 1 << 18
BITS_PER_URL = 12
PROBES = 6


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a final slash, and the other query parameters in order."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.lit("?"), kept)


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule whose host or parent domain and path prefix fit, as a struct; null without one."""
    fit = F.lit(None)
    for host_, path_, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        here = ((h == host_) | h.endswith("." + host_)) & p.startswith(path_)
        fit = F.when(here, F.struct(F.lit(host_ + path_).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _probe(h: Column, blocks: int) -> tuple[Column, Column]:
    """Block number of a 64-bit hash, and the bit positions it sets in that block."""
    other = F.xxhash64(h, F.lit(1))
    bits = F.array(*[F.shiftrightunsigned(other, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)])
    return F.pmod(h, F.lit(blocks)), bits


def bloom(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of (url) rows: (block, w0..w7), at most ``MAX_BLOCKS`` rows.

    Beyond that bound it lets more false hits through; the join after it removes them.
    """
    blocks = min(MAX_BLOCKS, max(1, -(-count * BITS_PER_URL // 512)))
    block, bits = _probe(F.xxhash64("url"), blocks)
    e = listed.select(block.alias("block"), F.explode(bits).alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)"))), F.lit(0)).alias(f"w{w}") for w in range(8)]
    return e.groupBy("block").agg(*words), blocks


def possible(urls: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with a column ``possible``: false only where the URL is certainly not listed.

    The filter is broadcast: its size is bounded by ``MAX_BLOCKS`` whatever the list's.
    """
    blocks_df, blocks = bloom(listed, listed.count())
    block, bits = _probe(F.xxhash64(url), blocks)
    probed = urls.withColumn("_block", block).withColumn("_bits", bits)
    near = probed.join(F.broadcast(blocks_df.withColumnRenamed("block", "_block")), "_block", "left")
    word = F.array(*[F.col(f"w{w}") for w in range(8)])
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))
    hit = F.forall("_bits", lambda b: F.get(word, F.shiftright(b, 6)).bitwiseAND(one(b)) != 0)
    return near.select(*urls.columns, F.coalesce(hit, F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    A rule that fits decides; else a listed canonical URL is blocked and any other
    allowed. Only rows that no rule decides and that pass the filter are shuffled for
    the exact join, which removes the filter's false hits. A null or malformed URL has
    empty host and path, fits no rule and is allowed; rows with null or repeated ids
    are judged each on their own; an empty list or table is no special case.
    """
    p = pages.select("page_id", F.col("url").alias("_url"))
    p = p.select("page_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), canonical(F.col("_url")).alias("url"))
    p = p.withColumn("_rule", rule(F.col("host"), F.col("path")))
    listed = materialise(listed.select("url").where("url is not null").distinct(), "url-list")
    p = possible(p, listed)
    ask = F.col("possible") & F.col("_rule").isNull() & (F.col("host") != "")
    given = lambda listed_: F.coalesce(F.col("_rule.verdict"), F.when(listed_, "block"), F.lit("allow")).alias("verdict")
    out = ["page_id", "host", "path", F.col("_rule.rule").alias("rule")]
    exact = p.where(ask).join(listed.withColumn("_listed", F.lit(True)), "url", "left")
    return p.where(~ask).select(*out, given(F.lit(False))).unionByName(exact.select(*out, given(F.col("_listed"))))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; the list is the canonical URLs of pages on the listed hosts."""
    pages = read_table(spark, sf_dir, "pages")
    listed = pages.where(host(F.col("url")).rlike(LISTED_HOSTS)).select(canonical(F.col("url")).alias("url"))
    return judge(pages, listed)


QUERIES = {"op5_urls": op5_urls}
ORACLE_SQL = {
    "op5_urls": r"""
with p as (select page_id, url u,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
  regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1) q from pages),
c as (select *, case when u is null then null else regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || '?' ||
  coalesce(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), '') end k from p),
r as (select *, case
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from c),
l as (select distinct k from c where regexp_matches(host, 'casino-win|free-bets|cheap-pills|ads-track|spam-farm|adult-x'))
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when host <> '' and k in (select k from l) then 'block' else 'allow' end verdict from r""",
}
