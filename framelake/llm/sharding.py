"""K-d tree partitioning of a corpus into shards of near equal bytes (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, read_table, running_total

BINS = 4096
ROWS_PER_BUCKET = 4000
DIMENSIONS = ("_d0", "_d1", "_d2", "_d3")
#: Leaves of the pipeline's corpus hold about this many bytes of text.
SHARD_BYTES = 256 << 20
#: Copies of one text stay together while they weigh at most this share of a shard.
WHOLE = 0.1
#: Cuts of more nodes than this, and more large groups of copies, are joined by a shuffle, fewer are broadcast.
BROADCAST_NODES = 1 << 16
#: So many copies of a large group's row meet its rows where they are joined by a shuffle.
SALT = 64
GROUP = ["_t", "size", "text_crc32"]


def _unit(*c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*c), 11) / F.lit(float(1 << 53))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_t"),
        _unit(F.coalesce(F.col("source"), F.lit(""))).alias("_s"),
        _unit(F.coalesce(F.col("lang"), F.lit(""))).alias("_l"),
        F.col("doc_id").cast("double").alias("_age"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _points(rows: DataFrame, n: int, total: int, shards: int) -> DataFrame:
    """``rows`` with the metadata that places them, ``_tie`` last: that of the first row for copies that stay together.

    Copies that make up much of a shard, by bytes or rows, are at most 20 groups for each
    shard: up to ``BROADCAST_NODES`` groups are broadcast, and more meet their rows salted. Their rows that are
    repeated alike, under one id too, are numbered (``_copy``), so that such a group is divided like any other. Other
    copies meet their first row by a join on the text's hashes.
    """
    copies = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_fs"), F.min("_l").alias("_fl"), F.min("_age").alias("_fa")).where("_n > 1")
    copies = materialise(copies, "kd-copies")
    weight = F.col("_n") * F.col("size")
    many = (weight > WHOLE * total / shards) | (F.col("_n") > WHOLE * n / shards)
    large = materialise(copies.where(many).withColumn("_whole", weight <= WHOLE * total / shards), "kd-large")
    held = large.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    key = GROUP
    if held["groups"] <= BROADCAST_NODES:
        large = F.broadcast(large)
    else:
        key = [*GROUP, "_salt"]
        rows, large = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALT)).cast("int")), large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = _unit(F.struct("doc_id", "text_crc32", "size", "_copy"))
    shared = _unit(F.struct(*GROUP), F.lit(1))

    def placed(d: DataFrame, together: Column) -> DataFrame:
        pick = lambda first, mine: F.when(together, first).otherwise(mine)
        return d.select("doc_id", "size", "text_crc32", "_copy", pick(F.col("_fs"), F.col("_s")).alias("_s"), pick(F.col("_fl"), F.col("_l")).alias("_l"), pick(F.col("_fa"), F.col("_age")).alias("_age"), pick(shared, own).alias("_tie"))

    rest = rows.join(large.select(*key), key, "left_anti").join(copies.where(~many), GROUP, "left").withColumn("_copy", F.lit(0).cast("long"))
    rest = placed(rest, F.col("_n").isNotNull())
    if not held["groups"]:
        return rest
    buckets = max(1, -(-held["rows"] // ROWS_PER_BUCKET))
    hot = materialise(rows.join(large, key).withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets))).withColumn("_one", F.lit(1)), "kd-hot")
    hot = running_total(hot, ["doc_id", "text_crc32", "size"], "_bucket", ["_id"], "_one", "_copy").withColumn("_copy", F.col("_copy").cast("long"))
    return placed(hot, F.col("_whole")).unionByName(rest)


def kd_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, copy, shard) for every row; ``copy`` numbers rows repeated alike that fill much of a shard.

    With ``target_bytes`` the number of shards is the power of two that brings leaves
    to that size. Source and language are placed by hash, length by its logarithm, age by
    the id; a few bits of a hash of the row are added below each value, so that rows
    with equal metadata (one source may hold a third of all rows) can be divided.

    Every level divides all nodes at once: one aggregate finds each node's widest dimension,
    one histogram of bytes per node along it finds the bin that holds the weighted median, and a
    second histogram of that bin alone finds the cut. Cuts stay tables of a row per node; documents
    are not shuffled, and nothing of either comes to the driver.

    Copies of one text are in one shard if together they weigh at most ``WHOLE`` of
    one, which bounds what they add to a shard; larger groups are divided, by the row's number where ids repeat too. Null text
    weighs 1 byte; null source, language or id are values like others; rows repeated
    alike go the way of copies; an empty table gives an empty result. Other columns are ignored.
    """
    rows = materialise(_rows(docs), "kd-rows")
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"), F.min("_age").alias("lo"), F.max("_age").alias("hi"), F.max("size").alias("most")).first()
    total = top["all"] or 0
    if target_bytes is not None:
        shards = 1 << max(0, math.ceil(math.log2(max(1.0, total / target_bytes))))
    levels = max(0, int(math.log2(shards)))
    if 1 << levels != shards:
        raise ValueError("the number of shards is a power of two")
    lo, span = float(top["lo"] or 0), max(1.0, float((top["hi"] or 0) - (top["lo"] or 0)))
    fine = F.col("_tie") / 4096
    d = _points(rows, top["n"], total, shards).select(
        "doc_id", "size", "text_crc32", "_copy",
        (F.col("_s") + fine).alias("_d0"),
        (F.col("_l") + fine).alias("_d1"),
        (F.log(F.col("size")) / math.log(max(2, top["most"] or 2)) + fine).alias("_d2"),
        ((F.coalesce("_age", F.lit(lo)) - lo) / span + fine).alias("_d3"),
        F.lit(0).alias("_node"),
    )
    d = materialise(d, "kd-level")
    for level in range(levels):
        cuts = _cuts(d, 1 << level)
        at = _along(d, cuts, 1 << level)
        halves = at.withColumn("_node", F.col("_node") * 2 + F.when(F.col("_v") >= F.col("_cut"), 1).otherwise(0))
        before, d = d, materialise(halves.select(*d.columns), "kd-level")
        discard(before)
    return d.select("doc_id", "size", "text_crc32", F.col("_copy").alias("copy"), F.col("_node").cast("int").alias("shard"))


def _along(d: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``d`` with its node's row of ``nodes`` and ``_v``, the value along that node's dimension."""
    nodes = F.broadcast(nodes) if n <= BROADCAST_NODES else nodes
    return d.join(nodes, "_node").withColumn("_v", F.get(F.array(*DIMENSIONS), F.col("_dim")))


def _cuts(d: DataFrame, n: int) -> DataFrame:
    """(_node, _dim, _cut): the value along each node's widest dimension nearest to which half its bytes lie below."""
    extent = d.groupBy("_node").agg(F.sum("size").alias("_all"), *[f(x).alias(f"_{name}{x}") for x in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max))])
    sides = F.array(*[F.col(f"_hi{x}") - F.col(f"_lo{x}") for x in DIMENSIONS])
    extent = extent.withColumn("_dim", (F.array_position(sides, F.array_max(sides)) - 1).cast("int"))
    extent = extent.select("_node", "_all", "_dim", F.get(F.array(*[F.col(f"_lo{x}") for x in DIMENSIONS]), F.col("_dim")).alias("_lo"), F.greatest(F.array_max(sides), F.lit(1e-12)).alias("_wide"))
    extent = materialise(extent, "kd-extent")
    bin_ = lambda lo, wide: F.least(F.greatest(F.floor((F.col("_v") - lo) / wide * BINS), F.lit(0)), F.lit(BINS - 1))
    below = Window.partitionBy("_node").orderBy("_bin")

    def middle(hist: DataFrame) -> DataFrame:
        """The first bin by which half of the bytes lie below."""
        h = hist.withColumn("_to", F.col("_before") + F.sum("_w").over(below))
        return h.where((2 * F.col("_to") >= F.col("_all")) & (2 * (F.col("_to") - F.col("_w")) < F.col("_all")))

    keep = ["_node", "_all", "_dim", "_lo", "_wide"]
    first = _along(d, extent, n).withColumn("_bin", bin_(F.col("_lo"), F.col("_wide"))).groupBy(*keep, "_bin").agg(F.sum("size").alias("_w")).withColumn("_before", F.lit(0))
    first = middle(first).select(*keep, F.col("_bin").alias("_in"), (F.col("_to") - F.col("_w")).alias("_before"))
    first = materialise(first, "kd-median")
    start, step = F.col("_lo") + F.col("_wide") / BINS * F.col("_in"), F.col("_wide") / BINS
    inner = _along(d, first, n).where(bin_(F.col("_lo"), F.col("_wide")) == F.col("_in")).withColumn("_bin", bin_(start, step))
    second = middle(inner.groupBy(*keep, "_in", "_before", "_bin").agg(F.sum("size").alias("_w")))
    half = F.col("_all") / 2
    up = F.when(half - (F.col("_to") - F.col("_w")) < F.col("_to") - half, 0).otherwise(1)
    return second.select("_node", "_dim", (start + step / BINS * (F.col("_bin") + up)).alias("_cut"))


def with_slots(d: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard, counted over hashed buckets of it."""
    buckets = max(1, -(-d.count() // ROWS_PER_BUCKET))
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(buckets))).withColumn("_one", F.lit(1))
    return running_total(d, ["shard"], "_bucket", ["doc_id", "text_crc32", "size", "copy"], "_one", "slot").withColumn("slot", F.col("slot").cast("long")).drop("_bucket", "_one")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return sharded(read_table(spark, sf_dir, "documents"))


def sharded(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """The shard and slot of every row; law ``bytes``. See ``kd_shards``."""
    d = with_slots(materialise(kd_shards(docs, shards, target_bytes), "kd-shards"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
