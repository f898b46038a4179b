"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, read_table, running_total, word_count

#: A level of the schedule has 2 ** BITS slots whatever the size of the input, or SLOTS_EACH for each source if that is more.
BITS, SLOTS_EACH = 17, 128
#: Sources that would win fewer slots of a level have theirs in the next one, which is theirs alone.
LEAST_SLOTS = 256
#: Buckets of a source's line; there are so many of them at most.
ROWS_PER_BUCKET, MAX_BUCKETS = 1000, 1 << 16
#: A bucket with this many times its rows holds ids that repeat, or none; these are dealt further.
OVERFULL = 4
#: A schedule of so many slots is broadcast; a longer one is joined by a shuffle.
BROADCAST_SLOTS = 1 << 20
MAX_EPOCHS = 3
SEED = 7


def van_der_corput(slot: Column, bits: int) -> Column:
    """Point ``slot`` of the base-2 sequence: its bits in reverse. The first 2^bits points are the multiples of 2^-bits."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("double") / (1 << bits)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: Column | None = None) -> DataFrame:
    """(source, sid, source_size, weight, target) from rows (source, size).

    Sources in code point order, null last, are numbered from 1 (``sid``) and weigh 1, 2,
    3, repeating. Targets share the sum of all sizes by weight but stop at ``max_epochs``
    times the source's size; the excess is shared again by weight. That is water-filling:
    with sources in order of cap/weight, those before the first one that stays below its
    cap are full. One row per source goes through the ordering windows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = by_source.withColumn("sid", nth).withColumn("weight", (weights if weights is not None else F.pmod(F.col("sid") - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "sid")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = lambda all_, part: F.sum(all_).over(whole) - F.coalesce(F.sum(part).over(earlier), F.lit(0.0))
    s = s.withColumn("_level", F.try_divide(rest("source_size", "_cap"), rest("weight", "weight")))
    below = F.col("_level") * F.col("weight") <= F.col("_cap")
    s = s.withColumn("_water", F.first(F.when(below, F.col("_level")), ignorenulls=True).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("weight"), F.col("_cap")))
    return s.select("source", "sid", "source_size", "weight", target.alias("target"))


def levelled(targets: DataFrame, bits: int) -> DataFrame:
    """``targets`` with ``level``, and ``level_words``: all words of that level.

    A source that would win fewer than ``LEAST_SLOTS`` slots of a level, or than an eighth of the level's mean,
    is left to the next level, where it is measured against sources as small. The largest source of a
    level always stays, so there are few levels: each is for sources some hundred times smaller.
    One pair of numbers a level comes to the driver.
    """
    bounds: list[float] = []
    while True:
        top = targets.where("target > 0" + (f" and target < {bounds[-1]!r}D" if bounds else "")).agg(F.sum("target").alias("all"), F.count(F.lit(1)).alias("n")).first()
        if not top["n"]:
            break
        bounds.append(min(LEAST_SLOTS, (1 << bits) // (8 * top["n"])) * top["all"] / (1 << bits))
    level = F.lit(0)
    for b in bounds:
        level = level + (F.col("target") < F.lit(b)).cast("int")
    t = targets.withColumn("level", level)
    return t.withColumn("level_words", F.floor(F.sum("target").over(Window.partitionBy("level")) + 0.5))


def schedule(spark: SparkSession, targets: DataFrame, bits: int = BITS, point=van_der_corput) -> DataFrame:
    """(slot, sid, rank): points of a low-discrepancy sequence through the cumulative targets of each level.

    A slot belongs to the source whose interval of the level's cumulative targets holds its
    point; ranks count a source's slots in schedule order, from 0. Intervals and points
    meet in an equi-join on cells of the unit line. The number of slots that a source
    wins is within one of its share of its level. Slots of all levels have one order: each level runs over the whole mix.
    """
    cells = 1024
    order = Window.partitionBy("level").orderBy("sid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = targets.where("target > 0").withColumn("_hi", F.sum("target").over(order) / F.sum("target").over(whole))
    t = t.withColumn("_lo", F.lag("_hi", 1, 0.0).over(order)).withColumn("_hi", F.when(F.col("sid") == F.max("sid").over(whole), 2.0).otherwise(F.col("_hi")))
    spans = t.select("sid", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))).alias("_cell"))
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), point(F.col("id"), bits).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells))
    hit = points.join(spans, "_cell").where("_u >= _lo and _u < _hi").select("slot", "sid")
    hit = hit.withColumn("_chunk", F.floor(F.col("slot") / 1024)).withColumn("_one", F.lit(1))
    return running_total(hit, ["sid"], "_chunk", ["slot"], "_one", "rank").select(F.col("slot").cast("int").alias("slot"), "sid", F.col("rank").cast("int").alias("rank"))


def _lines(d: DataFrame, buckets: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``d`` with ``_hot`` and ``_sub``, and the sums of (``_g``, source, ``_bucket``, ``_hot``, ``_sub``), the order of a source's line.

    Hashes fill buckets evenly unless ids repeat. Rows of a hash that alone exceeds a bucket come after the others of
    that bucket, dealt by a number of their own, so that no id is in one task.
    """
    key = ["_g", "source", "_bucket"]
    plain = d.withColumn("_hot", F.lit(-1).cast("long")).withColumn("_sub", F.lit(0).cast("long"))
    sums = materialise(plain.groupBy(*key, "_hot", "_sub").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_n")), "mix-sums")
    share = max(ROWS_PER_BUCKET, -(-rows // buckets))
    full = materialise(sums.where(F.col("_n") > OVERFULL * share).select("_g", "_bucket"), "mix-overfull")
    if full.isEmpty():
        return plain, sums
    # at most one in OVERFULL of the buckets, and as many hashes, are in these tables
    often = d.join(F.broadcast(full), ["_g", "_bucket"]).groupBy("_g", "_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    often = materialise(often.select("_g", "_h", F.ceil(F.col("_n") / share).alias("_subs")), "mix-often")
    x = d.join(F.broadcast(often), ["_g", "_h"], "left")
    dealt = x.withColumn("_hot", F.when(F.col("_subs").isNotNull(), F.col("_h")).otherwise(F.lit(-1))).withColumn("_sub", F.coalesce(F.pmod(F.xxhash64("size", "_row_number"), "_subs"), F.lit(0))).drop("_subs")
    return dealt, materialise(dealt.groupBy(*key, "_hot", "_sub").agg(F.sum("size").alias("size")), "mix-sums")


def mix(rows: DataFrame, seed: int = SEED, bits: int = BITS, max_epochs: int = MAX_EPOCHS, point=van_der_corput) -> DataFrame:
    """``rows`` (doc_id, source, size, ...), a written table, with source_size, target, ``taken`` and ``places``.

    Each source's documents lie on a line of words in an order shuffled by a hash of
    the id; the line repeats up to ``max_epochs`` times and is cut into blocks of equal
    numbers of words, the same for all sources of a level: its words over 2^bits. A source is given as many of
    its blocks, from the first on, as it wins slots of the ``schedule``; that, and not
    the target, decides the words ``taken`` of a document. A source wins ``LEAST_SLOTS`` slots at least (with hundreds of
    sources an eighth of their mean), see ``levelled``, and so meets its target to one block of so many, however small it is beside the others. ``places`` has for each epoch
    the words taken, the slot of the block in which they begin, and the number of blocks.

    Rows with null or repeated ids are documents of their own; null source is a source;
    documents without words are taken 0 times; identical rows share their order between them; an empty
    table gives an empty result. Other columns stay; results replace columns of their names.

    Rows are dealt by source and bucket of the hash, rows of ids that fill a bucket alone by a number of their own; only tables
    of one row per bucket, source or slot meet on the source alone. The schedule is broadcast up to ``BROADCAST_SLOTS`` rows.
    """
    spark = rows.sparkSession
    made = ["source_size", "target", "taken", "places"]
    keep = [c for c in rows.columns if c not in made]
    n = rows.count()
    buckets = min(MAX_BUCKETS, max(1, -(-n // ROWS_PER_BUCKET)))
    h = F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(15)), 16, 10).cast("long")
    d = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "source", F.col("size").cast("long").alias("size"), h.alias("_h"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_g"), F.monotonically_increasing_id().alias("_row_number"))
    d, sums = _lines(d.withColumn("_bucket", F.floor(F.col("_h") / F.lit(float(1 << 60)) * buckets)), buckets, n)
    targets = materialise(source_targets(sums, max_epochs), "mix-targets")
    top = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    if not top["all"]:
        none = F.array().cast("array<struct<epoch:int,words:bigint,slot:int,blocks:bigint>>")
        return rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), none.alias("places"))
    bits = max(bits, (SLOTS_EACH * top["n"] - 1).bit_length())
    targets = materialise(levelled(targets, bits), "mix-levels")
    plan = materialise(schedule(spark, targets, bits, point), "mix-schedule")
    won = plan.groupBy("sid").agg(F.count(F.lit(1)).alias("won"))
    per = targets.join(won, "sid", "left").select("sid", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_g"), "source_size", "target", "level_words", F.coalesce("won", F.lit(0)).alias("won"))
    line_key = ["_bucket", "_hot", "_sub"]
    before = Window.partitionBy("_g").orderBy(*line_key).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_g", *line_key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_start")).join(per, "_g")
    inside = Window.partitionBy("_g", *line_key).orderBy("_h", "_row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # block r covers the words from floor(r * level_words / 2^bits) on
    goal = F.least(F.expr(f"cast(won as decimal(20,0)) * level_words div {1 << bits}"), F.col("source_size") * max_epochs)
    line = d.join(starts, ["_g", *line_key]).withColumn("_at", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("_goal", goal)
    block = lambda at: f"cast(((cast({at} as decimal(20,0)) + 1) * {1 << bits} - 1) div level_words as int)"
    slots = plan.count()
    for e in range(max_epochs):
        line = line.withColumn(f"_from{e}", F.col("_at") + F.col("source_size") * e).withColumn(f"_to{e}", F.least(F.col(f"_from{e}") + F.col("size"), "_goal"))
        some = F.col(f"_to{e}") > F.col(f"_from{e}")
        line = line.withColumn(f"_r{e}", F.when(some, F.expr(block(f"_from{e}")))).withColumn(f"_n{e}", F.when(some, F.expr(block(f"_to{e} - 1"))) - F.col(f"_r{e}") + 1)
        at = plan.select("sid", F.col("rank").alias(f"_r{e}"), F.col("slot").alias(f"_slot{e}"))
        line = line.join(F.broadcast(at) if slots <= BROADCAST_SLOTS else at, ["sid", f"_r{e}"], "left")
    place = lambda e: F.struct(F.lit(e).alias("epoch"), (F.col(f"_to{e}") - F.col(f"_from{e}")).cast("long").alias("words"), F.col(f"_slot{e}").alias("slot"), F.col(f"_n{e}").cast("long").alias("blocks"))
    places = F.filter(F.array(*[place(e) for e in range(max_epochs)]), lambda p: p["words"] > 0)
    taken = F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return line.select("_row.*", "source_size", "target", taken.alias("taken"), places.alias("places"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document and its place in the schedule, beside its source's target."""
    docs = read_table(spark, sf_dir, "documents")
    m = mix(materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"))
    n_slots = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["blocks"])
    first = F.get("places", F.lit(0))["slot"].cast("long")
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", first.alias("first_slot"), n_slots.alias("n_slots"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix in the order of the schedule: a copy for every epoch of which at least half is taken.

    Columns of ``docs`` stay; a document of which less than half an epoch is taken is
    left out by the source's target, one of a source below its weight is repeated. Rows
    lie in the order of the slots in which their words begin, from the first partition to the last.
    Rows with null source or repeated or null ids, and empty tables: see ``mix``; documents without words
    count as one word.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", F.greatest(word_count(F.col("text")), F.lit(1)).alias("size"))
    copies = mix(rows, seed).select("row", "size", F.inline("places")).where("2 * words >= size")
    return copies.repartitionByRange("slot", "epoch").sortWithinPartitions("slot", "epoch", "row.doc_id").select("row.*")


QUERIES = {"op10_mixing": op10_mixing}


def _levels(n: int) -> str:
    """Bounds of ``n`` levels: sources below the bound of one are in the next."""
    rest = "".join(f", b{k} as (select least(256, 131072 // (8 * greatest(count(*), 1))) * sum(target) / 131072 b from t where target > 0{f' and target < (select b from b{k - 1})' if k else ''})" for k in range(n))
    return rest + ", v as (select t.*, " + " + ".join(f"(coalesce(target < (select b from b{k}), false))::int" for k in range(n)) + " lv from t)"


ORACLE_SQL = {
    "op10_mixing": r"""
with d as (select row_number() over () k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 15) h from documents),
b as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) sid from d group by source),
w as (select *, ((sid - 1) % 3 + 1)::double weight, 3.0::double * source_size as cap from b),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over q, 0)) / (sum(weight) over () - coalesce(sum(weight) over q, 0)) lvl from w
  window q as (order by cap / weight, sid rows between unbounded preceding and 1 preceding)),
f as (select arg_min(lvl, (cap / weight, sid)) water from l where lvl * weight <= cap),
t as (select sid, source, source_size, least(cap, coalesce(water * weight, cap))::double target from l, f)"""
    + _levels(4)
    + r""",
vw as (select *, floor(sum(target) over (partition by lv) + 0.5)::hugeint total from v),
c as (select *, sum(target) over (partition by lv order by sid) / sum(target) over (partition by lv) hi from vw where target > 0),
i as (select *, lag(hi, 1, 0) over (partition by lv order by sid) lo, case when sid = max(sid) over (partition by lv) then 2 else hi end up from c),
p as (select slot, list_sum(list_transform(range(17), lambda k: ((slot >> k) & 1) << (16 - k)))::double / 131072 u from range(131072) r(slot)),
s as (select p.slot, i.sid, row_number() over (partition by i.sid order by p.slot) - 1 rk from p join i on p.u >= i.lo and p.u < i.up),
n as (select sid, count(*) won from s group by sid),
g as (select vw.*, least(coalesce(won, 0)::hugeint * total // 131072, 3 * source_size)::bigint goal from vw left join n using (sid)),
x as (select d.*, g.sid, g.source_size, g.target, goal, total, coalesce(sum(size) over (partition by d.source order by h, doc_id, size, k rows between unbounded preceding and 1 preceding), 0)::bigint at_ from d join g on d.source is not distinct from g.source),
e as (select x.*, ep, at_ + ep * source_size fr, least(at_ + ep * source_size + size, goal) upto from x, range(3) z(ep)),
y as (select *, (((fr::hugeint + 1) * 131072 - 1) // total)::bigint r0, (((upto::hugeint) * 131072 - 1) // total)::bigint r1 from e where upto > fr),
o as (select k, sum(upto - fr)::bigint taken, arg_min(slot, ep)::bigint first_slot, sum(r1 - r0 + 1)::bigint n_slots from y join s on s.sid = y.sid and s.rk = y.r0 group by k)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, source, first_slot, coalesce(n_slots, 0)::bigint n_slots from x left join o using (k)""",
}
