"""Windowed near-duplicate resolution over ordered descriptors."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import grids
from framelake.functions import vectors as vs
from framelake.functions.grids import hash_bits
from framelake.operators import images
from framelake.tables import discard, materialise


@dataclass(frozen=True)
class DedupParams:
    """Thresholds for cosine scores of embeddings, which stand in for image similarity.

    Rows up to ``window`` back are always compared, others if their hashes differ by
    ``far_hash`` bits at most; none if they differ by more than ``max_hash``.
    """

    window: int = 20
    far_hash: int = 22
    max_hash: int = 40
    same: float = 0.30
    flag: float = 0.22


@dataclass(frozen=True)
class PictureParams:
    """Thresholds for pictures: as ``DedupParams``, and the least ``quick`` similarity of pairs that are compared in full.

    The quick check is of pictures at ``small`` times their size, of 8 pixels a side at least.

    Fixed values.
    """

    window: int = 20
    far_hash: int = 10
    max_hash: int = 26
    quick: float = 0.65
    max_shift: float = 0.06
    small: float = 0.25


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def descriptors(vectors: DataFrame) -> DataFrame:
    """(g, i, id, v, h): vectors of a group in order of id, numbered from 0."""
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return vectors.select(F.col("label").alias("g"), n.alias("i"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), hash_bits(F.col("embedding")).alias("h"))


def near_pairs(d: DataFrame, window: int) -> DataFrame:
    """(g, i, j) with 0 < j - i <= window: rows meet those of their own and the next block of ``window`` places."""
    block = F.floor(F.col("i") / window)
    a = d.select("g", "i", F.explode(F.array(block, block + 1)).alias("_b"))
    b = d.select("g", F.col("i").alias("j"), block.alias("_b"))
    return a.join(b, ["g", "_b"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= window)).select("g", "i", "j")


#: A radius is indexed if it meets less than this share of all pairs, else blocks of rows are compared.
INDEXED = 0.1
#: Groups that the index is cut for, keys of a row at most, and rows of a block.
USUAL_GROUP, MOST_KEYS, BLOCK = 2000, 1000, 2048


def hash_parts(distance: int) -> list[tuple[int, int]] | None:
    """(first bit, width) of the parts of 64 bits for an index of hashes ``distance`` apart; None if none is worth it.

    Of n parts one differs by at most ``distance // n`` bits (pigeonhole): a row has a key for every choice of them in
    every part, and meets rows by chance as often as keys of that width agree.
    """
    best = None
    for n in range(2, 17):
        cuts = [64 * k // n for k in range(n + 1)]
        parts = [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
        keys = [sum(math.comb(width, e) for e in range(distance // n + 1)) for _, width in parts]
        share = sum(k / 2**width for k, (_, width) in zip(keys, parts, strict=True))
        cost = sum(keys) + share * USUAL_GROUP / 2
        if share < INDEXED and sum(keys) <= MOST_KEYS and (best is None or cost < best[0]):
            best = cost, parts
    return best[1] if best else None


def far_pairs(d: DataFrame, window: int, distance: int, score: bool = False) -> DataFrame:
    """(g, i, j) with j - i > window and hashes at most ``distance`` bits apart; with ``score`` also ``dist`` and the score of their vectors.

    Multi-index join over ``hash_parts``: rows give each part with every choice of allowed bits changed, and
    meet rows that have one of these as their part. A radius too wide for that compares blocks of rows with each other:
    its pairs are a good share of all anyway. Vectors then go along with their blocks, a copy a block instead of one a pair.
    """
    parts = hash_parts(distance)
    near = (F.col("j") - F.col("i") > window) & (hamming(F.col("hi"), F.col("hj")) <= distance)
    if parts is None:
        block = F.floor(F.col("i") / BLOCK).cast("int")
        last = d.groupBy("g").agg(F.max(block).alias("_last"))
        blocks = d.join(last, "g").select("g", "i", "h", *(["v"] if score else []), block.alias("_b"), "_last")
        v = lambda of: [F.col("v").alias(of)] if score else []
        a = blocks.select("g", "i", F.col("h").alias("hi"), *v("vi"), F.col("_b").alias("_x"), F.explode(F.sequence("_b", "_last")).alias("_y"))
        b = blocks.select("g", F.col("i").alias("j"), F.col("h").alias("hj"), *v("vj"), F.explode(F.sequence(F.lit(0), "_b")).alias("_x"), F.col("_b").alias("_y"))
        met = a.join(b, ["g", "_x", "_y"]).where(near)
        return met.select("g", "i", "j", hamming(F.col("hi"), F.col("hj")).alias("dist"), _dot("vi", "vj").alias("score")) if score else met.select("g", "i", "j")
    if score:
        return _scores(_near_enough(far_pairs(d, window, distance), d, distance), d)
    errors = distance // len(parts)
    part = lambda h, lo, width: F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    flips = lambda width: [sum(1 << x for x in some) for n in range(errors + 1) for some in combinations(range(width), n)]
    key = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    exact = F.array(*[key(k, part(F.col("h"), lo, width)) for k, (lo, width) in enumerate(parts)])
    some = lambda k, lo, width: F.transform(F.array(*[F.lit(f).cast("long") for f in flips(width)]), lambda f: key(k, part(F.col("h"), lo, width).bitwiseXOR(f)))
    changed = F.flatten(F.array(*[some(k, lo, width) for k, (lo, width) in enumerate(parts)]))
    a = d.select("g", "i", F.col("h").alias("hi"), F.inline(exact))
    b = d.select("g", F.col("i").alias("j"), F.col("h").alias("hj"), F.inline(changed))
    met = a.join(b, ["g", "k", "v"]).where(near)
    # a pair meets once for every part that is near: the first of them counts
    apart = [F.when(F.bit_count(part(F.col("hi").bitwiseXOR(F.col("hj")), lo, width)) <= errors, k) for k, (lo, width) in enumerate(parts)]
    return met.where(F.col("k") == F.coalesce(*apart)).select("g", "i", "j")


def pairs(d: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """(g, i, j, dist, far): earlier references of each row, by window or by hash.

    Rows that are not ``active``, where ``d`` has that column, are neither candidates nor
    references. No join is on the group alone; vectors stay out of these joins and are
    fetched for the pairs that the hash lets through.
    """
    d = d.where("active") if "active" in d.columns else d
    found = near_pairs(d, p.window).withColumn("far", F.lit(False)).unionByName(far_pairs(d, p.window, p.far_hash).withColumn("far", F.lit(True)))
    return _near_enough(found, d, p.max_hash).select("g", "i", "j", "dist", "far")


def _near_enough(found: DataFrame, d: DataFrame, most: int) -> DataFrame:
    x = found.join(d.select("g", "i", F.col("h").alias("hi")), ["g", "i"]).join(d.select("g", F.col("i").alias("j"), F.col("h").alias("hj")), ["g", "j"])
    return x.withColumn("dist", hamming(F.col("hi"), F.col("hj"))).where(F.col("dist") <= most).drop("hi", "hj")


def _scores(found: DataFrame, d: DataFrame) -> DataFrame:
    return _with_vectors(found, d).select("g", "i", "j", "dist", _dot("vi", "vj").alias("score"))


def _dot(a: str, b: str) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, y: acc + y), 6)


def scored(d: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """Pairs with cosine ``score`` and ``rank``: 2 duplicate, 1 possible, 0 unique."""
    d = d.where("active") if "active" in d.columns else d
    near = _scores(_near_enough(near_pairs(d, p.window), d, p.max_hash), d).withColumn("far", F.lit(False))
    far = far_pairs(d, p.window, p.far_hash, score=True).where(F.col("dist") <= p.max_hash).withColumn("far", F.lit(True))
    x = near.unionByName(far).select("g", "i", "j", "dist", "far", "score")
    return x.withColumn("rank", F.when(F.col("score") >= p.same, 2).when(F.col("score") >= p.flag, 1).otherwise(0))


def _with_vectors(found: DataFrame, d: DataFrame) -> DataFrame:
    return found.join(d.select("g", "i", F.col("v").alias("vi")), ["g", "i"]).join(d.select("g", F.col("i").alias("j"), F.col("v").alias("vj")), ["g", "j"])


def picture_descriptors(pictures: DataFrame, w: int, h: int) -> DataFrame:
    """(g, i, id, v, h): pictures (g, id, v) of a group in order of id, numbered from 0 unless they have an ``i``, with their perceptual hashes."""
    v = F.col("v").cast("array<double>")
    hashed = pictures.select("g", "id", v.alias("v"), images.perceptual_hash(v, w, h).alias("h"), *[c for c in pictures.columns if c in ("active", "i")])
    return hashed if "i" in pictures.columns else hashed.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)


def _dealt(found: DataFrame) -> DataFrame:
    """Pairs dealt evenly: each costs far more to compare than its bytes say."""
    return found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i", "j")


def compared(d: DataFrame, w: int, h: int, p: PictureParams = PictureParams()) -> DataFrame:
    """Pairs of pictures with all measures of ``images.compare``, ``score`` (whole similarity) and ``rank``, as ``scored`` gives them.

    A cascade: hashes first, then the quick similarity of the pictures as they lie, and only pairs that pass both are
    laid on each other and compared. Each step is a written table, so that pairs left are dealt evenly to the next.
    """
    small = max(8, round(w * p.small)), max(8, round(h * p.small))
    d = materialise(d.withColumn("s", grids.resampled(F.col("v"), w, h, *small)), "pictures")
    near = materialise(pairs(d, p), "picture-pairs")
    quick = _dealt(_with_vectors(near, d.withColumn("v", F.col("s")))).withColumn("_q", images.quick_similarity(F.col("vi"), F.col("vj"), *small))
    alike = materialise(quick.where(F.round("_q", 9) >= p.quick).drop("vi", "vj", "_q"), "picture-alike")
    x = _dealt(_with_vectors(alike, d)).withColumn("m", images.compare(F.col("vi"), F.col("vj"), w, h, p.max_shift)).drop("vi", "vj")
    x = x.select("g", "i", "j", "dist", "far", "m.*")
    verdict = classify(F.col("ssim"), F.col("local"), F.col("peak"), F.col("spread"))
    return x.withColumn("score", F.round("ssim", 6)).withColumn("rank", F.when(verdict == "duplicate", 2).when(verdict == "possible", 1).otherwise(0))


def exact_repeats(rows: DataFrame, key: Column, id_: str) -> DataFrame:
    """(first, repeats): of the rows of one key the smallest id and how many more there are; null keys are one key."""
    return rows.groupBy(key.alias("_key")).agg(F.min(id_).alias("first"), (F.count(F.lit(1)) - 1).alias("repeats")).drop("_key")


def best_match(s: DataFrame) -> DataFrame:
    """The best reference of each row whatever became of it; far ones come first among equals."""
    w = Window.partitionBy("g", "j").orderBy(F.desc("rank"), F.desc("score"), F.desc("far"), "i")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1 and rank > 0").drop("_n")


#: Groups of so many candidates at most are settled in one pass over their rows, larger ones in rounds.
FOLD_ROWS = 20_000


def _settled(rows: pa.Table) -> pa.Table:
    """(g, j, status, i) of one group's candidates: rows in order, each with its best reference that is no duplicate."""
    by = rows.sort_by([("j", "ascending"), ("rank", "descending"), ("score", "descending"), ("far", "descending"), ("i", "ascending")])
    gone, at, duplicate, last = set(), [], [], None
    for k, (j, i, rank) in enumerate(zip(*(by.column(c).to_pylist() for c in ("j", "i", "rank")), strict=True)):
        if j == last or i in gone:
            continue
        last = j
        at.append(k)
        duplicate.append(rank == 2)
        if rank == 2:
            gone.add(j)
    kept = by.take(pa.array(at, pa.int64()))
    return pa.table({"g": kept.column("g"), "j": kept.column("j"), "status": pa.array(["duplicate" if d else "possible" for d in duplicate], pa.string()), "i": kept.column("i")})


def resolve(s: DataFrame) -> DataFrame:
    """(g, j, status, i): rows in order; only rows that are not duplicates themselves can be references.

    Candidates of a group, a few for each of its rows, are settled in one pass where there are ``FOLD_ROWS`` of
    them at most; larger groups go through ``resolved_in_rounds``.
    """
    live = materialise(s.where("rank > 0").select("g", "j", "i", "rank", "score", "far"), "dedup-live")
    large = materialise(live.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOLD_ROWS).select("g"), "dedup-large")
    out = T.StructType([live.schema["g"], live.schema["j"], T.StructField("status", T.StringType()), live.schema["i"]])
    if large.isEmpty():
        return live.groupBy("g").applyInArrow(_settled, out)
    small = live.join(large, "g", "left_anti").groupBy("g").applyInArrow(_settled, out)
    return small.unionByName(resolved_in_rounds(live.join(large, "g", "left_semi")))


def resolved_in_rounds(s: DataFrame) -> DataFrame:
    """As ``resolve``: a row is settled when its best reference that may still count is settled as
    kept, or when it has none left; references that turn out duplicates are dropped. Each
    round settles at least the first open row of every group, and mostly whole stretches, in
    joins on (group, row); no group is gathered in one place.
    """
    order = F.struct((-F.col("rank")).alias("r"), (-F.col("score")).alias("s"), (~F.col("far")).alias("n"), "i")
    live = materialise(s.where("rank > 0").select("g", "j", "i", "rank", order.alias("o")), "dedup-rounds")
    # only rows with a rank-2 candidate can become duplicates: others are kept as references at once
    open_ = materialise(live.where("rank = 2").select("g", "j").distinct(), "dedup-open")
    while True:
        waiting = live.join(open_.select("g", F.col("j").alias("i"), F.lit(True).alias("w")), ["g", "i"], "left")
        w = F.coalesce("w", F.lit(False))
        # a kept reference of rank 2 settles a row even while a better one is open
        best = waiting.groupBy("g", "j").agg(F.min(F.struct("o", "rank", w.alias("w"))).alias("b"), F.max((F.col("rank") == 2) & ~w).alias("sure"))
        state = open_.join(best, ["g", "j"], "left").select("g", "j", F.when(F.col("sure"), 2).otherwise(F.col("b.rank")).alias("rank"), F.coalesce(F.col("b.w") & ~F.col("sure"), F.lit(False)).alias("w"))
        state = materialise(state, "dedup-state")
        now = state.where("not w")
        if now.isEmpty():
            break
        gone = now.where("rank = 2").select("g", F.col("j").alias("i"))
        old = live, open_
        live, open_ = materialise(live.join(gone, ["g", "i"], "left_anti"), "dedup-live"), materialise(state.where("w").select("g", "j"), "dedup-open")
        for table in (*old, state):
            discard(table)
    best = live.groupBy("g", "j").agg(F.min(F.struct("o", "rank", "i")).alias("b"))
    return best.select("g", "j", F.when(F.col("b.rank") == 2, "duplicate").otherwise("possible").alias("status"), F.col("b.i").alias("i"))


#: Rows of a group that are settled in one pass, and that are compared with those in one task.
STRETCH = 8192


def resolved(d: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """(g, j, status, i): as ``resolve(scored(d, p))``, without making the pairs of rows that are duplicates.

    Only kept rows are references. The first ``STRETCH`` open rows of each group are settled among themselves, in one pass;
    then all rows after them, in blocks, are compared with those kept, and rows that repeat one of these are open no longer.
    So a row meets every kept row before it once, and a round settles a stretch of each group. Rows without a group or a vector are left out, as nothing equals them.
    """
    d = d.where("active") if "active" in d.columns else d
    limits = vs.Limits(p.window, p.far_hash, p.max_hash, p.same, p.flag)
    d = materialise(d.where("g is not null and h is not null").select("g", "i", "h", "v"), "dedup-rows")
    last = materialise(d.groupBy("g").agg(F.max("i").alias("_last")), "dedup-last")
    block = lambda i: F.floor(F.col(i) / STRETCH).cast("long")
    kept_type = T.StructType([*d.schema, T.StructField("_keep", T.BooleanType())])
    best_type = T.StructType([d.schema["g"], T.StructField("j", T.LongType()), T.StructField("i", T.LongType()), T.StructField("far", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def settled(rows: pa.Table) -> pa.Table:
        return rows.append_column("_keep", pa.array(vs.kept(rows, limits)))

    def matched(key: tuple[pa.Scalar, ...], refs: pa.Table, rows: pa.Table) -> pa.Table:
        out = vs.best(refs, rows, limits)
        return out.add_column(0, "g", pa.array([key[0].as_py()] * out.num_rows, rows.schema.field("g").type))

    open_, found = d, []
    while True:
        first = open_.withColumn("_n", F.row_number().over(Window.partitionBy("g").orderBy("i"))).where(F.col("_n") <= STRETCH).drop("_n")
        now = materialise(first.groupBy("g").applyInArrow(settled, kept_type), "dedup-settled")
        span = materialise(now.groupBy("g").agg(F.min("i").alias("_from"), F.max("i").alias("_to")), "dedup-span")
        refs = now.where("_keep").join(last, "g").select("g", "i", "h", "v", F.explode(F.sequence(block("i"), block("_last"))).alias("_b"))
        rows = d.join(span, "g").where("i > _from").select("g", "i", "h", "v", block("i").alias("_b"))
        best = refs.groupBy("g", "_b").cogroup(rows.groupBy("g", "_b")).applyInArrow(matched, best_type).withColumn("score", F.round("score", vs.PLACES))
        best = best.withColumn("rank", F.when(F.col("score") >= p.same, 2).when(F.col("score") >= p.flag, 1).otherwise(0)).where("rank > 0")
        found.append(materialise(best, "dedup-best"))
        gone = found[-1].where("rank = 2").select("g", F.col("j").alias("i")).distinct()
        rest = materialise(open_.join(span, "g").where("i > _to").select("g", "i", "h", "v").join(gone, ["g", "i"], "left_anti"), "dedup-open")
        for table in (now, span, *([] if open_ is d else [open_])):
            discard(table)
        open_ = rest
        if open_.isEmpty():
            break
    best = functools.reduce(DataFrame.unionByName, found).groupBy("g", "j").agg(F.max(F.struct("rank", "score", "far", (-F.col("i")).alias("i"))).alias("b"))
    place = d.schema["i"].dataType
    return best.select("g", F.col("j").cast(place).alias("j"), F.when(F.col("b.rank") == 2, "duplicate").otherwise("possible").alias("status"), (-F.col("b.i")).cast(place).alias("i"))


def classify(ssim: Column, local: Column, peak: Column, spread: Column) -> Column:
    """Verdict on an image match: whole similarity, weakest spot, and how far the largest difference stands out."""
    localized = (peak >= 6) & (peak / F.greatest(spread, F.lit(1.0)) >= 4)
    return F.when(ssim >= 0.88, F.when(localized, "possible").when(local >= 0.5, "duplicate").otherwise("possible")).when((ssim >= 0.8) & (local >= 0.3), "possible").otherwise("unique")
