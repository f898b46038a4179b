"""Importance resampling towards a target: hashed n-gram weights over word-id suffix arrays.

The texts of a part become one array of word ids. Its suffixes are sorted by their first words; the
words that neighbours in that order share (LCP) cut it into runs, one for each distinct n-gram of the
part. An n-gram is hashed once, in its run, and its bucket is scattered back to all its places.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, read_table, running_total
from .words import Part, Words, encode, words_of

BUCKETS, MOST_WORDS, LEAST_WORDS, PER_CENT, SEED = 10_000, 3, 20, 5, 42
#: A suffix array has so many suffixes at most; the words after them are looked at but begin none of them.
CHUNK = 1 << 18
#: Ranks are counted in ranges of about so many rows.
ROWS_PER_RANGE = 500_000
#: ASCII letters in lower case and digits; whatever else is ASCII separates words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)


def _after_zero(c: np.ndarray) -> np.ndarray:
    """CRC-32 states after a zero byte."""
    for _ in range(8):
        c = np.where(c & np.uint32(1), c >> np.uint32(1) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def _moved(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """States after the zero bytes that a table (4, 256) stands for: one entry for each byte of the state."""
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to 63 zero bytes, and for 64 times 1, 2, 4 and so on."""
    few = [(np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)]
    for _ in range(64):
        few.append(_after_zero(few[-1]))
    many = [few.pop()]
    for _ in range(24):
        many.append(_moved(many[-1], many[-1]))
    return np.stack(few), many


_FEW, _MANY = _tables()


def joined_crc(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other, from both checksums and the second's length."""
    n = length & 63
    out = _FEW[n, 0, a & 255] ^ _FEW[n, 1, a >> 8 & 255] ^ _FEW[n, 2, a >> 16 & 255] ^ _FEW[n, 3, a >> 24]
    rest, k = length >> 6, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _moved(out[odd], _MANY[k])
        rest, k = rest >> 1, k + 1
    return out ^ b


def features(part: Part, buckets: int = BUCKETS, most: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of 1 to ``most`` words of the texts of a part, in pieces."""
    w = words_of(Part(_PLAIN[part.data], part.offsets))
    if not len(w.starts):
        return
    _, first, ids = np.unique(w.hashes(), return_index=True, return_inverse=True)
    length = (w.ends - w.starts)[first]
    raw = w.data.tobytes()
    alone = np.array([zlib.crc32(raw[s : s + n]) for s, n in zip(w.starts[first].tolist(), length.tolist(), strict=True)], np.uint32)
    after_space = joined_crc(np.full(len(alone), zlib.crc32(b" "), np.uint32), alone, length)
    for lo in range(0, len(ids), CHUNK):
        yield from _runs(w, ids, lo, min(len(ids), lo + CHUNK), alone, after_space, length + 1, buckets, most)


def _runs(w: Words, ids: np.ndarray, lo: int, hi: int, alone: np.ndarray, after_space: np.ndarray, length: np.ndarray, buckets: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features that begin at words ``lo`` to ``hi``: a suffix array of those places, and its runs."""
    places = np.arange(lo, hi)
    doc = w.doc[lo:hi]
    # the ids of the words that follow, 0 beyond the end of the text
    ahead = np.zeros((most, hi - lo), np.int64)
    for j in range(most):
        at = places + j
        inside = at < len(ids)
        inside[inside] = w.doc[at[inside]] == doc[inside]
        ahead[j, inside] = ids[at[inside]] + 1
    base = len(alone) + 1
    if base**most < 1 << 63:
        key = ahead[0]
        for j in range(1, most):
            key = key * base + ahead[j]
        order = np.argsort(key)
    else:
        order = np.lexsort(ahead[::-1])
    ahead = ahead[:, order]
    # words that each suffix shares with the one before it
    shared = np.zeros(hi - lo, np.int64)
    same = np.ones(hi - lo - 1, bool)
    for j in range(most):
        same &= ahead[j, 1:] == ahead[j, :-1]
        shared[1:] += same
    crc = None
    for n in range(1, most + 1):
        long_enough = ahead[n - 1] > 0
        new = long_enough & (shared < n)
        new[0] = long_enough[0]
        heads = np.flatnonzero(new)
        last = ahead[n - 1, heads] - 1
        # the n-gram's checksum from that of its first n - 1 words, which their own run begins with
        mine = alone[last] if crc is None else joined_crc(crc[run[heads] - 1], after_space[last], length[last])  # noqa: F821
        run, crc = np.cumsum(new), mine
        bucket = (mine % np.uint32(buckets)).astype(np.int64)
        yield doc[order[long_enough]], bucket[run[long_enough] - 1]


def _counts(buckets: int, most: int):
    """(bucket, n): features of a whole task by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for part, _ in encode(b.column("text")):
                for _, bucket in features(part, buckets, most):
                    n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS) -> np.ndarray:
    """Features of all ``texts`` (text) in each bucket: one number a bucket comes to the driver."""
    by_task = texts.select("text").where("text is not null").mapInArrow(_counts(buckets, most), "bucket int, n long")
    n = np.zeros(buckets, np.int64)
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        n[r["bucket"]] = r["n"]
    return n


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: a thousand times the logarithm of its smoothed share in the target by that in the source."""
    k, every, aim = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (every + k) / ((s + 1) * (aim + k)))) for s, t in zip(map(float, source), map(float, target), strict=True)], np.int64)


def _weighed(gain: np.ndarray, most: int):
    """Rows with their numbers of words and features, weight and score in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, found, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for part, rows in encode(b.column("text")):
                size = rows.stop - rows.start
                for k, (doc, bucket) in enumerate(features(part, len(gain), most)):
                    n = np.bincount(doc, minlength=size)
                    found[rows] += n
                    if k % most == 0:
                        words[rows] += n
                    # sums of whole numbers, exact in doubles below 2^53
                    weight[rows] += np.bincount(doc, gain[bucket], minlength=size).astype(np.int64)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in b.column("_h").to_pylist()]
            cols = {"doc_id": b.column("doc_id"), "_row": b.column("_row"), "_h": b.column("_h"), "n_words": pa.array(words), "n_features": pa.array(found), "weight": pa.array(weight), "score": pa.array(weight + np.array(noise, np.int64))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def importance(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = MOST_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text) against ``target`` (text).

    Features are runs of 1 to ``most`` words (lower case, letters, digits and all that is not ASCII), hashed
    into ``buckets``. ``weight`` sums the gains of a text's features, ``score`` adds noise that the id decides, so that
    the highest scores are a draw without replacement by weight. Of the texts with ``least`` words,
    ``per_cent`` in 100 are drawn; ``rank`` is their place, null for others.

    Both passes read texts whole, and tables of one number a bucket are all that comes to the driver.
    Ranks are counted in ranges of scores: no row depends on a sort of all rows in one task.
    ``row`` is a struct of the columns ``keep``, carried along.

    Null texts have no words and weigh 0; null ids share one noise, and come last among equal scores; rows
    repeated under one id are documents each; without target texts all gains still count what is rare in ``docs``;
    an empty table gives an empty result. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("_"))
    rows = docs.select("doc_id", carried.alias("_row"), h.alias("_h"), "text")
    made = [T.StructField(c, T.LongType()) for c in ("_h", "n_words", "n_features", "weight", "score")]
    scored = rows.mapInArrow(_weighed(gain, most), T.StructType([rows.schema["doc_id"], rows.schema["_row"], *made]))
    scored = materialise(scored, "draw-scores")
    n = scored.where(F.col("n_words") >= least).count()
    drawn = n * per_cent // 100
    # equal rows are told apart by where they are read, which changes no value of the result
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "_h", "_tie"]
    able = scored.where(F.col("n_words") >= least).withColumn("_tie", F.monotonically_increasing_id())
    ranges = able.repartitionByRange(max(1, -(-n // ROWS_PER_RANGE)), *order).withColumn("_range", F.spark_partition_id()).withColumn("_one", F.lit(1))
    ranges = materialise(ranges, "draw-ranges")
    placed = running_total(ranges, [], "_range", order, "_one", "_before")
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1).cast("long")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    few = scored.where(F.col("n_words") < least)
    return placed.select(F.col("_row").alias("row"), *out, rank.alias("rank")).unionByName(few.select(F.col("_row").alias("row"), *out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, in their columns; see ``importance``."""
    return importance(docs, target, per_cent, seed=seed, keep=tuple(docs.columns)).where("rank is not null").select("row.*")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of all documents against the benchmark's texts, and the rank of those drawn."""
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return importance(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_resampling": op12_resampling}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _grams(w: str) -> str:
    return "list_concat(" + f"{w}, " + ", ".join(f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i : i + {n - 1}], ' '))" for n in (2, 3)) + ")"


#: CRC-32 by a table made from its polynomial; every distinct feature is hashed once.
ORACLE_SQL = {
    "op12_resampling": f"""
with b as (select range v from range(256)),
c8 as (select v, list_reduce(range(9), lambda a, k: case when k = 0 then a when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, v) c from b),
ct as materialized (select list(c order by v) t from c8),
d as materialized (select row_number() over () k, doc_id, {_WORDS} w from documents),
m as (select {_WORDS} w from benchmark),
dg as materialized (select k, unnest({_grams("w")}) g from d),
mg as materialized (select unnest({_grams("w")}) g from m),
u as (select g, hex(encode(g)) x from (select distinct g from dg union select distinct g from mg)),
hs as materialized (select g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[i * 2 + 1 : i * 2 + 2])::bigint)), lambda a, y: xor(a >> 8, t[xor(a & 255, y) + 1])), 4294967295) % 10000 bu from u, ct),
s as (select bu, count(*) s from dg join hs using (g) group by bu), t as (select bu, count(*) t from mg join hs using (g) group by bu),
z as (select coalesce(sum(s), 0)::double s_all from s), y as (select coalesce(sum(t), 0)::double t_all from t),
g as materialized (select bu, floor(1000 * ln((coalesce(t, 0)::double + 1) * (s_all + 10000) / ((s::double + 1) * (t_all + 10000))))::bigint gain from s left join t using (bu), z, y),
w as (select k, count(*) n, sum(gain)::bigint weight from dg join hs using (g) join g using (bu) group by k),
e as (select d.k, doc_id, len(d.w) n_words, coalesce(n, 0)::bigint n_features, coalesce(weight, 0)::bigint weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h from d left join w using (k)),
f as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint score from e),
r as (select k, row_number() over (order by score desc, doc_id) rank, count(*) over () n from f where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 5 * r.n // 100 then rank end::bigint rank from f left join r using (k)"""
}
