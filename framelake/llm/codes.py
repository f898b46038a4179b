"""Vector compression by product codes: Lloyd rounds that shuffle only what changed.

A row keeps the entry that each of its parts was assigned to, and a table keeps the running
integer sum and count of every entry. A round assigns all parts again, in place, and sends on
only contributions of parts that changed: plus to the new entry, minus to the old one, summed
inside each task before they are shuffled. Sums are whole numbers, so that neither the order nor
a task that runs twice changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are below this in size after scaling, so that all sums of squares are exact.
LIMIT = 1 << 26
#: Distances are worked out for so many rows at once.
BLOCK = 2048


def usable(v: Column) -> Column:
    """True for vectors that hold neither nulls nor non-finite components, and something at all."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have, the shorter of equals; 0 for none."""
    top = vectors.groupBy(F.size(column).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return top["n"] if top else 0


def _scaled(vectors: Column, scale: int) -> Column:
    whole = lambda x: F.floor(x.cast("double") * scale)
    checked = lambda q: F.when(F.abs(q) < LIMIT, q).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more")))
    return F.transform(vectors, lambda x: checked(whole(x)).cast("int"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _code(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower of equals, and its squared distance; all exact."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0), 1)
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    # products of doubles are exact while every sum stays below 2^53
    exact = 4 * int(most) ** 2 * x.shape[1] < 1 << 53
    y = book.astype(np.float64) if exact else book
    norms = (y * y).sum(1)
    for lo in range(0, len(x), BLOCK):
        some = x[lo : lo + BLOCK].astype(y.dtype)
        d = norms - 2 * (some @ y.T)
        best = d.argmin(1)
        at[lo : lo + BLOCK] = best
        far[lo : lo + BLOCK] = (d[np.arange(len(some)), best] + (some * some).sum(1)).astype(np.int64)
    return at, far


def _assign(books: np.ndarray, last: bool):
    """Rows with the entry of each part in ``code``, and the one before it in ``was``; the last time with their error and without components."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q")).reshape(b.num_rows, parts, -1)
            found = [nearest(q[:, p], books[p]) for p in range(parts)]
            code = pa.array([x.tobytes() for x in np.stack([f[0] for f in found], 1).astype(np.uint8)], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("q"), code, b.column("code")], names=["vec_id", "label", "q", "code", "was"])

    return run


def _changes(parts: int, entries: int):
    """(part, entry, n, s) of a whole task: what the parts that changed add to their new entries and take from their old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = s = None
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q")).reshape(b.num_rows, parts, -1)
            if s is None:
                n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, q.shape[2]), np.int64)
            now, first = _code(b.column("code"), parts), np.array(b.column("was").is_null())
            was = _code(b.column("was").fill_null(b"\0" * parts), parts)
            for p in range(parts):
                moved = first | (now[:, p] != was[:, p])
                left = moved & ~first
                for rows, entry, sign in ((moved, now, 1), (left, was, -1)):
                    np.add.at(n[p], entry[rows, p], sign)
                    np.add.at(s[p], entry[rows, p], sign * q[rows, p])
        if s is not None:
            part, entry = np.nonzero((n != 0) | (s != 0).any(2))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(s[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return run


def _summed(changes: DataFrame, width: int) -> DataFrame:
    sums = [F.sum(F.get("s", F.lit(i))).alias(f"_{i}") for i in range(width)]
    return changes.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).select("part", "entry", "n", F.array(*[f"_{i}" for i in range(width)]).alias("s"))


def lloyd_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the rows of ``vectors`` (vec_id, embedding, label), and the codebooks (part, entry, component).

    Components become floor(``scale`` * x). ``code`` has a byte for each part: the codebook's entry
    nearest to it, the lower of equals; ``error`` sums the squared distances. Codebooks begin as the
    parts of the ``entries`` smallest ids and are moved to floor(sum / count) in each of ``rounds``
    rounds; entries without parts stay. Codebooks, ``parts`` * ``entries`` rows of them, are all that comes to the driver.

    Null vectors, empty ones and those with null or non-finite components are left out, and so are
    vectors of another length than most; that length must be divided by ``parts`` (else ValueError).
    Rows with null ids are encoded but begin no codebook; repeated rows count each, equal
    ids go by their vectors; labels of any value, null too, are handed on. With fewer rows than ``entries``
    codebooks are shorter; an empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    length = usual_length(rows, "embedding")
    if length % parts or entries > 256:
        raise ValueError(f"vectors of {length} components are not cut into {parts} equal parts of at most 256 entries")
    q = rows.where(F.size("embedding") == length).select("vec_id", "label", _scaled(F.col("embedding"), scale).alias("q"), F.lit(None).cast("binary").alias("code"))
    state = materialise(q, "codes-rows")
    seeds = [r["q"] for r in state.where("vec_id is not null").orderBy("vec_id", "q").limit(entries).select("q").collect()]
    made = lambda **more: T.StructType([state.schema["vec_id"], state.schema["label"], *[T.StructField(c, t) for c, t in more.items()]])
    code, whole = T.BinaryType(), state.schema["q"].dataType
    if not seeds:
        none = state.select("vec_id", "label", F.col("code"), F.lit(0).cast("long").alias("error"))
        return none.where("false"), np.zeros((parts, 0, length // parts), np.int64)
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    width, sums = books.shape[2], None
    for _ in range(rounds):
        before, state = state, materialise(state.mapInArrow(_assign(books, False), made(q=whole, code=code, was=code)), "codes-rows")
        discard(before)
        moved = state.where("was is null or was <> code").select("q", "code", "was").mapInArrow(_changes(parts, books.shape[1]), "part int, entry int, n long, s array<bigint>")
        old, sums = sums, materialise(_summed(moved if sums is None else moved.unionByName(sums), width), "codes-sums")
        if old is not None:
            discard(old)
        for r in sums.where("n > 0").collect():
            books[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    if sums is not None:
        discard(sums)
    coded = materialise(state.mapInArrow(_assign(books, True), made(code=code, error=T.LongType())), "codes-final")
    discard(state)
    return coded, books


def decoded(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``embedding``: the vector that each code stands for, in the middle of its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _code(b.column("code"), len(books))
            v = np.concatenate([books[p][code[:, p]] for p in range(len(books))], 1) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list((v + 0.5) / scale), pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors and those of their labels, and a digest of the codebooks."""
    coded, books = lloyd_codes(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "codes-labels")
    x = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return x.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {"op13_codes": op13_codes}


def _round(k: int) -> str:
    """Assignment to codebook ``k`` and the codebook after it."""
    return f"""
a{k} as materialized (select r, p.p, arg_min(e, (nn - 2 * list_inner_product(v, w), e)) e from p join b{k} b on p.p = b.p group by r, p.p),
s{k} as (select a.p, e, i, floor(sum(v[i]) / count(*)) x from a{k} a join p on p.r = a.r and p.p = a.p, range(1, {{width}} + 1) z(i) group by a.p, e, i),
m{k} as (select p, e, list(x order by i) w from s{k} group by p, e),
b{k + 1} as materialized (select *, list_inner_product(w, w) nn from (select b.p, b.e, coalesce(m.w, b.w) w from b{k} b left join m{k} m on m.p = b.p and m.e = b.e))"""


#: Products and sums of whole numbers this small are exact in doubles.
ORACLE_SQL = {
    "op13_codes": f"""
with k as materialized (select row_number() over (order by vec_id, embedding) r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select r, i p, q[i * 16 + 1 : i * 16 + 16] v from k, range(4) z(i)),
b0 as materialized (select p, r - 1 e, v w, list_inner_product(v, v) nn from p where r <= 256),{",".join(_round(k) for k in range(ROUNDS))},
f as materialized (select r, p.p, min((nn - 2 * list_inner_product(v, w) + list_inner_product(v, v), e)) x from p join b{ROUNDS} b on p.p = b.p group by r, p.p),
c as (select r, string_agg(lpad(lower(to_hex(x[2]::bigint)), 2, '0'), '' order by p) code, sum(x[1])::bigint error from f group by r),
h as (select sha256(string_agg(array_to_string(list_transform(w, lambda x: x::bigint), ','), ',' order by p, e)) codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from k join c using (r), h""".replace("{width}", "16")
}
