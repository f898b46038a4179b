"""MinHash near-duplicates by a multi-index Hamming join.

A signature is ``SYMBOLS`` min-hashes of which the low ``BITS`` bits are kept. Its
distance to another is the number of symbols that differ. Two signatures within
``DISTANCE`` of each other, cut into ``DISTANCE // 2 + 1`` chunks, have a chunk in
which at most one symbol differs (pigeonhole). Each chunk is therefore indexed under
every way of leaving out one of its symbols; signatures within the distance always
share a key.

What is guaranteed and what is likely. All pairs within the signature distance share a key
and are met; a pair at the similarity threshold itself has a greater distance once in about
10,000 times (binomial), so the distance is no guarantee of the similarity. Pairs in buckets
that still hold several classes must also pass ``may_reach``, a second sketch of ``BINS``
bins that drops pairs whose estimate lies five deviations below the threshold; by the normal law one pair in
some millions at the threshold is lost there. Tests simulate both laws. Every link is confirmed
on full sets, so nothing is linked that should not be.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read_table
from .urls import possible
from .words import encode, mix64, words_of

SYMBOLS, BITS = 64, 16
#: For similarity 0.85 a symbol differs with probability 0.15: 9.6 of 64 on average, with deviation 2.9.
#: At 21, four deviations above, a pair at the threshold itself is missed once in 10,000 times, closer pairs hardly ever.
DISTANCE = 21
#: For similarity 0.8 (five-word shingles): 12.8 on average, deviation 3.2.
DISTANCE_80 = 26
#: Members of a bucket are compared in blocks of this many.
BLOCK = 256
#: Bins of the second sketch, which tells pairs near the threshold from those well below it before they are sent on.
BINS = 512
_SEEDS = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(part, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a part, sorted, and where each text's begin.

    A text of fewer than ``k`` words has its whole sequence as its one shingle.
    """
    w = words_of(part, lower=True, seed=seed)
    n = len(part.offsets) - 1
    grams, first = w.windows(k)
    doc = w.doc[first]
    counts = np.bincount(w.doc, minlength=n)
    short = (counts > 0) & (counts < k)
    if short.any():
        h, starts = w.hashes(), np.searchsorted(w.doc, np.flatnonzero(short))
        whole = []
        for at, size in zip(starts, counts[short], strict=True):
            x = np.full(1, 0x1234567 + size, np.uint64)
            for j in range(size):
                x = mix64(x * np.uint64(0xD6E8FEB86659FD93) + h[at + j : at + j + 1])
            whole.append(x[0])
        grams, doc = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([doc, np.flatnonzero(short)])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) of uint16; rows of empty sets are 0."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        starts = bounds[:-1][full]
        # a keyed multiplication and a fold per symbol; the minimum is taken of its upper half
        for s, seed in enumerate(_SEEDS):
            h = (grams ^ seed) * (seed | np.uint64(1))
            low = np.minimum.reduceat(h ^ (h >> np.uint64(29)), starts)
            out[full, s] = (mix64(low) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    return out


def bin_sketch(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BINS) of uint8: a byte of the least hash in each bin of a text's shingles, 0 where it has none."""
    out = np.zeros((len(bounds) - 1, BINS), np.uint8)
    h = mix64(grams ^ np.uint64(0x2545F4914F6CDD1D))
    at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out.ravel()[at[first]] = (h[first] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return out


def may_reach(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, per_cent: int) -> np.ndarray:
    """False for pairs of bin sketches whose estimated similarity is over five deviations below the threshold.

    ``sizes`` is the sum of both set sizes. Bins draw shingles without replacement: of
    a short text nearly all are seen, and the deviation shrinks accordingly.
    """
    used = np.maximum(((x | y) != 0).sum(-1), 1)
    same = ((x == y) & (x != 0)).sum(-1)
    j = per_cent / 100
    unseen = np.clip(1 - used * (1 + j) / np.maximum(sizes, 1), 0.1, 1)
    return same >= (j - 5 * np.sqrt(j * (1 - j) / used * unseen)) * used


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in encode(b.column("text")):
                grams, bounds = shingle_sets(part, k)
                sizes = np.diff(bounds)
                keys = np.zeros((2, len(sizes)), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    keys[0, full] = np.add.reduceat(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                    keys[1, full] = np.bitwise_xor.reduceat(mix64(grams + np.uint64(0x14057B7EF767814F)), bounds[:-1][full])
                sig = signatures(grams, bounds)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[rows.start : rows.stop], pa.array(sizes.astype(np.int64)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in bin_sketch(grams, bounds)], pa.binary())],
                    names=["doc_id", "n_shingles", "k0", "k1", "sig", "bins"],
                )

    return run


def _ways(distance: int) -> list[np.ndarray]:
    """Symbols kept under each key: chunks with every choice of allowed errors left out."""
    chunks = distance // 2 + 1
    errors = distance // chunks
    out = []
    for chunk in np.array_split(np.arange(SYMBOLS), chunks):
        out += [np.setdiff1d(chunk, gone) for gone in combinations(chunk, min(errors, len(chunk) - 1))]
    return out


def _index(ways: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                sig = np.array([np.frombuffer(x, np.uint16) for x in c.column("sig").to_pylist()], np.uint64).reshape(c.num_rows, SYMBOLS)
                keys = np.zeros((c.num_rows, len(ways)), np.uint64)
                for i, way in enumerate(ways):
                    h = np.full(c.num_rows, i + 1, np.uint64)
                    for s in way:
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, s])
                    keys[:, i] = h
                ids = np.repeat(c.column("rep").to_numpy(), len(ways))
                way = np.tile(np.arange(len(ways), dtype=np.int32), c.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(way)], names=["key", "rep", "way"])

    return run


def first_shared_way(equal: np.ndarray, distance: int) -> np.ndarray:
    """For pairs given as rows of equal symbols, the first key that both have: one per symbol left out, chunk by chunk."""
    out = np.full(len(equal), -1)
    for chunk in np.array_split(np.arange(SYMBOLS), distance // 2 + 1)[::-1]:
        differ = ~equal[:, chunk]
        n = differ.sum(1)
        out[n == 0] = chunk[0]
        out[n == 1] = chunk[differ[n == 1].argmax(1)]
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` from each node that has one.

    Large-star and small-star rounds: each halves the depth of the trees, and every
    round ends in a written table. No component is ever gathered in one place.
    """
    e = materialise(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "cc")
    last = None
    while True:
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(e.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        mid = materialise(large.where("lo < hi").distinct(), "cc")
        discard(e)
        down = mid.groupBy("hi").agg(F.min("lo").alias("m"))
        small = mid.join(down, "hi").select(F.col("m").alias("p"), F.col("lo"), "hi")
        links = small.select(F.col("p").alias("lo"), F.col("lo").alias("hi")).union(small.select(F.col("p").alias("lo"), "hi")).where("lo < hi")
        e = materialise(links.distinct(), "cc")
        discard(mid)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        last = state


def _confirm(k: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                # a centre's text stands in many rows one after the other
                sides = []
                for c in ("ta", "tb"):
                    d = b.column(c).dictionary_encode()
                    sets = []
                    for part, _ in encode(d.dictionary):
                        # not the hashes by which the pair was found
                        grams, bounds = shingle_sets(part, k, seed=1)
                        sets += [grams[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
                    sides.append((sets, d.indices.to_pylist()))
                good = []
                for i, j in zip(sides[0][1], sides[1][1], strict=True):
                    x, y = sides[0][0][i], sides[1][0][j]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    good.append(100 * both >= per_cent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], names=["a", "b"])

    return run


def _near(distance: int):
    """Pairs of a batch whose signatures are within the distance of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
            good = pa.array((x != y).sum(1) <= distance)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], names=["a", "b"])

    return run


def _blocks(distance: int, per_cent: int):
    """Pairs across two blocks of one bucket that different classes hold and whose signatures are near."""

    def run(rows: pa.Table) -> pa.Table:
        side = pc.equal(rows["side"], 1)
        left, right = rows.filter(side), rows.filter(pc.invert(side))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        get = lambda t: (np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS), t["rep"].to_numpy(), t["root"].to_numpy(), t["n"].to_numpy(), np.array(t["outside"].to_pylist(), bool), np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, BINS))
        (sl, il, rl, nl, _, bl), (sr, ir, rr, nr, out_r, br) = get(left), get(right)
        way = rows["way"][0].as_py()
        out_a, out_b = [], []
        for i in range(len(il)):
            # a pair of two outsiders meets in both orders; one is enough
            ok = (rr != rl[i]) & ~(out_r & (ir < il[i])) & (100 * np.minimum(nr, nl[i]) >= per_cent * np.maximum(nr, nl[i]))
            at = np.flatnonzero(ok)
            equal = sr[at] == sl[i]
            near = equal.sum(1) >= SYMBOLS - distance
            # a pair shares many buckets; it leaves the first of them only
            at = at[near][first_shared_way(equal[near], distance) == way]
            at = at[may_reach(br[at], bl[i], nr[at] + nl[i], per_cent)]
            out_a.append(np.minimum(ir[at], il[i]))
            out_b.append(np.maximum(ir[at], il[i]))
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, per_cent: int = 80, distance: int = DISTANCE_80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents with equal shingle sets become one representative by an aggregate, so a
    text that a third of the rows copy is one row from there on. Representatives are
    linked first to the one of each bucket that shares most in all; confirmed links make classes.
    In buckets that still hold several classes all members are then compared with
    those outside the largest class, block against block of ``BLOCK`` members, and
    only pairs of different classes within the signature distance leave a block. Every link is confirmed on the full sets.

    Null, empty and blank texts have no shingles, are linked with nothing and kept;
    rows repeated under one id are one document (ids of different texts too, of which any may
    stand for the id); rows with a null id are compared with none and kept; ids are whole numbers. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = docs.select("doc_id", "text").mapInArrow(_sketch(k), "doc_id long, n_shingles long, k0 long, k1 long, sig binary, bins binary")
    sketch = materialise(sketch, "nd-sketch")
    alike = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("k0", "k1", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = materialise(alike, "nd-reps")
    # most keys are in no bucket: working them out twice costs less than keeping them
    index = reps.select("rep", "sig").mapInArrow(_index(_ways(distance)), "key long, rep long, way int")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    index = materialise(index.join(shared, "key"), "nd-buckets")
    # the original of many copies shares most buckets with most of them: it becomes their centre
    weight = index.groupBy("rep").agg(F.sum("members").alias("w"))
    centres = index.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("centre"))
    sig = reps.select("rep", "sig", F.col("n_shingles").alias("n"))
    pairs = index.join(centres, "key").where("rep <> centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    x, y = sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb"))
    stars = sized.select("a", "b", "sa", "sb").mapInArrow(_near(distance), "a long, b long")
    edges = confirm(docs, materialise(stars, "nd-stars"), k, per_cent)
    classes = components(edges)
    root = F.coalesce("root", "rep").alias("root")
    labelled = materialise(reps.select("rep").join(classes, F.col("rep") == F.col("node"), "left").select("rep", root), "nd-labels")
    # the same keys again, now only buckets with several classes: all members against those outside the largest class
    roots = index.select("key", "rep", "way").join(labelled.select("rep", "root"), "rep")
    by_class = roots.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_class.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.sum("c").alias("size"), F.max("c").alias("most")).where("size > most")
    mixed = mixed.select("key", "largest", F.ceil(F.col("size") / BLOCK).cast("int").alias("_all"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("_few"))
    m = materialise(roots.join(mixed, "key").withColumn("outside", F.col("root") != F.col("largest")), "nd-mixed")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    few = m.where("outside").select("key", at("_few").alias("i"), spread("_all").alias("j"), F.lit(1).alias("side"), "rep", "outside", "way")
    everyone = m.select("key", spread("_few").alias("i"), at("_all").alias("j"), F.lit(0).alias("side"), "rep", "outside", "way")
    # signature and sketch of members of such buckets only
    members = materialise(m.select("rep").distinct(), "nd-members")
    own = ["rep", "k0", "k1", "n"]
    bins = narrowed(sketch.select(F.col("doc_id").alias("rep"), "k0", "k1", F.col("n_shingles").alias("n"), "bins"), members, "rep").dropDuplicates(own)
    known = narrowed(reps.select("rep", "k0", "k1", F.col("n_shingles").alias("n"), "sig"), members, "rep")
    evidence = materialise(known.join(bins, own).join(labelled, "rep").select("rep", "sig", "bins", "n", "root"), "nd-evidence")
    blocks = few.unionByName(everyone).join(evidence, "rep")
    rest = blocks.groupBy("key", "i", "j").applyInArrow(_blocks(distance, per_cent), "a long, b long")
    more = confirm(docs, materialise(rest, "nd-rest"), k, per_cent)
    classes = components(edges.unionByName(more))
    final = reps.select("rep").join(classes, F.col("rep") == F.col("node"), "left").select("rep", root)
    by_set = reps.select("k0", "k1", "n_shingles", "rep").join(final, "rep").drop("rep")
    out = sketch.drop("sig", "bins").join(by_set, ["k0", "k1", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def narrowed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (distinct, written).

    A Bloom filter of bounded size leaves rows out where they are read, so that few of
    them are shuffled for the exact join, which removes false hits.
    """
    return possible(rows, ids.select(F.col(key).alias("url")), key).where("possible").drop("possible").join(ids, key, "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nd-ids")
    needed = materialise(narrowed(texts, ids, "doc_id").dropDuplicates(["doc_id"]), "nd-texts")
    ta, tb = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    return materialise(both.mapInArrow(_confirm(k, per_cent), "a long, b long"), "nd-edges")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, per_cent=85, distance=DISTANCE)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its class (five words, 0.8); one row where rows repeat."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


QUERIES = {"op9_neardup": op9_neardup}
ORACLE_SQL = {
    "op9_neardup": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) end) s from d),
g as (select doc_id, len(s) n, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) i, any_value(a.n) na, any_value(b.n) nb from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p where 100 * i >= 85 * (na + nb - i)),
u as (select a x, b y from e union all select b, a from e),
r as (select doc_id x, doc_id root from d union select u.y, r.root from r join u on u.x = r.x),
m as (select x, min(root) root from r group by x)
select doc_id, len(s)::bigint n_shingles, root component_id, doc_id = root kept from s join m on m.x = s.doc_id""",
}
