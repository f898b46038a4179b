"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

Each inner node has a hyperplane across the line through two random points; each leaf a
place in the forest. A query goes down all trees at once: the queue holds nodes by the chance that a neighbour
at the query's usual distance lies there, which is the product of the normal law's shares on the
way down, so the best leaf of any tree comes first. It stops when a neighbour that is in none of the leaves
taken, in no tree, would be as rare as ``MISS``. All rows of those leaves, and no others, are then
compared exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codes import usable, usual_length
from .common import materialise, read_table

TREES, SEED, K = 4, 7, 10
#: The trees are fitted to this many vectors, but to no more than SAMPLE_NUMBERS numbers in all; every row is indexed.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: Leaves hold about this many rows, as far as the sample has LEAF_SAMPLE points for each.
LEAF_ROWS, LEAF_SAMPLE = 128, 24
#: So many vectors of the sample say how far from a query its answers lie at most.
REACH_SAMPLE = 2048
#: Of so many pairs of points the one is taken along which a node's points spread most.
TRIES = 8
#: A neighbour may be missed so often, by the law that orders the queue and as if trees were independent.
#: They are not, so this is set by recall measured against brute force: see the README.
MISS = 0.001
#: Rows of a leaf, and queries that look there, are compared in blocks of so many numbers.
BLOCK_NUMBERS = 1 << 20


class Forest:
    """Trees of one depth as arrays: node k has its children at 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.inner = trees, depth, (1 << depth) - 1
        self.normal, self.offset = np.zeros((trees, self.inner, sample.shape[1])), np.zeros((trees, self.inner))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                for k in range((1 << level) - 1, (2 << level) - 1):
                    self.normal[t, k], self.offset[t, k] = _plane(sample[node == k], rng)
                side = (sample * self.normal[t, node]).sum(1) >= self.offset[t, node]
                node = 2 * node + 1 + side

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Signed distance of each row from every node's plane: (tree, row, node)."""
        return np.einsum("tnd,rd->trn", self.normal, x, optimize=True) - self.offset[:, None]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in every tree: (row, tree)."""
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.normal[t, node]).sum(1) >= self.offset[t, node])
            out[:, t] = node - self.inner
        return out

    def probes(self, x: np.ndarray, reach: np.ndarray, rows: np.ndarray, least: int, miss: float = MISS) -> list[list[tuple[int, int, bool]]]:
        """The (tree, leaf, open) that each row looks at, best first, from one queue over all trees.

        ``rows`` has the number of rows in each tree's leaves. Leaves are ``open`` until those of one tree
        hold ``least`` rows: whatever they hold is a candidate.
        """
        spread = np.maximum(reach, 1e-12) / math.sqrt(max(1, x.shape[1]))
        z = np.clip(self.sides(x) / spread[None, :, None], -40, 40)
        # the normal law's share on the upper side of each plane
        up = 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))
        held = rows.tolist()
        return [self._search(up[:, r].tolist(), held, least, miss) for r in range(len(x))]

    def _search(self, up: list[list[float]], held: list[list[int]], least: int, miss: float) -> list[tuple[int, int, bool]]:
        queue = [(-1.0, t, 0) for t in range(self.trees)]
        taken, left, seen = [], [1.0] * self.trees, [0] * self.trees
        while queue:
            chance, t, node = heapq.heappop(queue)
            if node < self.inner:
                p = up[t][node]
                heapq.heappush(queue, (chance * p, t, 2 * node + 2))
                heapq.heappush(queue, (chance * (1 - p), t, 2 * node + 1))
                continue
            taken.append((t, node - self.inner, max(seen) < least))
            seen[t] += held[t][node - self.inner]
            left[t] = max(0.0, left[t] + chance)
            if math.prod(left) <= miss and max(seen) >= least:
                break
        return taken


def _plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    if len(points) < 2:
        return np.zeros(points.shape[1]), 0.0
    a, b = points[rng.integers(0, len(points), TRIES)], points[rng.integers(0, len(points), TRIES)]
    long = np.linalg.norm(a - b, axis=1)
    lines = (a - b)[long > 0] / long[long > 0, None]
    if not len(lines):
        return np.zeros(points.shape[1]), 0.0
    at = points @ lines.T
    best = at.std(0).argmax()
    return lines[best], float(np.median(at[:, best]))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances (query, row) in doubles, squares added in the order of the components."""
    out = np.zeros((len(q), len(x)))
    columns = np.ascontiguousarray(x.T)
    for j in range(q.shape[1]):
        step = columns[j][None] - q[:, j, None]
        step *= step
        out += step
    return np.sqrt(out)


def _best(q: np.ndarray, reach: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query the ``k`` nearest of the rows within its reach, each row under all its ids; ties to smaller ids."""
    step = max(1, BLOCK_NUMBERS // max(1, len(x)))
    for lo in range(0, len(q), step):
        d = distances(q[lo : lo + step], x)
        for i, row in enumerate(d):
            near = row <= reach[lo + i]
            if near.sum() > k:
                near = row <= np.partition(row, k - 1)[k - 1]
            found = sorted((float(row[j]), n) for j in np.flatnonzero(near) for n in ids[j])
            yield lo + i, found[:k]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _found(keys: pa.Array, rows: Iterator[tuple[int, list[tuple[float, int]]]]) -> pa.RecordBatch:
    at, score, ids = [], [], []
    for i, some in rows:
        at += [i] * len(some)
        score += [s for s, _ in some]
        ids += [n for _, n in some]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(score, pa.float64()), pa.array(ids, pa.int64())], names=["qid", "score", "vec_id"])


def _routed(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = forest.leaves(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(leaves), pa.list_(pa.int32()))], names=[*b.schema.names, "leaves"])

    return run


def _asked(forest: Forest, sample: np.ndarray, ids: list[list[int]], rows: np.ndarray, k: int, miss: float):
    """Queries with the leaves they look at, and how far from them an answer lies at most: no further than the ``k`` + 1 nearest of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tree", pa.int32()), ("leaf", pa.int32()), ("reach", pa.float64())]))
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                q = _matrix(b.column("v"))
                near = [[s for s, _ in some] for _, some in _best(q, np.full(len(q), np.inf), sample, ids, k + 1)]
                reach = [x[k] if len(x) > k else math.inf for x in near]
                usual = np.array([x[-1] if x else 1.0 for x in near])
                found = forest.probes(q, usual, rows, k + 1, miss)
                probes = [[{"tree": t, "leaf": leaf, "reach": math.inf if first else r} for t, leaf, first in some] for some, r in zip(found, reach, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("v"), pa.array(probes, kind)], names=["qid", "v", "probes"])

    return run


def _compared(k: int):
    """Queries of a leaf's block against rows of that block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        queries, rows = queries.combine_chunks(), rows.combine_chunks()
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "vec_id": pa.array([], pa.int64())})
        q, x = (_matrix(t.column("v").combine_chunks()) for t in (queries, rows))
        return pa.Table.from_batches([_found(queries.column("qid").combine_chunks(), _best(q, queries.column("reach").to_numpy(), x, rows.column("ids").to_pylist(), k + 1))])

    return run


def _vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v, k0, k1, asked): the vectors that take part, with two hashes that name equal ones, and their length."""
    v = F.col("embedding")
    some = F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "asked").where(F.col("vec_id").isNotNull() & usable(v) & F.coalesce(some, F.lit(False)))
    length = usual_length(good, "embedding")
    v = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    good = good.where(F.size("embedding") == length).select("vec_id", v.alias("v"), "asked")
    return good.select("*", F.xxhash64("v").alias("k0"), F.xxhash64("v", F.lit(1)).alias("k1")), length


def nearest_neighbours(vectors: DataFrame, asked: Column, k: int = K, trees: int = TREES, miss: float = MISS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``vectors`` (vec_id, embedding) for which ``asked`` holds.

    Candidates are all other rows; scores are Euclidean distances of the vectors as given, ties go to smaller ids.

    Equal vectors are one point with their ``k`` + 1 smallest ids, for no others can be in an answer, and
    queries with equal vectors are one query; so copies without number weigh no more than one row.
    Every point is routed to a leaf in each tree. A leaf's points and the queries that look there are cut into
    blocks, so that no leaf is in one task; tables of one number a leaf are broadcast, ``trees`` times 2^depth of them.
    ``REACH_SAMPLE`` vectors are compared with every query first: their nearest bound how far an answer can be,
    so that only rows nearer than that leave a block, but for the first leaves of a query, whose nearest rows all do.

    Null, empty and zero vectors, those with null or non-finite components, rows without an id and vectors
    of another length than most take no part. Rows repeated under one id are one row if their vectors are equal, else
    any of the vectors may give its place. With ``k`` candidates or fewer all are given; an
    empty table gives an empty result. Other columns are ignored.
    """
    every_row, length = _vectors(vectors.select("vec_id", "embedding", asked.alias("asked")))
    rows = every_row.drop("asked").dropDuplicates(["vec_id", "k0", "k1"])
    nth = F.row_number().over(Window.partitionBy("k0", "k1").orderBy("vec_id"))
    few = rows.withColumn("_n", nth).where(F.col("_n") <= k + 1)
    points = few.groupBy("k0", "k1").agg(F.min("vec_id").alias("pid"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    points = materialise(points, "forest-points")
    n = points.count()
    most = min(SAMPLE, max(64, SAMPLE_NUMBERS // max(1, length)))
    fitted = points.orderBy(F.xxhash64("pid", F.lit(SEED)), "pid").limit(most).select("ids", "v").collect()
    sample, ids = np.array([r["v"] for r in fitted], np.float64).reshape(len(fitted), length), [list(r["ids"]) for r in fitted]
    wanted = min(max(1.0, n / LEAF_ROWS), max(1.0, len(fitted) / LEAF_SAMPLE))
    forest = Forest(sample, trees, math.ceil(math.log2(wanted)))
    routed = materialise(points.select("pid", "ids", "v").mapInArrow(_routed(forest), "pid long, ids array<bigint>, v array<double>, leaves array<int>"), "forest-index")
    named = materialise(every_row.where("asked").drop("asked"), "forest-asked")
    queries = materialise(named.groupBy("k0", "k1").agg(F.min("vec_id").alias("qid"), F.first("v").alias("v")), "forest-queries")
    in_leaf = materialise(routed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), "forest-counts")
    held = np.zeros((trees, forest.inner + 1), np.int64)
    for r in in_leaf.collect():
        held[r["tree"], r["leaf"]] = r["n"]
    searched = queries.select("qid", "v").mapInArrow(_asked(forest, sample[:REACH_SAMPLE], ids[:REACH_SAMPLE], held, k, miss), "qid long, v array<double>, probes array<struct<tree:int,leaf:int,reach:double>>")
    searched = materialise(searched, "forest-probes")
    # a number of blocks for each leaf: of its rows, and of the queries that look there
    block = max(64, BLOCK_NUMBERS // max(1, length))
    looks = searched.select(F.inline("probes")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("m"))
    blocks = in_leaf.join(looks, ["tree", "leaf"]).select("tree", "leaf", F.ceil(F.col("n") / block).cast("int").alias("_rows"), F.ceil(F.col("m") / block).cast("int").alias("_queries"))
    blocks = F.broadcast(materialise(blocks, "forest-leaves"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    sides = ["tree", "leaf", "i", "j"]
    left = searched.select("qid", "v", F.inline("probes")).join(blocks, ["tree", "leaf"]).select("tree", "leaf", one("qid", "_queries").alias("i"), every("_rows").alias("j"), "qid", "v", "reach")
    right = routed.select("pid", "ids", "v", F.posexplode("leaves").alias("tree", "leaf")).join(blocks, ["tree", "leaf"]).select("tree", "leaf", every("_queries").alias("i"), one("pid", "_rows").alias("j"), "ids", "v")
    met = left.groupBy(*sides).cogroup(right.groupBy(*sides)).applyInArrow(_compared(k), "qid long, score double, vec_id long")
    found = met.groupBy("qid").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k + 1).alias("found"))
    found = materialise(queries.select("k0", "k1", "qid").join(found, "qid").select("k0", "k1", "found"), "forest-found")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = named.select(F.col("vec_id").alias("query_id"), "k0", "k1").distinct().join(found, ["k0", "k1"]).select("query_id", F.posexplode(own).alias("_n", "x"))
    return answers.select("query_id", (F.col("_n") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth embedding, among all others."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_neighbours": op11_neighbours}
ORACLE_SQL: dict[str, str] = {}
