"""Benchmark decontamination by latent semantic retrieval and sequence checks.

The latent space is the randomised SVD of the TF-IDF passages of the benchmark, with
document frequencies counted over the whole corpus. Windows of documents, as long as the
passage they are compared with, are folded into that space (terms outside the benchmark's
vocabulary have no coordinates there; case is folded); windows close to a passage by cosine go on
to a longest-common-subsequence check against the item, and paraphrases to a check of the
item's answer.

Places that cannot pass the sequence check are left out before they are folded in, by an exact
bound: of an item with n words of which m must be found, any place with a hit has at least t of
its n - m + t rarest words.

Document frequencies of all items' words come from one pass over the documents; one more
pass searches for ``BLOCKS_PER_PASS`` blocks of items, each with a latent space of its own.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read_table
from .words import encode, mix64, words_of

#: The benchmark is a stated set of queries; a block holds so many items or words, whichever is less, and a pass so many blocks.
ITEMS_PER_BLOCK, WORDS_PER_BLOCK, BLOCKS_PER_PASS = 250, 50_000, 16
#: Longer items are cut into passages of so many words, overlapping by half.
PASSAGE_WORDS = 48
RANK = 160
POWER_ITERATIONS = 1
MIN_COSINE = 0.45
#: Share of the item's words in order: alone, together with its answer, and of an item without one.
COPY, PARAPHRASE, NO_ANSWER = 0.8, 0.6, 0.7
#: The words in order stand within so many times the passage's length, and two words.
SPAN = 1.6
#: Where an item states its answer.
ANSWER = r"(?is)^.*\b(?:answer|réponse|antwort|respuesta)\s*[:=]\s*(.+)$"


def _cut(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out = []
    for part, _ in encode(pc.utf8_lower(pa.array(texts, pa.string()))):
        w = words_of(part)
        h, n = w.hashes(), len(part.offsets) - 1
        b = np.searchsorted(w.doc, np.arange(n + 1))
        out += [h[b[i] : b[i + 1]] for i in range(n)]
    return out


def _passages(words: np.ndarray) -> list[np.ndarray]:
    """An item as passages of at most ``PASSAGE_WORDS`` words, overlapping by half."""
    if len(words) <= PASSAGE_WORDS:
        return [words]
    half = PASSAGE_WORDS // 2
    return [words[i : i + PASSAGE_WORDS] for i in range(0, len(words) - half, half)]


class _Vocabulary:
    """Numbers of words by hash, looked up through a table over the hash's first bits."""

    def __init__(self, words: np.ndarray):
        self.words = words
        bits = min(20, max(8, int(len(words)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(words >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of words of the vocabulary, and their numbers."""
        out = np.full(len(h), -1, np.int64)
        cell = (h >> self.shift).astype(np.int64)
        place, stop = self.first[cell], self.first[cell + 1]
        left = np.flatnonzero(place < stop)
        while len(left):
            here = place[left]
            hit = self.words[here] == h[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] < stop[left]]
        at = np.flatnonzero(out >= 0)
        return at, out[at]


def _frequencies(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total, counts = _Vocabulary(words), 0, np.zeros(len(words), np.int64)
        for b in batches:
            for part, _ in encode(pc.utf8_lower(b.column("text"))):
                w = words_of(part)
                at, ids = vocabulary.find(w.hashes())
                pairs = np.unique(w.doc[at] * len(words) + ids)
                counts += np.bincount(pairs % len(words), minlength=len(words))
                total += len(part.offsets) - 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["term", "n"])

    return run


def _signs(terms: np.ndarray, k: int) -> np.ndarray:
    """Rows of the random test matrix, +-1, made from the term's number alone."""
    words = mix64(terms.astype(np.uint64)[:, None] * np.uint64(64) + np.arange(-(-k // 64), dtype=np.uint64)[None, :] + np.uint64(1))
    return (np.unpackbits(words.view(np.uint8), axis=1)[:, :k].astype(np.float64)) * 2 - 1


def _project(basis: np.ndarray | None, k: int, terms: int):
    """Partial sums of A'(A X), as (term, vector), for the rows of each task; X is the test matrix or ``basis``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for ids, values in zip(b.column("terms").to_pylist(), b.column("weights").to_pylist(), strict=True):
                ids, values = np.array(ids, np.int64), np.array(values)
                y = values @ (_signs(ids, k) if basis is None else basis[ids])
                for i, v in zip(ids.tolist(), values, strict=True):
                    out[i] = out[i] + v * y if i in out else v * y
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v.tolist() for v in out.values()], pa.list_(pa.float64()))], names=["term", "v"])

    return run


def latent_space(rows: DataFrame, terms: int, rank: int = RANK) -> np.ndarray:
    """(terms, rank) right singular vectors of the sparse rows (terms, weights).

    Randomised range finding with power iterations: each pass over the rows sums
    A'(A X) by term on the executors; only the (terms x rank) result, bounded by the
    block of items, is orthonormalised on the driver.
    """
    basis = None
    for _ in range(1 + POWER_ITERATIONS):
        sums = rows.mapInArrow(_project(basis, rank, terms), "term long, v array<double>").select("term", F.posexplode("v")).groupBy("term", "pos").agg(F.sum("col").alias("x")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
        z = np.zeros((terms, rank))
        for t, v in sums.select("term", "v.x").toLocalIterator():
            z[t] = v
        basis, r = np.linalg.qr(z)
        if basis.shape[1] < rank:
            rank = basis.shape[1]
    # directions without weight are noise
    weight = np.abs(np.diag(r))
    return basis[:, weight > 1e-9 * max(weight.max(initial=0), 1e-300)]


def _lcs(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence, a word of the other text at a time (bit-parallel)."""
    full = (1 << length) - 1
    s = full
    for x in other:
        u = s & masks.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


class _Block:
    """The latent space of a block of items and its passages there."""

    def __init__(self, local: np.ndarray, table: np.ndarray, passages: np.ndarray, at: int):
        #: Number in the block of each word of the pass; the last row of the table is that of words it does not have.
        self.local, self.at = np.where(local < 0, len(table), local), at
        self.table = np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)
        self.unit = (passages / np.maximum(np.linalg.norm(passages, axis=1), 1e-12)[:, None]).astype(np.float32)

    def closest(self, words: np.ndarray, places: np.ndarray, passage: int, size: int) -> tuple[float, int]:
        """Cosine and place of the window of ``size`` places that is closest to a passage."""
        sums = np.zeros((len(words) + 1, self.table.shape[1]), np.float32)
        np.cumsum(self.table[self.local[words]], axis=0, out=sums[1:])
        starts = np.arange(places[0], max(places[0], places[-1] + 1 - size) + 1, max(1, size // 4))
        windows = sums[np.searchsorted(places, starts + size)] - sums[np.searchsorted(places, starts)]
        cosine = (windows @ self.unit[passage - self.at]) / np.maximum(np.linalg.norm(windows, axis=1), 1e-12)
        best = int(cosine.argmax())
        return float(cosine[best]), int(starts[best])


class _Patterns:
    """Items, and the passages of long ones, as sets of rare words of which a place with a hit has enough."""

    def __init__(self, words: list[np.ndarray], least: np.ndarray, idf: np.ndarray):
        self.least = least
        sizes = np.array([len(w) for w in words])
        self.need = np.maximum(1, least // 3)
        # a hit lies within half a cell, so that one of two grids has it whole
        self.half = (SPAN * sizes).astype(np.int64) + 2
        rare = []
        for w, m, t in zip(words, least, self.need, strict=True):
            rare.append(np.unique(w[np.argsort(-idf[w], kind="stable")[: len(w) - m + t]]))
        pattern = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
        order = np.argsort(np.concatenate(rare), kind="stable")
        self.pattern = pattern[order]
        self.times = np.bincount(np.concatenate(rare), minlength=len(idf))
        self.first = np.cumsum(self.times) - self.times

    def places(self, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pattern, from, to): cells of words that have enough of a pattern's rare words."""
        times = self.times[ids]
        known = np.flatnonzero(times)
        times, first = times[known], self.first[ids[known]]
        pattern = self.pattern[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
        place = np.repeat(at[known], times)
        half = self.half[pattern]
        width = int(at[-1]) // (2 * int(self.half.min())) + 3 if len(at) else 0
        for shift in (0, 1):
            key = pattern * width + (place + shift * half) // (2 * half)
            if width * len(self.half) <= 1 << 22:
                n = np.bincount(key, minlength=width * len(self.half))
                cells = np.flatnonzero(n)
                n = n[cells]
            else:
                cells, n = np.unique(key, return_counts=True)
            which = cells // width
            enough = n >= self.need[which]
            for p, c in zip(which[enough].tolist(), (cells[enough] % width).tolist(), strict=True):
                h = int(self.half[p])
                yield p, (2 * c - shift) * h, (2 * c - shift + 2) * h


def _spanned(masks: dict[int, int], size: int, least: int, words: list[int], places: list[int]) -> float:
    """Largest share of the passage's words in order within a span that its length bounds."""
    whole, span = _lcs(masks, size, words), int(SPAN * size) + 2
    if whole < least or places[-1] - places[0] < span:
        return whole / size
    best, lo, hi = 0, 0, 0
    for start in range(places[0], places[-1] + 1, max(1, span // 8)):
        while places[lo] < start:
            lo += 1
        while hi < len(places) and places[hi] < start + span:
            hi += 1
        if hi - lo > best:
            best = max(best, _lcs(masks, size, words[lo:hi]))
        if hi == len(places):
            break
    return best / size


def _search(vocabulary: np.ndarray, idf: np.ndarray, blocks: list[_Block], items: list[np.ndarray], answers: list[np.ndarray], item_ids: list, item_of: np.ndarray, cuts: list[np.ndarray], without: bool):
    """Items, answers and passages are numbers of the words of the sorted ``vocabulary``; ``without`` gives the rows without hits in place of these."""
    long = [j for j, (i, p) in enumerate(zip(item_of, cuts, strict=True)) if len(p) < len(items[i])]
    words = [*items, *(cuts[j] for j in long)]
    floor = [*(PARAPHRASE if len(a) else NO_ANSWER for a in answers), *(COPY for _ in long)]
    least = np.array([math.ceil(f * len(w) - 1e-9) for f, w in zip(floor, words, strict=True)])
    first = np.searchsorted(item_of, np.arange(len(items) + 1))
    starts = [block.at for block in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, patterns = _Vocabulary(vocabulary), _Patterns(words, least, idf)
        masks, asked = [_masks(x.tolist()) for x in words], [_masks(a.tolist()) for a in answers]
        for b in batches:
            for part, rows in encode(pc.utf8_lower(b.column("text"))):
                w = words_of(part)
                if not len(w.starts):
                    if without:
                        yield b.slice(rows.start, rows.stop - rows.start)
                    continue
                at, ids = known.find(w.hashes())
                bounds = np.searchsorted(w.doc, np.arange(len(part.offsets)))
                hits: dict[tuple[int, int], tuple] = {}
                for p, lo, hi in patterns.places(at, ids):
                    item = p if p < len(items) else int(item_of[long[p - len(items)]])
                    passages = range(first[item], first[item + 1]) if p < len(items) else (long[p - len(items)],)
                    size, m = len(words[p]), int(least[p])
                    lo, hi = max(0, lo), min(hi, len(w.doc))
                    for doc in range(int(w.doc[lo]), int(w.doc[hi - 1]) + 1):
                        x, y = np.searchsorted(at, (max(lo, bounds[doc]), min(hi, bounds[doc + 1])))
                        if y - x < m:
                            continue
                        k = bisect.bisect_right(starts, passages[0]) - 1
                        cosine, start = max(blocks[k].closest(ids[x:y], at[x:y], j, len(cuts[j])) for j in passages)
                        if cosine < MIN_COSINE:
                            continue
                        held, places = ids[x:y].tolist(), at[x:y].tolist()
                        share = _spanned(masks[p], size, m, held, places)
                        if share * size < m - 1e-6:
                            continue
                        n_answer = len(answers[item])
                        answered = n_answer > 0 and _lcs(asked[item], n_answer, held) == n_answer
                        if (answered or share >= floor[p]) if p >= len(items) or not n_answer else (answered or share >= COPY):
                            old = hits.get((doc, item))
                            if old is None or share > old[1]:
                                hits[doc, item] = cosine, share, answered, start - int(bounds[doc])
                if without:
                    free = np.ones(rows.stop - rows.start, bool)
                    free[[doc for doc, _ in hits]] = False
                    yield b.slice(rows.start, rows.stop - rows.start).filter(pa.array(free))
                elif hits:
                    docs = b.column("doc_id")[rows.start : rows.stop]
                    keys, found = list(hits), list(hits.values())
                    yield pa.RecordBatch.from_arrays(
                        [docs.take(pa.array([k[0] for k in keys])), pa.array([item_ids[k[1]] for k in keys], pa.int64()), *(pa.array([f[c] for f in found], t) for c, t in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.int64())))],
                        names=["doc_id", "item_id", "cosine", "lcs_share", "answer_found", "at_word"],
                    )

    return run


HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean, at_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds, with the evidence.

    Whole texts are searched in overlapping windows. An item's answer is its column
    ``answer`` if the benchmark has one, else what its text has after a mark such as
    "Answer:"; without either, ``NO_ANSWER`` of its words in order are a hit by themselves.

    Null, empty and blank texts hold nothing; items without words are held by nothing;
    rows repeated under one id, and null ids, give rows each; items repeated under one
    id give a row each; an empty table or benchmark gives an empty result. Other columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes = [docs.mapInArrow(search(False), HITS) for search in _passes(docs, benchmark)]
    return reduce(DataFrame.unionByName, passes) if passes else docs.sparkSession.createDataFrame([], HITS)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Each row is judged by its own text, whatever its id; rows stay where they are, so
    nothing is shuffled. See ``contaminated`` for nulls, empty texts and empty tables.
    """
    for search in _passes(docs.select("text"), benchmark):
        docs = docs.mapInArrow(search(True), docs.schema)
    return docs


def _passes(docs: DataFrame, benchmark: DataFrame) -> list:
    """A search for each pass over the documents, given whether it returns the rows without hits."""
    given = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    answer = F.coalesce(given, F.nullif(F.regexp_extract("text", ANSWER, 1), F.lit("")), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).where(F.regexp_count("text", F.lit(WORD)) > 0)
    # the benchmark is the stated set of queries: its words go to the driver as hashes, block by block
    blocks: list[list] = []
    room = 0
    for r in items.orderBy("item_id", "text", "answer").toLocalIterator():
        words, answer_words = _cut([r["text"], r["answer"]])
        if not blocks or len(blocks[-1]) == ITEMS_PER_BLOCK or room < len(words):
            blocks.append([])
            room = WORDS_PER_BLOCK
        blocks[-1].append((r["item_id"], words, answer_words))
        room -= len(words)
    if not blocks:
        return []
    vocabulary = np.unique(np.concatenate([w for block in blocks for _, w, _ in block]))
    idf = _weights(docs, vocabulary)
    return [_pass(docs.sparkSession, blocks[lo : lo + BLOCKS_PER_PASS], vocabulary, idf) for lo in range(0, len(blocks), BLOCKS_PER_PASS)]


def _weights(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Inverse document frequencies of the vocabulary over all documents."""
    counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()
    df, n = np.zeros(len(vocabulary)), 0
    for term, count in counted:
        if term < 0:
            n = count
        else:
            df[term] = count
    return np.log((n + 1) / (df + 1)) + 1


def _pass(spark: SparkSession, blocks: list[list], vocabulary: np.ndarray, idf: np.ndarray):
    """The search for the items of a few blocks."""
    own = np.unique(np.concatenate([x for block in blocks for _, w, a in block for x in (w, a)]))
    made, items, answers, ids, item_of, cuts = [], [], [], [], [], []
    number = lambda words: np.searchsorted(own, words)
    for block in blocks:
        at, rows = len(cuts), []
        terms = np.unique(np.concatenate([w for _, w, _ in block]))
        weight = idf[np.searchsorted(vocabulary, terms)]
        for item_id, words, answer in block:
            for p in _passages(words):
                t, c = np.unique(np.searchsorted(terms, p), return_counts=True)
                rows.append((t.tolist(), (c * weight[t] / np.linalg.norm(c * weight[t])).tolist()))
                item_of.append(len(items))
                cuts.append(number(p))
            items.append(number(words))
            answers.append(number(answer))
            ids.append(item_id)
        frame = spark.createDataFrame(rows, "terms array<long>, weights array<double>")
        basis = latent_space(frame, len(terms), min(RANK, len(rows), len(terms)))
        passages = np.array([np.array(v) @ basis[t] for t, v in rows]) * np.array([np.linalg.norm(weight[t]) for t, _ in rows])[:, None]
        local = np.full(len(own), -1, np.int64)
        local[np.searchsorted(own, terms)] = np.arange(len(terms))
        made.append(_Block(local, basis * weight[:, None], passages, at))
    rarity = np.zeros(len(own))
    rarity[np.searchsorted(own, vocabulary[np.isin(vocabulary, own)])] = idf[np.isin(vocabulary, own)]
    return lambda without: _search(own, rarity, made, items, answers, ids, np.array(item_of), cuts, without)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by any document."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE_SQL: dict[str, str] = {}
