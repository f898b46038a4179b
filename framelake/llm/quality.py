"""Quality rules as a bitmask ledger: every rule once per document, policies and ablations on bits.

The ledger has one row per document with the measurements and ``fail_bits``; a
policy is a versioned mask of rules; applying one, or asking what it would do
without one of its rules, reads only the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table
from .words import encode, words_of

#: Rule names in the order of their bits. A rule is SQL over the measurements and is true where a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines > 0 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "shouting": "n_upper > 0 and 2 * n_upper > word_chars",
    "duplicate_lines_of_many": "n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines",
}
#: Policies by version: the rules that reject. Version 3 spares texts of a few lines of which one is repeated.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "word_length", "shouting"),
    3: ("few_words", "repeated_windows", "many_symbols", "word_length", "shouting", "duplicate_lines_of_many"),
}
BASE, CURRENT = 1, 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _line_counts(batch) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and of them those equal to an earlier line of the same text."""
    data, offsets = batch.data, batch.offsets
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])[order]
    ends = np.append(starts[1:], len(data))
    newline = np.zeros(len(starts), bool)
    inside = (ends > starts) & (ends > 0)
    newline[inside] = data[ends[inside] - 1] == 10
    ends = ends - newline
    words = np.searchsorted(batch.starts, ends) - np.searchsorted(batch.starts, starts)
    has = words > 0
    doc, h = doc[has], batch.hash_spans(starts[has], ends[has])
    lines = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return lines, np.bincount(doc[order][1:][same], minlength=n)


def _repeat_words(batch) -> np.ndarray:
    """Words covered by 3-word windows that are found twice or more in their text."""
    n = len(batch.offsets) - 1
    grams, first = batch.windows(3)
    if not len(grams):
        return np.zeros(n, np.int64)
    doc = batch.doc[first]
    order = np.lexsort((grams, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (grams[order][1:] == grams[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(batch.starts) + 3, bool)
    at = first[twice]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(batch.doc[covered[: len(batch.doc)]], minlength=n)


def _measure(drop_text: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in encode(b.column("text")):
                w = words_of(part)
                n = len(part.offsets) - 1
                n_words = np.bincount(w.doc, minlength=n)
                count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
                chars = count(((w.data & 0xC0) != 0x80) & ~w.space)
                lines, dup = _line_counts(w)
                upper = count((w.data >= 65) & (w.data <= 90))
                sliced = b.slice(rows.start, rows.stop - rows.start)
                keep = [c for c in b.schema.names if c != "text" or not drop_text]
                arrays = [sliced.column(c) for c in keep] + [pa.array(x.astype(np.int64)) for x in (n_words, chars, count(_SYMBOLS[w.data]), dup, _repeat_words(w), lines, upper)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *MEASURES])

    return run


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measurements, fail_bits): each rule evaluated once for every row.

    Null or empty text has no words and fails ``few_words``; a null key stays null;
    repeated rows give repeated rows; other columns are ignored.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = docs.select(key, "text").mapInArrow(_measure(), schema)
    return measured.withColumn("fail_bits", fail_bits())


def fail_bits():
    """A bit for each rule that a row's measurements fail."""
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("long")


def mask(version: int) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[version])


def failed(version: int):
    """True where the policy rejects a row of the ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(version))) != 0


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(version, rule, fails, only_rule, rejected, rejected_without): what each rule of a policy does.

    The ledger is first counted by its bits (at most 2^rules rows, with partial sums
    before the shuffle); all policies and ablations read those counts.
    """
    m = mask(version)
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    which = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if m >> i & 1])).alias("r")
    e = counted.select("b", "n", which).select("b", "n", "r.*")
    has = F.col("b").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return e.groupBy(F.lit(version).alias("version"), "rule").agg(
        count(has).alias("fails"), count(F.col("b") == F.col("bit")).alias("only_rule"), count(F.col("b") != 0).alias("rejected"),
        count(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("rejected_without"),
    )


def kept_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns.

    Null and repeated ids are rows like others; null and empty texts fail ``few_words``;
    an empty table gives an empty result. Columns of the measurements' names stay as they are.
    """
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    schema = T.StructType([*inside.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    kept = inside.mapInArrow(_measure(drop_text=False), schema).withColumn("fail_bits", fail_bits()).where(~failed(version))
    return kept.select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of all documents under the current policy."""
    rows = ledger(read_table(spark, sf_dir, "documents"))
    base = failed(BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~failed(CURRENT)).alias("kept"), "fail_bits")


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL = {
    "op3_quality": r"""
with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select r, i, ws[i:i+2] g from (select r, ws, unnest(range(1, len(ws) - 1)) i from w)),
c as (select r, i from (select r, i, count(*) over (partition by r, g) n from g) where n > 1),
p as (select r, count(distinct k) n from (select r, unnest([i, i + 1, i + 2]) k from c) group by r),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(p.n, 0)::bigint n_repeat_words,
             len(ls)::bigint n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint n_upper
      from w left join p using (r)),
b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
             + case when 10 * n_symbols > n_words then 4 else 0 end
             + case when n_lines > 0 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
             + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words) then 16 else 0 end
             + case when n_upper > 0 and 2 * n_upper > word_chars then 32 else 0 end
             + case when n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines then 64 else 0 end)::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 base_failed, (fail_bits & 119) = 0 kept, fail_bits from b""",
}
