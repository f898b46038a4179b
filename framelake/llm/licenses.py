"""License scans: TF-IDF cosine of lines, paragraphs, headers and whole texts to templates, then
inheritance from the nearest directory (DataFrame functions only)."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table
from .license_templates import HEADERS, STATEMENTS, TEXTS, WEAK

#: One statement for each of the licenses that the given documents speak of.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Proprietary": "All rights reserved.",
}
#: Lines against statements, and longer passages against headers and whole licenses.
MIN_COSINE, MIN_PASSAGE = 0.6, 0.75
TOKEN = r"[a-z]+|[0-9]+"
#: Words rarer than one file in so many weigh alike, which bounds the table of weights.
RAREST = 1000
#: Passages are compared if the text holds one of these; every header and whole license does.
ANCHORS = ("licen", "copyright", "permission", "permitted", "redistribut", "public domain")
MIN_PASSAGE_WORDS = 12
HEAD_LINES = 200
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*)*)"
#: A line that is not a comment.
CODE = r"^(?![ \t]*(?:#|//|/?\*|--|;|%|<!--|\"\"\"|'''|\(\*|\r?$))"
#: Stronger evidence first: an identifier, a whole text or header, a paragraph, a line, a family or reservation.
SPDX_RANK, WHOLE, PARAGRAPH, LINE, WEAKEST = 5, 4, 3, 2, 1
#: File names that license their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """Number of files that hold each word that at least one in ``RAREST`` holds, and of all files.

    At most ``RAREST`` times the mean number of distinct words of a file come back.
    """
    n = files.count()
    words = files.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)))).alias("w"))
    common = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * RAREST >= n)
    return {r["w"]: r["n"] for r in common.toLocalIterator()}, n


def weigher(df: dict[str, int], n: int):
    """Inverse document frequency of a word; no word weighs more than one of the rarest."""
    return lambda w: math.log((1 + n) / (1 + max(df.get(w, 0), n / RAREST))) + 1


def _built_in() -> list[tuple[str, str, tuple[str, ...], int]]:
    """(license, text, words needed, rank) of all templates of ``license_templates``."""
    return (
        [(k, t, (), WHOLE) for k, t in TEXTS.items()]
        + [(k, t, (), PARAGRAPH) for k, t in HEADERS]
        + [(k, t, keys, WEAKEST if k in WEAK else LINE) for k, t, keys in STATEMENTS]
    )


def needed_words(vectors: list[dict[str, float]], keys: list[tuple[str, ...]]) -> dict[str, set[str]]:
    """Words of which every line with a cosine of ``MIN_COSINE`` to some statement has
    one, each with further words of which it then has one as well (none: it needs none).

    Of each statement the first word that it cannot do without, or so many of its
    heaviest words that the rest of its unit vector is shorter than the threshold; and
    where that first word is shorter too, so many of the others likewise.
    """
    enough = (MIN_COSINE - 1e-6) ** 2

    def heaviest(v: dict[str, float], rest: float) -> set[str]:
        words = set()
        for w in sorted(v, key=lambda w: (w.isdigit(), -v[w], w)):
            if rest < enough:
                break
            words.add(w)
            rest -= v[w] ** 2
        return words

    found: dict[str, set[str]] = {}
    alone = set()
    for v, k in zip(vectors, keys, strict=True):
        for w in k[:1] or heaviest(v, 1.0):
            others = {x: y for x, y in v.items() if x != w}
            if not k or v[w] ** 2 >= enough:
                alone.add(w)
            found.setdefault(w, set()).update(heaviest(others, 1.0))
    return {w: set() if w in alone else more for w, more in found.items()}


def _hint(words) -> str:
    letters, digits = [w for w in sorted(words) if not w.isdigit()], [w for w in sorted(words) if w.isdigit()]
    return "|".join(rf"(?<![{c}])(?:{'|'.join(ws)})(?![{c}])" for c, ws in (("a-z", letters), ("0-9", digits)) if ws)


def own_licenses(files: DataFrame, templates: dict[str, str] | None = None, key: str = "_key") -> DataFrame:
    """(key, license, cosine): the best match of each file, if one reaches its threshold.

    Every line of the whole text is compared with statements; its paragraphs, the
    comment it begins with and all of it with standard headers and whole licenses.
    An SPDX line names its license itself (cosine 1). Of several matches the stronger
    kind comes first, see ``SPDX_RANK``, then the larger cosine. ``templates`` are
    statements to compare lines with in place of all these. Weights are counted over
    ``files``. Lines and texts that cannot match are left out before they are scored.
    """
    made = _built_in() if templates is None else [(k, t, (), LINE) for k, t in templates.items()]
    df, n = frequencies(files)
    weight = weigher(df, n)
    vectors = []
    for _, text, _, _ in made:
        v = {w: c * weight(w) for w, c in Counter(re.findall(TOKEN, text.lower())).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    short = [i for i, m in enumerate(made) if m[3] <= LINE]
    lower = F.lower("text")
    needed = needed_words([vectors[i] for i in short], [made[i][2] for i in short]) | ({"spdx": set()} if templates is None else {})
    hint, line = _hint(needed), F.lower("passage")
    can = line.rlike(_hint(w for w in needed if not needed[w])) if not all(needed.values()) else F.lit(False)
    for w in sorted(w for w in needed if needed[w]):
        can = can | (line.rlike(_hint([w])) & line.rlike(_hint(needed[w])))

    lines = files.where(lower.rlike(hint)).select(key, F.explode(F.split("text", "\r?\n")).alias("passage")).where(line.rlike(hint)).where(can)
    units = lines.select(key, F.lit(LINE).alias("unit_rank"), "passage")
    if templates is None:
        anchored = lambda c: F.exists(F.array(*[F.lit(a) for a in ANCHORS]), lambda a: F.contains(F.lower(c), a))
        anchor = F.lit(False)
        for a in ANCHORS:
            anchor = anchor | lower.contains(a)
        top = F.slice(F.split("text", "\n", HEAD_LINES + 1), 1, HEAD_LINES)
        code = F.array_position(F.transform(top, lambda x, i: x.rlike(CODE) & ~((i == 0) & x.startswith("#!"))), F.lit(True))
        head = F.array_join(F.when(code > 0, F.slice(top, F.lit(1), (code - 1).cast("int"))).otherwise(top), "\n")
        paragraphs = F.filter(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*\n)+"), anchored)
        passages = F.concat(
            F.array(F.struct(F.lit(WHOLE).alias("unit_rank"), F.col("text").alias("passage"))),
            F.filter(F.array(F.struct(F.lit(WHOLE).alias("unit_rank"), head.alias("passage"))), lambda x: anchored(x["passage"])),
            F.transform(paragraphs, lambda p: F.struct(F.lit(PARAGRAPH).alias("unit_rank"), p.alias("passage"))),
        )
        units = units.unionByName(files.where(anchor).select(key, F.inline(passages)))
    units = materialise(units.withColumn("_unit", F.monotonically_increasing_id()), "license-units")
    spdx = F.regexp_extract("passage", SPDX, 1)
    named = units.where(F.col("unit_rank") == LINE).select(key, spdx.alias("license")).where("license <> ''").select(key, F.lit(SPDX_RANK).alias("rank"), F.lit(1.0).alias("cosine"), "license")
    plain = units.where((F.col("unit_rank") != LINE) | (spdx == ""))

    spark = files.sparkSession
    terms: dict[str, list] = {}
    for i, v in enumerate(vectors):
        for w, x in v.items():
            terms.setdefault(w, []).append((i, x, int(w in made[i][2])))
    # the table of templates is a parameter and that of weights bounded, see ``frequencies``
    table = spark.createDataFrame([(w, weight(w), terms.get(w)) for w in sorted(set(terms) | set(df))], "w string, idf double, hits array<struct<template:int,x:double,key:int>>")
    about = spark.createDataFrame([(i, k, r, len(keys)) for i, (k, _, keys, r) in enumerate(made)], "template int, license string, rank int, n_keys int")
    tokens = plain.select("_unit", "unit_rank", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TOKEN), F.lit(0))).alias("w"))
    counts = tokens.groupBy("_unit", "unit_rank", "w").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(table), "w", "left")
    counts = materialise(counts.select("_unit", "unit_rank", "c", (F.col("c") * F.coalesce("idf", F.lit(weight("")))).alias("v"), "hits"), "license-words")
    norms = counts.groupBy("_unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("c").alias("words"))
    dots = counts.select("_unit", "unit_rank", "v", F.inline("hits")).groupBy("_unit", "unit_rank", "template").agg(F.sum(F.col("v") * F.col("x")).alias("dot"), F.sum("key").alias("keys"))
    fits = (F.col("keys") == F.col("n_keys")) & F.when(F.col("unit_rank") == LINE, (F.col("rank") <= LINE) & (F.col("cosine") >= MIN_COSINE)).otherwise(
        (F.col("rank") > LINE) & (F.col("rank") <= F.col("unit_rank")) & (F.col("cosine") >= MIN_PASSAGE) & (F.col("words") >= MIN_PASSAGE_WORDS))
    scored = dots.join(F.broadcast(about), "template").join(norms, "_unit").withColumn("cosine", F.round(F.try_divide("dot", "norm"), 9)).where(fits)
    matched = units.join(scored.select("_unit", "rank", "cosine", "license"), "_unit").select(key, "rank", "cosine", "license")
    best = matched.unionByName(named).groupBy(key).agg(F.max(F.struct("rank", "cosine", "license")).alias("b"))
    return best.select(key, "b.license", "b.cosine")


def scan(files: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``files`` (path, text, ...) with license, cosine, origin and licensed_by.

    A file's own statement comes first (origin ``own``); else the license of the
    nearest directory at or above it that a license file gives (``inherited``, with
    that directory in ``licensed_by``); else null. Of several license files in one
    directory the best match counts, then the first license by name.

    Directories meet their ancestors in equi-joins on paths: distinct directories
    are expanded to their ancestors, joined to licensed ones, and the longest wins;
    files, of which one directory may hold a third, join that result only. Null
    paths inherit nothing; null and empty texts state nothing; repeated rows are
    files of their own; an empty table gives an empty result. Columns of ``files``
    of the same names as results are replaced.
    """
    taken = ("license", "cosine", "origin", "licensed_by")
    # what is found follows from path and text alone: a hash of both names a row, so that no text is written to fix a key
    whole = [F.col("path"), F.col("path").isNull(), F.col("text")]
    row = F.struct(*[c for c in files.columns if c not in taken]).alias("row")
    keyed = files.select(F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b")).alias("_key"), "path", "text", row)
    own = materialise(own_licenses(keyed.select("_key", "path", "text"), templates), "license-own")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    f = materialise(keyed.select("_key", "path", folder.alias("_dir")).distinct().join(own, "_key", "left"), "license-paths")
    giving = f.where(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    licensed = giving.groupBy(F.col("_dir").alias("_up")).agg(F.max(F.struct("cosine", F.col("license"))).alias("g")).select("_up", F.col("g.license").alias("_given"))
    dirs = f.where("_dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = dirs.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    near = ups.join(licensed, "_up").groupBy("_dir").agg(F.max(F.struct(F.length("_up").alias("n"), "_up", "_given")).alias("b")).select("_dir", "b._up", "b._given")
    out = f.join(near, "_dir", "left")
    license_ = F.coalesce("license", "_given")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("_given").isNotNull(), "inherited")
    by = F.when(F.col("license").isNull(), F.col("_up"))
    found = out.select("_key", license_.alias("license"), "cosine", origin.alias("origin"), by.alias("licensed_by"))
    return keyed.select("_key", "row").join(found, "_key").select("row.*", *taken)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents.

    Documents stand for the files of one tree per source: ten to a directory with the
    first as its license file, a hundred such directories under one with the first of
    all as its license file, and the same once more above.
    """
    docs = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    tens, thousands = F.floor(i / 10).cast("string"), F.floor(i / 1000).cast("string")
    top = F.coalesce(F.col("source"), F.lit("unknown"))
    path = (
        F.when(i % 100000 == 0, F.concat(top, F.lit("/LICENSE")))
        .when(i % 1000 == 0, F.concat_ws("/", top, thousands, F.lit("LICENSE")))
        .when(i % 10 == 0, F.concat_ws("/", top, thousands, tens, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", top, thousands, tens, F.concat(i.cast("string"), F.lit(".txt"))))
    )
    return scan(docs.select("doc_id", path.alias("path"), "text")).drop("text")


QUERIES = {"op1_licenses": op1_licenses}
ORACLE_SQL: dict[str, str] = {}
