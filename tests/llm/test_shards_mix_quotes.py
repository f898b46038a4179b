"""Shards, mixtures and quotations where ids repeat, sources are tiny and phrases were said before."""

import re
from collections import Counter

import numpy as np
import pytest

from framelake.llm import mixing, quality, quotes, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n, lo=20, hi=120):
    return [" ".join(f"w{x}" for x in rng.integers(0, 3000, rng.integers(lo, hi))) for _ in range(n)]


@pytest.mark.parametrize("ids", ["one id", "null ids", "tiny texts"])
def test_shards_divide_rows_that_repeat(spark, ids):
    rng = np.random.default_rng(0)
    copy = "" if ids == "tiny texts" else "the same text again " * 10
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(sentences(rng, 2000))] + [(None if ids == "null ids" else 7, copy, "en", "a", 1)] * 1000
    got = sharding.sharded(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    by, n = Counter(), Counter()
    for r in got:
        by[r["shard"]] += r["size"]
        n[r["shard"]] += 1
    mean = sum(by.values()) / 16
    assert len(got) == 3000 and all(0.85 * mean <= by[s] <= 1.15 * mean for s in range(16))
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))


def test_shards_are_weighted_medians_of_the_widest_dimension(spark):
    """Every node, from the points and shards alone: a cut across its widest dimension, nearest to half its bytes."""
    rng = np.random.default_rng(1)
    sources = rng.choice(["hot", "b", "c"], 1500, p=[0.8, 0.1, 0.1])
    rows = [(int(i * i), t, "en" if i % 3 else "de", str(sources[i]), 1) for i, t in enumerate(sentences(rng, 1500, 5, 300))]
    docs = spark.createDataFrame(rows, DOCS)
    shard = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs, 8).collect()}
    base = sharding._rows(docs)
    pts = sharding._points(sharding.materialise(base, "test-rows"), 1500, sum(len(r[1]) + 1 for r in rows), 8).collect()
    lo, hi, most = min(r["_age"] for r in pts), max(r["_age"] for r in pts), max(r["size"] for r in pts)
    x = {r["doc_id"]: (np.array([r["_s"], r["_l"], np.log(r["size"]) / np.log(most), (r["_age"] - lo) / (hi - lo)]) + r["_tie"] / 4096, r["size"]) for r in pts}

    def check(ids, level, prefix):
        if level == 3:
            return
        v = np.array([x[i][0] for i in ids])
        dim = int((v.max(0) - v.min(0)).argmax())
        right = np.array([shard[i] >> (2 - level) & 1 for i in ids], bool)
        assert v[~right, dim].max() < v[right, dim].min() + 1e-12
        size = np.array([x[i][1] for i in ids])
        order = np.argsort(v[:, dim])
        half = size.sum() / 2
        # no whole row could be moved across the cut and bring both sides nearer to half, but for rows of one fine bin
        assert abs(size[right].sum() - half) <= size[order].max()
        for side in (False, True):
            check([i for i, r in zip(ids, right, strict=True) if r == side], level + 1, prefix + [side])

    check(list(x), 0, [])


def near_targets(rows, got, slack=0.01):
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack * target[s] + 1, (s, taken[s], target[s])
    assert abs(sum(taken.values()) - sum(sizes.values())) <= slack * sum(sizes.values())
    return taken, target


def test_mix_meets_the_targets_of_tiny_sources(spark):
    rows = [(i, "a", 200_000) for i in range(1000)] + [(2000 + i, "b", 20) for i in range(10)] + [(3000 + i, "c", 5) for i in range(3)] + [(4000, "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    taken, target = near_targets(rows, got)
    assert target["b"] == 600 and target["c"] == 45 and taken["b"] in (599, 600) and taken["c"] in (44, 45) and taken["d"] >= 2
    # their slots are spread over the whole mix
    slots = [p["slot"] for r in got if r["source"] == "b" for p in r["places"]]
    assert min(slots) < 30_000 and max(slots) > 100_000
    assert sorted(r["taken"] for r in mixing.mix(df).collect()) == sorted(r["taken"] for r in got)


def test_mix_of_hundreds_of_sources(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"s{int(min(299, rng.pareto(0.7)))}", int(rng.integers(0, 400))) for i in range(20000)]
    near_targets(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect(), 0.05)


def test_mix_deals_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 20)
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], int(n)) for i, n in enumerate(rng.integers(1, 50, 1500))] + [(None, "a", 11)] * 700 + [(5, "b", 3)] * 300
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    near_targets(rows, got)
    key = lambda i, s, n: (i is None, i or 0, s, n)
    assert sorted(key(r["doc_id"], r["source"], r["size"]) for r in got) == sorted(key(*r) for r in rows)
    # documents lie on their source's line without gap or overlap: all epochs that a source takes whole are taken of all
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    whole = {s: int(next(r["target"] for r in got if r["source"] == s) // sizes[s]) for s in sizes}
    assert all(r["taken"] >= whole[r["source"]] * r["size"] for r in got)


def words_of(lines):
    return re.findall(r"\w+", " ".join(re.sub(r"^(?:[ \t]{0,3}>)+[ \t]?", "", x) for x in lines).lower())


def runs_of(lines):
    w = words_of(lines)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute_parents(rows):
    """For each message of one level of quotes: the earlier message with most of its quoted runs, the first of equals."""
    own = {(c, t): runs_of([x for x in text.split("\n") if not x.startswith(">")]) for c, t, _, text in rows}
    out = {}
    for c, t, _, text in rows:
        quoted = runs_of([x for x in text.split("\n") if x.startswith(">")])
        good = [(len(quoted & own[c, m]), -m) for d, m in own if d == c and m < t and quoted and len(quoted & own[c, m]) >= 0.8 * len(quoted)]
        out[c, t] = -max(good)[1] if good else None
    return out


def test_quotes_of_phrases_said_before(spark):
    a, b, c = ("one two three four five six seven eight nine ten eleven twelve", "red green blue black white grey pink brown gold lime teal navy", "do re mi fa sol la ti ut ha he hi ho")
    rows = [(1, 0, "u", a), (1, 1, "u", b), (1, 2, "u", c), (1, 3, "a", f"{a}\n{b}\n{c}"), (1, 4, "u", "\n".join(f"> {x}" for x in (a, b, c)) + "\nall of it"), (1, 5, "u", f"> {b}\nthat one")]
    got = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[4]["parent_turn"], got[4]["n_linked"], got[4]["text"]) == (3, 1, "all of it")
    assert got[5]["parent_turn"] == 1


def test_quotes_against_brute_force_with_repeated_phrases(spark):
    rng = np.random.default_rng(4)
    phrases = sentences(rng, 12, 4, 9)
    rows = []
    for conv in range(5):
        said = []
        for t in range(30):
            mine = [phrases[k] for k in rng.choice(12, rng.integers(1, 4), replace=False)] + [f"only {conv} {t} here and now"]
            text = "\n".join(mine)
            if said and rng.random() < 0.7:
                other = said[rng.integers(0, len(said))].split("\n")
                if rng.random() < 0.4:
                    other = other[: max(1, len(other) - 1)]
                text = "\n".join(f"> {x}" for x in other) + "\n" + text
            said.append("\n".join(mine))
            rows.append((conv, t, "u", text))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, `a.b` int")
    got = {(r["conv_id"], r["turn"]): r["parent_turn"] for r in quotes.link_quotes(df).collect()}
    want = brute_parents(rows)
    assert got == want and sum(v is not None for v in want.values()) > 80


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "word " * 80 + "x", "en", "s", 1, 3)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    assert quality.kept_documents(df).columns == df.columns
    assert [r["a.b"] for r in mixing.mixed_documents(df).collect()]
