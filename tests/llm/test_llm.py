"""The training-data operators against brute force, round trips and planted cases."""

import gzip
import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import decontam, license_templates, licenses, mixing, neardup, pii, quality, quotes, registry, sharding, urls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


ODD = [None, "", " \n\t ", "one", "two words", "x " * 5000, "é" * 3000, "same text here for all", "same text here for all", "a\x00b c"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_quality_counts_and_ablations(spark):
    rows = quality.ledger(docs_of(spark, [*ODD, "a b c a b c\nx\nx", "ok " + " ".join(words(np.random.default_rng(0), 200))])).orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["n_words"] for i in range(5)] == [0, 0, 0, 1, 2]
    assert by[5]["n_repeat_words"] == 5000 and by[6]["word_chars"] == 3000
    assert (by[10]["n_repeat_words"], by[10]["n_dup_lines"]) == (6, 1)
    assert by[11]["fail_bits"] == 0
    ab = {r["rule"]: r for r in quality.ablations(quality.ledger(docs_of(spark, ODD))).collect()}
    bits = [r["fail_bits"] for r in rows if r["doc_id"] < 10]
    for k, rule in enumerate(quality.RULES):
        if rule not in quality.POLICIES[quality.CURRENT]:
            assert rule not in ab
            continue
        m = quality.mask(quality.CURRENT)
        assert ab[rule]["fails"] == sum(b >> k & 1 for b in bits)
        assert ab[rule]["rejected_without"] == sum(b & m & ~(1 << k) != 0 for b in bits)


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(["x" * 500, "y" * 500, "x" * 500, None, "", "z"])] + [(None, None, "q" * 200)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    back = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert back[2]["record_type"] == "revisit" and back[2]["refers_to"] == 0 and back[2]["payload_bytes"] == 500
    assert back[0]["payload"] == b"x" * 500 and back[3]["payload_bytes"] == 0 and back[None]["payload_bytes"] == 200
    made = [warc.record(i, None, bytes([65 + i]) * 300, __import__("hashlib").sha256(bytes([65 + i]) * 300).hexdigest(), None) for i in range(4)]
    broken = bytearray(made[1])
    broken[40] ^= 255
    data = made[0] + bytes(broken) + b"garbage" + made[2] + made[3][:50]
    found = list(warc.salvage("p", data))
    assert [r["page_id"] for r in found if r["record_type"] == "response"] == [0, 2]
    gaps = [(r["record_offset"], r["gap_bytes"]) for r in found if r["record_type"] == "gap"]
    assert gaps == [(len(made[0]), len(broken) + 7), (len(data) - 50, 50)]
    plain = b"".join(gzip.decompress(m) for m in made)
    cut = plain.replace(b"B" * 300, b"B" * 299, 1)
    assert [r["page_id"] for r in warc.salvage("p", cut) if r["record_type"] == "response"] == [0, 2, 3]


def test_warc_salvages_damaged_heads_and_members():
    sha = __import__("hashlib").sha256
    payloads = [np.random.default_rng(i).integers(0, 256, 6000, np.uint8).tobytes() for i in range(6)]
    made = [warc.record(i, None, p, sha(p).hexdigest(), None) for i, p in enumerate(payloads)]
    plain = [gzip.decompress(m) for m in made]
    ids = lambda data: [r["page_id"] for r in warc.salvage("p", bytes(data)) if r["record_type"] == "response"]
    gaps = lambda data: [(r["record_offset"], r["gap_bytes"]) for r in warc.salvage("p", bytes(data)) if r["record_type"] == "gap"]
    damaged = b"XXXX" + b"".join(plain)[4:]
    assert ids(damaged) == [1, 2, 3, 4, 5] and gaps(damaged) == [(0, len(plain[0]))]
    one = gzip.compress(b"".join(plain))
    assert ids(one[: len(one) * 3 // 4]) == [0, 1, 2, 3]
    inside = bytearray(gzip.compress(b"".join(plain[:4])) + made[4])
    end = len(inside) - len(made[4])
    inside[end - 8] ^= 255  # the checksum
    assert ids(inside) == [0, 1, 2, 3, 4]
    assert ids(b"XXXX" + plain[0][4:] + made[1] + plain[2] + made[3]) == [1, 2, 3]


def test_warc_of_other_writers(spark, tmp_path):
    import base64
    import hashlib

    def foreign(i, digest, kind="response"):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
        block = http + bytes([65 + i]) * 400
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: http://h/{i}\r\n{digest(bytes([65 + i]) * 400)}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    sha1 = lambda p: f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(p).digest()).decode()}\r\n"
    md5 = lambda p: f"WARC-Payload-Digest: md5:{hashlib.md5(p).hexdigest()}\r\n"
    none, odd, wrong = (lambda p: ""), (lambda p: "WARC-Payload-Digest: blake3:abc\r\n"), (lambda p: "WARC-Payload-Digest: sha1:AAAA\r\n")
    made = [foreign(i, d) for i, d in enumerate((sha1, md5, none, odd, wrong))]
    found = list(warc.salvage("p", b"".join(gzip.compress(m) for m in made)))
    assert [r["uri"] for r in found if r["record_type"] == "response"] == [f"http://h/{i}" for i in range(4)]
    assert [r["problem"] for r in found if r["record_type"] == "gap"] == ["payload digest differs"]
    assert found[0]["payload_digest"] == hashlib.sha256(b"A" * 400).hexdigest() and found[0]["page_id"] is None
    stream = gzip.compress(b"".join(foreign(i % 20, sha1) for i in range(50)))
    assert sum(r["record_type"] == "response" for r in warc.salvage("p", stream[:-1])) == 50


def test_warc_odd_tables(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "x" * 200, 1), (3, "u", "x" * 200, 1), (4, None, "x" * 200, 2), (None, "v", "x" * 200, 3)], "page_id long, url string, html string, digest long")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect())
    assert got == [("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "response", None)]
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_bloom_has_no_misses(spark):
    listed = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"))
    asked = spark.range(4000).select("id", F.concat(F.lit("u"), "id").alias("url"))
    rows = urls.possible(asked, listed).collect()
    assert all(r["possible"] for r in rows if r["id"] < 2000)
    assert sum(r["possible"] for r in rows if r["id"] >= 2000) < 200


def test_urls_odd(spark):
    p = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.NET"), (None, "http://a.org/fr/x")], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(p, p.select("url").limit(0)).collect()}
    assert (got[1]["host"], got[1]["verdict"]) == ("", "allow") and got[4]["rule"] is None and got[None]["rule"] == "org/fr/"


def test_shards(spark):
    rng = np.random.default_rng(1)
    texts = [*ODD, *(" ".join(words(rng, int(n))) for n in rng.integers(1, 200, 2000))]
    rows = sharding.sharded(docs_of(spark, texts, ["hot", "hot", "b"])).collect()
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert len(rows) == len(texts) and set(by) == set(range(16))
    assert max(by.values()) <= 1.15 * sum(by.values()) / 16 + 6000 and min(by.values()) >= 0.85 * sum(by.values()) / 16 - 6000
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.sharded(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_shards_keep_copies_together_and_meet_the_target(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(words(rng, int(n))) for n in rng.integers(20, 200, 1500)]
    copies = [t for t in texts[:60] for _ in range(int(rng.integers(2, 8)))]
    giant = [texts[70]] * 900  # a third of all bytes
    texts = texts + copies + giant + [None] * 400
    docs = docs_of(spark, texts, ["hot", "hot", "b", None])
    rows = sharding.sharded(docs).collect()
    total = sum(r["size"] for r in rows)
    assert len(rows) == len(texts) and sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    by, where = Counter(), {}
    for r in rows:
        by[r["shard"]] += r["size"]
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(0.85 * total / 16 <= by[s] <= 1.15 * total / 16 for s in range(16))
    n = Counter(texts)
    assert all(len(where[t]) == 1 for t in n if t and n[t] > 1 and n[t] * len(t) < sharding.WHOLE * total / 16)
    assert len(where[texts[70]]) >= 4
    small = sharding.sharded(docs, target_bytes=total // 40).collect()
    leaves = Counter()
    for r in small:
        leaves[r["shard"]] += r["size"]
    assert len(leaves) == 64 and max(leaves.values()) <= 1.2 * total / 64
    for s in leaves:
        assert sorted(r["slot"] for r in small if r["shard"] == s) == list(range(sum(r["shard"] == s for r in small)))


def test_shards_odd_rows(spark):
    rows = [(None, "a", None, None, "x"), (None, "a", None, None, "x"), (1, None, "en", "s", "y"), (1, "b", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    got = sharding.sharded(df, 4).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len(t or "") + 1, __import__("zlib").crc32((t or "").encode())) for _, t, *_ in rows)
    assert sharding.sharded(df, target_bytes=1 << 30).select("shard").distinct().collect()[0][0] == 0


def mix_rows(spark, n=3000):
    rng = np.random.default_rng(2)
    rows = [(i, s, int(k)) for i, (s, k) in enumerate(zip(rng.choice(["a", "b", "c", None], n, p=[0.9, 0.05, 0.03, 0.02]), rng.integers(0, 50, n)))]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_mix_against_brute_force(spark):
    rows, df = mix_rows(spark)
    bits = 9
    got = {r["doc_id"]: r for r in mixing.mix(df, bits=bits).collect()}
    total, sizes = sum(r[2] for r in rows), Counter()
    for _, s, n in rows:
        sizes[s] += n
    weights, target, open_ = dict(zip(["a", "b", "c", None], [1, 2, 3, 1])), {}, set(sizes)
    left = float(total)
    while True:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > 3 * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / w for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    order, edge, slots = ["a", "b", "c", None], 0.0, {s: [] for s in weights}
    ends = {}
    for s in order:
        edge += target[s] / total
        ends[s] = edge
    for i in range(1 << bits):
        u = int(f"{i:0{bits}b}"[::-1], 2) / (1 << bits)
        slots[next((s for s in order if u < ends[s]), None)].append(i)
    shuffle = {i: int(__import__("hashlib").md5(f"7:{i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows}
    owner = lambda at: ((at + 1) * (1 << bits) - 1) // total
    for s in order:
        goal = min(len(slots[s]) * total >> bits, 3 * sizes[s])
        assert abs(goal - target[s]) <= total / (1 << bits) + 1
        at = 0
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: shuffle[r[0]]):
            want = [(e, min(e * sizes[s] + at + n, goal) - e * sizes[s] - at, e * sizes[s] + at) for e in range(3)]
            want = [(e, w, slots[s][owner(x)], owner(x + w - 1) - owner(x) + 1) for e, w, x in want if w > 0]
            assert [tuple(p) for p in got[i]["places"]] == want
            assert got[i]["taken"] == sum(w[1] for w in want) <= 3 * n and got[i]["target"] == pytest.approx(target[s])
            at += n


def test_mix_comes_from_the_sequence(spark):
    _, df = mix_rows(spark, 300)
    taken = lambda **kw: {r["doc_id"]: r["taken"] for r in mixing.mix(df, bits=8, **kw).collect()}
    constant = taken(point=lambda slot, bits: F.lit(0.123456))
    assert constant != taken() and taken() == taken()
    # all slots are the source's that holds the point
    assert {i for i, n in constant.items() if n} <= {i for i, s, _ in mix_rows(spark, 300)[0] if s == "a"}


def test_mix_odd_rows(spark):
    rows = [(None, "a", 5, "x", 1), (None, "a", 5, "x", 1), (1, None, 0, "y", 2), (1, "b", 7, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, _row string, taken long")
    got = mixing.mix(df).collect()
    assert len(got) == 4 and abs(sum(r["taken"] for r in got) - 17) <= 2 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert got[0]["_row"] in ("x", "y", None)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_lie_in_slot_order(spark):
    texts = [" ".join(["w"] * int(n)) for n in np.random.default_rng(3).integers(1, 60, 300)]
    docs = docs_of(spark, texts, ["a", "b", "c"])
    got = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    rows = docs.select("doc_id", "source", F.expr("length(text) div 2 + 1").alias("size"))
    want = mixing.mix(rows).select("doc_id", "size", F.inline("places")).where("2 * words >= size").orderBy("slot", "epoch", "doc_id").collect()
    assert got == [r["doc_id"] for r in want] and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [*ODD]
    for _ in range(12):
        base = words(rng, 120)
        for _ in range(8):
            t = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 4)):
                t[k] = f"n{rng.integers(1e6)}"
            texts.append(" ".join(t))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, texts), 3, 85, neardup.DISTANCE).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert neardup.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = np.random.default_rng(4)
    items = [" ".join(words(rng, n)) for n in (15, 30, 45, 90)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    noise = lambda n: " ".join(words(rng, n))
    changed = items[2].split()
    for k in range(2, 40, 7):
        changed[k] = "other"
    texts = [*ODD, noise(300) + " " + items[0] + " " + noise(40), items[1].upper(), noise(23) + " " + " ".join(changed) + " " + noise(500), noise(70) + " " + items[3], noise(400), items[1][: len(items[1]) // 3]]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(10, 0), (11, 1), (12, 2), (13, 3)}
    assert decontam.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontam.clean_documents(docs_of(spark, texts), bench).count() == len(texts) - 4


def test_decontamination_finds_short_items_among_a_thousand(spark):
    rng = np.random.default_rng(7)
    items = [words(rng, int(n), 1500) for n in rng.choice([2, 5, 8, 12, 15, 20, 30], 1000)]
    texts = []
    for i in range(200):
        noise = words(rng, 300, 1500)
        at = int(rng.integers(0, 300))
        texts.append(" ".join(noise[:at] + items[i] + noise[at:]))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert [i for i in range(200) if (i, i) not in got] == []


def test_near_duplicates_near_the_threshold_in_large_buckets(spark, monkeypatch):
    """Many texts that share most words, with pairs on both sides of the threshold, in blocks of eight."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(13)
    base = words(rng, 260, 10**6)
    texts = []
    for _ in range(150):
        t = list(base)
        for k in rng.choice(260, rng.integers(4, 9), replace=False):
            t[k] = f"n{rng.integers(1e6)}"
        texts.append(t)
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    root = list(range(150))
    shares = []
    for a, b in itertools.combinations(range(150), 2):
        both = len(sets[a] & sets[b])
        shares.append(both / (len(sets[a]) + len(sets[b]) - both))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    assert sum(0.83 < x < 0.87 for x in shares) > 300
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, [" ".join(t) for t in texts]), 3, 85, neardup.DISTANCE).collect()}
    assert [got[i] for i in range(150)] == root


@pytest.mark.parametrize("per_cent,distance", [(85, neardup.DISTANCE), (80, neardup.DISTANCE_80)])
def test_sketches_keep_pairs_at_the_threshold(per_cent, distance):
    """Random sets as near the threshold from above as their size allows: the laws the module states."""
    rng = np.random.default_rng(per_cent)
    far = dropped = n = 0
    for size in (12, 40, 150, 600, 2500):
        for _ in range(max(40, 60_000 // size)):
            both = -(-2 * per_cent * size // (100 + per_cent))
            x = rng.integers(0, 1 << 63, 2 * size - both).astype(np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - both :])
            grams, bounds = np.concatenate([a, b]), np.array([0, size, 2 * size])
            sig, bins = neardup.signatures(grams, bounds), neardup.bin_sketch(grams, bounds)
            far += (sig[0] != sig[1]).sum() > distance
            dropped += not neardup.may_reach(bins[:1], bins[1], np.array([2 * size]), per_cent)[0]
            n += 1
    assert n > 7000 and far <= 6 and dropped == 0


def test_near_duplicates_odd_rows(spark):
    text = " ".join(words(np.random.default_rng(14), 40))
    rows = [(1, text, "x", 5), (1, text, "x", 5), (2, text + " end", "y", 6), (None, text, "z", 7), (3, None, "z", 8), (4, "", None, 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, root string, n_shingles int")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)], key=str)
    kept = neardup.one_of_each(df).collect()
    assert sorted((str(r["doc_id"]), r["root"], r["n_shingles"]) for r in kept) == [("1", "x", 5), ("3", "z", 8), ("4", None, 9), ("None", "z", 7)]


def test_quality_odd_rows(spark):
    good = " ".join(words(np.random.default_rng(15), 80, 10**6))
    rows = [(None, good, 1, "a"), (None, good, 1, "a"), (2, None, 2, "b"), (3, "", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    assert [tuple(r) for r in quality.kept_documents(df).collect()] == [(None, good, 1, "a")] * 2
    assert quality.ledger(df).count() == 4 and quality.kept_documents(df.limit(0)).count() == 0 and quality.ledger(df.limit(0)).count() == 0


def test_urls_and_licenses_odd_rows(spark):
    p = spark.createDataFrame([(1, "http://x.com/a?b=1", "k"), (1, "http://x.com/a?b=1", "k"), (2, "http://y.com/" + "a" * 100_000, "k")], "page_id long, url string, possible string")
    got = urls.judge(p, spark.createDataFrame([("x.com/a?b=1",)], "url string")).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "block"), (1, "block"), (2, "allow")]
    assert urls.judge(p.limit(0), p.select("url")).count() == 0
    mit = licenses.TEMPLATES["MIT"]
    f = spark.createDataFrame([("r/a.txt", mit, "old", 1), ("r/a.txt", mit, "old", 1), ("r/b.txt", "x " * 100_000, "old", 2), ("r/LICENSE", mit, None, 3)], "path string, text string, license string, _unit int")
    rows = licenses.scan(f).collect()
    assert sorted((r["path"], r["license"], r["origin"], r["_unit"]) for r in rows) == [("r/LICENSE", "MIT", "own", 3), ("r/a.txt", "MIT", "own", 1), ("r/a.txt", "MIT", "own", 1), ("r/b.txt", "MIT", "inherited", 2)]
    assert licenses.scan(f.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_decontamination_against_brute_force(spark):
    """Every (document, item) whose words in order reach the share within the span; recall of at least 0.9."""
    rng = np.random.default_rng(9)
    items = [words(rng, int(n), 600) for n in rng.integers(8, 48, 30)]
    texts = []
    for i in range(150):
        said = []
        for x in items[i % 30]:
            chance = rng.random()
            said += [] if chance < 0.08 else [f"v{rng.integers(600)}"] if chance < 0.08 + i % 5 * 0.07 else [x, f"v{rng.integers(600)}"] if chance > 0.94 else [x]
        texts.append(words(rng, int(rng.integers(0, 60)), 600) + said + words(rng, int(rng.integers(0, 60)), 600))
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            if lcs(x, t) >= decontam.NO_ANSWER * len(x):
                span = int(decontam.SPAN * len(x)) + 2
                if max(lcs(x, t[a : a + span]) for a in range(max(1, len(t) - span + 1))) >= decontam.NO_ANSWER * len(x):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.9 * len(want)


def test_decontamination_answers_and_spans(spark):
    bench = spark.createDataFrame([(0, "what is the capital of france", "paris"), (1, "who wrote the tale of the two old cities near the sea answer: mister dickens", None)], "item_id long, text string, answer string")
    far = "what a lovely place this is, near the old town under the sun of the south, where capital hill stands and one of the rivers of northern france ends: paris"
    texts = ["tell me what is the big capital of france it is paris", far, "who wrote this tale of those two cities near the sea answer: mister dickens", "who wrote this tale of those two cities near the sea it was someone else i think"]
    got = {(r["doc_id"], r["item_id"]): r["answer_found"] for r in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 0): True, (2, 1): True}


def test_decontamination_odd_rows(spark):
    item = " ".join(words(np.random.default_rng(1), 20))
    docs = spark.createDataFrame([(None, item, 1, "x"), (7, item, 2, "y"), (7, "clean text", 3, "z"), (7, "clean text", 3, "z"), (8, None, 4, None)], "doc_id long, text string, key long, row string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(decontam.clean_documents(docs, bench).collect(), key=str) == sorted(docs.collect()[2:], key=str)
    assert decontam.clean_documents(docs.limit(0), bench).count() == 0 and decontam.clean_documents(docs, bench.limit(0)).count() == 5


def test_words_alike_stay_apart(spark):
    """Thue-Morse words: equal for a polynomial modulo a power of two whatever its base."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    rows = quality.ledger(docs_of(spark, [f"{x} q\n{y} q"])).collect()
    assert rows[0]["n_dup_lines"] == 0
    tail = " ".join(f"w{i}" for i in range(2))
    got = neardup.near_duplicates(docs_of(spark, [f"{x} {tail}", f"{y} {tail}", f"{x} {tail}"]), 3, 85, neardup.DISTANCE).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0}


def test_decontamination_finds_passages_of_long_items(spark):
    rng = np.random.default_rng(8)
    items = [words(rng, 200) for _ in range(3)]
    noise = lambda n: " ".join(words(rng, n))
    texts = [noise(130) + " " + " ".join(items[0][50:150]) + " " + noise(90), noise(20) + " " + " ".join(items[1][:75]) + " " + noise(400), noise(100) + " " + " ".join(items[2][90:110]) + " " + noise(90)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_of(spark, texts), bench).collect()} == {(0, 0), (1, 1)}
    assert [r["doc_id"] for r in decontam.clean_documents(docs_of(spark, texts), bench).collect()] == [2]


KEY = "a key of the tests"


def test_pseudonyms(spark):
    values = ["4041894974608795", "4041-8949-7460-8795", "a.b@x.org", "q@x.org", "10.0.255.1", "+1 (988) 555-2485", "+44 20 7946 0958", "2024-02-29", "29.2.2024", "02/29/2024", "078-05-1120", "(212) 555-0187", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    x = df.select("v", pii.kind_of(F.col("v")).alias("k"), pii.replaced(F.col("v"), KEY).alias("p"))
    rows = x.select("*", pii.pseudonym(F.col("k"), F.col("p"), KEY, inverse=True).alias("back"), pii.kind_of(F.col("p")).alias("again"), pii.replaced(F.col("v"), "another key").alias("other")).collect()
    p = {r["v"]: r["p"] for r in rows}
    for r in rows:
        assert r["p"] != r["v"] and r["again"] == r["k"] and r["other"] != r["p"], r
        assert r["back"] == r["v"] or re.sub(r"\b0", "", r["back"]) == re.sub(r"\b0", "", r["v"]), r
    assert p["4041894974608795"] == p["4041-8949-7460-8795"].replace("-", "")
    assert p["+44 20 7946 0958"].startswith("+44 ") and p["+1 (988) 555-2485"].startswith("+1 (")
    y, m, d = p["2024-02-29"].split("-")
    assert [int(z) for z in p["29.2.2024"].split(".")] == [int(d), int(m), int(y)] and [int(z) for z in p["02/29/2024"].split("/")] == [int(m), int(d), int(y)]
    days = spark.range(270 * 271).select(pii.feistel_number(F.col("id"), F.lit(270), F.lit(271), F.lit(KEY)).alias("n"))
    assert days.distinct().count() == 270 * 271
    letters = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz"], "c string").select(pii.feistel_text(F.col("c"), F.lit(KEY), F.lit(pii._singles(KEY))).alias("p"), "c").collect()
    assert len({r["p"] for r in letters}) == 26 and len({(ord(r["p"]) - ord(r["c"])) % 26 for r in letters}) > 3


def test_pseudonymised_texts(spark):
    card = "4111111111111111"
    texts = [*ODD, "call +1 (988) 555-2485, now 2023-02-30 and 4041894974608796!", f"Visa 2 {card}", "2024 4111 1111 1111 1111", "4111 1111 1111 1111 2024", "31/12/1990 and 31.12.1990; 12/31/1990", "ssn 000-12-3456 078-05-1120", "phone 212-555-0187.", "IBAN DE89370400440532013000, not DE88370400440532013000"]
    rows = [(i, t, 3, "r", "m") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_replaced int, row string, made string")
    got = pii.pseudonymised(df, KEY)
    assert sorted(got.columns) == sorted(df.columns)
    out = {r["doc_id"]: r for r in got.collect()}
    n = len(ODD)
    assert [out[i]["text"] for i in range(n)] == ODD and out[0]["row"] == "r" and out[0]["made"] == "m"
    assert "2023-02-30" in out[n]["text"] and "4041894974608796" in out[n]["text"] and "555-2485" not in out[n]["text"]
    pseudonym = out[n + 1]["text"].removeprefix("Visa 2 ")
    assert pseudonym != card and out[n + 2]["text"].replace(" ", "") == "2024" + pseudonym and out[n + 3]["text"].replace(" ", "") == pseudonym + "2024"
    assert out[n + 4]["n_replaced"] == 3
    assert "000-12-3456" in out[n + 5]["text"] and "078-05-1120" not in out[n + 5]["text"] and "555-0187" not in out[n + 6]["text"]
    assert "DE88370400440532013000" in out[n + 7]["text"] and "DE89370400440532013000" not in out[n + 7]["text"]
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0
    assert pii.pseudonymised(df.union(df), KEY).distinct().count() == len(texts)
    with pytest.raises(ValueError):
        pii.pseudonymised(df, "")


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    rows = [("r/LICENSE", mit), ("r/a/x.py", "code"), ("r/a/b/y.py", "code"), ("r/a/COPYING", apache), ("r/c/z.py", "# all rights reserved\ncode"), ("q/x.py", "code"), (None, None), ("top", "")]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["r/a/x.py"]["license"] == "Apache-2.0" and got["r/a/b/y.py"]["licensed_by"] == "r/a"
    assert (got["r/c/z.py"]["license"], got["r/c/z.py"]["origin"]) == ("Proprietary", "own")
    assert got["q/x.py"]["license"] is None and got[None]["license"] is None and got["r/LICENSE"]["cosine"] == pytest.approx(1)


def test_licenses_against_brute_force(spark):
    """TF-IDF cosines of single lines to templates, and inheritance from the nearest directory, restated."""
    import math

    rng = np.random.default_rng(17)
    templates = {f"L{k}": " ".join(f"t{chr(97 + x)}" for x in rng.integers(0, 20, 7)) for k in range(6)}
    rows = []
    for i in range(200):
        folder = "/".join(["r", *(f"d{x}" for x in rng.integers(0, 3, rng.integers(0, 4)))])
        name = "LICENSE" if rng.random() < 0.12 else f"f{i}.txt"
        lines = [" ".join(f"t{chr(97 + x)}" for x in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(4)]
        if rng.random() < 0.4:
            said = templates[f"L{rng.integers(0, 6)}"].split()
            lines[1] = " ".join(said[: rng.integers(3, 8)])
        rows.append((f"{folder}/{name}", "\n".join(lines), i))
    words_in = [set(re.findall("[a-z]+|[0-9]+", t)) for _, t, _ in rows]
    df = Counter(w for s in words_in for w in s)
    idf = lambda w: math.log((1 + len(rows)) / (1 + max(df[w], len(rows) / licenses.RAREST))) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(re.findall("[a-z]+|[0-9]+", t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    made = {k: vector(t) for k, t in templates.items()}
    own = {}
    for path, text, i in rows:
        for line in text.split("\n"):
            v = vector(line)
            for k, x in made.items():
                c = round(sum(v.get(w, 0) * y for w, y in x.items()) / norm(v) / norm(x), 9)
                if c >= licenses.MIN_COSINE:
                    own[i] = max(own.get(i, (0, "")), (c, k))
    given = {}
    for path, _, i in rows:
        folder, name = path.rsplit("/", 1)
        if name == "LICENSE" and i in own:
            given[folder] = max(given.get(folder, (0, "")), own[i])
    got = {r["i"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, i int"), templates).collect()}
    for path, _, i in rows:
        ups = ["/".join(path.split("/")[:n]) for n in range(path.count("/"), 0, -1)]
        near = next((u for u in ups if u in given), None)
        want = (own[i][1], "own", None) if i in own else (given[near][1], "inherited", near) if near else (None, None, None)
        assert (got[i]["license"], got[i]["origin"], got[i]["licensed_by"]) == want, (path, want, got[i])
        assert i not in own or got[i]["cosine"] == pytest.approx(own[i][0], abs=1e-8)
    assert len(own) > 40 and sum(r["origin"] == "inherited" for r in got.values()) > 40


def test_licenses_of_headers_and_whole_texts(spark):
    mark = lambda t: "\n".join(f" * {x}".rstrip() for x in t.split("\n"))
    code = "\nint main(void) { return compute(42); }\n" * 30
    texts = {name: text.replace("<year> <copyright holders>", "2021 Jane Doe") for name, text in license_templates.TEXTS.items()}
    rows = [(f"whole/{k}", t) for k, t in texts.items()] + [(f"comment/{k}", f"/*\n{mark(texts[k])}\n */{code}") for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib")]
    gnu = "This file is part of Foo.\n\nThis {w} is free software: you can redistribute it and/or modify it under\nthe terms of the GNU {n} as published by the\nFree Software Foundation, either version {v} of the License, or\n(at your option) any later version."
    rows += [("header/GPL-3.0", mark(gnu.format(w="program", n="General Public License", v=3)) + code), ("header/GPL-2.0", mark(gnu.format(w="program", n="General Public License", v=2)) + code), ("header/AGPL-3.0", mark(gnu.format(w="program", n="Affero General Public License", v=3)) + code)]
    rows += [("header/Apache-2.0", mark(license_templates.HEADERS[0][1].replace(". ", ".\n")) + code)]
    lines = {"Apache-2.0": "// SPDX-License-Identifier: Apache-2.0", "MIT OR Apache-2.0": "# SPDX-License-Identifier: MIT OR Apache-2.0", "MPL-2.0": "Mozilla Public License Version 2.0", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "LGPL": "GNU LESSER GENERAL PUBLIC LICENSE", "GPL-2.0": "GNU General Public License version 2", "CC-BY-4.0": "Licensed under CC BY 4.0."}
    rows += [(f"line/{k}", f"{t}\n{code}") for k, t in lines.items()]
    rng = np.random.default_rng(6)
    none = ["License", "the version 2.0 of the library", "You need a license to drive and permission of the owner to park in this street, said the warden to us.", "the copyright"]
    rows += [(f"none/{i}", t) for i, t in enumerate(none)] + [(f"noise/{i}", " ".join(words(rng, 60)) + " the of and to in this is a you") for i in range(100)]
    got = {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame([(p.replace("/", "_"), t) for p, t in rows], "path string, text string")).collect()}
    want = {p.replace("/", "_"): None if p.startswith(("none", "noise")) else p.partition("/")[2] for p, _ in rows}
    assert {p: (got[p], want[p]) for p in want if got[p] != want[p]} == {}
    lowered = [t.lower() for t in [*license_templates.TEXTS.values(), *(t for _, t in license_templates.HEADERS)]]
    assert all(any(a in t for a in licenses.ANCHORS) for t in lowered)


def threads(rng):
    """Rows of conversations in which messages quote earlier ones, wrapped anew at other widths; parents and own texts."""
    import textwrap

    rows, parent, own = [], {}, {}
    for conv in range(6):
        for turn in range(25):
            own[conv, turn] = " ".join(words(rng, int(rng.integers(8, 40))))
            up = int(rng.integers(0, turn)) if turn and rng.random() < 0.8 else None
            parent[conv, turn] = up
            text = "\n".join(textwrap.wrap(own[conv, turn], 70))
            if up is not None:
                quoted = "\n".join("> " + x for x in textwrap.wrap(own[conv, up], int(rng.integers(20, 60))))
                if (higher := parent[conv, up]) is not None and rng.random() < 0.5:
                    quoted = "\n".join("> > " + x for x in textwrap.wrap(own[conv, higher], 30)) + "\n" + quoted
                text = quoted + "\n" + text if rng.random() < 0.7 else text + "\n" + quoted
            rows.append((conv, turn, "u", text, 1, "kept"))
    return rows, parent, own


def test_quotes_oracle_on_quotes(spark):
    import pandas as pd

    rows = [r[:4] for r in threads(np.random.default_rng(16))[0]] + [(7, 0, "u", ">>> print(1)\nsays the prompt"), (7, 1, "a", "> says the prompt\n> never said by anyone\nyes"), (7, 2, "u", "> yes\nno"), (None, 0, "u", "> a b c d"), (7, 3, None, None)]
    con = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})
    con.register("conversations", conversations)
    want = con.sql(quotes.ORACLE_SQL["op7_quotes"])
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there, my friend.\nHow are you today?"), (1, 1, "a", "> Hello there, my\n> friend. How are you\n> today?\nFine, thank you very much."), (1, 2, "u", "A new topic that nobody knows"),
        (1, 3, "u", "> > Hello there, my friend.\n> Fine, thank you\n> very much.\nGood to know."), (1, 4, "a", ">a new TOPIC that nobody knows!\nok"), (1, 5, "u", "> never said by anybody\nwhat"), (1, 6, "u", ">>> print(1)\nin Python"),
        (1, 7, "u", "> Hello there, my friend.\nLate reply"), (2, 0, "u", None), (None, None, None, "> x"), (2, 1, "u", ""), (3, 0, "u", "> Hello there, my friend.\nother conversation"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t]["parent_turn"] for t in range(8)] == [None, 0, None, 1, 2, None, None, 0] and got[3, 0]["parent_turn"] is None
    assert [(got[1, t]["root_turn"], got[1, t]["depth"], got[1, t]["thread_position"]) for t in range(8)] == [(0, 0, 0), (0, 1, 1), (2, 0, 0), (0, 2, 2), (2, 1, 1), (5, 0, 0), (6, 0, 0), (0, 1, 3)]
    assert [got[1, t]["text"] for t in (1, 3, 5, 6)] == ["Fine, thank you very much.", "Good to know.", "> never said by anybody\nwhat", ">>> print(1)\nin Python"]
    assert (got[1, 3]["n_quoted"], got[1, 3]["n_linked"]) == (2, 2) and got[2, 0]["text"] is None and got[None, None]["text"] == "> x" and len(got) == len(rows)


def test_quotes_against_generated_threads(spark):
    """Nested quotes wrapped anew at other widths; parents and depth-first order as planted."""
    rows, parent, own = threads(np.random.default_rng(11))
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, depth int, row string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert {k: r["parent_turn"] for k, r in got.items()} == parent and all(r["row"] == "kept" for r in got.values())
    assert all(" ".join(got[k]["text"].split()) == own[k] for k in own)
    ordered = [(r["conv_id"], r["turn"]) for r in quotes.in_order(quotes.link_quotes(df)).collect()]
    want = []
    for conv in range(6):
        def visit(turn, conv=conv):
            want.append((conv, turn))
            for t in range(25):
                if parent[conv, t] == turn:
                    visit(t)

        for t in range(25):
            if parent[conv, t] is None:
                visit(t)
    assert ordered == want
    empty = quotes.link_quotes(df.limit(0))
    assert empty.count() == 0 and set(quotes.MADE) < set(empty.columns)
