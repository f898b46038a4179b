"""Pseudonyms against a plain Feistel network, and the query's documented key."""

import datetime
import hashlib
import hmac
import re

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import pii

KEY = "a key for this test"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def secret(kind, key=KEY):
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()


def digest(s, i, half):
    return hashlib.sha256(f"{s}|{i}|{half}".encode()).hexdigest()


def plain_number(n, a, b, s):
    left, right = divmod(n, b)
    for i in range(6):
        by = int(digest(s, i, right if i % 2 == 0 else left)[:12], 16)
        if i % 2 == 0:
            left = (left + by) % a
        else:
            right = (right + by) % b
    return left * b + right


def plain_text(x, s):
    left, right = x[: len(x) // 2], x[len(x) // 2 :]

    def moved(half, d):
        out = ""
        for k, c in enumerate(half):
            by = int(d[k * 2 % 64 : k * 2 % 64 + 2], 16)
            alphabet = next((z for z in (LOWER, UPPER, "0123456789") if c in z), None)
            out += alphabet[(alphabet.index(c) + by) % len(alphabet)] if alphabet else c
        return out

    for i in range(6):
        if i % 2 == 0:
            left = moved(left, digest(s, i, right))
        else:
            right = moved(right, digest(s, i, left))
    return left + right


def plain_pseudonym(v):
    if re.fullmatch(r"[\d.]+", v):
        n = 0
        for x in v.split("."):
            n = n * 256 + int(x)
        n = plain_number(n, 1 << 16, 1 << 16, secret("ipv4"))
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
        first = datetime.date(1900, 1, 1)
        n = plain_number((datetime.date.fromisoformat(v) - first).days, 270, 271, secret("date"))
        return (first + datetime.timedelta(n)).isoformat()
    area, group, serial = map(int, v.split("-"))
    n = plain_number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, secret("ssn"))
    high = n // (99 * 9999) + 1
    return f"{high + (high >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def test_numbers_against_a_plain_network(spark):
    rng = np.random.default_rng(0)
    values = [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(40)] + ["0.0.0.0", "255.255.255.255"]
    values += [(datetime.date(1900, 1, 1) + datetime.timedelta(int(d))).isoformat() for d in rng.integers(0, 270 * 271, 40)] + ["1900-01-01", "2099-12-31"]
    values += [f"{a if a != 666 else 665:03d}-{g:02d}-{s:04d}" for a, g, s in zip(rng.integers(1, 900, 40), rng.integers(1, 100, 40), rng.integers(1, 10000, 40))] + ["899-99-9999", "001-01-0001", "667-01-0001", "665-99-9999"]
    text = "; ".join(f"({v})" for v in values)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate([*values, text])], "doc_id int, text string, `a.b` int")
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, KEY).collect()}
    want = [plain_pseudonym(v) for v in values]
    assert [got[i]["text"] for i in range(len(values))] == want
    assert got[len(values)]["text"] == "; ".join(f"({v})" for v in want) and got[0]["a.b"] == 1
    assert got[len(values)]["n_replaced"] == sum(a != b for a, b in zip(values, want))


def test_texts_against_a_plain_network(spark):
    rng = np.random.default_rng(1)
    values = ["".join(rng.choice(list(LOWER + UPPER + "0123456789.-_+"), rng.integers(2, 90))) for _ in range(120)] + ["é1ü", "..", "aZ"]
    x = pii.feistel_text(F.col("v"), F.lit(secret("email")), F.lit(pii._singles(secret("email"))))
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", x.alias("x")).orderBy("k").collect()]
    assert got == [plain_text(v, secret("email")) for v in values]


def test_the_query_has_one_key(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_replaced"]) for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((r["doc_id"], r["text"], r["n_replaced"]) for r in pii.pseudonymised(docs, pii.TEST_KEY).collect())


def test_runs_of_digits_have_no_greatest_length(spark):
    # a matcher that calls itself for each digit ends the whole process here
    card, more = " ".join("0" * 16), " 0" * 20_000
    texts = [card, card + more, "7" * 20_000, "7-" * 10_000]
    got = {r["k"]: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), KEY).collect()}
    assert got[0]["text"] != card and got[0]["n_replaced"] == 1
    assert got[1]["text"] == got[0]["text"] + more and got[1]["n_replaced"] == 1
    assert got[2]["text"] == texts[2] and got[2]["n_replaced"] == 0
    assert len(got[3]["text"]) == 20_000 and sum(a != b for a, b in zip(got[3]["text"], texts[3])) <= 19
