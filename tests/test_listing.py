"""Listings by page give what a scan of everything gives, and read no page more."""

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import catalog as ct
from framelake.sources import listing


def test_pages_are_read_until_enough(spark):
    rng = np.random.default_rng(0)
    rows = []
    for source, n, top in (("long", 120, 60), ("few numbers", 70, 2), ("short", 7, 9), ("unusable", 40, 30)):
        for i in range(n):
            title = f"Chapter {rng.integers(1, top + 1)}" if rng.random() < 0.7 else "Prologue"
            rows.append((source, i * 3, "[Deleted video]" if source == "unusable" and i % 2 else title, i // 10))
    table = spark.createDataFrame(rows, "source string, idx int, title string, page int").cache()
    asked = []

    def fetch(which):
        asked.append(sorted((r["source"], r["page"]) for r in which.collect()))
        return table.join(which, ["source", "page"]).drop("page")

    sources = spark.createDataFrame([("long",), ("few numbers",), ("short",), ("unusable",), ("none",), ("long",), (None,)], "source string")
    got, pages = listing.listed(sources, fetch, 8, extra=6, limit=45)
    want = ct.scanned(table.drop("page"), 8, extra=6, limit=45)
    plain = lambda d: sorted((r["source"], r["idx"], r["title"]) for r in d.collect())
    assert plain(got) == plain(want)
    read = {r["source"]: r["pages"] for r in pages.collect()}
    last = {}
    for s, i, t in plain(want):
        last[s] = max(last.get(s, -1), i // 3)
    usable = {s: sum(1 for r in rows if r[0] == s and r[2] != "[Deleted video]") for s in last}
    taken = {s: sum(1 for x in plain(want) if x[0] == s) for s in last}
    for s in last:
        pages_of = 1 + max(r[3] for r in rows if r[0] == s)
        assert read[s] == (pages_of if taken[s] == usable[s] and last[s] // 10 + 1 == pages_of else last[s] // 10 + 1)
    assert read["none"] == 0 and read["long"] < 12 and read["few numbers"] < 7
    # no source is asked for a page after it has ended or shown enough
    counts = {s: sum((s, k) in a for k, a in enumerate(asked)) for s in ("long", "few numbers", "short", "none")}
    assert counts["long"] == read["long"] and counts["none"] == 1 and counts["short"] == 2
    assert listing.listed(sources.limit(0), fetch, 8)[0].count() == 0
