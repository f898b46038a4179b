"""The cache computes what is new, changed or expired, and nothing else."""

import pytest
from pyspark.sql import functions as F

from framelake.sources.cache import Cache, params_key


def test_params_key():
    assert params_key("k", {"a": 1, "b": [2]}) == params_key("k", {"b": [2], "a": 1}) != params_key("k", {"a": 1, "b": [3]})
    assert params_key("k", {}) != params_key("l", {}) and len(params_key("k", {})) == 20


def test_only_new_keys_are_computed(spark, tmp_path):
    c, asked = Cache(spark, f"file://{tmp_path}/c", ttl_ms=1000), []

    def square(todo):
        asked.append(sorted((r["g"] is None, r["g"] or 0) for r in todo.collect()))
        return todo.select("g", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("x", F.coalesce("g", F.lit(-1)) * F.col("k")).where("g is null or g <> 99")

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "g int")
    rows = lambda d: sorted((r["g"] is None, r["g"] or 0, r["k"], r["x"], r["made_ms"]) for r in d.collect())
    first, n = c.get(keys(1, 2, None, 2), ["g"], square, "sq", {"p": 1}, 10_000)
    assert n == 3 and rows(first) == [(False, 1, 1, 1, 10_000), (False, 1, 2, 2, 10_000), (False, 2, 1, 2, 10_000), (False, 2, 2, 4, 10_000), (True, 0, 1, -1, 10_000), (True, 0, 2, -2, 10_000)]
    second, n = c.get(keys(2, 3, None), ["g"], square, "sq", {"p": 1}, 10_500)
    assert n == 1 and asked[-1] == [(False, 3)]
    assert rows(second) == [(False, 2, 1, 2, 10_000), (False, 2, 2, 4, 10_000), (False, 3, 1, 3, 10_500), (False, 3, 2, 6, 10_500), (True, 0, 1, -1, 10_000), (True, 0, 2, -2, 10_000)]
    _, n = c.get(keys(2, 3), ["g"], square, "sq", {"p": 1}, 10_600)
    assert n == 0 and asked[-1] == []
    # other parameters are other results
    _, n = c.get(keys(2), ["g"], square, "sq", {"p": 2}, 10_700)
    assert n == 1
    # the first run has expired, the second has not
    late, n = c.get(keys(1, 3), ["g"], square, "sq", {"p": 1}, 11_200)
    assert n == 1 and asked[-1] == [(False, 1)] and {r["made_ms"] for r in late.collect()} == {10_500, 11_200}
    assert c.expire(11_600) == 2 and c.expire(11_600) == 0
    again, n = c.get(keys(1, 2, 3), ["g"], square, "sq", {"p": 1}, 11_700)
    assert n == 2 and asked[-1] == [(False, 2), (False, 3)]
    # keys without results are asked for again, and leave nothing behind
    for now in (11_800, 11_801):
        _, n = c.get(keys(99), ["g"], square, "sq", {"p": 1}, now)
        assert n == 0 and asked[-1] == [(False, 99)]
    with pytest.raises(FileExistsError):
        c.get(keys(7), ["g"], square, "sq", {"p": 1}, 11_700)
    assert Cache(spark, f"file://{tmp_path}/none", 5).expire(0) == 0
    empty, n = c.get(keys(), ["g"], square, "sq", {"p": 3}, 1)
    assert n == 0 and empty.count() == 0
