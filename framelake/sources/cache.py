"""Results kept by key and parameters, so that a later run computes only what is new or has expired."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def params_key(kind: str, params: dict) -> str:
    """20 hex digits that name a kind of result and its parameters, in whatever order they are given."""
    return hashlib.sha1(json.dumps([kind, params], sort_keys=True).encode()).hexdigest()[:20]


class Cache:
    """A folder of results: one folder for each kind and parameters, in it one for each run, named by its time in milliseconds.

    Runs only add files, and a run's folder has its final name only once it is whole, so a run that is lost leaves
    nothing that counts. Which runs are fresh is read from folder names: expired ones are neither listed nor read.
    Any store that Spark can write to will do.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_ms: int | None = None) -> None:
        self.spark, self.path, self.ttl_ms = spark, path.rstrip("/"), ttl_ms

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def runs(self, key: str, now_ms: int) -> list[tuple[int, str]]:
        """(time, folder) of the fresh runs of a kind and parameters."""
        fs, p = self._fs(f"{self.path}/{key}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        times = sorted(int(n[5:]) for n in names if n.startswith("made="))
        return [(t, f"{self.path}/{key}/made={t}") for t in times if self.ttl_ms is None or t > now_ms - self.ttl_ms]

    def get(self, wanted: DataFrame, on: list[str], compute: Callable[[DataFrame], DataFrame], kind: str, params: dict, now_ms: int) -> tuple[DataFrame, int]:
        """The results of the rows of ``wanted`` (distinct ``on``), with ``made_ms``, and how many keys were computed now.

        ``compute`` takes the keys that no fresh run has and returns rows with the columns ``on`` and others, any number for a
        key; keys without rows are asked for again. Of several runs with a key the latest counts. Null keys are keys.
        """
        key, on_keys = params_key(kind, params), wanted.select(*on).distinct()
        fresh = self.runs(key, now_ms)
        have = self._read(fresh) if fresh else None
        todo = on_keys if have is None else self._without(on_keys, have.select(*on).distinct(), on)
        made = compute(todo)
        fs, final = self._fs(f"{self.path}/{key}/made={now_ms}")
        if fs.exists(final):
            raise FileExistsError(f"a run of {now_ms} is there already")
        _, draft = self._fs(f"{self.path}/{key}/_draft-{now_ms}")
        made.write.mode("overwrite").parquet(draft.toString())
        n = self.spark.read.schema(made.schema).parquet(draft.toString()).select(*on).distinct().count()
        if n:
            fs.rename(draft, final)
        else:
            fs.delete(draft, True)
        runs = self.runs(key, now_ms)
        if not runs:
            return made.where("false").withColumn("made_ms", F.lit(0).cast("long")), 0
        every = self._read(runs, made.schema)
        # a key is in several runs only if it expired between them or was asked for twice at once
        last = every.groupBy(*on).agg(F.max("made_ms").alias("_last"))
        newest = self._matching(every, last, on, "inner").where("made_ms = _last").drop("_last")
        return self._matching(newest, on_keys, on, "left_semi"), n

    def expire(self, now_ms: int) -> int:
        """Deletes the folders of expired runs of every kind; how many they were."""
        fs, p = self._fs(self.path)
        gone = 0
        for kind in fs.listStatus(p) if fs.exists(p) and self.ttl_ms is not None else []:
            for run in fs.listStatus(kind.getPath()):
                name = run.getPath().getName()
                if name.startswith("made=") and int(name[5:]) <= now_ms - self.ttl_ms:
                    gone += fs.delete(run.getPath(), True)
        return gone

    def _read(self, runs: list[tuple[int, str]], schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        x = reader.parquet(*[path for _, path in runs])
        made = F.regexp_extract(F.col("_metadata.file_path"), r"/made=(\d+)/", 1).cast("long")
        return x.select("*", made.alias("made_ms"))

    @staticmethod
    def _matching(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        """A join in which null keys are equal; columns of ``on`` once."""
        r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return left.join(r, same, how).drop(*[f"_r_{c}" for c in on])

    def _without(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return self._matching(left, right, on, "left_anti")
