"""Resumable chains (P1-P9): stage outputs with names, and a manifest of what is done.

A stage is a function that gives tables.  Its folder is named by a digest of what it
depends on: its name and parameters, the digests of the stages before it, and that of
the source files.  The tables are written there, then the manifest; a stage with a
manifest is read instead of run.  So a chain that failed, or whose driver was lost,
goes on after its last finished stage; a changed parameter or source file runs the
stages that depend on it and no others; a half-written stage is overwritten.

Figures taken while a table is written (Spark observations: one pass, no added job)
are kept in the manifest and so survive a restart as well.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stayline.sources.bucketed import load_bucketed, save_bucketed

DONE = "_done"


def source_digest(spark: SparkSession, *paths: str) -> str:
    """Digest of the files below the paths: names, lengths and times of change
    (a listing on the executors; no file is read)."""
    rows = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        mark = F.xxhash64("path", "length", F.col("modificationTime").cast("timestamp").cast("double"))
        r = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(mark)).first()
        rows.append([path, *map(str, r)])
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


class Stages:
    """Stage outputs below ``folder`` (in the store that the whole cluster shares)."""

    def __init__(self, spark: SparkSession, folder: str, source: str = "", bucket_by: Sequence[str] = (),
                 buckets: int = 0):
        """``bucket_by``: tables with all of these columns are written bucketed by them."""
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source
        self.bucket_by, self.buckets = list(bucket_by), buckets
        self.digest: dict[str, str] = {}
        self.metrics: dict[str, dict] = {}
        self.ran: list[str] = []

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{self.digest[name][:16]}"

    def _manifest(self, name: str) -> dict | None:
        try:
            return json.loads(self.spark.read.text(f"{self._path(name)}/{DONE}").first()["value"])
        except AnalysisException:
            return None

    def _bucketed(self, df: DataFrame) -> bool:
        return bool(self.buckets and self.bucket_by and all(k in df.columns for k in self.bucket_by))

    def run(self, name: str, make: Callable[[], Mapping[str, DataFrame]], after: Sequence[str] = (),
            params: object = None, observe: Mapping[str, Callable[[DataFrame], Mapping[str, Column]]] | None = None
            ) -> dict[str, DataFrame]:
        """The stage's tables, as written.  ``after``: stages its function reads;
        ``observe``: per table, aggregates taken while it is written."""
        key = [name, self.source, params, self.bucket_by, self.buckets, [self.digest[a] for a in after]]
        self.digest[name] = hashlib.sha256(json.dumps(key, default=str).encode()).hexdigest()
        done = self._manifest(name)
        if done is None:
            self.ran.append(name)
            done = {"tables": {}, "metrics": {}}
            for t, df in make().items():
                seen = None
                if observe and t in observe:
                    seen = Observation()
                    df = df.observe(seen, *[c.alias(m) for m, c in observe[t](df).items()])
                if self._bucketed(df):
                    save_bucketed(df, f"{self._path(name)}/{t}", self.bucket_by, self.buckets)
                    done["tables"][t] = "bucketed"
                else:
                    df.write.mode("overwrite").parquet(f"{self._path(name)}/{t}")
                    done["tables"][t] = "parquet"
                if seen is not None:
                    done["metrics"][t] = seen.get
            self.spark.createDataFrame([(json.dumps(done, default=str),)], "value string").coalesce(1).write.mode(
                "overwrite").text(f"{self._path(name)}/{DONE}")
        self.metrics[name] = done["metrics"]
        read = {"bucketed": lambda p: load_bucketed(self.spark, p), "parquet": self.spark.read.parquet}
        return {t: read[kind](f"{self._path(name)}/{t}") for t, kind in done["tables"].items()}


class Memory:
    """The same chain without a folder: tables are checkpointed, nothing is resumed."""

    def __init__(self):
        self.metrics: dict[str, dict] = {}

    def run(self, name, make, after=(), params=None, observe=None) -> dict[str, DataFrame]:
        from stayline.session import cut_lineage
        out, self.metrics[name] = {}, {}
        for t, df in make().items():
            if observe and t in observe:
                seen = Observation()
                out[t] = cut_lineage(df.observe(seen, *[c.alias(m) for m, c in observe[t](df).items()]))
                self.metrics[name][t] = seen.get
            else:
                out[t] = cut_lineage(df)
        return out
