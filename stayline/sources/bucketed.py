"""Bucketed layout (IO4 / IO6): tables of a bundle hashed into the same number of
buckets by their stay key and sorted inside each, so that every later join and
grouping on that key finds its rows together and needs no exchange.

A table is written through a Spark catalog table of its own folder, and its layout
(keys, number of buckets, partition columns, schema) beside it in ``_layout``; reading
declares the table again from that, so it works in any session and without a
metastore.  The bucket number must be equal for all tables that are to be joined; it
should make buckets of 100 MB to 1 GB of the largest table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.expr import col as Q_

LAYOUT = "_layout"


def _name(path: str) -> str:
    return "stayline_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _quoted(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def save_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes ``df`` (overwrite) and returns it as read back."""
    spark, keys, partition_by = df.sparkSession, list(keys), list(partition_by)
    df = df.select(*[Q_(c) for c in df.columns if c not in partition_by], *[Q_(c) for c in partition_by])
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    # the exchange hashes as the buckets do: one file per bucket (and partition value)
    w = df.repartition(buckets, *[Q_(k) for k in keys]).write.format("parquet").mode("overwrite").option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_name(path))
    spec = {"keys": keys, "buckets": buckets, "partition_by": partition_by, "schema": df.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")
    return load_bucketed(spark, path)


def layout(spark: SparkSession, path: str) -> dict | None:
    """The layout of a table's folder; none: an ordinary one."""
    try:
        return json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])
    except AnalysisException:
        return None


def load_bucketed(spark: SparkSession, path: str, spec: dict | None = None) -> DataFrame:
    """The table of a folder written by ``save_bucketed``."""
    spec = spec or layout(spark, path)
    if spec is None:
        raise ValueError(f"{path} has no bucketed layout")
    schema = T.StructType.fromJson(spec["schema"])
    columns = ", ".join(f"{_quoted([f.name])} {f.dataType.simpleString()}" for f in schema.fields)
    split = f"PARTITIONED BY ({_quoted(spec['partition_by'])})" if spec["partition_by"] else ""
    by = _quoted(spec["keys"])
    where = path.replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet {split} CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {spec['buckets']} BUCKETS LOCATION '{where}'")
    if spec["partition_by"]:
        spark.catalog.recoverPartitions(_name(path))
    return spark.table(_name(path)).select(*[F.col(f"`{f.name}`") for f in schema.fields])
