"""Sources and sinks (IO1-IO7): table directories in, Parquet/CSV out.

Pickle, torch and Excel codecs of the reference become Parquet and CSV.
Reads take explicit schemas where given; NaN becomes NULL at ingest.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.sources.bucketed import layout, load_bucketed, save_bucketed

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL in every float/double column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def list_names(spark: SparkSession, directory: str) -> list[str]:
    """Names of the tables (files, or folders with files) in a directory of any file
    system that Spark reads; listed by Spark, no file is opened."""
    if "://" not in directory and not directory.startswith(("/", "file:")):
        directory = os.path.abspath(directory)
    root = re.sub(_SCHEME, "", directory).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    path = F.regexp_replace("path", _SCHEME, "")
    first = F.split(F.substring(path, len(root) + 1, 1 << 20), "/")[0]
    return sorted(r[0] for r in files.select(first.alias("name")).distinct().collect())  # one name a table


def load_tables(spark: SparkSession, directory: str, names: Sequence[str] | None = None,
                schemas: Mapping[str, T.StructType] | None = None,
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """IO1: one DataFrame per table file of a directory (``<name>.<fmt>`` or a
    ``<name>`` folder).  Lazy: nothing is read until an action."""
    schemas = schemas or {}
    present = [f for f in list_names(spark, directory) if not f.startswith(("_", "."))]
    if names is None:
        names = sorted({f.rsplit(".", 1)[0] for f in present})
    out = {}
    for n in names:
        path = f"{directory}/{n}.{fmt}" if f"{n}.{fmt}" in present else f"{directory}/{n}"
        r = spark.read
        if n in schemas:
            r = r.schema(schemas[n])
        if fmt == "csv":
            df = r.option("header", True).csv(path)
        else:
            df = r.format(fmt).load(path)
        out[n] = nan_to_null(df)
    return out


def load_bundle(spark: SparkSession, directory: str, exclude: str = "cols") -> dict[str, DataFrame]:
    """IO3: load an intermediate bundle, skipping names containing ``exclude``;
    tables of a bucketed layout keep it."""
    names = [n for n in list_names(spark, directory) if exclude not in n and not n.startswith(("_", "."))]
    out = {}
    for n in names:
        spec = layout(spark, f"{directory}/{n}")
        out[n] = load_bucketed(spark, f"{directory}/{n}", spec) if spec else spark.read.parquet(f"{directory}/{n}")
    return out


def load_label_map(spark: SparkSession, path: str, key: str = "itemid",
                   label: str = "REALITEM") -> DataFrame:
    """IO2: reviewed item -> label sheet (CSV), rows without a label dropped."""
    df = spark.read.option("header", True).csv(path).select(F.col(key).cast("string").alias("itemid"),
                                                           F.col(label).alias("label"))
    return df.where(F.col("label").isNotNull())


def save_bundle(tables: Mapping[str, DataFrame], directory: str, partition_by: Sequence[str] = (),
                bucket_by: Sequence[str] = (), buckets: int = 0) -> None:
    """IO4 / IO6: write each table as Parquet (overwrite).  ``bucket_by`` with a
    number of ``buckets``: tables with these columns are bucketed and sorted by
    them (``sources/bucketed.py``), so joins on them need no exchange."""
    for n, df in tables.items():
        split = list(partition_by) if all(c in df.columns for c in partition_by) else []
        if buckets and bucket_by and all(c in df.columns for c in bucket_by):
            save_bucketed(df, f"{directory}/{n}", bucket_by, buckets, split)
            continue
        w = df.write.mode("overwrite")
        if split:
            w = w.partitionBy(*split)
        w.parquet(f"{directory}/{n}")


def save_report(df: DataFrame, path: str) -> None:
    """IO5: report-sized table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per loaded table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_type_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """IO7: for every string column: rows, non-null values and values that
    parse as a number - one aggregate pass, long form."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    aggs = []
    for c in cols:
        aggs += [F.count(F.lit(1)).alias(f"{c}__n"), F.count(c).alias(f"{c}__nn"),
                 F.count(F.col(c).try_cast("double")).alias(f"{c}__num")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_rows"),
                 F.col(f"{c}__nn").alias("n_nonnull"), F.col(f"{c}__num").alias("n_numeric"))
        for c in cols])).alias("_s")).select("_s.*")
