"""Sources and sinks: load a directory, label sheet, bundle round trip, report."""

import os
import tempfile

from pyspark.sql import functions as F

from stayline.sources import tables as IO


def test_load_tables_and_sizes(spark):
    t = IO.load_tables(spark, "/root/testdata/sf0.001", names=["region", "nation", "events"])
    sizes = {r["table_name"]: r["n_rows"] for r in IO.table_sizes(t).collect()}
    assert sizes == {"region": 5, "nation": 25, "events": 1000}


def test_nan_to_null_and_profile(spark):
    df = spark.createDataFrame([(float("nan"), "1.5"), (2.0, "abc"), (None, None)], "x double, s string")
    assert [r["x"] for r in IO.nan_to_null(df).collect()] == [None, 2.0, None]
    prof = IO.column_type_profile(df).collect()
    assert [(r["column"], r["n_rows"], r["n_nonnull"], r["n_numeric"]) for r in prof] == [("s", 3, 2, 1)]


def test_bundle_round_trip_and_label_sheet(spark):
    d = tempfile.mkdtemp(prefix="stayline-test-")
    a = spark.range(10).withColumn("split", F.when(F.col("id") < 5, "Train").otherwise("Test"))
    IO.save_bundle({"x_static": a, "x_static_cols": a}, d, partition_by=["split"])
    back = IO.load_bundle(spark, d)
    assert set(back) == {"x_static"} and back["x_static"].count() == 10
    sheet = os.path.join(d, "sheet.csv")
    with open(sheet, "w") as f:
        f.write("itemid,REALITEM\n220045,Heart Rate\n220046,\n")
    lm = IO.load_label_map(spark, sheet).collect()
    assert [(r["itemid"], r["label"]) for r in lm] == [("220045", "Heart Rate")]
    IO.save_report(a.groupBy("split").count(), os.path.join(d, "report"))
    assert any(n.endswith(".csv") for n in os.listdir(os.path.join(d, "report")))
