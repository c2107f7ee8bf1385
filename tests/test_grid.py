"""Panel, window and as-of edge rows (FIXTURES.md section 4)."""

import math

from pyspark.sql import functions as F

from stayline.functions import expr as X
from stayline.operators import grid, windows as W
from tests.conftest import ts

K = ["id"]


def _series(spark, vals, col="v", start="2024-01-01 00:00:00"):
    import datetime as dt
    t0 = dt.datetime.fromisoformat(start)
    rows = [(1, t0 + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, f"id int, hour timestamp_ntz, {col} double")


def _col(df, c, order="hour"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_hourly_grid_median_of_timestamp_means(spark):
    rows = [(1, ts("2024-01-01 10:10:00"), "x", 1.0), (1, ts("2024-01-01 10:10:00"), "x", 3.0),
            (1, ts("2024-01-01 10:50:00"), "x", 9.0), (1, ts("2024-01-01 13:05:00"), "x", 5.0),
            (1, ts("2024-01-01 11:30:00"), "y", None)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz, label string, v double")
    g = grid.hourly_grid(df, K, "t", "label", "v", ["x", "y"])
    got = [(r["hour"].hour, r["x"]) for r in g.orderBy("hour").collect()]
    assert got == [(10, 5.5), (11, None), (12, None), (13, 5.0)]


def test_limited_fill(spark):
    df = _series(spark, [1, None, None, None, 2])
    out = df.withColumn("f", W.ffill_col("v", K, limit=2))
    assert _col(out, "f") == [1, 1, 1, None, 2]


def test_code_status(spark):
    rows = [(1, ts("2024-01-01 00:00:00"), None, None), (1, ts("2024-01-01 01:00:00"), 1.0, 1.0),
            (1, ts("2024-01-01 02:00:00"), 1.0, None), (1, ts("2024-01-01 03:00:00"), None, None)]
    df = spark.createDataFrame(rows, "id int, hour timestamp_ntz, dnr double, full double")
    out = W.latest_state(df, K, "dnr", "full").orderBy("hour").collect()
    assert [(r["dnr"], r["full"]) for r in out] == [(False, False), (False, True), (True, False), (True, False)]


def test_oxygen_chain(spark):
    rows = [(1, ts("2024-01-01 00:00:00"), None, 30.0), (2, ts("2024-01-01 00:00:00"), None, None)]
    df = spark.createDataFrame(rows, "id int, hour timestamp_ntz, fio2 double, flow double")
    fi = F.coalesce(W.ffill_col("fio2", K), F.col("flow") * 3 + 21)
    out = df.withColumn("f", X.clip_upper(fi, 100))
    out = out.withColumn("f", F.coalesce(W.ffill_col("f", K), F.lit(21.0)) / 100)
    got = {r["id"]: r["f"] for r in out.collect()}
    assert got == {1: 1.0, 2: 0.21}


def test_spread(spark):
    rows = [(1, ts("2024-01-01 01:10:00"), ts("2024-01-01 03:50:00"), 9.0),
            (2, ts("2024-01-01 05:00:00"), ts("2024-01-01 04:00:00"), 9.0)]
    df = spark.createDataFrame(rows, "id int, s timestamp_ntz, e timestamp_ntz, amount double")
    df = df.withColumn("per_hour", grid.hourly_amount("s", "e", "amount"))
    out = grid.spread_intervals(df, K, "s", "e", "per_hour", "a").orderBy("hour").collect()
    assert [(r["id"], r["hour"].hour, r["a"]) for r in out] == [(1, 1, 3.0), (1, 2, 3.0), (1, 3, 3.0)]


def test_asof_to_grid(spark):
    bounds = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), ts("2024-01-01 12:00:00"))],
                                   "id int, first_hour timestamp_ntz, last_hour timestamp_ntz")
    ev = spark.createDataFrame([(1, ts("2024-01-01 10:30:00"), 1), (1, ts("2024-01-01 10:30:01"), 2),
                                (1, ts("2024-01-01 09:00:00"), 3), (1, ts("2024-01-01 08:59:59"), 4),
                                (1, ts("2024-01-01 13:00:00"), 5), (1, ts("2024-01-01 13:00:01"), 6)],
                               "id int, t timestamp_ntz, rid int")
    out = {r["rid"]: r["hour"].hour for r in grid.asof_to_grid(ev, bounds, "id", "t").collect()}
    assert out == {1: 10, 2: 11, 3: 10, 5: 12}


def test_asof_nearest_general(spark):
    left = spark.createDataFrame([(1, ts("2024-01-01 10:30:00"), 1), (1, ts("2024-01-01 12:00:00"), 2),
                                  (1, ts("2024-01-02 00:10:00"), 3), (2, ts("2024-01-01 10:00:00"), 4)],
                                 "id int, t timestamp_ntz, rid int")
    right = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), 1.0), (1, ts("2024-01-01 11:00:00"), 2.0),
                                   (1, ts("2024-01-01 23:50:00"), 3.0)], "id int, t timestamp_ntz, p double")
    out = grid.asof_nearest(left, right, "id", "t", "t", ["p"], tolerance_hours=1, partitions=3)
    got = {r["rid"]: r["p"] for r in out.collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_rolling_mean(spark):
    df = _series(spark, [None, 4, None, 8])
    out = df.withColumn("m", W.rolling_mean("v", K, 24, default=0.0))
    assert _col(out, "m") == [0.0, 4.0, 4.0, 6.0]


def test_rolling_future_composed(spark):
    df = _series(spark, [0, 3, 0, 0, 1, 0, 0, 0])
    out = df.withColumns({"r": W.rolling_max("v", K, 3), "f": W.future_max("v", K, 3),
                          "c": W.score_horizon("v", K, 3)})
    assert _col(out, "r") == [0, 3, 3, 3, 1, 1, 1, 0]
    assert _col(out, "f") == [3, 3, 1, 1, 1, 0, 0, 0]
    assert _col(out, "c") == [3, 3, 3, 3, 1, 1, 1, 0]


def test_time_since_observed(spark):
    mask = [0, 0, 1, 0, 0, 1, 1, 0]
    df = _series(spark, [1.0 if m else None for m in mask])
    out = df.withColumn("d", W.time_since_observed("v", K))
    assert _col(out, "d") == [0, 1, 2, 1, 2, 3, 1, 1]


def test_horizon_label(spark):
    rows = [(ts("2024-01-02 00:00:00"), 1), (ts("2024-01-02 00:00:01"), 2), (ts("2023-12-31 00:00:00"), 3), (None, 4)]
    df = spark.createDataFrame(rows, "death timestamp_ntz, rid int").withColumn("hour", F.lit(ts("2024-01-01 00:00:00")))
    got = {r["rid"]: r["l"] for r in df.select("rid", W.horizon_label("death", "hour", 24).alias("l")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_threshold_and_division(spark):
    df = spark.createDataFrame([(400.0,), (400.1,), (100.0,), (None,)], "sf double")
    got = [r["s"] for r in df.select(X.threshold_score("sf", "<=", [400, 300, 200, 100]).alias("s")).collect()]
    assert got == [1, 0, 4, 0]
    inr = spark.createDataFrame([(1.1,), (2.5,)], "v double")
    assert [r["s"] for r in inr.select(X.threshold_score("v", ">=", [1.1, 1.25, 1.5, 2.5]).alias("s")).collect()] == [1, 4]
    d = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, None)], "a double, b double")
    vals = [r["q"] for r in d.select(X.safe_div("a", "b").alias("q")).collect()]
    assert math.isinf(vals[0]) and vals[1] is None and vals[2] is None


def test_one_hot_null_row_all_false(spark):
    df = spark.createDataFrame([("M",), (None,)], "g string")
    out = grid.one_hot(df, "g", ["F", "M"], prefix="gender").collect()
    assert [(r["gender, F"], r["gender, M"]) for r in out] == [(False, True), (False, False)]


def test_asof_nearest_matches_pandas_merge_asof(spark):
    import datetime as dt
    import random

    import pandas as pd
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    left = [(k, t0 + dt.timedelta(minutes=rnd.randint(0, 3000)), i) for i, k in enumerate(rnd.choices([1, 2, 3], k=400))]
    right_t = set()
    right = []
    for k in (1, 2, 3):
        for _ in range(60):
            t = t0 + dt.timedelta(minutes=rnd.randint(0, 3000) // 30 * 30)
            if (k, t) not in right_t:
                right_t.add((k, t))
                right.append((k, t, float(len(right))))
    L = spark.createDataFrame(left, "id int, t timestamp_ntz, rid int")
    R = spark.createDataFrame(right, "id int, t timestamp_ntz, p double")
    got = {r["rid"]: r["p"] for r in grid.asof_nearest(L, R, "id", "t", "t", ["p"], 1, partitions=2).collect()}
    lp = pd.DataFrame(left, columns=["id", "t", "rid"]).sort_values("t")
    rp = pd.DataFrame(right, columns=["id", "t", "p"]).sort_values("t")
    m = pd.merge_asof(lp, rp, on="t", by="id", direction="nearest", tolerance=pd.Timedelta(1, "h"),
                      allow_exact_matches=True)
    exp = {int(r.rid): (None if pd.isna(r.p) else float(r.p)) for r in m.itertuples()}
    assert got == exp
