"""Random-data equivalence with the pandas operations the pipeline is defined
by (pivot_table + resample median, cumsum/shift masks, rolling maxima)."""

import datetime as dt
import random

import numpy as np
import pandas as pd

from stayline.operators import grid, windows as W

K = ["id"]


def test_hourly_grid_equals_pivot_resample(spark):
    rnd = random.Random(21)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(4):
        for _ in range(120):
            t = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 30) // 5 * 5)
            rows.append((i, t, rnd.choice(["a", "b", "c"]), float(rnd.randint(0, 50))))
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz, label string, v double")
    got = grid.hourly_grid(df, K, "t", "label", "v", ["a", "b", "c"]).toPandas()
    got = got.set_index(["id", "hour"]).sort_index()

    pdf = pd.DataFrame(rows, columns=["id", "t", "label", "v"])
    pv = pdf.pivot_table(index=["id", "t"], columns="label", values="v").reset_index()
    exp = pv.set_index("t").groupby("id")[["a", "b", "c"]].resample("1h").median()
    exp.index = exp.index.set_names(["id", "hour"])
    exp = exp.sort_index()
    assert list(got.index) == list(exp.index)
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(dtype=float), exp[["a", "b", "c"]].to_numpy(dtype=float))


def test_time_since_observed_equals_cumsum_shift(spark):
    rnd = random.Random(8)
    rows, masks = [], {}
    for i in range(5):
        m = [rnd.random() < 0.3 for _ in range(40)]
        masks[i] = m
        rows += [(i, h, 1.0 if b else None) for h, b in enumerate(m)]
    df = spark.createDataFrame(rows, "id int, hour int, v double")
    got = {(r["id"], r["hour"]): r["d"] for r in df.select("id", "hour", W.time_since_observed("v", K).alias("d")).collect()}
    for i, m in masks.items():
        mask = pd.Series([int(b) for b in m])
        ones = pd.Series(1, index=mask.index)
        exp = ones.groupby(mask.cumsum()).cumsum().shift().fillna(0)
        assert [got[(i, h)] for h in range(len(m))] == list(exp)


def test_score_horizon_equals_rolling_then_future(spark):
    rnd = random.Random(2)
    rows, series = [], {}
    for i in range(3):
        s = [rnd.randint(0, 4) for _ in range(80)]
        series[i] = s
        rows += [(i, h, v) for h, v in enumerate(s)]
    df = spark.createDataFrame(rows, "id int, hour int, v int")
    out = df.select("id", "hour", W.rolling_max("v", K, 24).alias("r"), W.score_horizon("v", K, 24).alias("c"))
    got = {(r["id"], r["hour"]): (r["r"], r["c"]) for r in out.collect()}
    for i, s in series.items():
        x = pd.Series(s, dtype=float)
        roll = x.rolling(24, min_periods=0).max()
        fut = roll[::-1].rolling(24, min_periods=1).max()[::-1]
        assert [got[(i, h)][0] for h in range(len(s))] == list(roll)
        assert [got[(i, h)][1] for h in range(len(s))] == list(fut)
