"""Operators that were only right on one partition: many rows, many partitions,
hot keys, null keys, extra columns; and rules that must stop a job."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stayline.operators import grid, joins, prep, quality as Q, ranking, report, stays
from stayline.session import cut_lineage

N = 500_000


@pytest.fixture(scope="module")
def wide(spark):
    """500,000 rows in several files; group 0 holds a third, value 7 is frequent."""
    x = spark.range(0, N, 1, 6).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 11 == 0, None)
        .otherwise(F.col("id") % 5).alias("g"),
        F.when(F.col("id") % 4 == 0, F.lit(7.0)).otherwise((F.xxhash64("id") % 100_003).cast("double")).alias("v"),
        F.concat(F.lit("extra "), F.col("id")).alias("note"))
    return cut_lineage(x)


@pytest.fixture(params=[16, 40])
def many_partitions(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rank_of_every_row(spark, wide, many_partitions):
    got = ranking.group_rank(wide, "g", ["v"]).select("id", "g", "v", "note", "_rank").toPandas()
    assert len(got) == N and got.id.nunique() == N
    assert (got.note == "extra " + got.id.astype(str)).all()
    for _, part in got.groupby(got.g.fillna(-1)):
        part = part.sort_values("_rank")
        assert (part["_rank"].to_numpy() == np.arange(len(part))).all()
        assert (np.diff(part.v.to_numpy()) >= 0).all()


def test_quantiles_with_a_hot_value(spark, wide, many_partitions):
    got = Q.exact_quantiles(wide, "g", "v", [0.01, 0.5, 0.77], ["a", "b", "c"]).toPandas()
    ref = wide.toPandas()
    for r in got.itertuples():
        own = ref[ref.g.isna()] if pd.isna(r.g) else ref[ref.g == r.g]
        assert (r.a, r.b, r.c) == pytest.approx(tuple(own.v.quantile([0.01, 0.5, 0.77])))
    assert len(got) == ref.g.nunique(dropna=False)


def test_split_and_case_control(spark, wide, many_partitions):
    x = wide.select("id", "note", (F.col("id") % 10 == 0).alias("y"))
    n = {(r.y, r.split): r.n for r in prep.stratified_split(x, "id", "y").groupBy("y", "split").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert n == {(True, "Train"): 25_000, (True, "Test"): 12_500, (True, "Val"): 12_500,
                 (False, "Train"): 225_000, (False, "Test"): 112_500, (False, "Val"): 112_500}
    cc = {r.y: r.n for r in prep.case_control(x, "id", "y", ratio=2.0).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
          .collect()}
    assert cc == {True: 50_000, False: 100_000}


def _events(spark):
    """User 1 holds a third of 500,000 events within hours; some have no user."""
    return cut_lineage(spark.range(0, N, 1, 6).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 5000)
        .alias("user"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=(F.pmod(F.xxhash64("id"), F.lit(86_400))).cast("double")))
        .cast("timestamp_ntz").alias("ts"), (F.col("id") % 13).alias("p")))


def test_sessions_of_a_hot_user(spark, many_partitions):
    ev = _events(spark)
    got = stays.sessionize(ev, "user", "ts", "ts", gap_hours=0.01, tiebreak=["rid"])
    w = Window.partitionBy("user").orderBy("ts", "rid")
    brk = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '36' SECOND")).cast("int"), F.lit(1))
    want = ev.withColumn("_b", brk).withColumn("want", F.sum("_b").over(w))
    both = got.join(want.select("rid", "want"), "rid")
    assert got.count() == N and both.where("session_no != want").count() == 0
    # the hot user is cut into balanced pieces
    pieces = ranking.range_numbered(ev, "user", ["ts", "rid"]).groupBy(ranking.PID).count().toPandas()["count"]
    assert pieces.max() < 4 * N / many_partitions


def test_prior_history_and_as_of_of_a_hot_key(spark, many_partitions):
    ev = _events(spark)
    facts = ev.where("p = 3").select("user", "ts", (F.col("rid") % 2 == 0).alias("even"), F.lit(True).alias("any"))
    probes = ev.where("p = 4").select("rid", "user", "ts")
    got = joins.prior_history(probes, facts, "user", "ts", "ts", ["even", "any"]).toPandas()
    f = facts.toPandas().fillna({"user": -1})
    got = got.fillna({"user": -1})
    assert len(got) == probes.count()
    for col, rows in (("prior_any", f), ("prior_even", f[f.even])):
        first = rows.groupby("user").ts.min()
        want = got.user.map(first)
        assert ((want < got.ts) == got[col]).all()
    left, right = probes, ev.where("p = 3").select("user", F.col("ts").alias("ts"), F.col("rid").alias("hit"))
    near = grid.asof_nearest(left.where("user IS NOT NULL"), right.where("user IS NOT NULL"), "user", "ts", "ts", ["hit"],
                             tolerance_hours=1).toPandas()
    r = right.where("user IS NOT NULL").toPandas().drop_duplicates(["user", "ts"]).rename(columns={"ts": "rts"})
    ref = pd.merge_asof(near.sort_values("ts"), r.sort_values("rts")[["user", "rts"]], left_on="ts", right_on="rts",
                        by="user", direction="nearest", tolerance=pd.Timedelta(hours=1))
    gap = lambda t: (ref.ts - t).abs()
    assert (gap(ref.match_t).fillna(pd.Timedelta(0)) == gap(ref.rts).fillna(pd.Timedelta(0))).all()
    assert (ref.match_t.isna() == ref.rts.isna()).all()


def test_unlisted_label_stops_the_grid(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a", 1.0), (1, dt.datetime(2024, 1, 1), "zz", 1.0)],
                               "k int, t timestamp_ntz, lab string, v double")
    with pytest.raises(Exception, match="unlisted label: zz"):
        grid.hourly_grid(df, "k", "t", "lab", "v", ["a"]).collect()
    assert grid.hourly_grid(df, "k", "t", "lab", "v", ["a"], unlisted="drop").count() == 1


def test_p_values():
    p = report.minus_log10_p
    assert p("numeric", 1.959963984540054, None) == pytest.approx(-math.log10(0.05))
    assert p("binary", 3.841458820694124, 1) == pytest.approx(-math.log10(0.05))
    assert p("categorical", 18.307038053275146, 10) == pytest.approx(-math.log10(0.05))
    assert p("categorical", 3.0, 10) == pytest.approx(-math.log10(0.981424), abs=1e-5)
    big = [p("numeric", t, None) for t in (30.0, 38.0, 40.0, 100.0, 1e4)]
    assert big == sorted(big) and all(math.isfinite(x) for x in big)
    assert p("numeric", 40.0, None) == pytest.approx(p("binary", 1600.0, 1), rel=1e-6)


def test_comparison_of_categories(spark):
    rows = [(k % 2 == 0, ["x", "y", "z"][(k * k) % 3], 1.0) for k in range(60)] + [(True, None, 2.0)]
    df = spark.createDataFrame(rows, "y boolean, c string, v double")
    r = report.cohort_comparison(df, "y", (), (), ["c"]).collect()[0]
    t = pd.DataFrame(rows, columns=["y", "c", "v"]).dropna()
    seen = pd.crosstab(t.c, t.y).to_numpy().astype(float)
    want = seen.sum(1)[:, None] * seen.sum(0) / seen.sum()
    assert r.test_stat == pytest.approx(((seen - want) ** 2 / want).sum()) and r.dof == (seen.shape[0] - 1)


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    from stayline import session

    class Ctx:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Ctx()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake())
