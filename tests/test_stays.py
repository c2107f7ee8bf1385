"""Stay construction edge rows (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.functions import expr as X
from stayline.operators import filters, stays
from tests.conftest import ts

SCHEMA = "hadm_id string, intime timestamp_ntz, outtime timestamp_ntz, rid int"


def _sess(spark, rows, partitions=7):
    df = spark.createDataFrame(rows, SCHEMA)
    out = stays.sessionize(df, "hadm_id", "intime", "outtime", 24, partitions=partitions, tiebreak=["rid"])
    return {r["rid"]: r["session_no"] for r in out.collect()}


def test_sessionize_gap_edges(spark):
    rows = [
        ("a", ts("2024-01-01 00:00:00"), ts("2024-01-02 00:00:00"), 1),
        ("a", ts("2024-01-03 00:00:00"), ts("2024-01-03 06:00:00"), 2),   # gap exactly 24 h: same
        ("a", ts("2024-01-04 06:00:01"), ts("2024-01-04 08:00:00"), 3),   # 24 h + 1 s: split
        ("a", ts("2024-01-10 00:00:00"), None, 4),                        # long gap: split
        ("a", ts("2024-01-20 00:00:00"), ts("2024-01-20 01:00:00"), 5),   # previous end null: no split
        ("b", ts("2024-01-20 02:00:00"), ts("2024-01-20 03:00:00"), 6),   # other admission: new
    ]
    for chunk in (1, 7, 365):
        got = _sess(spark, rows, chunk)
        assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 1}, (chunk, got)


def test_sessionize_previous_row_not_running_max(spark):
    # a nested transfer: the gap uses the previous row's end, so row 3 splits
    rows = [
        ("a", ts("2024-01-01 00:00:00"), ts("2024-01-10 00:00:00"), 1),
        ("a", ts("2024-01-02 00:00:00"), ts("2024-01-02 01:00:00"), 2),
        ("a", ts("2024-01-05 00:00:00"), ts("2024-01-06 00:00:00"), 3),
    ]
    assert _sess(spark, rows, 1) == {1: 1, 2: 1, 3: 2}
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1, 30):
        out = stays.sessionize(df, "hadm_id", "intime", "outtime", 24, partitions=chunk, tiebreak=["rid"],
                               running_end=True)
        assert {r["rid"]: r["session_no"] for r in out.collect()} == {1: 1, 2: 1, 3: 1}


def test_sessionize_running_end_matches_default_on_points(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = stays.sessionize(ev, "user_id", "ts", "ts", 24, partitions=3, tiebreak=["event_id"])
    b = stays.sessionize(ev, "user_id", "ts", "ts", 24, partitions=3, tiebreak=["event_id"], running_end=True)
    assert {r["event_id"]: r["session_no"] for r in a.collect()} == {r["event_id"]: r["session_no"] for r in b.collect()}


def test_sessionize_matches_plain_window_on_events(spark):
    from pyspark.sql import Window
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = stays.sessionize(ev, "user_id", "ts", "ts", 24, partitions=2, tiebreak=["event_id"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    brk = F.when(F.lag("ts").over(w).isNull(), 1).when(
        (F.col("ts") - F.lag("ts").over(w)) > F.expr("INTERVAL 24 HOURS"), 1).otherwise(0)
    b = ev.withColumn("b", brk).withColumn("session_no", F.sum("b").over(w.rowsBetween(-10 ** 9, 0)).cast("bigint"))
    ja = {r["event_id"]: r["session_no"] for r in a.collect()}
    jb = {r["event_id"]: r["session_no"] for r in b.collect()}
    assert ja == jb


def test_unit_filter_and_extract(spark):
    df = spark.createDataFrame([("Medical ICU (MICU)",), ("Coronary (CCU)",), ("Medicine",), (None,)], "u string")
    kept = df.where(filters.where_matches("u", K.UNIT_PATTERN)).select(X.regex_last_paren("u").alias("x"))
    assert sorted(r["x"] for r in kept.collect()) == ["CCU", "MICU"]


def test_stay_length_edges(spark):
    base = "2024-01-01 00:00:00"
    rows = [(ts(base), ts("2024-01-03 00:00:00"), 1), (ts(base), ts("2024-01-02 23:59:59"), 2),
            (ts(base), ts("2024-01-15 00:00:00"), 3), (ts(base), ts("2024-01-15 00:00:01"), 4)]
    df = spark.createDataFrame(rows, "intime timestamp_ntz, outtime timestamp_ntz, rid int")
    kept = df.where(stays.length_between("intime", "outtime", 48, 24 * 14))
    assert sorted(r["rid"] for r in kept.collect()) == [1, 3]


def test_cap_end_and_outcome(spark):
    rows = [
        (ts("2024-01-05 00:00:00"), ts("2024-01-04 00:00:00"), ts("2024-01-09 00:00:00"), 1),  # death first
        (ts("2024-01-05 00:00:00"), ts("2024-01-08 00:00:00"), ts("2024-01-03 00:00:00"), 2),  # discharge first
        (ts("2024-01-05 00:00:00"), None, None, 3),
    ]
    df = spark.createDataFrame(rows, "outtime timestamp_ntz, deathtime timestamp_ntz, dischtime timestamp_ntz, rid int")
    out = {r["rid"]: r["c"] for r in df.select("rid", stays.cap_end("outtime", "deathtime", "dischtime").alias("c")).collect()}
    assert out == {1: ts("2024-01-04 00:00:00"), 2: ts("2024-01-03 00:00:00"), 3: ts("2024-01-05 00:00:00")}
    rows2 = [(ts("2024-01-02 00:00:00"), ts("2024-01-01 00:00:00"), 1), (None, ts("2024-01-01 00:00:00"), 2)]
    df2 = spark.createDataFrame(rows2, "death timestamp_ntz, outtime timestamp_ntz, rid int")
    got = {r["rid"]: r["o"] for r in df2.select("rid", stays.outcome_within("death", "outtime", 24).alias("o")).collect()}
    assert got == {1: True, 2: False}


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, ts("2024-01-02 00:00:00"), 2), (1, ts("2024-01-01 00:00:00"), 3),
                                (1, ts("2024-01-01 00:00:00"), 1), (2, ts("2024-01-05 00:00:00"), 9)],
                               "k int, t timestamp_ntz, s int")
    got = sorted((r["k"], r["s"]) for r in stays.first_per_key(df, "k", ["t"], ["s"]).collect())
    assert got == [(1, 1), (2, 9)]


def test_sessionize_shuffles_rows_once_after_writing_them(spark):
    """A key cut into pieces is numbered right, and only such keys are joined: by broadcast."""
    ev = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).when(F.col("id") % 64 > 0, (F.col("id") % 40).cast("string")).alias("k"),
                                  F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id DIV 100 * 3 AS INT), 0, 0, CAST(id AS INT))").alias("t"), "id")
    for running in (False, True):
        out = stays.sessionize(ev, "k", "t", "t", 24, partitions=6, tiebreak=["id"], running_end=running)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert all(r.session_no == r.id // 100 + 1 for r in out.where("k = 'hot'").collect())
        for k in (None, "4", "36"):
            mine = sorted(r.id for r in ev.where(F.col("k").eqNullSafe(F.lit(k))).collect())
            days = sorted({i // 100 for i in mine})
            got = {r.id: r.session_no for r in out.where(F.col("k").eqNullSafe(F.lit(k))).collect()}
            assert got == {i: days.index(i // 100) + 1 for i in mine}


def test_daily_records_give_the_sessions_of_the_points(spark):
    """Gaps of exactly 24 h, of a microsecond more, over midnight, and points without a time."""
    t0 = dt.datetime(2024, 1, 1, 23, 59, 59)
    day, us = dt.timedelta(hours=24), dt.timedelta(microseconds=1)
    rows = [("a", t0), ("a", t0 + dt.timedelta(seconds=2)), ("a", t0 + dt.timedelta(seconds=2) + day),
            ("a", t0 + dt.timedelta(seconds=2) + 2 * day + us), ("a", None), ("b", None), (None, t0),
            *[("h", t0 + i * dt.timedelta(hours=5) + (i // 40) * dt.timedelta(hours=30)) for i in range(400)]]
    p = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    x = stays.daily_records(p, "k", "t")
    assert x.count() < 250
    ends = lambda df, a, b: sorted(str(tuple(r)) for r in df.groupBy("k", "session_no").agg(F.min(a), F.max(b)).collect())
    points = ends(stays.sessionize(p, "k", "t", "t", 24, partitions=7), "t", "t")
    assert len([r for r in points if r.startswith("('a'")]) == 2 and len([r for r in points if r.startswith("('h'")]) == 10
    assert ends(stays.sessionize(x, "k", "first_at", "last_at", 24, partitions=7), "first_at", "last_at") == points
