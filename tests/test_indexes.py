"""Interval index (J5), code segments (C2) and the native quantile transform."""

import bisect
import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.operators import codes as C, joins as J, prep

T0 = dt.datetime(2020, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _pairs(events, stays):
    out = []
    for e, k, t in events:
        for s, sk, lo, hi in stays:
            if None not in (k, sk, t, lo, hi) and k == sk and lo <= t <= hi:
                out.append((e, s))
    return sorted(out)


def test_events_in_stay_equal_brute_force(spark):
    rng = random.Random(3)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    stays = []
    for k in range(200):
        lo = rng.randint(-10**7, 10**7)
        stays.append((k, rng.choice(["a", "b", None]), at(lo), at(lo + rng.choice([0, 1, 600, 90_000, 10**6, 5 * 10**7]))))
    stays += [(900, "a", None, at(5)), (901, "a", at(5), None), (902, "a", at(9), at(3)),
              (903, "b", dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1))]
    events = [(k, rng.choice(["a", "b", "c", None]), at(rng.randint(-2 * 10**7, 2 * 10**7))) for k in range(400)]
    events += [(1000 + k, s[1], s[2 + k % 2]) for k, s in enumerate(stays[:60])] + [(2000, "a", None)]
    e = spark.createDataFrame(events, "event int, ward string, t timestamp_ntz")
    s = spark.createDataFrame(stays, "stay int, ward string, intime timestamp_ntz, outtime timestamp_ntz")
    got = J.events_in_stay(e, s, "ward", "t")
    assert got.columns == ["event", "ward", "t", "stay", "intime", "outtime"]
    assert sorted((r.event, r.stay) for r in got.collect()) == _pairs(events, stays)
    assert J.events_in_stay(e, s.limit(0), "ward", "t").count() == 0
    assert J.events_in_stay(e.limit(0), s, "ward", "t").count() == 0


def test_figures_of_a_stay_equal_those_of_its_pairs(spark):
    """Count (of NULL values too), least and largest event per stay: 40,000 events meet
    2,000 stays 13 million times, some stays equal, some without events or ends."""
    rng = random.Random(4)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    events = [(None if k % 50 == 0 else k * 7919 % 100_003, rng.choice(["a", "a", "b", None]), rng.randint(0, 30_000)) for k in range(40_000)]
    stays = [(k, rng.choice(["a", "a", "b", "c", None]), lo, lo + rng.choice([0, 1, 9, 600, 20_000]))
             for k, lo in enumerate(rng.randint(-100, 31_000) for _ in range(1990))]
    stays += [(1, "a", 10, 500)] * 2 + [(2, "a", None, 5), (3, "a", 5, None), (4, "a", 9, 3), (5, "a", 40_000, 50_000)]
    t = lambda x: None if x is None else at(x)
    e = spark.createDataFrame([(v, w, t(x)) for v, w, x in events], "event int, ward string, t timestamp_ntz")
    s = spark.createDataFrame([(k, w, t(a), t(b)) for k, w, a, b in stays], "stay int, ward string, intime timestamp_ntz, outtime timestamp_ntz")
    got = J.events_in_stay(e, s, "ward", "t", summary={"n": ("count", "event"), "lo": ("min", "event"), "hi": ("max", "event"),
                                                       "sum": ("sum", "event")})
    assert got.columns == ["stay", "ward", "intime", "outtime", "n", "lo", "hi", "sum"]
    per, want = {w: sorted((x, -1 if v is None else v) for v, ww, x in events if ww == w) for w in "abc"}, []
    for k, w, a, b in stays:
        if w is None or a is None or b is None:
            continue
        x = np.array(per[w]).reshape(-1, 2)
        v = x[np.searchsorted(x[:, 0], a, "left"):np.searchsorted(x[:, 0], b, "right"), 1] if a <= b else x[:0, 1]
        if len(v):
            p = v[v >= 0]
            want.append((k, w, at(a), at(b), len(v), *((int(p.min()), int(p.max()), int(p.sum())) if len(p) else (None,) * 3)))
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order(want)
    none = {"n": ("count", "event")}
    assert J.events_in_stay(e, s.limit(0), "ward", "t", summary=none).count() == 0
    assert J.events_in_stay(e.limit(0), s, "ward", "t", summary=none).count() == 0


def test_neighbouring_levels_share_their_cells(spark):
    """Events are looked up on three levels, not eleven, for stays of 72 minutes to 50 days."""
    shared = J.shared_levels(list(range(32, 43)))
    assert sorted(set(shared.values())) == [32, 36, 40] and all(0 <= k - v < 4 for k, v in shared.items())
    assert J.shared_levels([37]) == {37: 37} and J.shared_levels([]) == {}
    lo = F.lit(T0).cast("timestamp_ntz")
    at = lambda micros: lo + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros / 1e6)
    s = spark.range(32, 43).select(F.col("id").alias("stay"), F.lit("a").alias("ward"), lo.alias("intime"),
                                   at(F.expr("shiftleft(1L, CAST(id AS INT)) - 1")).alias("outtime"))
    e = spark.range(33, 44).select(F.col("id").alias("event"), F.lit("a").alias("ward"), at(F.expr("shiftleft(1L, CAST(id - 1 AS INT)) - 2")).alias("t"))
    got = J.events_in_stay(e, s, "ward", "t")
    assert len(re.findall(r"shiftright\(_at", got._jdf.queryExecution().analyzed().toString())) == 3
    assert sorted((r.event, r.stay) for r in got.collect()) == [(v, k) for v in range(33, 44) for k in range(v - 1, 43)]


def test_a_hot_ward_does_not_meet_all_its_events(spark):
    """500,000 events, a third of them in one ward that also holds 1,000 stays."""
    n = 500_000
    hour = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id * 61 % 31536000 AS INT))")
    e = spark.range(n).select(F.col("id").alias("event"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1).alias("ward"),
                              hour.alias("t"))
    lo = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, CAST(id * 8 AS INT), 0, 0)")
    s = spark.range(1000).select(F.col("id").alias("stay"), F.lit(0).alias("ward"), lo.alias("intime"),
                                 (lo + F.expr("INTERVAL 30 HOURS")).alias("outtime"))
    out = J.events_in_stay(e, s, "ward", "t")
    rows = out.count()
    cells = J.stay_cells(s, "intime", "outtime", 32)
    assert cells.count() <= 2 * 1000 and cells.select("_lv").distinct().count() == 1
    level = cells.first()["_lv"]
    probes = e.withColumn("_cell", F.shiftright(J.epoch_micros("t"), level))
    met = probes.join(cells.select("ward", "_cell"), ["ward", "_cell"]).count()
    assert rows < met <= 4 * rows  # by key alone: 166,667 x 1,000
    per = {r.stay: r.c for r in out.groupBy("stay").agg(F.count("*").alias("c")).collect()}
    seconds = np.sort((np.arange(0, n, 3) * 61) % 31536000)
    for k in (0, 17, 999):
        a, b = k * 8 * 3600, k * 8 * 3600 + 30 * 3600
        assert per[k] == np.searchsorted(seconds, b, "right") - np.searchsorted(seconds, a, "left")


def _matches(code, version):
    c = code.strip().replace(".", "").replace(" ", "").upper()
    return sorted({g for g, v, lo, hi, _ in C.rule_rows() if v == version and c[:len(lo)] >= lo and c[:len(hi)] <= hi})


def test_code_segments_equal_the_prefix_rule(spark):
    rng = random.Random(1)
    ends = sorted({x for _, _, lo, hi, _ in C.rule_rows() for x in (lo, hi)})
    codes = [e + t for e in ends for t in ("", "0", "9", "Z")] + [e[:-1] for e in ends if len(e) > 1]
    codes += ["".join(rng.choices("ABCDEGIZ0123456789", k=rng.randint(1, 6))) for _ in range(500)] + ["", " e11.9 ", "i 50.0"]
    rows = [(i, c, v) for i, c in enumerate(codes) for v in (9, 10)] + [(-1, None, 9), (-2, "I50", None), (-3, "I50", 8)]
    d = spark.createDataFrame(rows, "i int, code string, v int")
    rules = C.code_rules(spark)
    got = {}
    for r in C.assign_groups(d, "code", "v", rules).collect():
        got.setdefault((r.i, r.v), []).append(r.group)
    want = {(i, v): m for i, c, v in rows if c is not None and v in (9, 10) and (m := _matches(c, v))}
    assert {k: sorted(x) for k, x in got.items()} == want
    kept = C.assign_groups(d, "code", "v", rules, keep_unmatched=True)
    assert kept.count() == sum(max(1, len(want.get((i, v), []))) for i, _, v in rows)
    assert kept.columns == ["i", "code", "v", "group"]


def test_segments_are_disjoint_and_rows_meet_no_range(spark):
    seg = C.code_segments(C.code_rules(spark)).collect()
    for r in seg:
        assert list(r.bounds) == sorted(set(r.bounds)) and len(r.groups) == len(r.bounds) + 1 and r.groups[0] == []
        assert r.groups[bisect.bisect_right(r.bounds, "ZZZ")] == []
    d = spark.createDataFrame([("I50", 10, 1)], "code string, v int, k int")
    plan = _plan(C.assign_groups(d, "code", "v", C.code_rules(spark)))
    assert "substr" not in plan.split("Generate")[0]  # the join back has equal keys only


def test_packed_groups_equal_flags(spark):
    rng = random.Random(2)
    ends = [lo for _, v, lo, _, _ in C.rule_rows() if v == 10]
    rows = [(rng.randint(0, 20), rng.choice(ends), 10) for _ in range(150)] + [(99, "QQQ", 10)]
    d = spark.createDataFrame(rows, "k int, code string, v int")
    names = C.group_names()
    flags = {r.k: [bool(r[g]) for g in names] for r in C.group_flags(
        C.assign_groups(d, "code", "v", C.code_rules(spark)), "k", names).collect()}
    packed, words = C.group_words(d, "code", "v", C.code_rules(spark), "k", names)
    got = {r.k: [bool(r[f"f{i}"]) for i in range(len(names))] for r in packed.select(
        "k", *[J.flag_of(words, i).alias(f"f{i}") for i in range(len(names))]).collect()}
    assert got == flags and 99 not in got
    assert len(K.COMORBIDITY_GROUPS) == len(names)


def _reference_transform(x, xp):
    xp = np.asarray(xp, float)
    m = len(xp)
    refs = np.linspace(0.0, 1.0, m) if m > 1 else np.zeros(1)
    y = 0.5 * (np.interp(x, xp, refs) - np.interp(-x, -xp[::-1], -refs[::-1]))
    y[x == xp[-1]] = refs[-1]
    y[x == xp[0]] = refs[0]
    return y


@pytest.mark.parametrize("m", [1, 2, 3, 100, 1000])
def test_quantile_transform_is_native_and_equals_numpy(spark, m):
    rng = np.random.default_rng(m)
    knots = {"a": sorted(rng.normal(size=m).round(1).tolist()), "b.c": sorted(rng.integers(0, 5, m).astype(float).tolist())}
    v = np.concatenate([rng.normal(size=300) * 2, knots["a"], knots["b.c"], [1e9, -1e9]])
    rows = [(i, float(x), float(x)) for i, x in enumerate(v)] + [(-1, None, float("nan"))]
    df = spark.createDataFrame(rows, "i int, a double, `b.c` double")
    out = prep.quantile_transform(df, knots)
    assert out.columns == df.columns
    plan = _plan(out)
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = {r.i: r for r in out.collect()}
    assert got[-1]["a"] is None and got[-1]["b.c"] is None
    for c in knots:
        np.testing.assert_allclose([got[i][c] for i in range(len(v))], _reference_transform(v, knots[c]), atol=1e-12)
    assert prep.quantile_transform(df, {}).columns == df.columns


def test_counted_lookup_is_broadcast_up_to_its_limit(spark):
    """A small side is written, counted and broadcast; a larger one is joined by key, with the same rows."""
    left = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small, large = (left.join(J.counted_lookup(right, n), "k") for n in (40, 39))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (small, large)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() == 800


def test_epoch_micros_of_odd_times(spark):
    """Before 1970, at the ends of the calendar, in a skipped hour of the session's zone; no decimals."""
    epoch, us = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=1)
    times = [dt.datetime(1, 1, 1), dt.datetime(1582, 10, 10, 1, 2, 3, 4), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), epoch,
             dt.datetime(2024, 3, 10, 2, 30, 0, 100000), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), None]
    x = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select("t", J.epoch_micros("t").alias("m"))
    assert all(r["m"] == (None if r["t"] is None else (r["t"] - epoch) // us) for r in x.collect())
    assert "Decimal" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert "extract" not in x._jdf.queryExecution().optimizedPlan().toString().lower()
