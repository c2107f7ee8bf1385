"""Series cut into blocks, packing by length and mergeable sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import prep, quality as Q, windows as W
from stayline.operators.series import LongSeries
from stayline.session import cut_lineage


def _series(spark, n):
    x = spark.range(0, n, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 1009 == 1, None).otherwise(F.col("id") % 7 + 1).alias("k"),
        ((F.col("id") * 7919) % n).alias("t"), F.when(F.xxhash64("id") % 4 != 0, F.xxhash64("id") % 100).cast("double").alias("v"),
        F.when(F.xxhash64("id", F.lit(1)) % 50_000 == 0, F.col("id")).alias("rare"),
        F.when(F.xxhash64("id", F.lit(2)) % 9000 == 0, 1).alias("a"), F.when(F.xxhash64("id", F.lit(3)) % 9000 == 0, 1).alias("b"))
    return cut_lineage(x)


def test_one_key_with_half_a_million_rows(spark):
    """Equal to the plain windows, in blocks of an even size."""
    x = _series(spark, 500_000).withColumn("k", F.lit(1))
    made = {"mx": lambda k, o: W.rolling_max("v", k, 24, o), "up": lambda k, o: W.future_max("v", k, 24, o),
            "hz": lambda k, o: W.score_horizon("v", k, 24, order=o), "mean": lambda k, o: W.rolling_mean("v", k, 24, order=o),
            "f2": lambda k, o: W.ffill_col("v", k, o, limit=2)}
    s = LongSeries(x, "k", "t", block=10_000, reach=100).counter("no").frames(made).since_observed("rare", "since")
    s = s.ffill(["rare"]).latest_state("a", "b")
    got = s.frame()
    assert got.columns == [*x.columns, "no", *made, "since"]
    # what a task gets: the rows of one block and its halo
    sizes = [r["count"] for r in s.rows.groupBy("_sr_block").count().collect()]
    assert len(sizes) == 50 and max(sizes) == 10_000 and sum(sizes) == 500_000
    want = x.withColumn("no", W.hours_since_start("k", "t"))
    want = want.withColumns({n: f(["k"], "t") for n, f in made.items()}).withColumn("since", W.time_since_observed("rare", ["k"], "t"))
    want = W.latest_state(want.withColumn("rare", W.ffill_col("rare", ["k"], "t")), ["k"], "a", "b", "t")
    a, b = got.toPandas().sort_values("id"), want.select(*got.columns).toPandas().sort_values("id")
    for c in got.columns:
        assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c


def test_several_keys_null_keys_and_short_series(spark):
    x = _series(spark, 30_000)
    s = LongSeries(x, ["k"], ["t"], block=50, reach=50).frames({"mx": lambda k, o: W.rolling_max("v", k, 51, o)}).ffill(["v"])
    a = s.frame().toPandas().sort_values("id")
    want = x.withColumn("mx", W.rolling_max("v", ["k"], 51, "t")).withColumn("v", W.ffill_col("v", ["k"], "t"))
    b = want.toPandas().sort_values("id")
    for c in ("mx", "v"):
        assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c
    assert LongSeries(x.limit(0), "k", "t").ffill(["v"]).frame().count() == 0
    with pytest.raises(ValueError):
        LongSeries(x, "k", "t", block=10, reach=11)


def test_pack_by_length_round_trip(spark):
    rng = random.Random(2)
    rows = [(f"s{k}", h, float(k * 1000 + h), None if rng.random() < 0.3 else float(h)) for k in range(60)
            for h in range(rng.choice([1, 2, 9, 10, 11, 64, 65, 200, 700]))]
    df = spark.createDataFrame(rows, "stay string, hour int, a double, b double").repartition(5)
    packed = prep.pack_by_length(df, "stay", "hour", ["a", "b"], segment=64, batch=8)
    got = packed.collect()
    assert max(r.maxsteps for r in got) <= 64 and all(len(r.x) >= r.maxsteps for r in got)
    by_class = {}
    for r in got:
        by_class.setdefault(r.length_class, []).append(r)
        assert r.offset == r.segment_no * 64 and all(v == [0.0, 0.0] for v in r.x[r.maxsteps:])
    for c, rs in by_class.items():
        assert {len(r.x) for r in rs} == {max(r.maxsteps for r in rs)}  # one length a class
        per = {}
        for r in rs:
            per[r.batch_no] = per.get(r.batch_no, 0) + 1
        assert all(n == 8 for b, n in per.items() if b < max(per)) and max(per) == (len(rs) - 1) // 8
    back = prep.unpack_segments(packed, "stay", ["a", "b"]).collect()
    assert sorted((r.stay, r.step, r.a, r.b is None, r.b or 0) for r in back) == sorted(
        (s, h, a, b is None, b or 0) for s, h, a, b in rows)
    short = prep.padded_share(packed).first()
    whole = prep.pack_sequences(df, "stay", "hour", ["a", "b"]).withColumn("split", F.lit("x"))
    long = prep.padded_share(prep.pad_to_split_max(whole)).first()
    assert short.steps == long.steps == len(rows)
    assert short.padded_share < 0.2 < 0.5 < long.padded_share
    assert prep.pack_by_length(df.limit(0), "stay", "hour", ["a", "b"]).count() == 0


def test_length_classes():
    for top in (1, 2, 3, 100, 513):
        b = prep.length_classes(top)
        assert b[0] == 1 and b[-1] == top and b == sorted(set(b))
        assert all(y <= max(x + 1, 1.25 * x) for x, y in zip(b, b[1:]))


def test_sketches_of_loads_merge(spark):
    x = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("load"),
                                    ((F.xxhash64("id") % 1_000_003) * (F.col("id") % 3 + 1)).cast("double").alias("v"))
    x = cut_lineage(x.withColumn("v", F.when(F.col("v") % 17 != 0, F.col("v"))))
    loads = [Q.quantile_sketches(x.where(F.col("load") == k), "g", "v") for k in range(5)]
    both = loads[0]
    for s in loads[1:]:
        both = both.unionByName(s)
    lim = {r.g: r for r in Q.sketch_limits(Q.merge_sketches(both, "g"), "g", 0.01, 0.99).collect()}
    ref = x.toPandas().dropna()
    for g, own in ref.groupby("g"):
        v = np.sort(own.v.to_numpy())
        for q, limit in ((0.01, lim[g].lo_limit), (0.99, lim[g].hi_limit)):
            assert abs(np.searchsorted(v, limit) / len(v) - q) < 0.003
    size = Q.quantile_sketches(x, "g", "v").select(F.max(F.octet_length("sketch")).alias("n")).first().n
    assert size < 200_000  # of fixed size
