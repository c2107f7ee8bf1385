"""Single evaluation of split and case/control, pivot labels, reduced curves, shared
score groups and small-sample p-values."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.operators import evaluate as E, grid, prep, ranking, report


# ---------------------------------------------------------------- ranks by digest
def test_hash_rank_equals_a_plain_rank(spark):
    x = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).alias("g"),
                                   F.md5((F.col("id") % 9000).cast("string")).alias("h"))
    got = ranking.hash_rank(x, "g", "h", ["id"], "r", "n", partitions=23).toPandas()
    want = x.toPandas().sort_values(["h", "id"])
    want["r"] = want.groupby("g", dropna=False).cumcount()
    want["n"] = want.groupby("g", dropna=False)["id"].transform("count")
    a, b = got.sort_values("id").reset_index(drop=True), want.sort_values("id").reset_index(drop=True)
    assert (a.r == b.r).all() and (a.n == b.n).all() and len(a) == 20_000
    assert ranking.hash_rank(x.limit(0), "g", "h", ["id"], "r", "n").count() == 0


def test_split_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("y"))
    got = prep.stratified_split(x.mapInArrow(count, x.schema), "id", "y").groupBy("y", "split").count().collect()
    assert seen.value == 1000
    assert {(r.y, r.split): r["count"] for r in got} == {(True, "Train"): 50, (True, "Test"): 25, (True, "Val"): 25,
                                                         (False, "Train"): 450, (False, "Test"): 225, (False, "Val"): 225}
    seen.value = 0
    kept = prep.case_control(x.mapInArrow(count, x.schema), "id", "y", ratio=1.5).groupBy("y").count().collect()
    assert seen.value == 1000 and {r.y: r["count"] for r in kept} == {True: 100, False: 150}


# ---------------------------------------------------------------- R2
def test_pivot_names_every_label(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", 5.0), (2, "zz", 7.0), (3, None, 1.0), (4, "a", None)],
                               "k int, lab string, v double")
    with pytest.raises(Exception, match="unlisted label: zz"):
        grid.pivot_labels(df, "k", "lab", "v", ["a", "b"]).collect()
    got = {r.k: r for r in grid.pivot_labels(df, "k", "lab", "v").collect()}
    assert set(got) == {1, 2} and got[2].zz == 7.0 and got[1].a == 2.0 and got[1].zz is None
    kept = grid.pivot_labels(df, "k", "lab", "v", ["a", "b"], unlisted="drop").collect()
    assert [tuple(r) for r in kept] == [(1, 2.0, 5.0)]
    with pytest.raises(ValueError, match="more than 2 labels"):
        grid.label_domain(df, "lab", most=2)


# ---------------------------------------------------------------- E1-E4, E13
def _scores(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.3, rng.choice([round(rng.random(), 3), 0.5, 0.25, None])) for _ in range(n)]
    rows = [(None if rng.random() < 0.01 else int(y), s) for y, s in rows]
    return rows, spark.createDataFrame(rows, "y int, s double").repartition(7)


@pytest.mark.parametrize("partitions", [1, 23])
def test_reduced_curves_keep_their_shape(spark, partitions):
    rows, df = _scores(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        full = sorted(((r.fpr, r.tpr, r.threshold) for r in E.roc_points(df, "y", "s").collect()), key=lambda p: -p[2])
        less = sorted(((r.fpr, r.tpr, r.threshold) for r in E.roc_points(df, "y", "s", reduce=True).collect()), key=lambda p: -p[2])
        pr = sorted(E.pr_points(df, "y", "s").collect(), key=lambda r: -r.threshold)
        cut = sorted(E.pr_points(df, "y", "s", reduce=True).collect(), key=lambda r: -r.threshold)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    pos, neg = Counter(s for y, s in rows if y == 1 and s is not None), Counter(s for y, s in rows if y == 0 and s is not None)
    P, N = sum(pos.values()), sum(neg.values())

    def exact(points):
        return [(Fraction(round(a * N)), Fraction(round(b * P))) for a, b, _ in points]

    def area(points):
        return sum((b[0] - a[0]) * (a[1] + b[1]) for a, b in zip(points, points[1:]))

    big, small = exact(full), exact(less)
    assert set(small) <= set(big) and len(small) < 0.8 * len(big) and small[0] == big[0] and small[-1] == big[-1]
    assert area(big) == area(small)
    for a, b, c in zip(small, small[1:], small[2:]):
        assert (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])
    recall = [r.recall for r in pr]
    want = [r for k, r in enumerate(pr) if k in (0, len(pr) - 1) and (k or recall[0] > 0 or recall[1] > recall[0] or len(pr) == 1)
            or 0 < k < len(pr) - 1 and not (recall[k - 1] == recall[k] == recall[k + 1])]
    assert [r.threshold for r in cut] == [r.threshold for r in want] and len(cut) < len(pr)


def test_assess_many_equals_assess(spark):
    _, df = _scores(spark)
    df = df.withColumns({"b.x": F.round("s", 1), "c": F.lit(0.5)})
    many = {r.score_name: r for r in E.assess_many(df, "y", ["s", "b.x", "c"]).collect()}
    for c, name in (("s", "s"), ("b.x", "`b.x`"), ("c", "c")):
        one = E.assess(df.select("y", F.col(name).cast("double").alias("z")), "y", "z").first()
        assert (many[c].auroc, many[c].average_precision, many[c].n_scores) == pytest.approx(tuple(one))
    assert many["c"].auroc == 0.5 and many["c"].n_scores == 1


# ---------------------------------------------------------------- AG17
def test_known_small_sample_values():
    # Student's t: tables of the distribution, two-sided
    for t, dof, p in ((12.706204736432095, 1, 0.05), (4.302652729696142, 2, 0.05), (2.2281388519649385, 10, 0.05),
                      (3.169272672616951, 10, 0.01)):
        assert 10 ** -report.minus_log10_p("numeric", t, dof) == pytest.approx(p, rel=1e-9)
    # closed forms: one and two degrees of freedom
    for t in (0.01, 0.3, 1.0, 7.0, 1e3, 1e8):
        one, two = 1 - 2 / math.pi * math.atan(t), 2 / ((2 + t * t) * (1 + t / math.sqrt(2 + t * t)))
        assert report.minus_log10_p("numeric", t, 1) == pytest.approx(-math.log10(one if t < 1e3 else 2 / math.pi / t), rel=1e-6)
        assert report.minus_log10_p("numeric", -t, 2) == pytest.approx(-math.log10(two), rel=1e-9)
    assert report.minus_log10_p("numeric", 0.0, 5) == 0
    # many degrees of freedom: the normal distribution
    for t in (0.5, 3.0, 30.0):
        assert report.minus_log10_p("numeric", t, 1e13) == pytest.approx(report.minus_log10_p("numeric", t, None), rel=1e-9)
    assert math.isfinite(report.minus_log10_p("numeric", 1e5, 1e6))
    assert report.welch_dof(10, 2.0, 10, 2.0) == pytest.approx(18) and report.welch_dof(1, 0.0, 9, 1.0) is None


def _fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = [Fraction(math.comb(row, k) * math.comb(n - row, col - k), math.comb(n, col))
         for k in range(max(0, row + col - n), min(row, col) + 1)]
    return float(sum(x for x in p if x <= p[a - max(0, row + col - n)]))


def test_exact_test_of_small_tables():
    rng = random.Random(0)
    assert 10 ** report.exact_2x2(3, 1, 1, 3) == pytest.approx(17 / 35, rel=1e-12)  # the lady tasting tea
    for _ in range(300):
        t = [rng.randint(0, 12) for _ in range(4)]
        if sum(t):
            assert 10 ** report.exact_2x2(*t) == pytest.approx(_fisher(*t), rel=1e-9)
    assert report.exact_2x2(0, 2_000_000, 4, 0) < -20


def test_report_chooses_the_test(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(k % 4 == 0), float(rng.normal(k % 4 == 0)), bool(k in (0, 4, 8)), bool(rng.random() < 0.5), ["x", "y", "z"][k % 3])
            for k in range(120)]
    df = spark.createDataFrame(rows, "y boolean, num double, rare boolean, common boolean, cat string")
    got = {r.variable: r for r in report.with_p_values(report.cohort_comparison(df, "y", ["num"], ["rare", "common"], ["cat"])).collect()}
    assert {v: r.test for v, r in got.items()} == {"num": "welch", "rare": "exact", "common": "chi-square", "cat": "chi-square"}
    assert 10 ** -got["rare"].minus_log10_p == pytest.approx(_fisher(3, 27, 0, 90), rel=1e-9)
    a, b = [r[1] for r in rows if r[0]], [r[1] for r in rows if not r[0]]
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    assert got["num"].minus_log10_p == pytest.approx(report.minus_log10_p("numeric", (np.mean(a) - np.mean(b)) / math.sqrt(va + vb), dof))


# ---------------------------------------------------------------- L9
def test_boosted_trees_learn_what_a_line_cannot(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        a, b = rng.random(), rng.random()
        rows.append((k, a, b if k % 17 else None, int((a > 0.5) != (b > 0.5))))
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    train, test = df.where("id < 400"), df.where("id >= 400")
    auc = {}
    for kind in ("logistic", "gbt"):
        out = prep.baseline_logistic(train, test, ["a", "b"], "y", kind=kind, max_iter=15)
        assert out.columns == [*test.columns, "proba"] and out.count() == test.count()
        assert out.where("proba < 0 OR proba > 1 OR proba IS NULL").isEmpty()
        auc[kind] = E.auroc(out, "y", "proba").first()[0]
    assert auc["gbt"] > 0.9 > 0.7 > auc["logistic"]


def test_baseline_reads_written_scores(spark):
    """The model's stages and the scoring read one written table, not the panel anew."""
    import __spark_entry__ as E
    out = E.queries()["baseline_logistic"](spark, "/root/testdata/sf0.001")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    from stayline.plans.q_eval import scored
    assert out.where("proba > 0 AND proba < 1").count() == scored(spark, "/root/testdata/sf0.001").count() > 0
