"""Cohort reports: sizes (AG12), prevalence (AG13), cohort comparison (AG17).

All outputs are report-sized (one row per variable or flag); the work is a
single aggregate pass over the data-sized input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def cohort_size(panel: DataFrame, keys, label: str) -> DataFrame:
    """AG12: distinct stays, stays with any positive step, and their log2."""
    s = panel.groupBy(*_as_list(keys)).agg(F.bool_or(label).alias("_pos"))
    return s.agg(F.count(F.lit(1)).alias("n_stays"), F.count_if("_pos").alias("n_positive")) \
            .withColumn("log2_stays", F.log2(F.col("n_stays").cast("double"))) \
            .withColumn("log2_positive", F.log2(F.col("n_positive").cast("double")))


def label_prevalence(panel: DataFrame, keys, label: str) -> DataFrame:
    """AG13: percent positive per stay (any step) and per step, 1 decimal."""
    per_stay = panel.groupBy(*_as_list(keys)).agg(F.bool_or(label).alias("_pos")) \
        .agg(F.round(F.avg(F.col("_pos").cast("double")) * 100, 1).alias("pct")) \
        .select(F.lit("per_stay").alias("flag"), "pct")
    per_step = panel.agg(F.round(F.avg(F.col(label).cast("double")) * 100, 1).alias("pct")) \
        .select(F.lit("per_step").alias("flag"), "pct")
    return per_stay.unionByName(per_step)


def stay_counts() -> dict:
    """Aggregates over one row per stay (``_pos``: any positive step, ``_steps``,
    ``_steps_pos``), to be observed while those rows are written."""
    return {"n_stays": F.count(F.lit(1)), "n_positive": F.count_if("_pos"), "n_steps": F.sum("_steps"),
            "n_steps_positive": F.sum("_steps_pos")}


def observed_size(spark, m) -> DataFrame:
    """AG12 from observed ``stay_counts``."""
    one = spark.range(1).select(F.lit(int(m["n_stays"] or 0)).cast("bigint").alias("n_stays"),
                                F.lit(int(m["n_positive"] or 0)).cast("bigint").alias("n_positive"))
    return one.withColumn("log2_stays", F.log2(F.col("n_stays").cast("double"))) \
              .withColumn("log2_positive", F.log2(F.col("n_positive").cast("double")))


def observed_prevalence(spark, m) -> DataFrame:
    """AG13 from observed ``stay_counts``."""
    def pct(part, whole):
        return F.round(F.lit(float(m[part] or 0)) / F.lit(float(m[whole] or 0)) * 100, 1) if m[whole] else F.lit(None).cast("double")
    rows = F.array(F.struct(F.lit("per_stay").alias("flag"), pct("n_positive", "n_stays").alias("pct")),
                   F.struct(F.lit("per_step").alias("flag"), pct("n_steps_positive", "n_steps").alias("pct")))
    return spark.range(1).select(F.explode(rows).alias("_s")).select("_s.*")


def prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """AG13: percent true per flag column, long form, sorted descending."""
    row = df.agg(*[F.round(F.avg(F.col(f).cast("double")) * 100, 1).alias(f) for f in flags])
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("pct")) for f in flags])).alias("_s")).select("_s.*")
    return out.orderBy(F.desc("pct"), "flag")


# ---------------------------------------------------------------- AG17
def _log10_erfc(x: float) -> float:
    """log10(erfc(x)) for x >= 0, by its asymptotic series where erfc itself
    would leave the range of a double."""
    if x < 5:
        return math.log10(math.erfc(x))
    y = 1 / (2 * x * x)
    tail = 1 - y * (1 - 3 * y * (1 - 5 * y))
    return -x * x / math.log(10) + math.log10(tail / (x * math.sqrt(math.pi)))


def _log10_gamma_q(a: float, x: float) -> float:
    """log10 of the upper regularised incomplete gamma function Q(a, x)."""
    head = a * math.log(x) - x - math.lgamma(a) if x > 0 else -math.inf
    if x <= 0:
        return 0.0
    if x < a + 1:  # series of P(a, x)
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return math.log10(max(1 - math.exp(head) * total, 1e-300))
    tiny = 1e-300  # continued fraction of Q(a, x)
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c if abs(b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return (head + math.log(h)) / math.log(10)


def _log_beta_half(a: float) -> float:
    """log of the beta function B(a, 1/2); for a large a by the asymptotic series of
    the gamma ratio, where the difference of two log-gammas would lose all digits."""
    if a < 100:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return math.lgamma(0.5) - (0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3) - 1 / (640 * a ** 5))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def off(v):
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1 / off(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 200_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / off(1 + num * d)
            c = off(1 + num / c)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _log10_t_tails(t: float, dof: float) -> float:
    """log10 of the two-sided tail of Student's t: I_x(dof / 2, 1 / 2) at
    x = dof / (dof + t^2), in logs, so no statistic underflows."""
    t2 = t * t
    if t2 == 0:
        return 0.0
    if dof > 1e6:  # Wallace's normal deviate: its error falls with the square of dof
        return _log10_erfc((8 * dof + 1) / (8 * dof + 3) * math.sqrt(dof * math.log1p(t2 / dof) / 2))
    a, b = dof / 2, 0.5
    log_x, log_rest = -math.log1p(t2 / dof), -math.log1p(dof / t2)
    front = a * log_x + b * log_rest - _log_beta_half(a)
    x = dof / (dof + t2)
    if x < (a + 1) / (a + b + 2):
        return (front - math.log(a) + math.log(_beta_fraction(a, b, x))) / math.log(10)
    rest = math.exp(front - math.log(b)) * _beta_fraction(b, a, t2 / (dof + t2))
    return math.log1p(-rest) / math.log(10)


def welch_dof(n1: float, s1: float, n0: float, s0: float) -> float | None:
    """Welch-Satterthwaite degrees of freedom; None where a group has no variance estimate."""
    if min(n1, n0) < 2:
        return None
    v1, v0 = s1 * s1 / n1, s0 * s0 / n0
    low = v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)
    return (v1 + v0) ** 2 / low if low > 0 else None


def exact_2x2(a: int, b: int, c: int, d: int) -> float:
    """log10 of the two-sided p of Fisher's exact test: the probabilities, given the
    margins, of all tables that are no likelier than the observed one."""
    row, col, n = a + b, a + c, a + b + c + d

    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    total = choose(n, col)
    logs = [choose(row, k) + choose(n - row, col - k) - total for k in range(max(0, row + col - n), min(row, col) + 1)]
    seen = logs[a - max(0, row + col - n)]
    part = [x for x in logs if x <= seen + 1e-7]
    top = max(part)
    return min(0.0, (top + math.log(math.fsum(math.exp(x - top) for x in part))) / math.log(10))


def minus_log10_p(kind: str, stat: float | None, dof: float | None) -> float | None:
    """-log10 of the p-value: two-sided Student's t with ``dof`` for ``numeric``
    (normal without), chi-square with ``dof`` degrees of freedom otherwise; finite
    for any finite statistic."""
    if stat is None or math.isnan(stat):
        return None
    if kind == "numeric":
        return -(_log10_t_tails(stat, dof) if dof else _log10_erfc(abs(stat) / math.sqrt(2.0)))
    if not dof:
        return None
    return -_log10_gamma_q(dof / 2.0, max(stat, 0.0) / 2.0)


SMALL_EXPECTED = 5  # below it chi-square is no approximation of a 2 x 2 table


def _row_p(r: dict) -> tuple[float | None, str | None]:
    """(-log10 p, test) of one row of a cohort comparison."""
    if r["kind"] == "numeric":
        if r["test_stat"] is None:
            return None, None
        dof = welch_dof(r["n_pos"], r["sd_pos"], r["n_neg"], r["sd_neg"])
        return minus_log10_p("numeric", r["test_stat"], dof), "welch" if dof else "normal"
    if r["kind"] == "binary" and r["n_pos"] and r["n_neg"]:
        a, c = round(r["stat_pos"] * r["n_pos"] / 100), round(r["stat_neg"] * r["n_neg"] / 100)
        n, true = r["n_pos"] + r["n_neg"], a + c
        if min(r["n_pos"], r["n_neg"]) * min(true, n - true) < SMALL_EXPECTED * n:
            return abs(exact_2x2(a, r["n_pos"] - a, c, r["n_neg"] - c)), "exact"
    p = minus_log10_p(r["kind"], r["test_stat"], r["dof"])
    return p, None if p is None else "chi-square"


def cohort_comparison(df: DataFrame, outcome: str, numeric: Sequence[str] = (),
                      binary: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """AG17 ("table one"): every variable by outcome group.

    Own definition (the reference calls an external package): numeric
    variables get n / mean / sample sd per group and Welch's t; boolean
    variables get counts of true per group and the 2x2 chi-square statistic;
    ``categorical`` variables (any number of levels) the r x c chi-square over
    their levels with ``dof`` = (r - 1) (c - 1).  Moments and two-level counts
    come from one aggregate pass, level counts from a second; ``with_p_values``
    adds the p-value to the report-sized result.  Rows with a missing value of
    the variable are left out of that variable's statistics.
    """
    y = F.col(outcome).cast("boolean")
    aggs = []
    for c in numeric:
        v = F.col(c).cast("double")
        for g, cond in (("1", y), ("0", ~y)):
            vv = F.when(cond, v)
            aggs += [F.count(vv).alias(f"{c}__n{g}"), F.avg(vv).alias(f"{c}__m{g}"),
                     F.stddev_samp(vv).alias(f"{c}__s{g}")]
    for c in binary:
        b = F.col(c).cast("boolean")
        for g, cond in (("1", y), ("0", ~y)):
            aggs += [F.count_if(cond & b.isNotNull()).alias(f"{c}__n{g}"),
                     F.count_if(cond & b).alias(f"{c}__k{g}")]
    row = df.where(F.col(outcome).isNotNull()).agg(*aggs) if aggs else None
    parts = []
    for c in numeric:
        n1, n0 = F.col(f"{c}__n1"), F.col(f"{c}__n0")
        m1, m0, s1, s0 = (F.col(f"{c}__m1"), F.col(f"{c}__m0"), F.col(f"{c}__s1"), F.col(f"{c}__s0"))
        se = F.sqrt(s1 * s1 / n1 + s0 * s0 / n0)
        t = F.when(se > 0, (m1 - m0) / se)
        parts.append(F.struct(F.lit(c).alias("variable"), F.lit("numeric").alias("kind"),
                              n1.alias("n_pos"), n0.alias("n_neg"), m1.alias("stat_pos"), m0.alias("stat_neg"),
                              s1.alias("sd_pos"), s0.alias("sd_neg"), F.lit(None).cast("double").alias("dof"),
                              t.alias("test_stat")))
    for c in binary:
        n1, n0 = F.col(f"{c}__n1").cast("double"), F.col(f"{c}__n0").cast("double")
        k1, k0 = F.col(f"{c}__k1").cast("double"), F.col(f"{c}__k0").cast("double")
        n = n1 + n0
        a, b, cc, d = k1, n1 - k1, k0, n0 - k0
        den = (a + b) * (cc + d) * (a + cc) * (b + d)
        chi = F.when(den > 0, n * (a * d - b * cc) * (a * d - b * cc) / den)
        parts.append(F.struct(F.lit(c).alias("variable"), F.lit("binary").alias("kind"),
                              F.col(f"{c}__n1").alias("n_pos"), F.col(f"{c}__n0").alias("n_neg"),
                              (k1 / n1 * 100).alias("stat_pos"), (k0 / n0 * 100).alias("stat_neg"),
                              F.lit(None).cast("double").alias("sd_pos"), F.lit(None).cast("double").alias("sd_neg"),
                              F.lit(1.0).alias("dof"), chi.alias("test_stat")))
    out = row.select(F.explode(F.array(*parts)).alias("_s")).select("_s.*") if parts else None
    if categorical:
        cat = _categorical(df.where(F.col(outcome).isNotNull()), y, list(categorical))
        out = cat if out is None else out.unionByName(cat)
    return out


def _categorical(df: DataFrame, y, variables: list[str]) -> DataFrame:
    """r x c chi-square of every variable against the outcome, from level counts
    (one row per variable and level after the map-side combine)."""
    level = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("string").alias("level"))
                                for v in variables])).alias("_l")
    n = df.select(y.cast("int").alias("_y"), level).select("_y", "_l.*").where(F.col("level").isNotNull())
    n = n.groupBy("variable", "level").agg(F.sum("_y").cast("double").alias("a"),
                                           F.sum(1 - F.col("_y")).cast("double").alias("b"))
    tot = n.groupBy("variable").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("r"))
    n = n.join(tot, "variable")
    both, rows = F.col("ta") + F.col("tb"), F.col("a") + F.col("b")

    def term(seen, side):
        expected = rows * F.col(side) / both
        return F.when(expected > 0, (F.col(seen) - expected) * (F.col(seen) - expected) / expected)

    columns = (F.first("ta") > 0).cast("int") + (F.first("tb") > 0).cast("int")
    none = F.lit(None).cast("double")
    return n.groupBy("variable").agg(
        F.lit("categorical").alias("kind"), F.first("ta").cast("bigint").alias("n_pos"),
        F.first("tb").cast("bigint").alias("n_neg"), none.alias("stat_pos"), none.alias("stat_neg"),
        none.alias("sd_pos"), none.alias("sd_neg"), ((F.first("r") - 1) * (columns - 1)).cast("double").alias("dof"),
        F.sum(term("a", "ta") + term("b", "tb")).alias("test_stat")).select(
        "variable", "kind", "n_pos", "n_neg", "stat_pos", "stat_neg", "sd_pos", "sd_neg", "dof", "test_stat")


def with_p_values(table: DataFrame) -> DataFrame:
    """Add ``minus_log10_p`` and ``test`` to a cohort comparison (report-sized: one
    row per variable, so it is brought to the driver) and sort by it, descending.

    Numeric variables: Welch's t with its own degrees of freedom.  Boolean ones:
    chi-square, or Fisher's exact test where an expected count is below 5."""
    rows = table.collect()
    out = []
    for r in rows:
        d = r.asDict()
        d["minus_log10_p"], d["test"] = _row_p(d)
        out.append(d)
    schema = T.StructType(table.schema.fields + [T.StructField("minus_log10_p", T.DoubleType()),
                                                 T.StructField("test", T.StringType())])
    res = table.sparkSession.createDataFrame([tuple(d[f.name] for f in schema.fields) for d in out], schema)
    return res.orderBy(F.desc_nulls_last("minus_log10_p"), "variable")
