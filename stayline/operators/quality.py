"""Data quality and distribution operators: exact quantiles (AG7), outlier
trimming (AG8/AG9), medians (AG2/AG6), profiles (AG10/AG20/PF10), histograms
(AG14), quantile bins (AG15), presence overlap (AG16).

Exact quantiles at scale
------------------------
``percentile`` buffers every distinct value of a group in one task; a group
holding a third of all rows would not fit.  ``exact_quantiles`` instead

1. counts equal values per group (map-side combined), so that a frequent value
   is one row,
2. range-partitions the distinct values on ``(group, value)`` - a hot group is
   split over many partitions by the sampled range bounds,
3. derives the ranks that every value covers from running sums of the counts
   (``ranking.prefix_sums``), and
4. keeps only the values at the ranks needed for linear interpolation.

The result equals linear-interpolation quantiles (``quantile_cont``, pandas
``quantile``) exactly; no group is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_
from stayline.functions.expr import true_or_false
from stayline.operators.ranking import null_safe_join, prefix_sums

def _as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def exact_quantiles(df: DataFrame, by, c: str, probs: Sequence[float],
                    names: Sequence[str] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """AG7: linear-interpolation quantiles of ``c`` per ``by`` group, NULLs skipped.

    Returns one row per group: ``by..., <name per prob>``.
    """
    by = _as_list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    val = exact_quantiles_long(df, by, c, probs, partitions)
    aggs = [F.max(F.when(F.col("qi") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    if by:
        return val.groupBy(*by).agg(*aggs)
    return val.agg(*aggs)


def exact_quantiles_long(df: DataFrame, by, c: str, probs: Sequence[float] | None = None,
                         partitions: int | None = None, n_grid: int | None = None) -> DataFrame:
    """Same as ``exact_quantiles`` in long form: ``by..., qi, q`` (one row
    per group and probability) - for many probabilities (scaler knots).

    With ``n_grid`` the probabilities are ``linspace(0, 1, m)`` with
    ``m = min(n_grid, n)`` per group (the quantile-scaler knots), generated
    inside Spark from the group counts."""
    by = _as_list(by)
    x = df.where(Q_(c).isNotNull()).select(*by, Q_(c).cast("double").alias("_v"))
    x = x.where(~F.isnan("_v"))
    # a frequent value is one row with its count before anything is sorted
    x = x.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    x = prefix_sums(x, ["_v"], ["_c"], by, partitions=partitions, totals="_n")
    # a value stands at the ranks [cum - count, cum) of its group of n rows
    n, first, stop = F.col("_c_n"), F.col("_c_cum") - F.col("_c"), F.col("_c_cum")
    if n_grid:
        m = F.least(F.lit(n_grid).cast("bigint"), n)
        step = F.when(m > 1, F.lit(1.0) / (m - 1)).otherwise(F.lit(0.0))
        per = F.greatest((n - 1) * step, F.lit(1e-300))  # ranks between two knots
        lo = F.greatest(F.floor((first - 1) / per) - 1, F.lit(0)).cast("bigint")
        hi = F.least(F.ceil(stop / per) + 1, m - 1).cast("bigint")
        near = F.when(lo <= hi, F.sequence(lo, hi))  # the knots that may lie here
        targets = F.transform(near, lambda q: F.struct(q.alias("qi"), ((n - 1) * (q * step)).alias("h")))
    else:
        targets = F.array(*[F.struct(F.lit(i).cast("bigint").alias("qi"), ((n - 1) * F.lit(float(p))).alias("h"))
                            for i, p in enumerate(probs)])
    lower = lambda t: F.floor(t["h"]).cast("bigint")
    upper = lambda t: F.least(lower(t) + 1, n - 1)
    here = lambda r: (r >= first) & (r < stop)
    hit = F.transform(F.filter(targets, lambda t: here(lower(t)) | here(upper(t))), lambda t: F.struct(
        t["qi"].alias("qi"), (t["h"] - lower(t)).alias("frac"), here(lower(t)).alias("is_lo"), here(upper(t)).alias("is_hi")))
    x = x.select(*by, "_v", F.explode(hit).alias("_t"))
    x = x.groupBy(*by, F.col("_t.qi").alias("qi")).agg(
        F.max("_t.frac").alias("_frac"), F.max(F.when(F.col("_t.is_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_t.is_hi"), F.col("_v"))).alias("_vhi"))
    q = F.when(F.col("_frac") == 0, F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    return x.select(*by, "qi", q.alias("q"))


def quantile_limits(df: DataFrame, by, c: str, lo: float = 0.01, hi: float = 0.99,
                    approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """AG7: (lo, hi) limits per group; ``approx`` uses ``approx_percentile``."""
    by = _as_list(by)
    if approx:
        q = F.percentile_approx(c, [lo, hi], accuracy)
        g = df.groupBy(*by) if by else df
        return g.agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("lo_limit"),
                                           F.col("_q")[1].alias("hi_limit"))
    return exact_quantiles(df, by, c, [lo, hi], ["lo_limit", "hi_limit"])


SKETCH_K = 4096  # rank error of a KLL sketch of this size: below 0.1 % in 99 % of the cases


def quantile_sketches(df: DataFrame, by, c: str, k: int = SKETCH_K) -> DataFrame:
    """AG7 per load: one KLL sketch of ``c`` per group (``by``, ``sketch``), of fixed size
    however many rows the group has; built before the shuffle and merged after."""
    by = _as_list(by)
    x = df.where(Q_(c).isNotNull())
    agg = F.kll_sketch_agg_double(Q_(c).cast("double"), F.lit(k)).alias("sketch")
    return x.groupBy(*by).agg(agg) if by else x.agg(agg)


def merge_sketches(loads: DataFrame, by, k: int = SKETCH_K) -> DataFrame:
    """Sketches of several loads (rows of ``quantile_sketches``, unioned) as one per
    group: limits follow new data without a scan of the old."""
    by = _as_list(by)
    agg = F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    return loads.groupBy(*by).agg(agg) if by else loads.agg(agg)


def sketch_limits(sketches: DataFrame, by, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """``lo_limit``, ``hi_limit`` per group from its sketch."""
    return sketches.select(*_as_list(by), *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(n)
                                            for q, n in ((lo, "lo_limit"), (hi, "hi_limit"))])


def trim_outliers(df: DataFrame, by, c: str, lo: float = 0.01, hi: float = 0.99,
                  exempt: Sequence[str] = (), keep_null: bool = True,
                  action: str = "drop", limits: DataFrame | None = None) -> DataFrame:
    """AG8 / AG9: drop rows outside the per-group limits.

    ``keep_null=True`` (AG8): rows with a NULL value are kept and rows of
    ``exempt`` groups are never touched.  ``keep_null=False`` (AG9): only rows
    with ``lo <= v <= hi`` survive.  ``action='clip'`` clips instead (the
    README variant).  The limits are a plain join: AQE decides from their
    measured size whether they are broadcast.
    """
    by = _as_list(by)
    src = df
    if exempt and by:
        src = df.where(~true_or_false(F.col(by[0]).isin(list(exempt))))
    lim = limits if limits is not None else quantile_limits(src, by, c, lo, hi)
    if not by:
        x = df.crossJoin(F.broadcast(lim))  # one row
    else:
        x = null_safe_join(df, lim, by, "left")
    v = Q_(c)
    is_exempt = true_or_false(F.col(by[0]).isin(list(exempt))) if (exempt and by) else F.lit(False)
    if action == "clip":
        clipped = F.when(v < F.col("lo_limit"), F.col("lo_limit")).when(
            v > F.col("hi_limit"), F.col("hi_limit")).otherwise(v)
        x = x.withColumn(c, F.when(is_exempt, v).otherwise(clipped))
        if not keep_null:
            x = x.where(v.isNotNull())
    elif keep_null:
        outside = true_or_false((v < F.col("lo_limit")) | (v > F.col("hi_limit")))
        x = x.where(is_exempt | ~outside)
    else:
        x = x.where(is_exempt | true_or_false(v.between(F.col("lo_limit"), F.col("hi_limit"))))
    return x.drop("lo_limit", "hi_limit")


def group_median(df: DataFrame, by, c: str, out: str | None = None) -> DataFrame:
    """AG2: exact (interpolated) median per group, skew safe."""
    return exact_quantiles(df, by, c, [0.5], [out or c])


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG6: whole-column medians of several columns in one range sort:
    columns are unpivoted to ``(column, value)`` and ranked per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), Q_(c).cast("double").alias("value")) for c in cols])).alias("_s"))
    long = long.select("_s.column", "_s.value")
    med = exact_quantiles(long, "column", "value", [0.5], ["median"])
    return med.groupBy().pivot("column", list(cols)).agg(F.first("median"))


def fill_with_stats(df: DataFrame, cols: Sequence[str], stats_row: DataFrame) -> DataFrame:
    """AG6: coalesce every column with its one-row statistic (broadcast)."""
    s = stats_row.select(*[Q_(c).alias(f"_fill_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(s))
    x = x.withColumns({c: F.coalesce(Q_(c), F.col(f"_fill_{c}")) for c in cols})
    return x.drop(*[f"_fill_{c}" for c in cols])


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AG10: fraction of NULLs per column, one aggregate pass, long form."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.avg(Q_(c).isNull().cast("double")).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), Q_(c).alias("null_frac")) for c in cols])).alias("_s")) \
        .select("_s.column", "_s.null_frac")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, Column]:
    """Aggregates of the null profile, to be observed while ``df`` is written:
    rows (``n``) and NULLs of column i (``c<i>``)."""
    cols = list(cols or df.columns)
    return {"n": F.count(F.lit(1)), **{f"c{i}": F.count_if(Q_(c).isNull()) for i, c in enumerate(cols)}}


def observed_profile(metrics: Mapping[str, int], cols: Sequence[str]) -> dict[str, float]:
    """AG10 from observed ``null_counts``: NULL fraction per column."""
    n = int(metrics["n"] or 0)
    return {c: int(metrics[f"c{i}"] or 0) / n for i, c in enumerate(cols)} if n else {}


def drop_sparse(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.95,
                profile: Mapping[str, float] | None = None) -> DataFrame:
    """PF10: drop columns whose NULL fraction is strictly above the threshold.

    The column list shapes the plan, so the one-row profile is fetched, unless
    it was taken when the table was written (``observed_profile``)."""
    if profile is None:
        drop = [r["column"] for r in null_profile(df, cols).where(F.col("null_frac") > threshold).collect()]
    else:
        drop = [c for c in (cols or df.columns) if profile.get(c, 0.0) > threshold]
    return df.drop(*drop)


def histogram(df: DataFrame, c: str, bins: int = 10, by=None) -> DataFrame:
    """AG14: fixed-width bins between min and max; last bin closed on the right."""
    by = _as_list(by)
    v = Q_(c)
    x = df.where(v.isNotNull())
    stats = (x.groupBy(*by) if by else x).agg(F.min(Q_(c)).alias("_mn"), F.max(Q_(c)).alias("_mx"))
    x = null_safe_join(x, stats, by) if by else x.crossJoin(F.broadcast(stats))  # grouped: AQE decides
    width = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    idx = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_mn")) / width), F.lit(bins - 1))).cast("int")
    x = x.withColumn("bin", idx)
    out = x.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                    F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    return out.select(*by, "bin", (F.col("_mn") + F.col("bin") * w).alias("left"),
                      (F.col("_mn") + (F.col("bin") + 1) * w).alias("right"), "n")


def quantile_edges(df: DataFrame, c: str, n: int) -> DataFrame:
    """AG15: one row with the sorted distinct qcut edges of ``c``."""
    probs = [i / n for i in range(n + 1)]
    q = exact_quantiles(df, None, c, probs, [f"e{i}" for i in range(n + 1)])
    return q.select(F.array_sort(F.array_distinct(F.array(*[f"e{i}" for i in range(n + 1)]))).alias("edges"))


def quantile_bins(df: DataFrame, c: str, n: int = 10, out: str = "bin") -> DataFrame:
    """AG15: equal-frequency bins, duplicate edges dropped, right-closed, the
    first bin includes the minimum.  Adds ``bin``, ``bin_left``, ``bin_right``."""
    edges = quantile_edges(df, c, n)
    x = df.where(Q_(c).isNotNull()).crossJoin(F.broadcast(edges))
    below = F.size(F.filter("edges", lambda e: e < Q_(c)))
    idx = F.greatest(below - 1, F.lit(0))
    x = x.withColumn(out, idx.cast("int"))
    x = x.withColumn(f"{out}_left", F.element_at("edges", F.col(out) + 1)) \
         .withColumn(f"{out}_right", F.element_at("edges", F.col(out) + 2))
    return x.drop("edges")


def outcome_by_bin(binned: DataFrame, outcome: str, b: str = "bin") -> DataFrame:
    """AG15 (second half): mean outcome per bin."""
    return binned.groupBy(b, f"{b}_left", f"{b}_right").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("outcome_mean"))


def presence_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG16: rows with both, only a, only b, neither present."""
    pa, pb = F.col(a).isNotNull(), F.col(b).isNotNull()
    return df.agg(F.count_if(pa & pb).alias("both"), F.count_if(pa & ~pb).alias("only_a"),
                  F.count_if(~pa & pb).alias("only_b"), F.count_if(~pa & ~pb).alias("neither"),
                  F.count(F.lit(1)).alias("total"))


def feature_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG20: min / max / mean / sample std per column, long form (typed)."""
    aggs = []
    for c in cols:
        v = Q_(c).cast("double")
        aggs += [F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
                 F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), Q_(f"{c}__min").alias("min"), Q_(f"{c}__max").alias("max"),
                 Q_(f"{c}__mean").alias("mean"), Q_(f"{c}__std").alias("std")) for c in cols])).alias("_s")
    ).select("_s.*")
