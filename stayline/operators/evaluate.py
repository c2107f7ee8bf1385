"""Evaluation and explanation on scored tables (E1-E13, AG18, AG19, AG21).

Curves and areas work on score groups: ``groupBy(score)`` counts positives
and negatives (map-side combined), then cumulative counts from the highest
score down come from ``prefix_sums`` (range-partitioned, no single-partition
window), so continuous scores with millions of distinct values stay
distributed.  Areas are one aggregate over the score groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.functions.expr import col as Q_
from stayline.operators.quality import exact_quantiles
from stayline.operators.ranking import prefix_sums


def score_groups(df: DataFrame, y: str, s: str, by=None, following: str | None = None) -> DataFrame:
    """Positives / negatives per distinct score, with cumulative counts from
    the highest score down (inclusive) and class totals ``P`` and ``N``; inside the
    groups ``by``.  One range sort, written once, gives all of them."""
    by = [by] if isinstance(by, str) else list(by or [])
    yy = F.col(y).cast("int")
    g = df.where(F.col(s).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(s).alias("score")).agg(
        F.sum(yy).cast("bigint").alias("pos"), F.sum(1 - yy).cast("bigint").alias("neg"))
    c = prefix_sums(g, [F.col("score").desc()], ["pos", "neg"], by=by, totals="_all", following=following)
    return c.withColumnsRenamed({"pos_all": "P", "neg_all": "N"})


def _turns(next_: str) -> Column:
    """Does the ROC curve change direction at a point?  The steps to it and from it
    are the group's own counts and those of the next group: cross product not 0."""
    wide = "decimal(19,0)"
    p, n = F.col("pos").cast(wide), F.col("neg").cast(wide)
    q, m = F.col(f"pos{next_}").cast(wide), F.col(f"neg{next_}").cast(wide)
    return F.coalesce(p * m != n * q, F.lit(True))  # the last point stays


def roc_points(df: DataFrame, y: str, s: str, reduce: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the start
    point (threshold +inf, 0, 0).  ``reduce``: without the points that lie on the
    line between their neighbours; the curve and its area stay the same."""
    g = score_groups(df, y, s, following="_next" if reduce else None)
    if reduce:
        g = g.where(_turns("_next"))
    pts = g.select(F.col("score").cast("double").alias("threshold"),
                   (F.col("neg_cum") / F.col("N")).alias("fpr"), (F.col("pos_cum") / F.col("P")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def pr_points(df: DataFrame, y: str, s: str, reduce: bool = False) -> DataFrame:
    """(threshold, precision, recall) for every distinct score.  ``reduce``:
    without the points inside a run of equal recall (a vertical line: no positive
    at the threshold, none at the next), first and last of each run stay."""
    g = score_groups(df, y, s, following="_next" if reduce else None)
    if reduce:
        g = g.where((F.col("pos") > 0) | F.coalesce(F.col("pos_next") > 0, F.lit(True)))
    return g.select(F.col("score").cast("double").alias("threshold"),
                    (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
                    (F.col("pos_cum") / F.col("P")).alias("recall"))


def _auroc():
    below = F.col("N") - F.col("neg_cum")
    return F.sum(F.col("pos") * (below + F.col("neg") / 2.0)) / (F.first("P") * F.first("N"))


def _average_precision():
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    return F.sum(F.col("pos") / F.col("P") * prec)


def auroc(df: DataFrame, y: str, s: str) -> DataFrame:
    """P(score_pos > score_neg) + 0.5 P(tie), from score groups."""
    return score_groups(df, y, s).agg(_auroc().alias("auroc"))


def average_precision(df: DataFrame, y: str, s: str) -> DataFrame:
    """Sum over thresholds of (recall step) x precision (step rule)."""
    return score_groups(df, y, s).agg(_average_precision().alias("average_precision"))


def calibration_bins(df: DataFrame, y: str, p: str, bins: int = K.CALIBRATION_BINS) -> DataFrame:
    """E5: right-closed bins with edges ``i * (1/bins)`` as float products;
    a score equal to the lowest edge falls in no bin (pandas ``cut``)."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    v = F.col(p)
    b = None
    for i in range(bins):
        cond = (v > F.lit(edges[i])) & (v <= F.lit(edges[i + 1]))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    x = df.withColumn("_bin", b).where(F.col("_bin").isNotNull())
    out = x.groupBy("_bin").agg(F.sum(F.col(y).cast("bigint")).alias("n_pos"), F.count(F.lit(1)).alias("n"),
                                F.avg(F.col(y).cast("double")).alias("rate"))
    edge = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("_bin") + 1)
    edge_r = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("_bin") + 2)
    return out.select(edge.alias("bin_left"), edge_r.alias("bin_right"), "n_pos", "n", "rate")


def calibration_by_score(df: DataFrame, y: str, s: str) -> DataFrame:
    """AG19: size and mean outcome per discrete score value."""
    return df.groupBy(F.col(s).alias("score")).agg(F.count(F.lit(1)).alias("size"),
                                                   F.avg(F.col(y).cast("double")).alias("mean"))


def assess(df: DataFrame, y: str, s: str) -> DataFrame:
    """AUROC, AUPRC and number of score groups for one score, one row, all
    from the same score groups.  Rows without an outcome count for the number of
    scores only if another row of that score has one."""
    return score_groups(df, y, s).agg(_auroc().alias("auroc"), _average_precision().alias("average_precision"),
                                      F.count(F.lit(1)).alias("n_scores"))


def assess_many(df: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """E13 for several score columns: one row each, from one range sort of all."""
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("score_name"), Q_(c).cast("double").alias("_s")) for c in scores])).alias("_p"))
    g = score_groups(long.select("_y", "_p.*"), "_y", "_s", by="score_name")
    return g.groupBy("score_name").agg(_auroc().alias("auroc"), _average_precision().alias("average_precision"),
                                       F.count(F.lit(1)).alias("n_scores"))


# ---------------------------------------------------------------- losses
def _valid(df: DataFrame, step: str | None, maxsteps: str | None):
    if step and maxsteps:
        return df.where(F.col(step) < F.col(maxsteps))
    return df


def masked_log_loss(df: DataFrame, y: str, p: str, step: str | None = None,
                    maxsteps: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy over valid steps; logs clamped at -100."""
    x = _valid(df, step, maxsteps)
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    lg = F.greatest(F.log(pp), F.lit(-100.0))
    lg1 = F.greatest(F.log(1 - pp), F.lit(-100.0))
    # log(0) is NULL in Spark: clamp explicitly
    lg = F.when(pp <= 0, F.lit(-100.0)).otherwise(lg)
    lg1 = F.when(pp >= 1, F.lit(-100.0)).otherwise(lg1)
    bce = -(yy * lg + (1 - yy) * lg1)
    g = x.groupBy(*by) if by else x
    return g.agg(F.avg(bce).alias("log_loss"), F.count(F.lit(1)).alias("n_steps"))


def masked_mse(df: DataFrame, pairs: Sequence[tuple[str, str]], step: str | None = None,
               maxsteps: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error over valid steps x concept pairs (true, pred)."""
    x = _valid(df, step, maxsteps)
    sq = None
    for t, pr in pairs:
        d = (F.col(t).cast("double") - F.col(pr).cast("double"))
        term = d * d
        sq = term if sq is None else sq + term
    g = x.groupBy(*by) if by else x
    return g.agg((F.sum(sq) / (F.count(F.lit(1)) * len(pairs))).alias("mse"))


def observed_mse(df: DataFrame, pairs: Sequence[tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """sum(mask * (observed - reconstructed)^2) / sum(mask) over
    (observed, reconstructed, mask) column triples."""
    num = None
    den = None
    for o, r, m in pairs:
        mm = F.col(m).cast("double")
        d = F.coalesce(F.col(o).cast("double"), F.lit(0.0)) - F.col(r).cast("double")
        a, b = mm * d * d, mm
        num = a if num is None else num + a
        den = b if den is None else den + b
    g = df.groupBy(*by) if by else df
    return g.agg((F.sum(num) / F.sum(den)).alias("observed_mse"))


def total_loss(primary, aux, imputation, weights=K.LOSS_WEIGHTS):
    """Weighted total of the three losses (columns or literals)."""
    a, b, c = weights
    return primary * a + aux * b + imputation * c


def imputation_quality(df: DataFrame, split: str, triples: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per split and variable: missing percent and observed-cell MSE; with
    each variable's Train figures, by which ``train_order`` (S3) sorts."""
    parts = []
    for o, r, m in triples:
        mm = F.col(m).cast("double")
        d = F.coalesce(F.col(o).cast("double"), F.lit(0.0)) - F.col(r).cast("double")
        parts.append(F.struct(F.lit(o).alias("variable"), mm.alias("m"), (mm * d * d).alias("e")))
    long = df.select(split, F.explode(F.array(*parts)).alias("_s")).select(split, "_s.*")
    q = long.groupBy(split, "variable").agg(((1 - F.avg("m")) * 100).alias("missing_pct"),
                                            (F.sum("e") / F.sum("m")).alias("mse"))
    order = q.where(F.col(split) == "Train").select("variable", F.col("missing_pct").alias("_train_missing"),
                                                    F.col("mse").alias("_train_mse"))
    return q.join(order, on="variable", how="left")


def train_order(quality: DataFrame, split: str) -> DataFrame:
    """S3: rows of ``imputation_quality`` in the order of the Train rows, by
    missing percent and then MSE, ascending, with the place as ``position``."""
    w = Window.orderBy(F.asc_nulls_last("_train_missing"), F.asc_nulls_last("_train_mse"), "variable")
    names = quality.select("variable", "_train_missing", "_train_mse").distinct()  # a report: one row per variable
    place = names.select("variable", F.row_number().over(w).cast("bigint").alias("position"))
    return quality.join(place, "variable").orderBy("position", split)


def quartiles_by_actual(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """AG18: predicted-value quartiles per actual value: median and the
    distances down to Q1 and up to Q3."""
    q = exact_quantiles(df, actual, pred, [0.25, 0.5, 0.75], ["_q1", "median", "_q3"])
    return q.select(F.col(actual), "median", (F.col("median") - F.col("_q1")).alias("down"),
                    (F.col("_q3") - F.col("median")).alias("up"))


def loss_percentiles(log: DataFrame, by: Sequence[str] = ("split", "loss", "epoch"),
                     value: str = "value") -> DataFrame:
    """AG21: 25/50/75 percentiles of batch losses per split, loss and epoch."""
    return exact_quantiles(log, list(by), value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])


def explanation_trace(scored: DataFrame, ids: DataFrame, keys, step: str,
                      concepts: Sequence[tuple[str, str, str]], y: str, p: str) -> DataFrame:
    """Per hour of the chosen stays: true / predicted outcome and, per
    concept, true, predicted, relevance and contribution (long form)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    x = scored.join(ids.select(*keys), on=keys, how="left_semi")
    parts = [F.struct(F.lit(t).alias("concept"), F.col(t).cast("double").alias("concept_true"),
                      F.col(pr).cast("double").alias("concept_pred"), F.col(rel).cast("double").alias("relevance"),
                      (F.col(pr).cast("double") * F.col(rel).cast("double")).alias("contribution"))
             for t, pr, rel in concepts]
    return x.select(*keys, step, F.col(y).cast("double").alias("y_true"), F.col(p).cast("double").alias("y_pred"),
                    F.explode(F.array(*parts)).alias("_c")).select(*keys, step, "y_true", "y_pred", "_c.*")


def reconstruction_trace(scored: DataFrame, ids: DataFrame, keys, step: str,
                         variables: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Observed vs reconstructed values (and mask) of chosen variables for
    the chosen stays, long form; keyed by the drawn stay id."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    on = [c for c in ids.columns if c in scored.columns]  # with the split, if ids were drawn per split
    x = scored.join(ids.select(*on), on=on, how="left_semi")
    parts = [F.struct(F.lit(o).alias("variable"), F.col(o).cast("double").alias("observed"),
                      F.col(r).cast("double").alias("reconstructed"), F.col(m).cast("int").alias("mask"))
             for o, r, m in variables]
    return x.select(*keys, step, F.explode(F.array(*parts)).alias("_v")).select(*keys, step, "_v.*")
