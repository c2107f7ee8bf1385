"""Catalogue: split, scaling, packing, sampling, evaluation and explanation
(L3-L9, R6, R7, S4, S5, E1-E13, AG17-AG19, AG21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stayline.operators import evaluate as E, prep, report, windows as W
from stayline.plans.base import (KEYS, LABELLED_SQL, LABELS, PANEL_SQL, finish,
                                 labelled_panel, panel, rounded_sql, sessions, stay_table, table)
from stayline.functions import expr as X
from stayline.plans.q_panel import SCORE_CUTS, _ff_sql, _score_case
from stayline.plans.registry import register
from stayline.session import cut_lineage

WS = "PARTITION BY user_id, session_no ORDER BY hour"
N_EXPLAINED = 20  # stays of an explanation report
N_RECONSTRUCTED = 5  # stays of each split in a reconstruction report


def _md5(keys, seed):
    return "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f", '{seed}'))"


# ---------------------------------------------------------------- scored tables
def event_scores(spark, d):
    """Scored events: y = purchase event, score = value / 500 (0..1)."""
    ev = table(spark, d, "events").where(F.col("value").isNotNull())
    return ev.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"),
                     (F.col("value") / 500).alias("s"))


EV_SQL = """x AS (SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y, value / 500 AS s
        FROM events WHERE value IS NOT NULL),
g AS (SELECT s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM x GROUP BY s),
c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)"""


def scored(spark, d):
    """Scored panel: y = 24 h label, y_proba from the forward-filled value,
    concept true / predicted = score and its rolling max (scaled 0..1),
    relevance from purchases, observed / reconstructed / mask for click.
    One labelled panel, every column from windows on the same partitioning."""
    x = labelled_panel(spark, d)
    x = x.withColumn("view_ff", W.ffill_col("view", KEYS))
    x = x.withColumn("score", X.threshold_score("view_ff", ">=", SCORE_CUTS))
    x = x.withColumn("score_roll24", W.rolling_max("score", KEYS, 24))
    w = W.spec(KEYS).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("step", W.hours_since_start(KEYS)).withColumn("maxsteps", F.count(F.lit(1)).over(w))
    x = x.withColumn("y", F.col("label").cast("int"))
    x = x.withColumn("y_proba", F.least(F.coalesce(F.col("view_ff"), F.lit(0.0)) / 500, F.lit(1.0)))
    x = x.withColumn("c_true", F.col("score") / 4.0).withColumn("c_pred", F.col("score_roll24") / 4.0)
    x = x.withColumn("relevance", F.coalesce(W.ffill_col("purchase", KEYS), F.lit(0.0)) / 500)
    x = x.withColumn("obs", F.col("click")).withColumn("rec", F.coalesce(W.ffill_col("click", KEYS), F.lit(0.0)))
    x = x.withColumn("mask", F.col("click").isNotNull().cast("int"))
    x = x.withColumn("split", F.when(F.col("hour") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit("Train"))
                     .otherwise(F.lit("Test")))
    return x


SCORED_SQL = LABELLED_SQL + f""",
f AS (SELECT *, {_ff_sql('view')} AS view_ff, {_ff_sql('purchase')} AS purchase_ff,
             {_ff_sql('click')} AS click_ff FROM lp),
s0 AS (SELECT *, {_score_case('view_ff', '>=', SCORE_CUTS)} AS score FROM f),
sc AS (SELECT user_id, session_no, hour, view_ff, score, label,
              max(score) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS score_roll24,
              CAST(row_number() OVER ({WS}) - 1 AS BIGINT) AS step,
              count(*) OVER (PARTITION BY user_id, session_no) AS maxsteps,
              CAST(label AS INTEGER) AS y, least(coalesce(view_ff, 0.0) / 500, 1.0) AS y_proba,
              score / 4.0 AS c_true,
              coalesce(purchase_ff, 0.0) / 500 AS relevance, click AS obs, coalesce(click_ff, 0.0) AS rec,
              CAST(click IS NOT NULL AS INTEGER) AS mask,
              CASE WHEN hour < TIMESTAMP '2024-01-16' THEN 'Train' ELSE 'Test' END AS split
       FROM s0),
scored AS (SELECT *, score_roll24 / 4.0 AS c_pred FROM sc)"""


# ---------------------------------------------------------------- E1-E5
register("roc_points", rounded_sql("WITH " + EV_SQL + """
  SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
  UNION ALL SELECT s AS threshold, cn / N AS fpr, cp / P AS tpr FROM c, t""", ["threshold", "fpr", "tpr"]))(
    lambda spark, d: finish(E.roc_points(event_scores(spark, d), "y", "s")))

register("pr_points", rounded_sql("WITH " + EV_SQL + """
  SELECT s AS threshold, cp / (cp + cn) AS precision, cp / P AS recall FROM c, t""",
    ["threshold", "precision", "recall"]))(
    lambda spark, d: finish(E.pr_points(event_scores(spark, d), "y", "s")))

register("auroc", rounded_sql("""
  WITH x AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, value / 500 AS s FROM events WHERE value IS NOT NULL),
  r AS (SELECT y, s, row_number() OVER (ORDER BY s) AS rn FROM x),
  a AS (SELECT y, avg(rn) OVER (PARTITION BY s) AS ar FROM r),
  t AS (SELECT sum(y) AS P, sum(1 - y) AS N FROM x)
  SELECT (sum(CASE WHEN y = 1 THEN ar END) - max(P) * (max(P) + 1) / 2) / (max(P) * max(N)) AS auroc
  FROM a, t""", ["auroc"]))(
    lambda spark, d: finish(E.auroc(event_scores(spark, d), "y", "s")))

register("average_precision", rounded_sql("WITH " + EV_SQL + """
  SELECT sum(pos / P * (cp / (cp + cn))) AS average_precision FROM c, t""", ["average_precision"]))(
    lambda spark, d: finish(E.average_precision(event_scores(spark, d), "y", "s")))


def _edges_sql():
    return [f"CAST('{repr(i * (1.0 / 10))}' AS DOUBLE)" for i in range(11)]


_EDG = _edges_sql()
register("calibration_bins", rounded_sql("""
  WITH x AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, value / 500 AS s FROM events WHERE value IS NOT NULL),
  b AS (SELECT y, CASE """ + " ".join(f"WHEN s > {_EDG[i]} AND s <= {_EDG[i + 1]} THEN {i}" for i in range(10)) + """ END AS bin
        FROM x)
  SELECT [""" + ", ".join(_EDG) + """][bin + 1] AS bin_left, [""" + ", ".join(_EDG) + """][bin + 2] AS bin_right,
         CAST(sum(y) AS BIGINT) AS n_pos, count(*) AS n, avg(CAST(y AS DOUBLE)) AS rate
  FROM b WHERE bin IS NOT NULL GROUP BY bin""", ["bin_left", "bin_right", "rate"]))(
    lambda spark, d: finish(E.calibration_bins(event_scores(spark, d), "y", "s")))


# ---------------------------------------------------------------- AG19 / E13 / AG18
register("calibration_by_score", rounded_sql("WITH " + SCORED_SQL + """
  SELECT score, count(*) AS size, avg(CAST(y AS DOUBLE)) AS mean FROM scored GROUP BY score""", ["mean"]))(
    lambda spark, d: finish(E.calibration_by_score(scored(spark, d), "y", "score")))


def _assess(spark, d):
    return finish(E.assess(scored(spark, d), "y", "score"))


register("assess_score", rounded_sql("WITH " + SCORED_SQL + """,
  g AS (SELECT score AS s, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM scored GROUP BY score),
  c AS (SELECT s, pos, neg, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp,
               sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cn FROM g),
  t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
  SELECT sum(pos * ((N - cn) + neg / 2.0)) / (max(P) * max(N)) AS auroc,
         sum(pos / P * (cp / (cp + cn))) AS average_precision, count(*) AS n_scores FROM c, t""",
    ["auroc", "average_precision"]))(_assess)


def _quartiles(spark, d):
    return finish(E.quartiles_by_actual(scored(spark, d).where(F.col("view_ff").isNotNull()), "score", "view_ff"))


register("quartiles_by_actual", rounded_sql("WITH " + SCORED_SQL + """
  SELECT score, median(view_ff) AS median, median(view_ff) - quantile_cont(view_ff, 0.25) AS down,
         quantile_cont(view_ff, 0.75) - median(view_ff) AS up
  FROM scored WHERE view_ff IS NOT NULL GROUP BY score""", ["median", "down", "up"]))(_quartiles)


# ---------------------------------------------------------------- E6-E10
register("masked_log_loss", rounded_sql("WITH " + SCORED_SQL + """
  SELECT split, avg(-(y * CASE WHEN y_proba <= 0 THEN -100.0 ELSE greatest(ln(y_proba), -100.0) END
                 + (1 - y) * CASE WHEN y_proba >= 1 THEN -100.0 ELSE greatest(ln(1 - y_proba), -100.0) END)) AS log_loss,
         count(*) AS n_steps
  FROM scored WHERE step < maxsteps GROUP BY split""", ["log_loss"]))(
    lambda spark, d: finish(E.masked_log_loss(scored(spark, d), "y", "y_proba", "step", "maxsteps", ["split"])))

register("masked_mse", rounded_sql("WITH " + SCORED_SQL + """
  SELECT split, sum((c_true - c_pred) * (c_true - c_pred) + (relevance - c_pred) * (relevance - c_pred))
                / (count(*) * 2) AS mse
  FROM scored WHERE step < maxsteps GROUP BY split""", ["mse"]))(
    lambda spark, d: finish(E.masked_mse(scored(spark, d), [("c_true", "c_pred"), ("relevance", "c_pred")],
                                         "step", "maxsteps", ["split"])))

register("observed_mse", rounded_sql("WITH " + SCORED_SQL + """
  SELECT split, sum(mask * (coalesce(obs, 0.0) - rec) * (coalesce(obs, 0.0) - rec)) / sum(mask) AS observed_mse
  FROM scored GROUP BY split""", ["observed_mse"]))(
    lambda spark, d: finish(E.observed_mse(scored(spark, d), [("obs", "rec", "mask")], ["split"])))


def _imp_quality(spark, d):
    s = scored(spark, d)
    s = s.withColumn("view_rec", F.coalesce(F.col("view_ff"), F.lit(0.0))) \
         .withColumn("view_mask", F.col("view_ff").isNotNull().cast("int"))
    q = E.imputation_quality(s, "split", [("obs", "rec", "mask"), ("view_ff", "view_rec", "view_mask")])
    return finish(E.train_order(q, "split"))


register("imputation_quality", rounded_sql("WITH " + SCORED_SQL + """,
  long AS (SELECT split, 'obs' AS variable, CAST(mask AS DOUBLE) AS m,
                  mask * (coalesce(obs, 0.0) - rec) * (coalesce(obs, 0.0) - rec) AS e FROM scored
           UNION ALL
           SELECT split, 'view_ff' AS variable, CAST(view_ff IS NOT NULL AS DOUBLE) AS m,
                  CAST(view_ff IS NOT NULL AS DOUBLE) * (coalesce(view_ff, 0.0) - coalesce(view_ff, 0.0))
                  * (coalesce(view_ff, 0.0) - coalesce(view_ff, 0.0)) AS e FROM scored),
  q AS (SELECT split, variable, (1 - avg(m)) * 100 AS missing_pct, sum(e) / sum(m) AS mse FROM long GROUP BY ALL),
  o AS (SELECT variable, missing_pct, mse FROM q WHERE split = 'Train'),
  n AS (SELECT v.variable, row_number() OVER (ORDER BY o.missing_pct NULLS LAST, o.mse NULLS LAST, v.variable) AS position
        FROM (SELECT DISTINCT variable FROM q) AS v LEFT JOIN o USING (variable))
  SELECT q.variable, q.split, q.missing_pct, q.mse, o.missing_pct AS _train_missing, o.mse AS _train_mse, n.position
  FROM q LEFT JOIN o ON q.variable = o.variable JOIN n ON n.variable = q.variable""",
    ["missing_pct", "mse", "_train_missing", "_train_mse"]))(_imp_quality)


# ---------------------------------------------------------------- E11 / E12 (drawn stays)
def _drawn(s, n: int, by: str | None = None):
    """``n`` positive stays drawn by seeded hash (of each split with ``by``)."""
    g = s.groupBy(*KEYS, *([by] if by else [])).agg(F.max("y").alias("y"))
    return prep.sample_ids(g, KEYS, n, seed=7, where=F.col("y") == 1, by=by)


def _expl(spark, d):
    s = scored(spark, d)
    return finish(E.explanation_trace(s, _drawn(s, N_EXPLAINED), KEYS, "step", [("c_true", "c_pred", "relevance")],
                                      "y", "y_proba"))


register("explanation_trace", rounded_sql("WITH " + SCORED_SQL + f""",
  top AS (SELECT user_id, session_no FROM (SELECT user_id, session_no, max(y) AS y FROM scored GROUP BY ALL)
          WHERE y = 1 ORDER BY {_md5(KEYS, 7)}, user_id, session_no LIMIT {N_EXPLAINED})""" + """
  SELECT s.user_id, s.session_no, s.step, CAST(s.y AS DOUBLE) AS y_true, s.y_proba AS y_pred, 'c_true' AS concept,
         s.c_true AS concept_true, s.c_pred AS concept_pred, s.relevance, s.c_pred * s.relevance AS contribution
  FROM scored s JOIN top USING (user_id, session_no)""",
    ["y_true", "y_pred", "concept_true", "concept_pred", "relevance", "contribution"]))(_expl)


def _recon(spark, d):
    s = scored(spark, d)
    return finish(E.reconstruction_trace(s, _drawn(s, N_RECONSTRUCTED, "split"), KEYS, "step", [("obs", "rec", "mask")]))


register("reconstruction_trace", rounded_sql("WITH " + SCORED_SQL + f""",
  top AS (SELECT user_id, session_no, split FROM (SELECT user_id, session_no, split, max(y) AS y FROM scored GROUP BY ALL)
          WHERE y = 1 QUALIFY row_number() OVER (PARTITION BY split ORDER BY {_md5(KEYS, 7)}, user_id, session_no)
                              <= {N_RECONSTRUCTED})""" + """
  SELECT s.user_id, s.session_no, s.step, 'obs' AS variable, s.obs AS observed, s.rec AS reconstructed,
         s.mask AS mask FROM scored s JOIN top USING (user_id, session_no, split)""", ["observed", "reconstructed"]))(_recon)


# ---------------------------------------------------------------- AG21 (run-log analogue)
register("loss_percentiles", rounded_sql("""
  SELECT l_returnflag AS split, l_linestatus AS loss, CAST(year(l_shipdate) AS INTEGER) AS epoch,
         quantile_cont(l_discount * l_quantity, 0.25) AS p25, quantile_cont(l_discount * l_quantity, 0.5) AS p50,
         quantile_cont(l_discount * l_quantity, 0.75) AS p75
  FROM lineitem GROUP BY ALL""", ["p25", "p50", "p75"]))(
    lambda spark, d: finish(E.loss_percentiles(table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("loss"),
        F.year("l_shipdate").alias("epoch"), (F.col("l_discount") * F.col("l_quantity")).alias("value")))))


# ---------------------------------------------------------------- AG17
def _static(spark, d):
    sess = cut_lineage(sessions(spark, d).withColumn("_one", F.lit(1).cast("bigint")))
    st = stay_table(spark, d, sess, sums={"n_events": "_one"})
    lp = labelled_panel(spark, d, sess).groupBy(*KEYS).agg(F.bool_or("label").alias("outcome"))
    x = st.join(lp, KEYS)
    x = x.withColumn("first_weekday", F.weekday("intime").cast("string"))
    return x.withColumn("los_hours", F.timestamp_diff("MICROSECOND", "intime", "outtime") / 3.6e9)


def _comparison(spark, d):
    return finish(report.cohort_comparison(_static(spark, d), "outcome", ["los_hours", "n_events"],
                                           ["click", "purchase", "signup", "view"], ["first_weekday"]))


def _cmp_sql():
    num = []
    for c, e in [("los_hours", "date_diff('microsecond', intime, outtime) / 3.6e9"), ("n_events", "CAST(n_events AS DOUBLE)")]:
        num.append(f"""SELECT '{c}' AS variable, 'numeric' AS kind,
              count(CASE WHEN outcome THEN {e} END) AS n_pos, count(CASE WHEN NOT outcome THEN {e} END) AS n_neg,
              avg(CASE WHEN outcome THEN {e} END) AS stat_pos, avg(CASE WHEN NOT outcome THEN {e} END) AS stat_neg,
              stddev_samp(CASE WHEN outcome THEN {e} END) AS sd_pos, stddev_samp(CASE WHEN NOT outcome THEN {e} END) AS sd_neg,
              CAST(NULL AS DOUBLE) AS dof,
              (avg(CASE WHEN outcome THEN {e} END) - avg(CASE WHEN NOT outcome THEN {e} END))
              / sqrt(var_samp(CASE WHEN outcome THEN {e} END) / count(CASE WHEN outcome THEN {e} END)
                   + var_samp(CASE WHEN NOT outcome THEN {e} END) / count(CASE WHEN NOT outcome THEN {e} END)) AS test_stat
              FROM x""")
    for c in ["click", "purchase", "signup", "view"]:
        num.append(f"""SELECT '{c}' AS variable, 'binary' AS kind, n1 AS n_pos, n0 AS n_neg,
              k1 / n1 * 100 AS stat_pos, k0 / n0 * 100 AS stat_neg, CAST(NULL AS DOUBLE) AS sd_pos,
              CAST(NULL AS DOUBLE) AS sd_neg, CAST(1 AS DOUBLE) AS dof,
              CASE WHEN (k1 + (n1 - k1)) * (k0 + (n0 - k0)) * (k1 + k0) * ((n1 - k1) + (n0 - k0)) > 0 THEN
                (n1 + n0) * (k1 * (n0 - k0) - (n1 - k1) * k0) * (k1 * (n0 - k0) - (n1 - k1) * k0)
                / ((k1 + (n1 - k1)) * (k0 + (n0 - k0)) * (k1 + k0) * ((n1 - k1) + (n0 - k0))) END AS test_stat
              FROM (SELECT CAST(count_if(outcome AND {c} IS NOT NULL) AS DOUBLE) AS n1,
                           CAST(count_if(NOT outcome AND {c} IS NOT NULL) AS DOUBLE) AS n0,
                           CAST(count_if(outcome AND {c}) AS DOUBLE) AS k1,
                           CAST(count_if(NOT outcome AND {c}) AS DOUBLE) AS k0 FROM x) AS z""")
    for c, e in [("first_weekday", "CAST(isodow(intime) - 1 AS VARCHAR)")]:
        num.append(f"""SELECT '{c}' AS variable, 'categorical' AS kind, sum(a) AS n_pos, sum(b) AS n_neg,
              CAST(NULL AS DOUBLE) AS stat_pos, CAST(NULL AS DOUBLE) AS stat_neg, CAST(NULL AS DOUBLE) AS sd_pos,
              CAST(NULL AS DOUBLE) AS sd_neg,
              CAST((count(*) - 1) * ((max(ta) > 0)::INT + (max(tb) > 0)::INT - 1) AS DOUBLE) AS dof,
              sum((a - n * ta / (ta + tb)) * (a - n * ta / (ta + tb)) / nullif(n * ta / (ta + tb), 0)
                  + (b - n * tb / (ta + tb)) * (b - n * tb / (ta + tb)) / nullif(n * tb / (ta + tb), 0)) AS test_stat
              FROM (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM (
                SELECT {e} AS lev, CAST(count_if(outcome) AS DOUBLE) AS a, CAST(count_if(NOT outcome) AS DOUBLE) AS b,
                       CAST(count(*) AS DOUBLE) AS n FROM x WHERE {e} IS NOT NULL GROUP BY 1) AS l0) AS l1""")
    return num


register("cohort_comparison", rounded_sql("WITH " + LABELLED_SQL + """,
  st AS (SELECT user_id, session_no, min(ts) AS intime, max(ts) AS outtime, count(*) AS n_events, """ +
    ", ".join(f"coalesce(bool_or(event_type = '{L}'), false) AS {L}" for L in LABELS) + """
         FROM sess GROUP BY user_id, session_no),
  o AS (SELECT user_id, session_no, bool_or(label) AS outcome FROM lp GROUP BY ALL),
  x AS (SELECT st.*, o.outcome FROM st JOIN o USING (user_id, session_no))
  SELECT variable, kind, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, stat_pos, stat_neg,
         sd_pos, sd_neg, dof, test_stat FROM (""" + " UNION ALL ".join(_cmp_sql()) + ") AS u",
    ["stat_pos", "stat_neg", "sd_pos", "sd_neg", "test_stat"]))(_comparison)


# ---------------------------------------------------------------- L3 / L4
def _split(spark, d):
    lp = labelled_panel(spark, d).groupBy(*KEYS).agg(F.bool_or("label").alias("pos"))
    return prep.stratified_split(lp, KEYS, "pos", seed=7).select(*KEYS, "pos", "split")


register("stratified_split", "WITH " + LABELLED_SQL + """,
  s AS (SELECT user_id, session_no, bool_or(label) AS pos FROM lp GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY """ + _md5(KEYS, 7) + """, user_id, session_no) - 1 AS rk,
               count(*) OVER (PARTITION BY pos) AS n FROM s),
  k AS (SELECT *, floor(n * 0.5 + 0.5) AS ntr FROM r),
  k2 AS (SELECT *, floor((n - ntr) * 0.5 + 0.5) AS nte FROM k)
  SELECT user_id, session_no, pos,
         CASE WHEN rk < ntr THEN 'Train' WHEN rk < ntr + nte THEN 'Test' ELSE 'Val' END AS split FROM k2""")(_split)


# ---------------------------------------------------------------- L5 / L6
TRAIN_END = "2024-01-16"


def _qscale(spark, d):
    p = cut_lineage(W.ffill(panel(spark, d), ["click", "view"], KEYS).select(*KEYS, "hour", "click", "view"))
    train = p.where(F.col("hour") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    knots = prep.quantile_knots(train, ["click", "view"], n_quantiles=1000)
    return finish(prep.quantile_transform(p, knots))


def _qs_value(c):
    """Mean of forward and backward interpolation of column ``c`` between the
    knots found by as-of joins: f = last knot <= x, g = first knot >= x."""
    r = lambda i: f"({i} / (m_{c} - 1.0))"
    fwd = (f"CASE WHEN fn_{c} IS NULL THEN {r(f'fi_{c}')} ELSE {r(f'fi_{c}')} + (x - fq_{c}) * "
           f"({r(f'(fi_{c} + 1)')} - {r(f'fi_{c}')}) / (fn_{c} - fq_{c}) END").replace("x -", f"{c} -")
    bwd = (f"CASE WHEN gq_{c} = x THEN {r(f'gi_{c}')} ELSE {r(f'(gi_{c} - 1)')} + (x - gp_{c}) * "
           f"({r(f'gi_{c}')} - {r(f'(gi_{c} - 1)')}) / (gq_{c} - gp_{c}) END").replace("= x", f"= {c}").replace("x -", f"{c} -")
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= lo_{c} THEN 0.0 WHEN {c} >= hi_{c} THEN 1.0 "
            f"ELSE 0.5 * (({fwd}) + ({bwd})) END AS {c}")


def _qs_asof(src, c):
    """One column's knots around every value, by two as-of joins."""
    return f"""(SELECT p.*, f.qi AS fi_{c}, f.q AS fq_{c}, f.nx AS fn_{c}, g.qi AS gi_{c}, g.q AS gq_{c}, g.pv AS gp_{c},
      z.m AS m_{c}, z.lo AS lo_{c}, z.hi AS hi_{c}
    FROM {src} AS p ASOF LEFT JOIN (SELECT * FROM kl WHERE col = '{c}') AS f ON p.{c} >= f.q
    ASOF LEFT JOIN (SELECT * FROM kf WHERE col = '{c}') AS g ON p.{c} <= g.q
    CROSS JOIN (SELECT count(*) AS m, min(q) AS lo, max(q) AS hi FROM kn WHERE col = '{c}') AS z)"""


register("quantile_scale", rounded_sql("WITH " + PANEL_SQL + f""",
  p AS (SELECT user_id, session_no, hour, {_ff_sql('click')} AS click, {_ff_sql('view')} AS view FROM panel),
  tr AS (SELECT * FROM p WHERE hour < TIMESTAMP '{TRAIN_END}'),
  lv AS (SELECT 'click' AS col, click AS v FROM tr WHERE click IS NOT NULL
         UNION ALL SELECT 'view' AS col, view AS v FROM tr WHERE view IS NOT NULL),
  rk AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS r,
                count(*) OVER (PARTITION BY col) AS n FROM lv),
  g AS (SELECT DISTINCT col, n, least(1000, n) AS m FROM rk),
  kk AS (SELECT col, n, m, unnest(range(m)) AS qi FROM g),
  h AS (SELECT *, (n - 1) * (qi * (CASE WHEN m > 1 THEN 1.0 / (m - 1) ELSE 0.0 END)) AS hh FROM kk),
  h2 AS (SELECT *, CAST(floor(hh) AS BIGINT) AS lo, least(CAST(floor(hh) AS BIGINT) + 1, n - 1) AS hi,
                hh - floor(hh) AS frac FROM h),
  kn AS (SELECT h2.col, h2.qi, CASE WHEN frac = 0 THEN a.v ELSE a.v + (b.v - a.v) * frac END AS q
         FROM h2 JOIN rk a ON a.col = h2.col AND a.r = h2.lo JOIN rk b ON b.col = h2.col AND b.r = h2.hi),
  kw AS (SELECT col, qi, q, lead(q) OVER (PARTITION BY col ORDER BY qi) AS nx,
                lag(q) OVER (PARTITION BY col ORDER BY qi) AS pv FROM kn),
  kl AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY col, q ORDER BY qi DESC) = 1),
  kf AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY col, q ORDER BY qi) = 1)
  SELECT user_id, session_no, hour, {_qs_value('click')}, {_qs_value('view')}
  FROM {_qs_asof(_qs_asof('p', 'click'), 'view')} AS t""", ["click", "view"]))(_qscale)


def _mm(spark, d):
    s = cut_lineage(scored(spark, d).select(*KEYS, "hour", "score", "score_roll24", "split"))  # fit and transform
    fit = prep.minmax_fit(s.where(F.col("split") == "Train"), ["score", "score_roll24"])
    return finish(prep.minmax_transform(s, ["score", "score_roll24"], fit).drop("split"))


register("minmax_scale", rounded_sql("WITH " + SCORED_SQL + """,
  mmf AS (SELECT min(score) AS a, max(score) AS b, min(score_roll24) AS c, max(score_roll24) AS e
        FROM scored WHERE split = 'Train')
  SELECT user_id, session_no, hour,
         (score - a) / CASE WHEN b - a = 0 THEN 1.0 ELSE CAST(b - a AS DOUBLE) END AS score,
         (score_roll24 - c) / CASE WHEN e - c = 0 THEN 1.0 ELSE CAST(e - c AS DOUBLE) END AS score_roll24
  FROM scored, mmf""", ["score", "score_roll24"]))(_mm)


# ---------------------------------------------------------------- R6 / R7
def _imputed(spark, d):
    p = W.ffill(panel(spark, d), ["click", "view"], KEYS)
    return p.select(*KEYS, "hour", F.coalesce("click", F.lit(0.0)).alias("click"),
                    F.coalesce("view", F.lit(0.0)).alias("view"))


def _pack(spark, d):
    return prep.pack_sequences(_imputed(spark, d), KEYS, "hour", ["click", "view"])


IMPUTED_SQL = PANEL_SQL + f""",
imp AS (SELECT user_id, session_no, hour, coalesce({_ff_sql('click')}, 0.0) AS click,
               coalesce({_ff_sql('view')}, 0.0) AS view FROM panel)"""

register("pack_sequences", "WITH " + IMPUTED_SQL + """
  SELECT user_id, session_no, list([click, view] ORDER BY hour) AS x, CAST(count(*) AS INTEGER) AS maxsteps
  FROM imp GROUP BY user_id, session_no""")(_pack)


def _unpack(spark, d):
    packed = prep.pad_to_split_max(_pack(spark, d), split="user_id")
    return finish(prep.unpack_sequences(packed, KEYS, ["click", "view"]))


register("unpack_sequences", rounded_sql("WITH " + IMPUTED_SQL + f"""
  SELECT user_id, session_no, CAST(row_number() OVER ({WS}) - 1 AS BIGINT) AS step, click, view FROM imp""",
    ["click", "view"]))(_unpack)


# ---------------------------------------------------------------- L7 observed mask covered in q_panel
# ---------------------------------------------------------------- S4 / S5 / L9 (rows-only)
def _sample(spark, d):
    s = scored(spark, d)
    stays_pos = s.groupBy(*KEYS).agg(F.max("y").alias("y"))
    return prep.sample_ids(stays_pos, KEYS, 20, seed=7, where=F.col("y") == 1)


register("sample_ids", "WITH " + SCORED_SQL + """,
  sp AS (SELECT user_id, session_no, max(y) AS y FROM scored GROUP BY ALL)
  SELECT user_id, session_no FROM sp WHERE y = 1
  ORDER BY """ + _md5(KEYS, 7) + """, user_id, session_no LIMIT 20""")(_sample)


def _case_control(spark, d):
    lp = labelled_panel(spark, d).select(*KEYS, "label")
    return prep.case_control(lp, KEYS, "label", ratio=0.2, seed=7)


register("case_control", "WITH " + LABELLED_SQL + """,
  ids AS (SELECT user_id, session_no, coalesce(bool_or(label), false) AS label FROM lp GROUP BY ALL),
  np AS (SELECT count(*) AS n FROM ids WHERE label),
  neg AS (SELECT user_id, session_no, label,
                 row_number() OVER (ORDER BY """ + _md5(KEYS, 7) + """, user_id, session_no) - 1 AS rk FROM ids WHERE NOT label)
  SELECT user_id, session_no, label FROM ids WHERE label
  UNION ALL SELECT user_id, session_no, label FROM neg, np WHERE rk < floor(np.n * 0.2)""")(_case_control)


def _baseline(spark, d):
    s = scored(spark, d).select(*KEYS, "hour", "split", "y", "view_ff", "score", "score_roll24", "relevance")
    s = cut_lineage(s)  # the stages of the model and the scoring read it, five times in all
    out = prep.baseline_logistic(s.where(F.col("split") == "Train"), s, ["view_ff", "score_roll24", "relevance"],
                                 "y", max_iter=20)
    return out.select(*KEYS, "hour", "split", "y", "proba")


register("baseline_logistic")(_baseline)


def _baseline_check(spark, d):
    """L9 in figures that SQL can check: per feature the Train rows, mean and
    standard deviation of the mean-imputed values, and whether the fitted model
    meets its score equation (mean of (y - p) * standardised x is zero on Train)."""
    feats = ["view_ff", "score_roll24", "relevance"]
    s = cut_lineage(scored(spark, d).select(*KEYS, "hour", "split", "y", *feats))
    train = s.where(F.col("split") == "Train")
    out = prep.baseline_logistic(train, train, feats, "y", max_iter=200)
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in feats])
    x = out.crossJoin(F.broadcast(stats))  # one row
    x = x.withColumns({c: F.coalesce(F.col(c), F.col(f"m_{c}")) for c in feats})
    aggs = []
    for c in feats:
        aggs += [F.avg(c).alias(f"a_{c}"), F.stddev_samp(c).alias(f"s_{c}"),
                 (F.covar_pop(c, F.col("y") - F.col("proba")) / F.stddev_pop(c)).alias(f"g_{c}")]
    row = x.agg(F.count(F.lit(1)).alias("n_train"), F.avg(F.col("y") - F.col("proba")).alias("bias"), *aggs)
    return finish(row.select("n_train", (F.abs("bias") < 1e-4).alias("centred"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("mean"), F.col(f"s_{c}").alias("std"),
                 (F.abs(F.col(f"g_{c}")) < 1e-4).alias("balanced")) for c in feats])).alias("_s"))
                  .select("n_train", "centred", "_s.*"))


register("baseline_check", rounded_sql("WITH " + SCORED_SQL + """,
  tr AS (SELECT view_ff, score_roll24, relevance FROM scored WHERE split = 'Train'),
  m AS (SELECT avg(view_ff) AS a, avg(score_roll24) AS b, avg(relevance) AS c FROM tr),
  fi AS (SELECT coalesce(view_ff, a) AS view_ff, coalesce(score_roll24, b) AS score_roll24,
               coalesce(relevance, c) AS relevance FROM tr, m)
  """ + " UNION ALL ".join(f"""SELECT count(*) AS n_train, true AS centred, '{c}' AS feature, avg({c}) AS mean,
         stddev_samp({c}) AS std, true AS balanced FROM fi""" for c in ("view_ff", "score_roll24", "relevance")),
    ["mean", "std"]))(_baseline_check)


def _total_loss(spark, d):
    from stayline.plans.clinical import losses
    s = cut_lineage(scored(spark, d))
    return finish(losses(s, [("c_true", "c_pred"), ("relevance", "c_pred")], [("obs", "rec", "mask")]))


register("total_loss", rounded_sql("WITH " + SCORED_SQL + """,
  l AS (SELECT split, avg(-(y * greatest(CASE WHEN y_proba > 0 THEN ln(y_proba) ELSE -100.0 END, -100.0)
                  + (1 - y) * greatest(CASE WHEN y_proba < 1 THEN ln(1 - y_proba) ELSE -100.0 END, -100.0))) AS log_loss,
               count(*) AS n_steps,
               sum((c_true - c_pred) * (c_true - c_pred) + (relevance - c_pred) * (relevance - c_pred))
                 / (count(*) * 2) AS mse
        FROM scored WHERE step < maxsteps GROUP BY split),
  o AS (SELECT split, sum(mask * (coalesce(obs, 0.0) - rec) * (coalesce(obs, 0.0) - rec)) / sum(mask) AS observed_mse
        FROM scored GROUP BY split)
  SELECT l.split, log_loss, n_steps, mse, observed_mse, log_loss + mse + 0.1 * observed_mse AS total
  FROM l JOIN o USING (split)""", ["log_loss", "mse", "observed_mse", "total"]))(_total_loss)


def _apply_split(spark, d):
    lp = cut_lineage(labelled_panel(spark, d).select(*KEYS, "hour", "label"))
    ids = prep.stratified_split(lp.groupBy(*KEYS).agg(F.bool_or("label").alias("pos")), KEYS, "pos", seed=7)
    return prep.apply_split(lp, ids, KEYS).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_distinct(*KEYS).alias("n_stays"),
        F.count_if("label").alias("n_positive"))


register("apply_split", "WITH " + LABELLED_SQL + """,
  s AS (SELECT user_id, session_no, bool_or(label) AS pos FROM lp GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY """ + _md5(KEYS, 7) + """, user_id, session_no) - 1 AS rk,
               count(*) OVER (PARTITION BY pos) AS n FROM s),
  k AS (SELECT *, floor(n * 0.5 + 0.5) AS ntr FROM r),
  i AS (SELECT user_id, session_no, CASE WHEN rk < ntr THEN 'Train'
               WHEN rk < ntr + floor((n - ntr) * 0.5 + 0.5) THEN 'Test' ELSE 'Val' END AS split FROM k)
  SELECT split, count(*) AS n_steps, count(DISTINCT (lp.user_id, lp.session_no)) AS n_stays,
         CAST(count_if(label) AS BIGINT) AS n_positive FROM lp JOIN i USING (user_id, session_no) GROUP BY split""")(_apply_split)
