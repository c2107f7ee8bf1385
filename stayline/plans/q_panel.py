"""Catalogue: hourly panel, windows, panel scalars and as-of joins
(R2, R3, W3-W11, L1, L7, L8, F10-F16, J6, J7, R4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as X
from stayline.operators import grid, stays, windows as W
from stayline.plans.base import (KEYS, LABELS, LABELLED_SQL, PANEL_SQL, PANEL_STAYS_SQL, SESS_SQL, STAYS_SQL,
                                 finish, labelled_panel, stay_amounts, panel, rounded_sql, sessions,
                                 stay_table)
from stayline.plans.registry import register
from stayline.session import cut_lineage

WS = "PARTITION BY user_id, session_no ORDER BY hour"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _ff_sql(c, limit=None):
    frame = ALL if limit is None else f"ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW"
    return f"last_value({c} IGNORE NULLS) OVER ({WS} {frame})"


# ---------------------------------------------------------------- R3
register("hourly_grid", rounded_sql("WITH " + PANEL_SQL + " SELECT * FROM panel", LABELS))(
    lambda spark, d: finish(panel(spark, d)))


# ---------------------------------------------------------------- R2
def _pivot(spark, d):
    s = sessions(spark, d)
    return finish(grid.pivot_labels(s, [*KEYS, "ts"], "event_type", "value", LABELS, "avg"))


register("pivot_labels", rounded_sql("WITH " + SESS_SQL + """
  SELECT user_id, session_no, ts, """ + ", ".join(
    f"avg(CASE WHEN event_type = '{L}' THEN value END) AS {L}" for L in LABELS) + """
  FROM sess WHERE value IS NOT NULL AND event_type IN (""" + ", ".join(f"'{L}'" for L in LABELS) + """)
  GROUP BY user_id, session_no, ts""", LABELS))(_pivot)


# ---------------------------------------------------------------- W3
register("ffill", rounded_sql("WITH " + PANEL_SQL + " SELECT user_id, session_no, hour, " + ", ".join(
    f"{_ff_sql(L)} AS {L}" for L in LABELS) + " FROM panel", LABELS))(
    lambda spark, d: finish(W.ffill(panel(spark, d), LABELS, KEYS)))


# ---------------------------------------------------------------- W4
def _ffill_limit(spark, d):
    p = panel(spark, d).withColumn("seen", F.when(F.col("click").isNotNull(), F.lit(1.0)))
    p = p.withColumn("click_flag", X.true_or_false(
        F.coalesce(W.ffill_col("seen", KEYS, limit=14), F.lit(0.0)) == 1))
    p = p.withColumn("view_ff14", W.ffill_col("view", KEYS, limit=14))
    return finish(p.select(*KEYS, "hour", "click_flag", "view_ff14"))


register("ffill_limit", rounded_sql("WITH " + PANEL_SQL + """,
  p AS (SELECT *, CASE WHEN click IS NOT NULL THEN 1.0 END AS seen FROM panel)
  SELECT user_id, session_no, hour,
         coalesce(coalesce(""" + _ff_sql("seen", 14) + """, 0.0) = 1, false) AS click_flag,
         """ + _ff_sql("view", 14) + """ AS view_ff14
  FROM p""", ["view_ff14"]))(_ffill_limit)


# ---------------------------------------------------------------- W5 / F7
def _since_start(spark, d):
    p = panel(spark, d).select(*KEYS, "hour")
    st = stay_table(spark, d).select(*KEYS, "intime")
    x = p.join(st, on=KEYS, how="left")
    x = x.withColumn("hours_since_start", W.hours_since_start(KEYS))
    x = x.withColumn("hours_since_admit", X.hours_between("hour", "intime"))
    return finish(x.select(*KEYS, "hour", "hours_since_start", "hours_since_admit"))


register("hours_since_start", rounded_sql("WITH " + PANEL_STAYS_SQL + """
  SELECT p.user_id, p.session_no, p.hour,
         CAST(row_number() OVER (PARTITION BY p.user_id, p.session_no ORDER BY p.hour) - 1 AS BIGINT) AS hours_since_start,
         date_diff('microsecond', st.intime, p.hour) / 3.6e9 AS hours_since_admit
  FROM panel p LEFT JOIN st ON p.user_id = st.user_id AND p.session_no = st.session_no""",
    ["hours_since_admit"]))(_since_start)


# ---------------------------------------------------------------- W6 / W7
register("rolling_max", rounded_sql("WITH " + PANEL_SQL + f"""
  SELECT user_id, session_no, hour, purchase,
         max(purchase) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS purchase_roll24
  FROM panel""", ["purchase", "purchase_roll24"]))(
    lambda spark, d: finish(panel(spark, d).select(
        *KEYS, "hour", "purchase", W.rolling_max("purchase", KEYS, 24).alias("purchase_roll24"))))

register("future_max", rounded_sql("WITH " + PANEL_SQL + f"""
  SELECT user_id, session_no, hour, purchase,
         max(purchase) OVER ({WS} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS purchase_next24
  FROM panel""", ["purchase", "purchase_next24"]))(
    lambda spark, d: finish(panel(spark, d).select(
        *KEYS, "hour", "purchase", W.future_max("purchase", KEYS, 24).alias("purchase_next24"))))


# ---------------------------------------------------------------- F15 + W8 (flagship)
SCORE_CUTS = [50, 100, 200, 400]


def flagship(spark, d):
    """events -> sessions -> hourly panel -> ffill -> threshold score ->
    rolling max and 24 h horizon max -> 24 h outcome label."""
    p = labelled_panel(spark, d)
    p = p.withColumn("view_ff", W.ffill_col("view", KEYS))
    p = p.withColumn("score", X.threshold_score("view_ff", ">=", SCORE_CUTS))
    p = p.withColumn("score_roll24", W.rolling_max("score", KEYS, 24))
    p = p.withColumn("score_horizon24", W.score_horizon("score", KEYS, 24))
    return finish(p.select(*KEYS, "hour", "view_ff", "score", "score_roll24", "score_horizon24", "label"))


def _score_case(c, op, cuts):
    parts = " ".join(f"WHEN {c} {op} {cuts[i - 1]} THEN {i}" for i in range(len(cuts), 0, -1))
    return f"CASE {parts} ELSE 0 END"


register("score_horizon", rounded_sql("WITH " + LABELLED_SQL + f""",
  f AS (SELECT *, {_ff_sql('view')} AS view_ff FROM lp),
  s AS (SELECT *, {_score_case('view_ff', '>=', SCORE_CUTS)} AS score FROM f)
  SELECT user_id, session_no, hour, view_ff, score,
         max(score) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS score_roll24,
         max(score) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND 23 FOLLOWING) AS score_horizon24,
         label
  FROM s""", ["view_ff"]))(flagship)


def _threshold(spark, d):
    p = W.ffill(panel(spark, d), ["view", "click", "purchase"], KEYS)
    return finish(p.select(
        *KEYS, "hour",
        X.threshold_score("view", "<=", [400, 300, 200, 100]).alias("score_le"),
        X.threshold_score("click", ">", [100, 150, 200, 300]).alias("score_gt"),
        X.threshold_score("purchase", "<", [150, 130, 100, 60]).alias("score_lt"),
        X.threshold_score("purchase", ">=", [1.2, 2.0, 6.0, 12.0]).alias("score_ge")))


register("threshold_score", "WITH " + PANEL_SQL + f""",
  f AS (SELECT user_id, session_no, hour, {_ff_sql('view')} AS view, {_ff_sql('click')} AS click,
               {_ff_sql('purchase')} AS purchase FROM panel)
  SELECT user_id, session_no, hour,
         {_score_case('view', '<=', [400, 300, 200, 100])} AS score_le,
         {_score_case('click', '>', [100, 150, 200, 300])} AS score_gt,
         {_score_case('purchase', '<', [150, 130, 100, 60])} AS score_lt,
         {_score_case('purchase', '>=', [1.2, 2.0, 6.0, 12.0])} AS score_ge
  FROM f""")(_threshold)


# ---------------------------------------------------------------- L1
def _horizon(spark, d):
    return labelled_panel(spark, d).select(*KEYS, "hour", "label")


register("horizon_label", "WITH " + LABELLED_SQL + " SELECT user_id, session_no, hour, label FROM lp")(_horizon)


# ---------------------------------------------------------------- W10 / L7 / L8
def _tso(spark, d):
    p = panel(spark, d)
    return p.select(*KEYS, "hour", *[W.time_since_observed(L, KEYS).alias(f"{L}_delta") for L in LABELS])


def _tso_sql(c):
    rn = f"row_number() OVER ({WS})"
    last = (f"max(CASE WHEN {c} IS NOT NULL THEN rn END) OVER ({WS} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return f"CAST(CASE WHEN rn = 1 THEN 0 ELSE rn - coalesce({last}, 1) END AS DOUBLE) AS {c}_delta"


register("time_since_observed", "WITH " + PANEL_SQL + f""",
  r AS (SELECT *, row_number() OVER ({WS}) AS rn FROM panel)
  SELECT user_id, session_no, hour, """ + ", ".join(_tso_sql(L) for L in LABELS) + " FROM r")(_tso)

register("observed_mask", "WITH " + PANEL_SQL + " SELECT user_id, session_no, hour, " + ", ".join(
    f"CAST({L} IS NOT NULL AS INTEGER) AS {L}_mask" for L in LABELS) + " FROM panel")(
    lambda spark, d: panel(spark, d).select(*KEYS, "hour", *[W.observed_mask(L).alias(f"{L}_mask") for L in LABELS]))


def _impute(spark, d):
    p = W.ffill(panel(spark, d), LABELS, KEYS)
    return finish(p.withColumns({L: F.coalesce(F.col(L), F.lit(0.0)) for L in LABELS}))


register("impute_ffill_zero", rounded_sql("WITH " + PANEL_SQL + " SELECT user_id, session_no, hour, " + ", ".join(
    f"coalesce({_ff_sql(L)}, 0.0) AS {L}" for L in LABELS) + " FROM panel", LABELS))(_impute)


# ---------------------------------------------------------------- W11
def _latest(spark, d):
    p = panel(spark, d).select(*KEYS, "hour",
                               F.when(F.col("error").isNotNull(), F.lit(1.0)).alias("dnr"),
                               F.when(F.col("purchase").isNotNull(), F.lit(1.0)).alias("full_code"))
    return W.latest_state(p, KEYS, "dnr", "full_code")


register("latest_state", "WITH " + PANEL_SQL + f""",
  c AS (SELECT user_id, session_no, hour,
               CASE WHEN purchase IS NOT NULL THEN 2 WHEN error IS NOT NULL THEN 1 END AS code FROM panel),
  f AS (SELECT *, {_ff_sql('code')} AS st FROM c)
  SELECT user_id, session_no, hour, coalesce(st = 1, false) AS dnr, coalesce(st = 2, false) AS full_code
  FROM f""")(_latest)


# ---------------------------------------------------------------- F10 / F11
def _coalesce(spark, d):
    p = panel(spark, d)
    p = p.withColumn("sbp", F.coalesce("click", "view")).withColumn("dbp", F.coalesce("purchase", "signup"))
    p = p.withColumn("map", F.lit(2.0 / 3.0) * F.col("dbp") + F.lit(1.0 / 3.0) * F.col("sbp"))
    p = p.withColumn("shock_index", X.safe_div("error", "sbp"))
    return finish(p.select(*KEYS, "hour", "sbp", "dbp", "map", "shock_index"))


def _div_sql(a, b):
    return (f"CASE WHEN ({b}) = 0 THEN (CASE WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END) ELSE ({a}) / ({b}) END")


register("scalar_coalesce", rounded_sql("WITH " + PANEL_SQL + """,
  c AS (SELECT *, coalesce(click, view) AS sbp, coalesce(purchase, signup) AS dbp FROM panel)
  SELECT user_id, session_no, hour, sbp, dbp, (2.0 / 3.0) * dbp + (1.0 / 3.0) * sbp AS map,
         """ + _div_sql("error", "sbp") + """ AS shock_index FROM c""",
    ["sbp", "dbp", "map", "shock_index"]))(_coalesce)


def _ratios(spark, d):
    p = panel(spark, d)
    a, b = F.floor(F.col("click") / 100).cast("double"), F.floor(F.col("view") / 100).cast("double")
    return finish(p.select(*KEYS, "hour", X.safe_div(a, b).alias("click_view_ratio"),
                           X.safe_div("purchase", "signup").alias("purchase_signup_ratio")))


register("scalar_ratios", rounded_sql("WITH " + PANEL_SQL + """
  SELECT user_id, session_no, hour,
         """ + _div_sql("CAST(floor(click / 100) AS DOUBLE)", "CAST(floor(view / 100) AS DOUBLE)") + """ AS click_view_ratio,
         """ + _div_sql("purchase", "signup") + """ AS purchase_signup_ratio FROM panel""",
    ["click_view_ratio", "purchase_signup_ratio"]))(_ratios)


# ---------------------------------------------------------------- F12
def _chain(spark, d):
    """Oxygen-fraction chain on the analogue: FiO2 = view, flow = click,
    PaO2 = purchase, SpO2 = signup."""
    p = panel(spark, d)
    fi = F.coalesce(W.ffill_col("view", KEYS), F.col("click") * 3 + 21)
    p = p.withColumn("fio2_imp", X.clip_upper(fi, 100))
    p = p.withColumn("fio2_imp", F.coalesce(W.ffill_col("fio2_imp", KEYS), F.lit(21.0)) / 100)
    p = p.withColumn("pao2_imp", F.coalesce(W.ffill_col("purchase", KEYS), F.lit(100.0)))
    p = p.withColumn("pf_ratio", X.safe_div("pao2_imp", "fio2_imp"))
    p = p.withColumn("sf_ratio", X.safe_div("signup", "fio2_imp"))
    return finish(p.select(*KEYS, "hour", "fio2_imp", "pao2_imp", "pf_ratio", "sf_ratio"))


register("impute_chain", rounded_sql("WITH " + PANEL_SQL + f""",
  a AS (SELECT *, coalesce({_ff_sql('view')}, click * 3 + 21) AS fi0 FROM panel),
  b AS (SELECT *, CASE WHEN fi0 IS NOT NULL THEN least(fi0, 100) END AS fi1 FROM a),
  c AS (SELECT *, coalesce({_ff_sql('fi1')}, 21.0) / 100 AS fio2_imp,
               coalesce({_ff_sql('purchase')}, 100.0) AS pao2_imp FROM b)
  SELECT user_id, session_no, hour, fio2_imp, pao2_imp,
         {_div_sql('pao2_imp', 'fio2_imp')} AS pf_ratio, {_div_sql('signup', 'fio2_imp')} AS sf_ratio
  FROM c""", ["fio2_imp", "pao2_imp", "pf_ratio", "sf_ratio"]))(_chain)


# ---------------------------------------------------------------- F16 / AG6
def _component_total(spark, d):
    from stayline.operators import quality as Q
    comps = ["click", "view", "purchase"]
    p = panel(spark, d)
    mx = p.agg(*[F.max(c).alias(c) for c in comps])
    f = W.ffill(p, comps, KEYS)
    f = Q.fill_with_stats(f, comps, mx)
    return finish(f.select(*KEYS, "hour", (F.col("click") + F.col("view") + F.col("purchase")).alias("total")))


register("component_total", rounded_sql("WITH " + PANEL_SQL + f""",
  m AS (SELECT max(click) AS mc, max(view) AS mv, max(purchase) AS mp FROM panel),
  f AS (SELECT user_id, session_no, hour, {_ff_sql('click')} AS c, {_ff_sql('view')} AS v,
               {_ff_sql('purchase')} AS p FROM panel)
  SELECT user_id, session_no, hour, coalesce(c, mc) + coalesce(v, mv) + coalesce(p, mp) AS total
  FROM f CROSS JOIN m""", ["total"]))(_component_total)


def _fill_median(spark, d):
    from stayline.operators import quality as Q
    cols = ["click", "view", "purchase"]
    p = panel(spark, d)
    med = Q.column_medians(p, cols)
    f = W.ffill(p, cols, KEYS)
    f = Q.fill_with_stats(f, cols, med)
    return finish(f.select(*KEYS, "hour", *cols))


register("fill_global_median", rounded_sql("WITH " + PANEL_SQL + f""",
  m AS (SELECT median(click) AS mc, median(view) AS mv, median(purchase) AS mp FROM panel),
  f AS (SELECT user_id, session_no, hour, {_ff_sql('click')} AS c, {_ff_sql('view')} AS v,
               {_ff_sql('purchase')} AS p FROM panel)
  SELECT user_id, session_no, hour, coalesce(c, mc) AS click, coalesce(v, mv) AS view,
         coalesce(p, mp) AS purchase FROM f CROSS JOIN m""", ["click", "view", "purchase"]))(_fill_median)


# ---------------------------------------------------------------- J6 + J7 + W9
def _first_stays(spark, d, sess=None):
    st = stay_table(spark, d, sess).where(stays.length_between("intime", "outtime", 48, 24 * 14))
    return stays.first_per_key(st, "user_id", ["intime"], ["session_no"]).select(*KEYS)


FIRST_SQL = """
fs AS (SELECT user_id, session_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY intime, session_no) AS rn FROM st
  WHERE outtime - intime >= INTERVAL 48 HOUR AND outtime - intime <= INTERVAL 336 HOUR) AS z WHERE rn = 1)"""


def _rolling_mean(spark, d):
    """Urine-output analogue: every ``error`` event of a user is attached to the
    nearest hour of the user's cohort stay grid (1 h tolerance), summed per
    hour, re-indexed to the grid, 24-row trailing mean, missing -> 0."""
    sess = cut_lineage(sessions(spark, d))
    # the cohort's hours give the bounds and take the series: written once
    p = cut_lineage(panel(spark, d, sess).join(_first_stays(spark, d, sess), on=KEYS, how="left_semi")
                    .select(*KEYS, "hour"))
    bounds = p.groupBy(*KEYS).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    from stayline.plans.base import table
    ev = table(spark, d, "events").where(F.col("event_type") == "error").select("user_id", "ts", "value")
    m = grid.asof_to_grid(ev, bounds, "user_id", "ts")
    s = m.groupBy(*KEYS, "hour").agg(F.sum("value").alias("err_sum"))
    x = grid.attach_hourly(p, s, KEYS, ["err_sum"])
    x = x.withColumn("err_mean24", W.rolling_mean("err_sum", KEYS, 24, default=0.0))
    return finish(x.select(*KEYS, "hour", "err_sum", "err_mean24"))


register("rolling_mean", rounded_sql("WITH " + PANEL_STAYS_SQL + "," + FIRST_SQL + f""",
  gp AS (SELECT p.user_id, p.session_no, p.hour FROM panel p JOIN fs ON p.user_id = fs.user_id AND p.session_no = fs.session_no),
  ev AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'error'),
  cand AS (SELECT ev.event_id, ev.value, gp.user_id, gp.session_no, gp.hour,
                  row_number() OVER (PARTITION BY ev.event_id
                                     ORDER BY abs(date_diff('microsecond', gp.hour, ev.ts)), gp.hour) AS rn
           FROM ev JOIN gp ON ev.user_id = gp.user_id
            AND gp.hour BETWEEN ev.ts - INTERVAL 1 HOUR AND ev.ts + INTERVAL 1 HOUR),
  s AS (SELECT user_id, session_no, hour, sum(value) AS err_sum FROM cand WHERE rn = 1 GROUP BY ALL),
  j AS (SELECT gp.*, s.err_sum FROM gp LEFT JOIN s USING (user_id, session_no, hour))
  SELECT user_id, session_no, hour, err_sum,
         coalesce(avg(err_sum) OVER ({WS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0.0) AS err_mean24
  FROM j""", ["err_sum", "err_mean24"]))(_rolling_mean)


def _asof(spark, d):
    from stayline.plans.base import table
    ev = table(spark, d, "events")
    left = ev.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    right = ev.where(F.col("event_type") == "purchase").select("user_id", "ts", F.col("value").alias("pvalue"))
    out = grid.asof_nearest(left, right, "user_id", "ts", "ts", ["pvalue"], tolerance_hours=1)
    return finish(out)


register("asof_nearest", rounded_sql("""
  WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
  r AS (SELECT user_id, ts, value AS pvalue FROM events WHERE event_type = 'purchase'),
  c AS (SELECT l.event_id, r.ts AS match_t, r.pvalue,
               row_number() OVER (PARTITION BY l.event_id ORDER BY abs(date_diff('microsecond', r.ts, l.ts)), r.ts) AS rn
        FROM l JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR)
  SELECT l.event_id, l.user_id, l.ts, c.match_t, c.pvalue FROM l LEFT JOIN c ON l.event_id = c.event_id AND c.rn = 1""",
    ["pvalue"]))(_asof)


# ---------------------------------------------------------------- R4
def _spread(spark, d):
    x = stay_amounts(spark, d).withColumn("per_hour", grid.hourly_amount("intime", "outtime", "amount"))
    return finish(grid.spread_intervals(x, ["user_id"], "intime", "outtime", "per_hour", "amount_per_hour"))


register("spread_intervals", rounded_sql("WITH " + STAYS_SQL + """,
  tot AS (SELECT user_id, session_no, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM sess GROUP BY ALL),
  x AS (SELECT st.user_id, date_trunc('hour', intime) AS s, date_trunc('hour', outtime) AS e,
               amount / (date_diff('hour', date_trunc('hour', intime), date_trunc('hour', outtime)) + 1) AS per_hour
        FROM st JOIN tot USING (user_id, session_no)),
  h AS (SELECT user_id, per_hour, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS hour FROM x WHERE s <= e)
  SELECT user_id, hour, sum(per_hour) AS amount_per_hour FROM h GROUP BY user_id, hour""",
    ["amount_per_hour"]))(_spread)
