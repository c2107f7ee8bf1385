"""Catalogue: series that no stay bounds, packing by length, mergeable sketches,
reduced curves, CSV reports and columns by type (W3-W10, R6, R7, AG7, E1, E3, IO5, PF9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.operators import evaluate as E, filters, prep, quality as Q, report, windows as W
from stayline.operators.series import LongSeries
from stayline.plans.base import KEYS, LABELS, PANEL_SQL, finish, panel, rounded_sql, table
from stayline.plans.q_eval import EV_SQL, event_scores
from stayline.plans.registry import register
from stayline.session import checkpoint_dir
from stayline.sources.tables import save_report

# ---------------------------------------------------------------- W3-W10 on long series
WARD = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 + user_id % 4 END"


def _long_series(spark, d):
    """Events of a few wards, a third of all in one; no stay bounds a ward's series."""
    ev = table(spark, d, "events").select("event_id", F.expr(WARD).cast("bigint").alias("ward"), "ts", "value",
                                          F.when(F.col("event_type") == "click", F.col("value")).alias("click"))
    s = LongSeries(ev, "ward", ["ts", "event_id"], block=2_000, reach=48).counter("step").frames({
        "max24": lambda k, o: W.rolling_max("value", k, 24, o),
        "ahead24": lambda k, o: W.future_max("value", k, 24, o),
        "both24": lambda k, o: W.score_horizon("value", k, 24, order=o),
        "mean24": lambda k, o: W.rolling_mean("value", k, 24, order=o),
        "fill3": lambda k, o: W.ffill_col("click", k, o, limit=3)})
    s = s.since_observed("click", "since_click").ffill(["click"])
    return finish(s.frame().select("event_id", "ward", "step", "max24", "ahead24", "both24", "mean24", "fill3",
                                   "since_click", "click"))


register("long_series", rounded_sql(f"""
  WITH e AS (SELECT event_id, CAST({WARD} AS BIGINT) AS ward, ts, value,
                    CASE WHEN event_type = 'click' THEN value END AS click FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY ts, event_id) AS rn FROM e)
  SELECT event_id, ward, rn - 1 AS step,
         max(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS max24,
         max(value) OVER (w ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS ahead24,
         max(value) OVER (w ROWS BETWEEN 23 PRECEDING AND 23 FOLLOWING) AS both24,
         coalesce(avg(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0.0) AS mean24,
         last_value(click IGNORE NULLS) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fill3,
         CAST(CASE WHEN rn = 1 THEN 0 ELSE rn - coalesce(max(CASE WHEN click IS NOT NULL THEN rn END)
              OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) END AS DOUBLE) AS since_click,
         last_value(click IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS click
  FROM n WINDOW w AS (PARTITION BY ward ORDER BY rn)""", ["max24", "ahead24", "both24", "mean24", "fill3", "click"]))(_long_series)


# ---------------------------------------------------------------- R6 / R7 by length
SEGMENT = 128


def _by_length(spark, d):
    return prep.pack_by_length(panel(spark, d), KEYS, "hour", LABELS, segment=SEGMENT)


register("pack_by_length", rounded_sql("WITH " + PANEL_SQL + """
  SELECT user_id, session_no, row_number() OVER (PARTITION BY user_id, session_no ORDER BY hour) - 1 AS step,
         """ + ", ".join(LABELS) + " FROM panel", LABELS))(
    lambda spark, d: finish(prep.unpack_segments(_by_length(spark, d), KEYS, LABELS)))


def _padding(spark, d):
    """Share of padding: rows by length class against every stay padded to the longest."""
    p = panel(spark, d)
    one = prep.pack_sequences(p, KEYS, "hour", LABELS).withColumn("split", F.lit("all")).withColumn("x", F.transform("x", lambda v: F.lit(0)))
    long = one.crossJoin(F.broadcast(one.agg(F.max("maxsteps").alias("top")))).agg(
        F.sum("maxsteps").alias("steps"), F.sum("top").cast("bigint").alias("stored"))
    long = long.withColumn("padded_share", 1 - F.col("steps") / F.col("stored"))
    short = prep.padded_share(_by_length(spark, d))
    return finish(short.select(F.lit("by length").alias("method"), "*").unionByName(
        long.select(F.lit("to the longest").alias("method"), "*")))


_BOUNDS = prep.length_classes(SEGMENT)
register("pack_padding", rounded_sql("WITH " + PANEL_SQL + f""",
  n AS (SELECT user_id, session_no, count(*) AS n FROM panel GROUP BY user_id, session_no),
  s AS (SELECT least(n - k * {SEGMENT}, {SEGMENT}) AS m
        FROM (SELECT n, unnest(generate_series(0, (n - 1) // {SEGMENT})) AS k FROM n) AS u),
  c AS (SELECT m, len(list_filter({_BOUNDS}, lambda b: b < m)) AS cls FROM s),
  t AS (SELECT m, max(m) OVER (PARTITION BY cls) AS top FROM c)
  SELECT 'by length' AS method, CAST(sum(m) AS BIGINT) AS steps, CAST(sum(top) AS BIGINT) AS stored,
         1 - sum(m) / sum(top) AS padded_share FROM t
  UNION ALL SELECT 'to the longest', CAST(sum(n) AS BIGINT), CAST(count(*) * max(n) AS BIGINT), 1 - sum(n) / (count(*) * max(n)) FROM n""",
    ["padded_share"]))(_padding)


# ---------------------------------------------------------------- AG7 mergeable sketches
RANK_ERROR = 0.003


def _sketch(spark, d):
    """Limits from one sketch a day and event type, merged; each limit's true rank is
    held against the wanted one.  The comparison, not the limit, is the result: a
    sketch draws."""
    ev = table(spark, d, "events").select("event_type", "value", F.to_date("ts").alias("load")).where("value IS NOT NULL")
    loads = Q.quantile_sketches(ev, ["event_type", "load"], "value")
    lim = Q.sketch_limits(Q.merge_sketches(loads, "event_type"), "event_type", 0.01, 0.99)

    def near(limit, q):
        low, high = F.avg((F.col("value") < F.col(limit)).cast("double")), F.avg((F.col("value") <= F.col(limit)).cast("double"))
        return (low - RANK_ERROR <= q) & (high + RANK_ERROR >= q)

    return ev.join(lim, "event_type").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), near("lo_limit", 0.01).alias("lo_within"), near("hi_limit", 0.99).alias("hi_within"))


register("sketch_limits", """
  SELECT event_type, count(value) AS n, true AS lo_within, true AS hi_within
  FROM events WHERE value IS NOT NULL GROUP BY event_type""")(_sketch)

# ---------------------------------------------------------------- E1 / E3 reduced
register("roc_points_reduced", rounded_sql("WITH " + EV_SQL + """,
  l AS (SELECT *, lead(pos) OVER (ORDER BY s DESC) AS np, lead(neg) OVER (ORDER BY s DESC) AS nn FROM c)
  SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
  UNION ALL SELECT s, cn / N, cp / P FROM l, t WHERE coalesce(pos * nn <> neg * np, true)""", ["threshold", "fpr", "tpr"]))(
    lambda spark, d: finish(E.roc_points(event_scores(spark, d), "y", "s", reduce=True)))

register("pr_points_reduced", rounded_sql("WITH " + EV_SQL + """,
  l AS (SELECT *, lead(pos) OVER (ORDER BY s DESC) AS np FROM c)
  SELECT s AS threshold, cp / (cp + cn) AS precision, cp / P AS recall FROM l, t WHERE pos > 0 OR coalesce(np > 0, true)""",
    ["threshold", "precision", "recall"]))(
    lambda spark, d: finish(E.pr_points(event_scores(spark, d), "y", "s", reduce=True)))


# ---------------------------------------------------------------- IO5 / PF9
def _saved_report(spark, d):
    """A report written as one CSV file (IO5) and read back."""
    ev = table(spark, d, "events").select(*[(F.col("event_type") == n).alias(n) for n in LABELS])
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    save_report(report.prevalence(ev, LABELS), path)
    return finish(spark.read.schema("flag string, pct double").option("header", True).csv(path))


register("io_save_report", rounded_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS flag, round(100 * avg(CASE WHEN event_type = '{n}' THEN 1.0 ELSE 0.0 END), 1) AS pct FROM events"
    for n in LABELS), ["pct"]))(_saved_report)


def _by_type(spark, d):
    """Columns chosen by type and by a part of their name (PF9), then summed."""
    li = table(spark, d, "lineitem")
    cols = [c for c in filters.columns_of(li, "double") if c in filters.columns_like(li, "l_")]
    long = li.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("decimal(18,2)").alias("v")) for c in cols])).alias("s"))
    return finish(long.select("s.*").groupBy("column").agg(F.count("v").alias("n"), F.sum("v").cast("double").alias("total")))


register("columns_by_type", rounded_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), ["total"]))(_by_type)
