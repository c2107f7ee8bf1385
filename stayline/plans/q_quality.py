"""Catalogue: aggregates, profiles, reshaping and scalars on the driver tables
(AG2-AG16, AG20, AG22, PF10, PF11, R1, IO1, IO7, F1-F7, F18, F19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as X
from stayline.operators import filters, grid, quality as Q, report
from stayline.plans.base import (KEYS, stay_amounts, LABELS, LABELLED_SQL, PANEL_SQL, STAYS_SQL, finish,
                                 labelled_panel, panel, rounded_sql, sessions, stay_table, table)
from stayline.plans.registry import register
from stayline.session import cut_lineage
from stayline.sources import tables as IO


def _lit_list(vals):
    return "[" + ", ".join(repr(float(v)) for v in vals) + "]"


# ---------------------------------------------------------------- AG7
def _limits(spark, d):
    ev = table(spark, d, "events")
    return finish(Q.quantile_limits(ev, "event_type", "value", 0.01, 0.99))


register("quantile_limits", rounded_sql("""
  SELECT event_type, quantile_cont(value, 0.01) AS lo_limit, quantile_cont(value, 0.99) AS hi_limit
  FROM events WHERE value IS NOT NULL GROUP BY event_type""", ["lo_limit", "hi_limit"]))(_limits)


# ---------------------------------------------------------------- AG8
def _trim(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    return finish(Q.trim_outliers(ev, "event_type", "value", 0.01, 0.99, exempt=["signup"], keep_null=True))


register("trim_outliers", rounded_sql("""
  WITH lim AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi
               FROM events WHERE value IS NOT NULL AND event_type <> 'signup' GROUP BY event_type)
  SELECT e.event_id, e.event_type, e.value FROM events e LEFT JOIN lim USING (event_type)
  WHERE coalesce(e.event_type IN ('signup'), false)
     OR NOT coalesce(e.value < lim.lo OR e.value > lim.hi, false)""", ["value"]))(_trim)


# ---------------------------------------------------------------- AG9
def _trim_between(spark, d):
    """Input-spreading analogue: per-hour share of each session's total value,
    rows outside the 10 % / 99 % limits of all shares dropped (nulls too)."""
    x = stay_amounts(spark, d).withColumn("per_hour", grid.hourly_amount("intime", "outtime", "amount"))
    x = x.select(*KEYS, "per_hour")
    return finish(Q.trim_outliers(x, None, "per_hour", 0.10, 0.99, keep_null=False))


register("trim_between", rounded_sql("WITH " + STAYS_SQL + """,
  tot AS (SELECT user_id, session_no, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM sess GROUP BY ALL),
  x AS (SELECT user_id, session_no,
               amount / (date_diff('hour', date_trunc('hour', intime), date_trunc('hour', outtime)) + 1) AS per_hour
        FROM st JOIN tot USING (user_id, session_no)),
  lim AS (SELECT quantile_cont(per_hour, 0.10) AS lo, quantile_cont(per_hour, 0.99) AS hi FROM x)
  SELECT user_id, session_no, per_hour FROM x, lim WHERE per_hour BETWEEN lo AND hi""", ["per_hour"]))(_trim_between)


# ---------------------------------------------------------------- AG2
register("group_median", rounded_sql("""
  SELECT o_custkey, median(o_totalprice) AS median_price FROM orders
  WHERE o_totalprice IS NOT NULL GROUP BY o_custkey""", ["median_price"]))(
    lambda spark, d: finish(Q.group_median(table(spark, d, "orders"), "o_custkey", "o_totalprice", "median_price")))


# ---------------------------------------------------------------- AG10
def _null_profile(spark, d):
    return finish(Q.null_profile(panel(spark, d), LABELS))


register("null_profile", rounded_sql("WITH " + PANEL_SQL + " " + " UNION ALL ".join(
    f"SELECT '{L}' AS \"column\", avg(CAST({L} IS NULL AS DOUBLE)) AS null_frac FROM panel" for L in LABELS),
    ["null_frac"]))(_null_profile)


# ---------------------------------------------------------------- PF10
def _drop_sparse(spark, d):
    p = cut_lineage(panel(spark, d).withColumn("big_error", F.when(F.col("error") > 480, F.col("error"))))
    cols = [*LABELS, "big_error"]
    left = Q.drop_sparse(p, cols, 0.95)  # the drop itself; the profile tells why
    return finish(Q.null_profile(p, cols).withColumn("dropped", ~F.col("column").isin(left.columns)))


register("drop_sparse_columns", rounded_sql("WITH " + PANEL_SQL + """,
  p AS (SELECT *, CASE WHEN error > 480 THEN error END AS big_error FROM panel),
  prof AS (""" + " UNION ALL ".join(
    f"SELECT '{L}' AS \"column\", avg(CAST({L} IS NULL AS DOUBLE)) AS null_frac FROM p"
    for L in [*LABELS, "big_error"]) + """)
  SELECT "column", null_frac, null_frac > 0.95 AS dropped FROM prof""", ["null_frac"]))(_drop_sparse)


# ---------------------------------------------------------------- AG14
def _hist(spark, d):
    return finish(Q.histogram(table(spark, d, "lineitem"), "l_extendedprice", 10))


register("histogram", rounded_sql("""
  WITH x AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
  s AS (SELECT min(v) AS mn, max(v) AS mx FROM x),
  b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / ((mx - mn) / 10)), 9) END AS INTEGER) AS bin,
               mn, mx FROM x, s)
  SELECT bin, mn + bin * ((mx - mn) / 10) AS "left", mn + (bin + 1) * ((mx - mn) / 10) AS "right",
         count(*) AS n FROM b GROUP BY bin, mn, mx""", ["left", "right"]))(_hist)


# ---------------------------------------------------------------- AG15
def _qbins(spark, d):
    ev = table(spark, d, "events").withColumn("is_purchase", F.col("event_type") == "purchase")
    b = Q.quantile_bins(ev, "value", 10)
    return finish(Q.outcome_by_bin(b, "is_purchase"))


register("quantile_bins", rounded_sql(f"""
  WITH e AS (SELECT list_sort(list_distinct(quantile_cont(value, {_lit_list([i / 10 for i in range(11)])}))) AS edges
             FROM events WHERE value IS NOT NULL),
  b AS (SELECT event_type, CAST(greatest(len(list_filter(edges, lambda x: x < value)) - 1, 0) AS INTEGER) AS bin, edges
        FROM events, e WHERE value IS NOT NULL)
  SELECT bin, edges[bin + 1] AS bin_left, edges[bin + 2] AS bin_right, count(*) AS n,
         avg(CAST(event_type = 'purchase' AS DOUBLE)) AS outcome_mean
  FROM b GROUP BY bin, edges""", ["bin_left", "bin_right", "outcome_mean"]))(_qbins)


# ---------------------------------------------------------------- AG16
register("presence_overlap", "WITH " + PANEL_SQL + """
  SELECT CAST(count_if(click IS NOT NULL AND view IS NOT NULL) AS BIGINT) AS both,
         CAST(count_if(click IS NOT NULL AND view IS NULL) AS BIGINT) AS only_a,
         CAST(count_if(click IS NULL AND view IS NOT NULL) AS BIGINT) AS only_b,
         CAST(count_if(click IS NULL AND view IS NULL) AS BIGINT) AS neither, count(*) AS total FROM panel""")(
    lambda spark, d: Q.presence_overlap(panel(spark, d), "click", "view"))


# ---------------------------------------------------------------- AG20
register("feature_summary", rounded_sql("WITH " + PANEL_SQL + " " + " UNION ALL ".join(
    f"SELECT '{L}' AS \"column\", min({L}) AS min, max({L}) AS max, avg({L}) AS mean, stddev_samp({L}) AS std FROM panel"
    for L in LABELS), ["min", "max", "mean", "std"]))(
    lambda spark, d: finish(Q.feature_summary(panel(spark, d), LABELS)))


# ---------------------------------------------------------------- AG3 / AG22
register("any_flag", """
  SELECT user_id, coalesce(bool_or(event_type = 'purchase'), false) AS any_purchase,
         count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id""")(
    lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(
        F.coalesce(F.bool_or(F.col("event_type") == "purchase"), F.lit(False)).alias("any_purchase"),
        F.count_distinct("event_type").alias("n_types")))


# ---------------------------------------------------------------- AG12 / AG13
def _cohort_size(spark, d):
    return finish(report.cohort_size(labelled_panel(spark, d), KEYS, "label"))


register("cohort_size", rounded_sql("WITH " + LABELLED_SQL + """,
  s AS (SELECT user_id, session_no, bool_or(label) AS pos FROM lp GROUP BY ALL)
  SELECT count(*) AS n_stays, CAST(count_if(pos) AS BIGINT) AS n_positive, log2(count(*)) AS log2_stays,
         log2(count_if(pos)) AS log2_positive FROM s""", ["log2_stays", "log2_positive"]))(_cohort_size)


def _prevalence(spark, d):
    lp = labelled_panel(spark, d)
    st = stay_table(spark, d)
    a = report.label_prevalence(lp, KEYS, "label")
    b = report.prevalence(st, LABELS)
    return a.unionByName(b)


register("prevalence", "WITH " + LABELLED_SQL + ", " + """
  st AS (SELECT user_id, session_no, """ + ", ".join(f"coalesce(bool_or(event_type = '{L}'), false) AS {L}" for L in LABELS) + """
         FROM sess GROUP BY user_id, session_no),
  s AS (SELECT user_id, session_no, bool_or(label) AS pos FROM lp GROUP BY ALL)
  SELECT 'per_stay' AS flag, round(avg(CAST(pos AS DOUBLE)) * 100, 1) AS pct FROM s
  UNION ALL SELECT 'per_step' AS flag, round(avg(CAST(label AS DOUBLE)) * 100, 1) AS pct FROM lp
  UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{L}' AS flag, round(avg(CAST({L} AS DOUBLE)) * 100, 1) AS pct FROM st" for L in LABELS))(_prevalence)


# ---------------------------------------------------------------- R1
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _one_hot(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    c = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 17 != 0, F.col("c_mktsegment")))
    return grid.one_hot(c, "c_mktsegment", SEGMENTS, prefix="segment")


register("one_hot", """
  WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS seg FROM customer)
  SELECT c_custkey, """ + ", ".join(f"coalesce(seg = '{s}', false) AS \"segment, {s}\"" for s in SEGMENTS) +
         " FROM c")(_one_hot)


# ---------------------------------------------------------------- PF11
def _cond_update(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                            "l_discount", "l_tax")
    out = filters.update_when(li, [
        (F.col("l_returnflag") == "R", "l_discount", 0.0),
        (F.col("l_discount") == 0.0, "l_tax", F.col("l_tax") * 2),
        (F.col("l_tax") > 0.1, "l_returnflag", "X"),
    ])
    return finish(out)


register("conditional_update", rounded_sql("""
  WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
                    CASE WHEN coalesce(l_returnflag = 'R', false) THEN 0.0 ELSE l_discount END AS l_discount, l_tax
             FROM lineitem),
  b AS (SELECT * REPLACE (CASE WHEN coalesce(l_discount = 0.0, false) THEN l_tax * 2 ELSE l_tax END AS l_tax) FROM a)
  SELECT * REPLACE (CASE WHEN coalesce(l_tax > 0.1, false) THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM b""",
    ["l_discount", "l_tax"]))(_cond_update)


# ---------------------------------------------------------------- IO1 / IO7
register("io_load_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in IO.DRIVER_TABLES))(
    lambda spark, d: IO.table_sizes(IO.load_tables(spark, d)))


def _type_profile(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority",
                                         F.col("o_totalprice").cast("string").alias("price_text"))
    return IO.column_type_profile(o)


register("column_type_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({e}) AS n_nonnull, "
    f"count(TRY_CAST({e} AS DOUBLE)) AS n_numeric FROM orders"
    for c, e in [("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"),
                 ("price_text", "CAST(o_totalprice AS VARCHAR)")]))(_type_profile)


# ---------------------------------------------------------------- F1 - F7
def _try_number(spark, d):
    ev = table(spark, d, "events").select("event_id", "props")
    return finish(ev.select("event_id", X.try_num(F.regexp_extract("props", r"(\d+)", 1)).alias("k_num"),
                            X.try_num(F.substring("props", 7, 3)).alias("bad_num")))


register("scalar_try_number", rounded_sql(r"""
  SELECT event_id, TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k_num,
         TRY_CAST(substr(props, 7, 3) AS DOUBLE) AS bad_num FROM events""", ["k_num", "bad_num"]))(_try_number)


def _regex(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    txt = F.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")  ")))
    return p.select("p_partkey", txt.alias("label"), X.regex_last_paren(txt).alias("unit"))


register("scalar_regex", r"""
  WITH p AS (SELECT p_partkey, trim('  ' || p_name || ' (' || p_brand || ')  ') AS label FROM part)
  SELECT p_partkey, label, nullif(regexp_extract(label, '.*\((.*)\)$', 1), '') AS unit FROM p""")(_regex)

PRIORITY_MAP = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}


register("scalar_value_map", """
  SELECT o_orderkey, CASE """ + " ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in PRIORITY_MAP.items()) +
         " END AS priority FROM orders")(
    lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey", X.value_map("o_orderpriority", PRIORITY_MAP).alias("priority")))


def _consolidate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    x = o.join(c, "o_custkey", "left")
    return x.select("o_orderkey",
                    X.consolidate("o_orderpriority", {"HIGH": ["1-URGENT", "2-HIGH"]}).alias("priority"),
                    X.keep_or_other("c_mktsegment", ["BUILDING", "MACHINERY"]).alias("segment"))


register("scalar_consolidate", """
  SELECT o_orderkey,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' ELSE o_orderpriority END AS priority,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment
              ELSE 'OTHER' END AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")(_consolidate)


def _units(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    p = p.withColumn("uom", F.when(F.col("p_partkey") % 2 == 0, F.lit("Inch")).otherwise(F.lit("cm")))
    p = p.withColumn("height_m", X.height_to_m(F.col("p_size").cast("double") * 4, "uom"))
    p = p.withColumn("temp_c", X.fahrenheit_to_celsius(F.col("p_retailprice") / 10))
    return finish(p.where(X.true_or_false(F.col("height_m") > 1)).select("p_partkey", "uom", "height_m", "temp_c"))


register("scalar_units", rounded_sql("""
  WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Inch' ELSE 'cm' END AS uom,
                    CAST(p_size AS DOUBLE) * 4 AS v, p_retailprice FROM part),
  q AS (SELECT p_partkey, uom, (CASE WHEN uom = 'Inch' THEN v * 2.54 ELSE v END) / 100.0 AS height_m,
               (p_retailprice / 10 - 32) * 5 / 9 AS temp_c FROM p)
  SELECT * FROM q WHERE height_m > 1""", ["height_m", "temp_c"]))(_units)


def _datetime(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    return finish(ev.select("event_id", F.year("ts").alias("yr"), X.floor_hour("ts").alias("hour"),
                            X.add_hours("ts", 3).alias("ts_plus3h"),
                            X.hours_between("ts", X.floor_hour("ts")).alias("hours_into_hour")))


register("scalar_datetime", rounded_sql("""
  SELECT event_id, CAST(year(ts) AS INTEGER) AS yr, date_trunc('hour', ts) AS hour, ts + INTERVAL 3 HOUR AS ts_plus3h,
         date_diff('microsecond', date_trunc('hour', ts), ts) / 3.6e9 AS hours_into_hour FROM events""",
    ["hours_into_hour"]))(_datetime)


def _links(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                            "l_discount", "l_tax")
    li = li.withColumn("relevance", F.col("l_quantity") / 50)
    return finish(li.select("l_orderkey", "l_linenumber", "l_partkey",
                            X.sigmoid(F.col("l_quantity") / 10 - 2).alias("proba"),
                            X.explanation_link(["l_discount", "l_tax"], ["relevance", "relevance"]).alias("link"),
                            (F.col("l_discount") * F.col("relevance")).alias("contribution")))


register("scalar_links", rounded_sql("""
  SELECT l_orderkey, l_linenumber, l_partkey, 1.0 / (1.0 + exp(-(l_quantity / 10 - 2))) AS proba,
         1.0 - 1.0 / exp(l_discount * (l_quantity / 50) + l_tax * (l_quantity / 50)) AS link,
         l_discount * (l_quantity / 50) AS contribution FROM lineitem""", ["proba", "link", "contribution"]))(_links)


# ---------------------------------------------------------------- IO2 - IO6 round trips, PF12, F8
def _folder(spark) -> str:
    import uuid

    from stayline.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


def _bundle_round_trip(spark, d):
    """IO4 / IO6 then IO3: tables written (one partitioned), listed and read back."""
    f = _folder(spark)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    IO.save_bundle({"items": li, "items_cols": li.limit(1)}, f, partition_by=["l_returnflag"])
    got = IO.load_bundle(spark, f, exclude="cols")
    return got["items"].select("l_orderkey", "l_linenumber", "l_quantity", F.lit(len(got)).alias("n_tables"),
                               F.col("l_returnflag").cast("string").alias("l_returnflag"))


register("bundle_round_trip", """
  SELECT l_orderkey, l_linenumber, l_quantity, 1 AS n_tables, l_returnflag FROM lineitem""")(_bundle_round_trip)


def _label_map(spark, d):
    """IO5 then IO2: a reviewed label sheet as CSV, rows without a label dropped."""
    f = _folder(spark)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("itemid"),
                                       F.when(F.col("p_size") > 10, F.col("p_brand")).alias("REALITEM"))
    IO.save_report(p, f)
    return IO.load_label_map(spark, f)


register("label_map", """
  SELECT CAST(p_partkey AS VARCHAR) AS itemid, p_brand AS label FROM part WHERE p_size > 10""")(_label_map)


register("drop_literal", """
  SELECT o_orderkey, o_orderpriority FROM orders
  WHERE NOT coalesce(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT', false)""")(
    lambda spark, d: filters.drop_literal(table(spark, d, "orders"), "o_orderstatus", "F", "o_orderpriority", "1-URGENT")
    .select("o_orderkey", "o_orderpriority"))


register("age_at", """
  SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) - (1990 - CAST(o_custkey % 60 AS DOUBLE)) AS age FROM orders
  WHERE CAST(year(o_orderdate) AS DOUBLE) - (1990 - CAST(o_custkey % 60 AS DOUBLE)) >= 18""")(
    lambda spark, d: table(spark, d, "orders").withColumn(
        "birthyear", X.try_num(F.lit("1990")) - X.try_num((F.col("o_custkey") % 60).cast("string")))
    .withColumn("age", F.year("o_orderdate").cast("double") - F.col("birthyear"))
    .where(X.true_or_false(F.col("age") >= 18)).select("o_orderkey", "age"))
