"""Catalogue: stays, cohort filters, sessions (W1, W2, AG1, PF2-PF6, F9, L2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import expr as X
from stayline.operators import filters, stays
from stayline.plans.base import (KEYS, SESS_SQL, STAYS_SQL, finish, rounded_sql,
                                 sessions, stay_table, table)
from stayline.plans.registry import register

# ---------------------------------------------------------------- W1
register("sessionize", rounded_sql(
    "WITH " + SESS_SQL + " SELECT event_id, user_id, ts, session_no FROM sess", []))(
    lambda spark, d: sessions(spark, d).select("event_id", "user_id", "ts", "session_no"))

# ---------------------------------------------------------------- AG1
register("stay_rollup", "WITH " + STAYS_SQL + " SELECT * FROM st")(
    lambda spark, d: stay_table(spark, d))


# ---------------------------------------------------------------- PF6
def _stay_len(spark, d):
    st = stay_table(spark, d)
    x = st.where(stays.length_between("intime", "outtime", 48, 24 * 14))
    return finish(x.withColumn("los_hours", X.hours_between("outtime", "intime")))


register("filter_stay_length", rounded_sql(
    "WITH " + STAYS_SQL + """
    SELECT *, date_diff('microsecond', intime, outtime) / 3.6e9 AS los_hours FROM st
    WHERE outtime - intime >= INTERVAL 48 HOUR AND outtime - intime <= INTERVAL 336 HOUR""",
    ["los_hours"]))(_stay_len)


# ---------------------------------------------------------------- W2
def _first(spark, d):
    st = stay_table(spark, d).where(stays.length_between("intime", "outtime", 48, 24 * 14))
    return stays.first_per_key(st, "user_id", ["intime"], ["session_no"])


register("first_per_key", "WITH " + STAYS_SQL + """,
  ok AS (SELECT * FROM st WHERE outtime - intime >= INTERVAL 48 HOUR AND outtime - intime <= INTERVAL 336 HOUR)
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY intime, session_no) AS rn FROM ok) AS z
  WHERE rn = 1""")(_first)


# ---------------------------------------------------------------- PF2
def _regex(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    x = o.where(filters.where_matches("o_orderpriority", r"URGENT$|HIGH$"))
    return x.withColumn("unit", X.regex_last_paren(F.concat(F.lit("Unit ("), F.col("o_orderpriority"), F.lit(")"))))


register("filter_regex", r"""
  SELECT o_orderkey, o_orderpriority,
         nullif(regexp_extract('Unit (' || o_orderpriority || ')', '.*\((.*)\)$', 1), '') AS unit
  FROM orders WHERE coalesce(regexp_matches(o_orderpriority, 'URGENT$|HIGH$'), false)""")(_regex)


# ---------------------------------------------------------------- PF4
def _in_lists(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.where(filters.is_in("o_orderpriority", ["1-URGENT", "2-HIGH"])
                   & filters.not_in("o_orderstatus", ["P"]))


register("filter_in_lists", """
  SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
  WHERE coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)
    AND NOT coalesce(o_orderstatus IN ('P'), false)""")(_in_lists)


# ---------------------------------------------------------------- PF3 / J-semi
def _semi(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    keys = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("o_custkey"))
    return finish(filters.keep_keys(o, keys, "o_custkey"))


register("join_semi", rounded_sql("""
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ["o_totalprice"]))(_semi)


# ---------------------------------------------------------------- F9 / L2
def _cap_end(spark, d):
    st = stay_table(spark, d)
    ev = table(spark, d, "events")
    # analogue: "death" = the user's last error event, "discharge" = intime + 10 days;
    # end capped by both, outcome = event within 24 h of the capped end
    last = ev.where(F.col("event_type") == "error").groupBy("user_id").agg(F.max("ts").alias("deathtime"))
    x = st.join(last, on="user_id", how="left").withColumn("dischtime", X.add_hours("intime", 240))
    x = x.withColumn("outtime_capped", stays.cap_end("outtime", "deathtime", "dischtime"))
    x = x.withColumn("outcome", stays.outcome_within("deathtime", "outtime_capped", 24))
    return x.select(*KEYS, "intime", "outtime", "deathtime", "dischtime", "outtime_capped", "outcome")


register("scalar_cap_end", "WITH " + STAYS_SQL + """,
  last AS (SELECT user_id, max(ts) AS deathtime FROM events WHERE event_type = 'error' GROUP BY user_id),
  x AS (SELECT st.user_id, st.session_no, intime, outtime, deathtime, intime + INTERVAL 240 HOUR AS dischtime
        FROM st LEFT JOIN last ON st.user_id = last.user_id),
  y AS (SELECT *, CASE WHEN outtime IS NOT NULL THEN least(outtime, deathtime, dischtime) END AS outtime_capped FROM x)
  SELECT user_id, session_no, intime, outtime, deathtime, dischtime, outtime_capped,
         coalesce(deathtime - outtime_capped <= INTERVAL 24 HOUR, false) AS outcome FROM y""")(_cap_end)
