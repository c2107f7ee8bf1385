"""Catalogue: joins and diagnosis-code grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import codes as C, joins as J, stays
from stayline.plans.base import STAYS_SQL, finish, rounded_sql, stay_table, table
from stayline.plans.registry import register

# ---------------------------------------------------------------- J1 / J2
register("join_left", """
  SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", "o_custkey").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"),
        on="o_custkey", how="left"))

register("join_inner", """
  SELECT l_orderkey, l_linenumber, l_partkey, p_type, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey""")(
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"),
        on="l_partkey", how="inner"))


# ---------------------------------------------------------------- diagnosis analogue
def diagnoses(spark, d):
    """Diagnosis rows: one per line item, the code and version derived from
    its part (admission = order)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type")
    x = li.join(p, "l_partkey")
    ver = F.when(F.col("l_partkey") % 2 == 0, F.lit(10)).otherwise(F.lit(9))
    v10 = F.concat(F.expr("substr('CDEGI', CAST(1 + (l_partkey DIV 2) % 5 AS INT), 1)"),
                   F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."),
                   (F.col("l_partkey") % 10).cast("string"))
    v9 = F.concat(F.lpad(((F.col("l_partkey") * 7) % 1000).cast("string"), 3, "0"), F.lit("."),
                  (F.col("l_partkey") % 10).cast("string"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "p_type", ver.alias("icd_version"),
                    F.when(ver == 10, v10).otherwise(v9).alias("icd_code"))


DIAG_SQL = """
diag AS (
  SELECT l_orderkey, l_linenumber, l_partkey, p_type,
         CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 9 END AS icd_version,
         CASE WHEN l_partkey % 2 = 0
              THEN substr('CDEGI', CAST(1 + (l_partkey // 2) % 5 AS INTEGER), 1) || lpad(CAST(p_size AS VARCHAR), 2, '0')
                   || '.' || CAST(l_partkey % 10 AS VARCHAR)
              ELSE lpad(CAST((l_partkey * 7) % 1000 AS VARCHAR), 3, '0') || '.' || CAST(l_partkey % 10 AS VARCHAR)
         END AS icd_code
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _rules_values():
    seen, rows = set(), []
    for g, ver, lo, hi, _c1 in C.rule_rows():
        k = (g, ver, lo, hi)
        if k not in seen:
            seen.add(k)
            rows.append(k)
    vals = ", ".join("('{}', {}, '{}', '{}')".format(g.replace("'", "''"), v, lo, hi) for g, v, lo, hi in rows)
    return f"rules(grp, version, lo, hi) AS (VALUES {vals})"


MATCH_SQL = DIAG_SQL + ",\n" + _rules_values() + """,
m AS (
  SELECT diag.*, rules.grp AS "group" FROM diag JOIN rules
    ON diag.icd_version = rules.version
   AND substr(upper(regexp_replace(trim(icd_code), '[. ]', '', 'g')), 1, length(lo)) >= lo
   AND substr(upper(regexp_replace(trim(icd_code), '[. ]', '', 'g')), 1, length(hi)) <= hi)"""


# ---------------------------------------------------------------- J3
def _multi_key(spark, d):
    dx = diagnoses(spark, d)
    dictionary = dx.groupBy("icd_code", "icd_version").agg(F.min("p_type").alias("long_title"))
    return dx.drop("p_type").join(dictionary, on=["icd_code", "icd_version"], how="left")


register("join_multi_key", "WITH " + DIAG_SQL + """,
  dict AS (SELECT icd_code, icd_version, min(p_type) AS long_title FROM diag GROUP BY icd_code, icd_version)
  SELECT diag.l_orderkey, diag.l_linenumber, diag.l_partkey, diag.icd_version, diag.icd_code, dict.long_title
  FROM diag LEFT JOIN dict ON diag.icd_code = dict.icd_code AND diag.icd_version = dict.icd_version""")(_multi_key)


# ---------------------------------------------------------------- C2 / C3
def _code_groups(spark, d):
    return C.assign_groups(diagnoses(spark, d).drop("p_type"), "icd_code", "icd_version", C.code_rules(spark))


register("code_groups", "WITH " + MATCH_SQL + """
  SELECT l_orderkey, l_linenumber, l_partkey, icd_version, icd_code, "group" FROM m""")(_code_groups)

GROUPS = C.group_names()


def _q(g):
    return '"' + g.replace('"', '""') + '"'


def _code_flags(spark, d):
    a = C.assign_groups(diagnoses(spark, d).drop("p_type"), "icd_code", "icd_version", C.code_rules(spark),
                        keep_unmatched=True)
    return C.group_flags(a, "l_orderkey", GROUPS)


register("code_flags", "WITH " + MATCH_SQL + """,
  a AS (SELECT diag.l_orderkey, m."group" FROM diag LEFT JOIN m
          ON diag.l_orderkey = m.l_orderkey AND diag.l_linenumber = m.l_linenumber AND diag.l_partkey = m.l_partkey)
  SELECT l_orderkey, """ + ", ".join(f"coalesce(bool_or(\"group\" = '{g}'), false) AS {_q(g)}" for g in GROUPS) + """
  FROM a GROUP BY l_orderkey""")(_code_flags)


# ---------------------------------------------------------------- J4 + C4 + F17
def _weighted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    facts, words = C.group_words(diagnoses(spark, d).drop("p_type"), "icd_code", "icd_version", C.code_rules(spark),
                                 "l_orderkey", GROUPS)
    facts = facts.join(o.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    out = [f"_p{k}" for k in range(len(words))]
    pr = J.prior_words(o, facts, "o_custkey", "o_orderdate", "o_orderdate", words, out)
    w, n, score = C.moore_weights(), F.lit(0), F.lit(0)
    for i, g in enumerate(GROUPS):
        has = J.flag_of(out, i).cast("int")
        n, score = n + has, score + has * w[g]
    return pr.select("o_orderkey", "o_custkey", n.alias("n_prior_groups"), score.alias("score"))


_W = C.moore_weights()
register("weighted_score", "WITH " + MATCH_SQL + """,
  fl AS (SELECT l_orderkey, """ + ", ".join(f"coalesce(bool_or(\"group\" = '{g}'), false) AS {_q(g)}" for g in GROUPS) + """
         FROM m GROUP BY l_orderkey),
  fo AS (SELECT o.o_custkey, o.o_orderdate, fl.* FROM orders o JOIN fl ON o.o_orderkey = fl.l_orderkey),
  pr AS (SELECT p.o_orderkey, p.o_custkey, """ + ", ".join(
    f"coalesce(bool_or(fo.{_q(g)}), false) AS {_q(g)}" for g in GROUPS) + """
         FROM orders p LEFT JOIN fo ON fo.o_custkey = p.o_custkey AND fo.o_orderdate < p.o_orderdate
         GROUP BY p.o_orderkey, p.o_custkey)
  SELECT o_orderkey, o_custkey, """ + " + ".join(f"CAST({_q(g)} AS INTEGER)" for g in GROUPS) + """ AS n_prior_groups,
         """ + " + ".join(f"CAST({_q(g)} AS INTEGER) * ({_W[g]})" for g in GROUPS) + """ AS score FROM pr""")(_weighted)


def _prior(spark, d):
    """Prior history on orders: any strictly earlier order of the same customer
    that was urgent / high priority."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    facts = o.select("o_custkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
                     (F.col("o_orderpriority") == "2-HIGH").alias("high"))
    return J.prior_history(o.drop("o_orderpriority"), facts, "o_custkey", "o_orderdate", "o_orderdate",
                           ["urgent", "high"])


register("prior_history", """
  SELECT p.o_orderkey, p.o_custkey, p.o_orderdate,
         coalesce(bool_or(f.o_orderpriority = '1-URGENT'), false) AS prior_urgent,
         coalesce(bool_or(f.o_orderpriority = '2-HIGH'), false) AS prior_high
  FROM orders p LEFT JOIN orders f ON f.o_custkey = p.o_custkey AND f.o_orderdate < p.o_orderdate
  GROUP BY p.o_orderkey, p.o_custkey, p.o_orderdate""")(_prior)


# ---------------------------------------------------------------- J5
def _interval(spark, d):
    st = stay_table(spark, d).where(stays.length_between("intime", "outtime", 48, 24 * 14))
    first = stays.first_per_key(st, "user_id", ["intime"], ["session_no"]).select("user_id", "session_no",
                                                                                   "intime", "outtime")
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return finish(J.events_in_stay(ev, first, "user_id", "ts"))


register("join_interval", rounded_sql("WITH " + STAYS_SQL + """,
  fs AS (SELECT user_id, session_no, intime, outtime FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY intime, session_no) AS rn FROM st
    WHERE outtime - intime >= INTERVAL 48 HOUR AND outtime - intime <= INTERVAL 336 HOUR) AS z WHERE rn = 1)
  SELECT e.event_id, e.user_id, e.ts, e.value, fs.session_no, fs.intime, fs.outtime
  FROM events e JOIN fs ON e.user_id = fs.user_id AND e.ts >= fs.intime AND e.ts <= fs.outtime""",
    ["value"]))(_interval)


def _interval_hot(spark, d):
    """J5 where one key holds a third of the rows: users are pooled into wards, every
    third one into ward 0; events meet the first day of every stay of their ward.
    The pairs of a ward grow with its events times its stays, so the join gives each
    stay's figures, not its pairs."""
    ward = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("bigint")
    st = stay_table(spark, d)
    st = st.select(ward.alias("ward"), "user_id", "session_no", "intime",
                   F.least("outtime", F.col("intime") + F.expr("INTERVAL 24 HOURS")).alias("until"))
    ev = table(spark, d, "events").select("event_id", ward.alias("ward"), "ts")
    figures = {"n_events": ("count", "event_id"), "first_id": ("min", "event_id"), "last_id": ("max", "event_id")}
    return J.events_in_stay(ev, st, "ward", "ts", "intime", "until", summary=figures).groupBy(
        "ward", "user_id", "session_no").agg(F.sum("n_events").alias("n_events"), F.min("first_id").alias("first_id"),
                                             F.max("last_id").alias("last_id"))


_WARD = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END"
register("join_interval_wards", "WITH " + STAYS_SQL + f""",
  w AS (SELECT {_WARD} AS ward, user_id, session_no, intime, least(outtime, intime + INTERVAL 24 HOUR) AS until FROM st),
  e AS (SELECT event_id, {_WARD} AS ward, ts FROM events)
  SELECT CAST(w.ward AS BIGINT) AS ward, w.user_id, w.session_no, count(*) AS n_events, min(e.event_id) AS first_id,
         max(e.event_id) AS last_id
  FROM e JOIN w ON e.ward = w.ward AND e.ts >= w.intime AND e.ts <= w.until GROUP BY ALL""")(_interval_hot)
