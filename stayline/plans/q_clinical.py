"""Catalogue: the clinical chains P1-P11 on hospital-shaped tables that Spark derives
from the driver tables, each held against SQL that states the chain's result anew.

Hospital analogue: a user is a subject, a session an admission with two ICU transfers
(the second ends a week after the last event), the subject's orders' parts give the
diagnoses, events give the charted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.operators import codes as C, joins as J
from stayline.plans import clinical as P
from stayline.plans.base import LABELLED_SQL, PANEL_SQL, STAYS_SQL, finish, labelled_panel, panel, rounded_sql, stay_bounds, table
from stayline.plans.q_eval import EV_SQL, SCORED_SQL, _md5, event_scores, scored
from stayline.plans.q_joins import _rules_values
from stayline.plans.q_panel import _score_case
from stayline.plans.registry import register

UNITS = ["Medical Intensive Care Unit (MICU)", "Surgical ICU (SICU)", "Coronary Care Unit (CCU)", "Medicine"]
ADMISSIONS = ["EW EMER.", "EU OBSERVATION", "URGENT", None]
PLACES = ["EMERGENCY ROOM", "WALK-IN", "PHYSICIAN REFERRAL"]
DISCHARGES = ["HOME", "HOME HEALTH CARE", "DIED", "OTHER FACILITY"]
INSURANCES = ["Medicare", "Other", None]
ETHNICITIES = ["WHITE", "UNKNOWN", "ASIAN"]
DEVICES = ["CPAP mask ", "Nasal cannula", "None", "Other"]
ITEMS = {"click": "HR", "error": "BP", "view": "226730", "purchase": "224639", "signup": "DEV"}


def _pick(values, number: str) -> str:
    """SQL of both engines: the value of a list that a number names."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v + "'") for i, v in enumerate(values))
    return f"CASE CAST({number} % {len(values)} AS INT) {cases} END"


# ---------------------------------------------------------------- tables
#: name -> columns, as expressions of ``stays`` (user_id, session_no, intime, outtime); both engines read them
ADMISSION = {
    "subject_id": "CAST(user_id AS {text})", "hadm_id": "concat(CAST(user_id AS {text}), '-', CAST(session_no AS {text}))",
    "admittime": "intime - INTERVAL '24' HOUR",
    "dischtime": "outtime + CASE WHEN user_id % 7 = 0 THEN INTERVAL '160' HOUR ELSE INTERVAL '200' HOUR END",
    "deathtime": "CASE WHEN user_id % 4 = 0 THEN outtime + INTERVAL '180' HOUR WHEN user_id % 4 = 1 THEN outtime + INTERVAL '400' HOUR END",
    "admission_type": _pick(ADMISSIONS, "user_id"), "admission_location": _pick(PLACES, "user_id"),
    "discharge_location": _pick(DISCHARGES, "user_id"), "insurance": _pick(INSURANCES, "user_id"),
    "ethnicity": _pick(ETHNICITIES, "user_id"), "edregtime": "CASE WHEN user_id % 2 = 0 THEN intime END"}
TRANSFER = [{"careunit": _pick(UNITS, "user_id"), "intime": "intime", "outtime": "intime + INTERVAL '60' HOUR"},
            {"careunit": _pick(UNITS, "(user_id + session_no)"), "intime": "intime + INTERVAL '62' HOUR",
             "outtime": "outtime + INTERVAL '168' HOUR"}]
PATIENT = {"anchor_year": "'2024'", "anchor_age": "CAST(10 + user_id * 7 % 80 AS {text})",
           "gender": "CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'M' WHEN 1 THEN 'X' ELSE 'F' END"}


def _spark(e: str):
    return F.expr(e.replace("{text}", "STRING"))


def _duck(e: str) -> str:
    return e.replace("{text}", "VARCHAR")


def hospital(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of ``plans/clinical.py`` and its label map."""
    st = P.cut(stay_bounds(spark, d))  # every table reads it
    ids = [_spark(ADMISSION[c]).alias(c) for c in ("subject_id", "hadm_id")]
    transfers = [st.select(*ids, *[_spark(e).alias(c) for c, e in t.items()]) for t in TRANSFER]
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    ver = F.expr("CASE WHEN p_partkey % 2 = 0 THEN '10' ELSE '9' END")
    code = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(substr('CDEGI', CAST(1 + p_partkey DIV 2 % 5 AS INT), 1), "
                  "lpad(CAST(p_size AS STRING), 2, '0'), '.', CAST(p_partkey % 10 AS STRING), ' ') "
                  "ELSE concat(lpad(CAST(p_partkey * 7 % 1000 AS STRING), 3, '0'), '.', CAST(p_partkey % 10 AS STRING)) END")
    part = part.select("p_partkey", "p_type", code.alias("icd_code"), ver.alias("icd_version"))
    which = st.select(*ids, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq_num"), "user_id", "session_no")
    which = which.withColumn("p_partkey", F.expr("1 + (user_id * 31 + session_no * 7 + seq_num * 53) % 200"))
    named = J.counted_lookup(which.select("p_partkey").distinct())
    coded = J.counted_lookup(part.join(named, "p_partkey", "left_semi").drop("p_type"))  # parts that a diagnosis names
    dx = which.join(coded, "p_partkey").select("subject_id", "hadm_id", F.col("seq_num").cast("string").alias("seq_num"),
                                              "icd_code", "icd_version")
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    ev = J.events_in_stay(ev, st, "user_id", "ts").select(*ids, "event_id", "ts", "event_type", "value")
    kinds = F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv])
    ce = ev.select("subject_id", "hadm_id", kinds[F.col("event_type")].alias("itemid"), F.col("ts").alias("charttime"),
                   F.when(F.col("event_type") == "signup", F.expr(_pick(DEVICES, "event_id"))).alias("value"),
                   F.col("value").cast("string").alias("valuenum"),
                   F.when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "Inch").otherwise("cm")).alias("valueuom"))
    empty = spark.range(0)
    t = {"transfers": transfers[0].unionByName(transfers[1]),
         "patients": st.select(*ids[:1], *[_spark(e).alias(c) for c, e in PATIENT.items()]).distinct(),
         "admissions": st.select(*[_spark(e).alias(c) for c, e in ADMISSION.items()]),
         "diagnoses_icd": dx, "chartevents": ce,
         "d_icd_diagnoses": part.groupBy("icd_code", "icd_version").agg(F.min("p_type").alias("long_title")),
         "d_items": spark.createDataFrame([("RBC", "Packed Red Blood Cells"), *[(i, i) for i in ITEMS.values()]], "itemid string, label string"),
         "inputevents": st.select(ids[1], F.lit("RBC").alias("itemid"), (F.col("intime") + F.expr("INTERVAL '10' HOUR")).alias("starttime"),
                                  (F.col("intime") + F.expr("INTERVAL '12' HOUR")).alias("endtime"),
                                  (F.col("user_id") % 9 + 3).cast("double").alias("totalamount"), F.lit("01-Drips").alias("ordercategoryname")),
         "outputevents": empty.selectExpr("'' AS hadm_id", "'' AS itemid", "TIMESTAMP_NTZ'2024-01-01' AS charttime", "0D AS value")}
    labels = spark.createDataFrame([("HR", K.V["hr"]), ("BP", K.V["nisbp"]), ("DEV", K.DEVICE_LABEL)], "itemid string, label string")
    return t, labels


def _merge_case(c: str, merges) -> str:
    arms = " ".join(f"WHEN {c} IN ({', '.join(repr(s) for s in src)}) THEN '{t}'" for t, src in merges.items())
    return f"CASE {arms} ELSE {c} END"


_IDS = f"{_duck(ADMISSION['subject_id'])} AS subject_id, {_duck(ADMISSION['hadm_id'])} AS hadm_id"
_TRANSFERS = " UNION ALL ".join(f"SELECT {_IDS}, " + ", ".join(f"{_duck(e)} AS {c}" for c, e in t.items()) + " FROM st" for t in TRANSFER)
HOSPITAL_SQL = STAYS_SQL + f""",
tr AS ({_TRANSFERS}),
adm AS (SELECT user_id, session_no AS own_no, intime AS first_event, {', '.join(f'{_duck(e)} AS {c}' for c, e in ADMISSION.items())} FROM st),
pt AS (SELECT DISTINCT {_duck(ADMISSION['subject_id'])} AS subject_id, {', '.join(f'{_duck(e)} AS {c}' for c, e in PATIENT.items())} FROM st),
codes AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 9 END AS ver,
            CASE WHEN p_partkey % 2 = 0 THEN substr('CDEGI', CAST(1 + (p_partkey // 2) % 5 AS INTEGER), 1)
                   || lpad(CAST(p_size AS VARCHAR), 2, '0') || CAST(p_partkey % 10 AS VARCHAR)
                 ELSE lpad(CAST((p_partkey * 7) % 1000 AS VARCHAR), 3, '0') || CAST(p_partkey % 10 AS VARCHAR) END AS code FROM part),
dx AS (SELECT subject_id, hadm_id, ver, code FROM (SELECT *, unnest([0, 1, 2]) AS k FROM adm) AS a
       JOIN codes ON p_partkey = 1 + (user_id * 31 + own_no * 7 + k * 53) % 200),
{_rules_values()},
gr AS (SELECT DISTINCT subject_id, hadm_id, grp FROM dx JOIN rules ON ver = version
       WHERE substr(code, 1, length(lo)) >= lo AND substr(code, 1, length(hi)) <= hi),
ev AS (SELECT {_IDS.replace('user_id', 'e.user_id')}, e.event_id, e.ts, e.event_type, e.value FROM events e
       JOIN st ON e.user_id = st.user_id AND e.ts >= st.intime AND e.ts <= st.outtime),
icu AS (SELECT subject_id, hadm_id, min(intime) AS intime, max(outtime) AS outtime,
          bool_or(careunit LIKE '%(MICU)') AS micu, bool_or(careunit LIKE '%(SICU)') AS sicu, bool_or(careunit LIKE '%(CCU)') AS ccu
        FROM tr WHERE regexp_matches(careunit, 'ICU\\)$|CCU\\)$') GROUP BY subject_id, hadm_id),
one AS (SELECT * FROM icu WHERE outtime - intime BETWEEN INTERVAL 48 HOUR AND INTERVAL 336 HOUR
        QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY intime, hadm_id) = 1),
co0 AS (SELECT one.*, year(one.intime) - (CAST(anchor_year AS DOUBLE) - CAST(anchor_age AS DOUBLE)) AS age,
          CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' END AS gender,
          coalesce(admission_type, 'UNKNOWN') AS admission_type, coalesce(admission_location, 'UNKNOWN') AS admission_location,
          coalesce(adm.discharge_location, 'UNKNOWN') AS discharge_location, coalesce(insurance, 'UNKNOWN') AS insurance,
          coalesce(ethnicity, 'UNKNOWN') AS ethnicity, edregtime IS NOT NULL AS ed, admittime, dischtime, deathtime,
          least(one.outtime, deathtime, dischtime) AS capped
        FROM one JOIN pt USING (subject_id) JOIN adm USING (hadm_id)),
co AS (SELECT * EXCLUDE (outtime), capped AS outtime, coalesce(deathtime - capped <= INTERVAL 24 HOUR, false) AS dies,
          date_diff('microsecond', intime, capped) / 3.6e9 AS los,
          (SELECT count(*) FROM gr WHERE gr.hadm_id = co0.hadm_id) AS n_groups
       FROM co0 WHERE age >= {K.MIN_AGE} AND capped - intime >= INTERVAL {K.FINAL_MIN_LOS_HOURS} HOUR
         AND EXISTS (SELECT 1 FROM dx WHERE dx.hadm_id = co0.hadm_id)),
size AS (SELECT co.hadm_id, h.h AS height, w.w AS weight FROM co
  LEFT JOIN (SELECT subject_id, median(CASE WHEN event_id % 2 = 0 THEN value * 2.54 ELSE value END / 100.0) AS h FROM ev
             WHERE event_type = 'view' AND value IS NOT NULL GROUP BY subject_id) AS h ON h.subject_id = co.subject_id AND h.h > {K.MIN_HEIGHT_M}
  LEFT JOIN (SELECT hadm_id, median(value) AS w FROM ev WHERE event_type = 'purchase' AND value IS NOT NULL AND subject_id IN
             (SELECT subject_id FROM co) GROUP BY hadm_id) AS w ON w.hadm_id = co.hadm_id AND w.w > {K.MIN_WEIGHT_KG})"""


# ---------------------------------------------------------------- P1-P3
def _cohort(spark, d):
    co, _ = P.build_cohort(hospital(spark, d)[0])
    n = sum((F.col(f"`(Elixhauser) {g}`").cast("int") for g in C.group_names()), F.lit(0))
    return finish(co.select("subject_id", "hadm_id", "session_no", "intime", "outtime", "age", "gender",
                            F.col("Admission type").alias("admission_type"), F.col("ED admit").alias("ed"),
                            F.col("MICU").alias("micu"), F.col("SICU").alias("sicu"), F.col("CCU").alias("ccu"),
                            n.cast("bigint").alias("n_groups"), F.col(f"`{P.DEATH}`").alias("dies"), F.col("`LOS (h)`").alias("los")))


register("clinical_cohort", rounded_sql("WITH " + HOSPITAL_SQL + """
  SELECT subject_id, hadm_id, CAST(1 AS BIGINT) AS session_no, intime, outtime, age, gender, admission_type, ed,
         coalesce(micu, false) AS micu, coalesce(sicu, false) AS sicu, coalesce(ccu, false) AS ccu, n_groups, dies, los
  FROM co""", ["age", "los"]))(_cohort)


def _with_size(spark, d):
    t, _ = hospital(spark, d)
    co, dx = P.build_cohort(t)
    return t, P.cut(P.add_body_size(t, P.cut(co))), dx


def _body_size(spark, d):
    _, co, _ = _with_size(spark, d)
    return finish(co.select("hadm_id", F.col("`Height (m)`").alias("height"), F.col("`Weight (kg)`").alias("weight"),
                            F.col("BMI").alias("bmi"), F.col("Admission type").alias("admission_type"),
                            F.col("Admission location").alias("admission_location"), "discharge_location",
                            F.col("Ethnicity").alias("ethnicity")))


register("clinical_body_size", rounded_sql("WITH " + HOSPITAL_SQL + f"""
  SELECT hadm_id, height, weight, weight / (height * height) AS bmi, {_merge_case('admission_type', K.ADMISSION_TYPE_MERGE)} AS admission_type,
         CASE WHEN admission_location IN ({', '.join(repr(x) for x in K.ADMISSION_LOCATION_KEEP)}) THEN admission_location ELSE 'OTHER' END AS admission_location,
         {_merge_case('discharge_location', K.DISCHARGE_LOCATION_MERGE)} AS discharge_location, {_merge_case('ethnicity', K.ETHNICITY_MERGE)} AS ethnicity
  FROM co JOIN size USING (hadm_id)""", ["height", "weight", "bmi"]))(_body_size)


def _static(spark, d):
    t, co, dx = _with_size(spark, d)
    st = P.static_features(t, co, dx)
    n = sum((F.coalesce(F.col(f"`{K.PRIOR_PREFIX}{g}`").cast("int"), F.lit(0)) for g in C.group_names()), F.lit(0))
    return finish(st.select("hadm_id", "age", F.col("`gender, Male`").alias("male"), F.col("`Insurance, Medicare`").alias("medicare"),
                            F.col("BMI").alias("bmi"), n.cast("bigint").alias("n_prior"), F.col(f"`{K.PRIOR_SCORE}`").alias("prior_score")))


_WEIGHT = " ".join(f"WHEN '{g}' THEN {w}" for g, w in C.moore_weights().items())
register("clinical_static", rounded_sql("WITH " + HOSPITAL_SQL + f""",
  med AS (SELECT median(height) AS mh, median(weight) AS mw FROM size),
  pr AS (SELECT DISTINCT co.hadm_id, gr.grp FROM co JOIN gr USING (subject_id) JOIN adm ON adm.hadm_id = gr.hadm_id
         WHERE adm.dischtime < co.dischtime),
  ps AS (SELECT hadm_id, count(*) AS n, sum(CASE grp {_WEIGHT} ELSE 0 END) AS s FROM pr GROUP BY hadm_id)
  SELECT co.hadm_id, age, coalesce(gender = 'Male', false) AS male, insurance = 'Medicare' AS medicare,
         coalesce(weight, mw) / (coalesce(height, mh) * coalesce(height, mh)) AS bmi, CAST(coalesce(n, 0) AS BIGINT) AS n_prior,
         CAST(coalesce(s, 0) AS INTEGER) AS prior_score
  FROM co JOIN size USING (hadm_id) CROSS JOIN med LEFT JOIN ps ON ps.hadm_id = co.hadm_id""", ["age", "bmi"]))(_static)


# ---------------------------------------------------------------- P4 / P5
def _measured(spark, d):
    t, labels = hospital(spark, d)
    co, _ = P.build_cohort(t)
    co = P.cut(co)
    return t, labels, co, P.clean_measurements(t, co, labels)


_DEV = " ".join(f"WHEN '{v}' THEN '{K.DEVICE_MAP[v]}'" for v in DEVICES if v in K.DEVICE_MAP)
MEASURED_SQL = HOSPITAL_SQL + f""",
m0 AS (SELECT ev.hadm_id, ev.ts, CASE WHEN event_type = 'signup' THEN 1.0 ELSE value END AS v,
         CASE event_type WHEN 'click' THEN '{K.V['hr']}' WHEN 'error' THEN '{K.V['nisbp']}'
              ELSE CASE {_pick(DEVICES, 'event_id')} {_DEV} END END AS label
       FROM ev JOIN co ON co.hadm_id = ev.hadm_id AND ev.ts >= co.intime AND ev.ts <= co.outtime
       WHERE event_type IN ('click', 'error', 'signup')),
lim AS (SELECT label, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m0 WHERE label NOT LIKE 'O2 Del%' GROUP BY label),
m AS (SELECT m0.* FROM m0 LEFT JOIN lim USING (label) WHERE label IS NOT NULL AND NOT coalesce(v < lo OR v > hi, false))"""

register("clinical_measurements", rounded_sql("WITH " + MEASURED_SQL + """
  SELECT hadm_id, ts AS charttime, label, v AS valuenum FROM m""", ["valuenum"]))(
    lambda spark, d: finish(_measured(spark, d)[3].select("hadm_id", "charttime", "label", "valuenum")))

_ON = "O2 Delivery Device: NIPPV"


def _panel(spark, d):
    t, labels, co, ce = _measured(spark, d)
    p = P.hourly_panel(t, co, ce, P.panel_labels(labels))
    return finish(p.select("hadm_id", "hour", F.col(f"`{K.V['hr']}`").alias("hr"), F.col("SBP").alias("sbp"),
                           F.col("Shock Index").alias("shock"), F.col("Hours since ICU admit").alias("since_icu"),
                           F.col("Hours since admit").alias("since_admit"), F.col(f"`{_ON}`").alias("nippv"),
                           F.col("Packed Red Blood Cells").alias("red_cells")))


PANEL5_SQL = MEASURED_SQL + f""",
h0 AS (SELECT hadm_id, date_trunc('hour', ts) AS hour, ts, label, avg(v) AS v FROM m GROUP BY hadm_id, ts, label),
h1 AS (SELECT hadm_id, hour, median(CASE WHEN label = '{K.V['hr']}' THEN v END) AS hr, median(CASE WHEN label = '{K.V['nisbp']}' THEN v END) AS sbp,
         median(CASE WHEN label = '{_ON}' THEN v END) AS dev FROM h0 GROUP BY hadm_id, hour),
hb AS (SELECT hadm_id, min(hour) AS lo, max(hour) AS hi FROM h1 GROUP BY hadm_id),
hs AS (SELECT hadm_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM hb),
h AS (SELECT hs.hadm_id, hs.hour, hr, sbp, dev FROM hs LEFT JOIN h1 ON h1.hadm_id = hs.hadm_id AND h1.hour = hs.hour),
rb AS (SELECT a.hadm_id, a.first_event + INTERVAL 10 HOUR AS s, a.first_event + INTERVAL 12 HOUR AS e,
         CAST(user_id % 9 + 3 AS DOUBLE) / (date_diff('hour', date_trunc('hour', a.first_event + INTERVAL 10 HOUR),
                                              date_trunc('hour', a.first_event + INTERVAL 12 HOUR)) + 1) AS v
       FROM adm a JOIN co ON co.hadm_id = a.hadm_id),
rl AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM rb),
rs AS (SELECT hadm_id, unnest(generate_series(date_trunc('hour', s), date_trunc('hour', e), INTERVAL 1 HOUR)) AS hour, v
       FROM rb, rl WHERE v BETWEEN rl.lo AND rl.hi)"""

register("clinical_panel", rounded_sql("WITH " + PANEL5_SQL + f"""
  SELECT h.hadm_id, h.hour, hr, sbp, CASE WHEN sbp = 0 AND hr > 0 THEN CAST('inf' AS DOUBLE) ELSE hr / nullif(sbp, 0) END AS shock,
         CAST(row_number() OVER (PARTITION BY h.hadm_id ORDER BY h.hour) - 1 AS BIGINT) AS since_icu,
         date_diff('microsecond', co.admittime, h.hour) / 3.6e9 AS since_admit,
         coalesce(last_value(dev IGNORE NULLS) OVER (PARTITION BY h.hadm_id ORDER BY h.hour
                  ROWS BETWEEN {K.DEVICE_LIMIT_ROWS} PRECEDING AND CURRENT ROW), 0) = 1 AS nippv, coalesce(rs.v, 0.0) AS red_cells
  FROM h JOIN co USING (hadm_id) LEFT JOIN rs ON rs.hadm_id = h.hadm_id AND rs.hour = h.hour""",
    ["hr", "sbp", "shock", "since_admit", "red_cells"]))(_panel)


# ---------------------------------------------------------------- P6-P8 on the panel of the sessions
_SOURCES = {"Total Bilirubin": "click / 40", "INR": "view / 200", "Creatinine (serum)": "purchase / 100", "PAR": "coalesce(signup, 0.0) / 15",
            "SpO2 FiO2 Ratio": "error"}


def _scored_panel(spark, d):
    p = panel(spark, d).withColumn("hadm_id", F.col("user_id").cast("string"))
    p = p.select("hadm_id", "session_no", "hour", *[F.expr(e).alias(c) for c, e in _SOURCES.items()],
                 (F.floor("click") % 5).cast("double").alias("GCS - Eye Opening"))
    stays_ = p.groupBy(*P.ID).agg(F.max("hour").alias("last"))
    death = F.when(F.col("session_no") % 3 == 0, F.col("last") + F.expr("INTERVAL '5' HOUR")).alias("deathtime")
    return P.add_scores(P.add_outcome(p, stays_.select(*P.ID, death)))


_CUTS = {n: (op, cuts) for n, _, op, cuts in K.SCORES}
_WIN = "PARTITION BY user_id, session_no ORDER BY hour"
_ff = lambda e: f"last_value({e} IGNORE NULLS) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
P7_SQL = PANEL_SQL + f""",
g AS (SELECT *, CAST(CAST(floor(click) AS BIGINT) % 5 AS DOUBLE) AS eye FROM panel),
f AS (SELECT *, {_ff('click / 40')} AS bili, {_ff('view / 200')} AS inr, coalesce({_ff('eye')}, max(eye) OVER (), 0.0) AS gcs FROM g),
b AS (SELECT user_id, session_no, hour, {_score_case('bili', *_CUTS['SOFA Hepatic'])} AS hep, {_score_case('inr', *_CUTS['SOFA Hematologic'])} AS hem,
        {_score_case('gcs', *_CUTS['SOFA Neurological'])} AS neu, max(hour) OVER (PARTITION BY user_id, session_no) AS last FROM f)"""

register("clinical_scores", "WITH " + P7_SQL + f"""
  SELECT CAST(user_id AS VARCHAR) AS hadm_id, session_no, hour, hep, hem, neu,
         max(hep) OVER ({_WIN} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS hep_max,
         max(neu) OVER ({_WIN} ROWS BETWEEN 23 PRECEDING AND 23 FOLLOWING) AS neu_ahead,
         session_no % 3 = 0 AND (last + INTERVAL 5 HOUR) - hour <= INTERVAL 24 HOUR AS dies
  FROM b""")(lambda spark, d: _scored_panel(spark, d).select(
        "hadm_id", "session_no", "hour", F.col("SOFA Hepatic").alias("hep"), F.col("SOFA Hematologic").alias("hem"),
        F.col("SOFA Neurological").alias("neu"), F.col("SOFA Hepatic Rolling Max 24h").alias("hep_max"),
        F.col("SOFA Neurological Future Max 24h").alias("neu_ahead"), F.col(f"`{P.LABEL}`").alias("dies")))


def _export(spark, d):
    """Which columns of the panel are kept (at most 95 % NULL), with their values."""
    p = P.cut(_scored_panel(spark, d))
    static = p.select(*P.ID).distinct().withColumn("age", F.lit(1.0))
    out = P.export(static, p)["x_dynamic"]
    names = [c for c in out.columns if c in (*_SOURCES, "GCS - Eye Opening")]
    long = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in names])).alias("s"))
    return long.select("s.*").groupBy("column").agg(F.count("v").alias("n"))


_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({e}) AS n, count(*) AS rows FROM panel"
                             for c, e in {**_SOURCES, "GCS - Eye Opening": "click"}.items())
register("clinical_export", "WITH " + PANEL_SQL + f"""
  SELECT "column", n FROM ({_COUNTS}) AS u WHERE 1 - n / rows <= 0.95""")(_export)


# ---------------------------------------------------------------- P9
def _prepared(spark, d):
    """The packed labels of a prepared bundle, unpacked: every step with its split."""
    from stayline.operators import prep
    x = labelled_panel(spark, d).withColumn("hadm_id", F.col("user_id").cast("string"))
    x = P.cut(x.select("hadm_id", "session_no", "hour", F.col("label").alias(P.LABEL), "click", "view",
                       F.lit(1).alias("SOFA Renal Future Max 24h")))
    bundle = {"y": x.select(*P.ID, "hour", F.col(f"`{P.LABEL}`")), "x_dynamic": x.select(*P.ID, "hour", "click", "view"),
              "y_aux": x.select(*P.ID, "hour", F.col("`SOFA Renal Future Max 24h`")),
              "x_static": x.select(*P.ID).distinct().withColumn("age", F.length("hadm_id").cast("double"))}
    packed = P.prepare(bundle, n_quantiles=100, seed=7)
    both = prep.unpack_sequences(packed["y"], [*P.ID, "split"], ["label"], arr="y")
    mask = prep.unpack_sequences(packed["x_mask"], P.ID, ["click_seen", "view_seen"], arr="x_mask")
    return both.join(mask, [*P.ID, "step"])


register("clinical_prepared", "WITH " + LABELLED_SQL + f""",
  s AS (SELECT CAST(user_id AS VARCHAR) AS hadm_id, session_no, bool_or(label) AS pos FROM lp GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY {_md5(['hadm_id', 'session_no'], 7)}, hadm_id, session_no) - 1 AS rk,
               count(*) OVER (PARTITION BY pos) AS n FROM s),
  k AS (SELECT *, floor(n * 0.5 + 0.5) AS ntr FROM r),
  k2 AS (SELECT *, floor((n - ntr) * 0.5 + 0.5) AS nte FROM k)
  SELECT k2.hadm_id, k2.session_no, CASE WHEN rk < ntr THEN 'Train' WHEN rk < ntr + nte THEN 'Test' ELSE 'Val' END AS split,
         CAST(row_number() OVER (PARTITION BY lp.user_id, lp.session_no ORDER BY hour) - 1 AS BIGINT) AS step,
         CAST(label AS DOUBLE) AS label, CAST(click IS NOT NULL AS DOUBLE) AS click_seen, CAST(view IS NOT NULL AS DOUBLE) AS view_seen
  FROM lp JOIN k2 ON CAST(lp.user_id AS VARCHAR) = k2.hadm_id AND lp.session_no = k2.session_no""")(_prepared)


# ---------------------------------------------------------------- P10 / P11
def _evaluated(spark, d):
    s = event_scores(spark, d).withColumn("split", F.when(F.col("event_id") % 4 == 0, "Test").otherwise("Train"))
    out = P.evaluate_scored(s, "y", "s")
    a = out["assess"].select(F.lit("assess").alias("part"), F.col("auroc").alias("a"), F.col("average_precision").alias("b"),
                             F.col("n_scores").cast("double").alias("n"))
    c = out["calibration"].select(F.lit("calibration").alias("part"), F.col("bin_left").alias("a"), F.col("rate").alias("b"),
                                  F.col("n").cast("double").alias("n"))
    return finish(a.unionByName(c))


_EDGES = ", ".join(f"({i}, CAST('{i * (1.0 / 10)!r}' AS DOUBLE), CAST('{(i + 1) * (1.0 / 10)!r}' AS DOUBLE))" for i in range(10))
register("clinical_evaluation", rounded_sql("WITH " + EV_SQL.replace("FROM events WHERE value IS NOT NULL", "FROM events WHERE value IS NOT NULL AND event_id % 4 = 0") + f""",
  e(i, lo, hi) AS (VALUES {_EDGES})
  SELECT 'assess' AS part, sum(pos * ((N - cn) + neg / 2.0)) / (max(P) * max(N)) AS a, sum(pos / P * (cp / (cp + cn))) AS b,
         CAST(count(*) AS DOUBLE) AS n FROM c, t
  UNION ALL SELECT 'calibration', lo, avg(CAST(y AS DOUBLE)), CAST(count(*) AS DOUBLE) FROM x JOIN e ON s > lo AND s <= hi GROUP BY lo""",
    ["a", "b", "n"]))(_evaluated)

N_TRACED = 10


def _explained(spark, d):
    out = P.explain_scored(scored(spark, d), keys=["user_id", "session_no"], n=N_TRACED, seed=3,
                           concepts=[("c_true", "c_pred", "relevance")], variables=[("obs", "rec", "mask")])
    x = out["explanation"].join(out["reconstruction"].select("user_id", "session_no", "step", "observed", "reconstructed"),
                                ["user_id", "session_no", "step"])
    return finish(x.select("user_id", "session_no", "step", "y_true", "y_pred", "concept_true", "contribution", "observed", "reconstructed"))


register("clinical_explained", rounded_sql("WITH " + SCORED_SQL + f""",
  test AS (SELECT * FROM scored WHERE split = 'Test'),
  top AS (SELECT user_id, session_no FROM (SELECT user_id, session_no, max(y) AS y FROM test GROUP BY ALL)
          WHERE y = 1 ORDER BY {_md5(['user_id', 'session_no'], 3)}, user_id, session_no LIMIT {N_TRACED})""" + """
  SELECT s.user_id, s.session_no, s.step, CAST(s.y AS DOUBLE) AS y_true, s.y_proba AS y_pred, s.c_true AS concept_true,
         s.c_pred * s.relevance AS contribution, s.obs AS observed, s.rec AS reconstructed
  FROM test s JOIN top USING (user_id, session_no)""",
    ["y_true", "y_pred", "concept_true", "contribution", "observed", "reconstructed"]))(_explained)
