"""Clinical compositions P1-P11 on hospital-shaped tables (FIXTURES.md 1).

Each step is a ``DataFrame -> DataFrame`` chain of ``stayline.operators``; the
only driver-side values are fixed constants, report-sized tables and the
fitted scaler knots.  ``run_extraction`` writes the four outputs and
``run_preparation`` the split, scaled and packed tables; long chains cut their
lineage with a reliable checkpoint into the shared checkpoint folder.

Tables (dict name -> DataFrame): transfers, patients, admissions,
diagnoses_icd, d_icd_diagnoses, d_items, chartevents, inputevents,
outputevents, label_map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.expr import col as Q_

from stayline.functions import constants as K
from stayline.functions import expr as X
from stayline.sources.stages import Memory, Stages, source_digest
from stayline.sources.tables import (column_type_profile, load_bundle, load_label_map, load_tables, save_bundle,
                                     save_report)
from stayline.operators import (codes as C, evaluate as E, filters, grid, joins as J, prep, quality as Q,
                                report, stays as S, windows as W)

ID = ["hadm_id", "session_no"]          # stay key
DEATH = "Death w/in 24h of ICU disch"
LABEL = f"Death w/in {K.HORIZON_HOURS}h"


# ---------------------------------------------------------------- P1
def build_cohort(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """First contiguous ICU stay per subject with demographics, admission
    categories, comorbidity flags, capped end and outcome flag.  The second table
    has every admission with a diagnosis and its comorbidity groups as bits."""
    tr = t["transfers"].where(filters.where_matches("careunit", K.UNIT_PATTERN)) \
        .select("subject_id", "hadm_id", "careunit", "intime", "outtime")
    tr = S.sessionize(tr, "hadm_id", "intime", "outtime", K.GAP_TOL_HOURS)
    tr = tr.withColumn("careunit", X.regex_last_paren("careunit"))
    co = S.rollup_stays(tr, ["subject_id", "hadm_id", "session_no"], "intime", "outtime", "careunit", K.CARE_UNITS)
    co = co.where(S.length_between("intime", "outtime", K.MIN_ICU_LOS_HOURS, K.MAX_ICU_LOS_HOURS))
    co = S.first_per_key(co, "subject_id", ["intime"], ["hadm_id", "session_no"])

    pat = t["patients"].select("subject_id", (X.try_num("anchor_year") - X.try_num("anchor_age")).alias("birthyear"),
                               X.value_map("gender", K.SEX_MAP).alias("gender"))
    co = co.join(pat, "subject_id", "left").withColumn("age", F.year("intime").cast("double") - F.col("birthyear"))
    co = co.drop("birthyear").where(X.true_or_false(F.col("age") >= K.MIN_AGE))

    adm = t["admissions"].select(
        "hadm_id", "admittime", "dischtime", "deathtime",
        F.coalesce("admission_type", F.lit("UNKNOWN")).alias("Admission type"),
        F.coalesce("admission_location", F.lit("UNKNOWN")).alias("Admission location"),
        F.coalesce("discharge_location", F.lit("UNKNOWN")).alias("discharge_location"),
        F.coalesce("insurance", F.lit("UNKNOWN")).alias("Insurance"),
        F.coalesce("ethnicity", F.lit("UNKNOWN")).alias("Ethnicity"),
        F.col("edregtime").isNotNull().alias("ED admit"))
    co = co.join(adm, "hadm_id", "left")

    diag = t["diagnoses_icd"].drop("seq_num").join(t["d_icd_diagnoses"], ["icd_code", "icd_version"], "left")
    diag = diag.withColumn("icd_code", F.trim("icd_code"))
    rules = C.code_rules(t["transfers"].sparkSession)
    groups = C.group_names()
    dx, words = C.group_words(diag, "icd_code", "icd_version", rules, ["subject_id", "hadm_id"], groups, keep_unmatched=True)
    dx = cut(dx)  # for the flags and for the prior history
    # admissions without a diagnosis go
    co = co.join(dx.groupBy("hadm_id").agg(*[F.bit_or(w).alias(w) for w in words]), "hadm_id")
    co = co.withColumns({f"(Elixhauser) {g}": J.flag_of(words, i) for i, g in enumerate(groups)}).drop(*words)

    co = co.withColumn("outtime", S.cap_end("outtime", "deathtime", "dischtime"))
    co = co.where(S.length_between("intime", "outtime", K.MIN_ICU_LOS_HOURS))
    co = co.withColumn(DEATH, S.outcome_within("deathtime", "outtime", 24))
    co = co.withColumn("LOS (h)", X.hours_between("outtime", "intime"))
    co = co.where(X.true_or_false(F.col("LOS (h)") >= K.FINAL_MIN_LOS_HOURS))
    return co, dx


# ---------------------------------------------------------------- P2
def add_body_size(t: dict[str, DataFrame], cohort: DataFrame) -> DataFrame:
    """Height (median per subject, metres) and weight (median per
    admission, kg), plausibility cuts, BMI, category consolidation."""
    items = t["d_items"].select("itemid", F.when(F.col("itemid").isin(K.HEIGHT_ITEMS), F.lit("Height"))
                                .when(F.col("itemid").isin(K.WEIGHT_ITEMS), F.lit("Weight")).alias("type"))
    items = items.where(F.col("type").isNotNull())
    # the items, a handful, go to the events: shuffled by item, all events would be in as many tasks
    ce = t["chartevents"].where(filters.is_in("itemid", [*K.HEIGHT_ITEMS, *K.WEIGHT_ITEMS]))
    ce = filters.keep_keys(ce, cohort.select("subject_id"), "subject_id").join(J.counted_lookup(items), "itemid")
    ce = ce.withColumn("v", X.try_num("valuenum")).where(F.col("v").isNotNull())
    ce = ce.withColumn("v", F.when(X.true_or_false(F.col("valueuom").isin("Inch", "cm")),
                                   X.height_to_m("v", "valueuom")).otherwise(F.col("v")))
    ce = cut(ce.select("subject_id", "hadm_id", "type", "v"))  # read for either median
    h = Q.group_median(ce.where(F.col("type") == "Height"), "subject_id", "v", "Height (m)")
    w = Q.group_median(ce.where(F.col("type") == "Weight"), "hadm_id", "v", "Weight (kg)")
    h = h.where(F.col("Height (m)") > K.MIN_HEIGHT_M)
    w = w.where(F.col("Weight (kg)") > K.MIN_WEIGHT_KG)
    co = cohort.join(h, "subject_id", "left").join(w, "hadm_id", "left")
    co = co.withColumn("BMI", F.col("Weight (kg)") / (F.col("Height (m)") * F.col("Height (m)")))
    return co.withColumns({
        "Admission type": X.consolidate("Admission type", K.ADMISSION_TYPE_MERGE),
        "Admission location": X.keep_or_other("Admission location", K.ADMISSION_LOCATION_KEEP),
        "discharge_location": X.consolidate("discharge_location", K.DISCHARGE_LOCATION_MERGE),
        "Ethnicity": X.consolidate("Ethnicity", K.ETHNICITY_MERGE),
    })


def cohort_report(cohort: DataFrame) -> DataFrame:
    """AG17 report of the cohort by outcome (statistics; p on the small result)."""
    numeric = ["age", "Height (m)", "Weight (kg)", "BMI", "LOS (h)"]
    binary = [*K.CARE_UNITS, "ED admit"] + [c for c in cohort.columns if c.startswith("(Elixhauser)")]
    categorical = ["Admission type", "Admission location", "discharge_location", "Insurance", "Ethnicity", "gender"]
    return report.with_p_values(report.cohort_comparison(cohort, DEATH, numeric,
                                                         [b for b in binary if b in cohort.columns],
                                                         [c for c in categorical if c in cohort.columns]))


def body_size_histograms(cohort: DataFrame, bins: int = 10) -> DataFrame:
    """AG14 on height, weight and BMI, long form."""
    parts = [Q.histogram(cohort, c, bins).withColumn("variable", F.lit(c))
             for c in ("Height (m)", "Weight (kg)", "BMI")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prior_report(static: DataFrame, cohort: DataFrame) -> DataFrame:
    """AG17 on the prior-history flags by outcome."""
    flags = [c for c in static.columns if c.startswith(K.PRIOR_PREFIX) and c != K.PRIOR_SCORE]
    x = static.select(*ID, *[Q_(c) for c in flags]).join(cohort.select(*ID, Q_(DEATH)), ID)
    # names with brackets and commas are numbered for the aggregate
    short = {f"f{i}": c for i, c in enumerate(flags)}
    x = x.select(Q_(DEATH).alias("y"), *[Q_(c).alias(s) for s, c in short.items()])
    out = report.with_p_values(report.cohort_comparison(x, "y", (), list(short)))
    return out.withColumn("variable", X.value_map("variable", short))


def score_report(panel: DataFrame, n_bins: int = 10) -> dict[str, DataFrame]:
    """AG15 + E13 of every organ score: outcome by quantile bin of its raw input,
    and AUROC / average precision of the 24 h horizon score."""
    out = {}
    y = panel.withColumn("_y", F.col(f"`{LABEL}`").cast("int"))
    for name, src, *_ in K.SCORES:
        binned = Q.quantile_bins(y.select(Q_(src).alias("v"), "_y"), "v", n_bins)
        out[f"bins {name}"] = Q.outcome_by_bin(binned, "_y")
    future = {f"{name} Future Max {K.HORIZON_HOURS}h": name for name, *_ in K.SCORES}
    total = E.assess_many(y, "_y", list(future))  # all six from one range sort
    total = total.select("auroc", "average_precision", "n_scores", X.value_map("score_name", future).alias("score"))
    return {**out, "scores": total}


# ---------------------------------------------------------------- P3
def static_features(t: dict[str, DataFrame], cohort: DataFrame, dx: DataFrame) -> DataFrame:
    """Static table (one row per stay): unit flags, age, one-hot
    categories, median-filled body size, prior comorbidity flags and score.
    ``dx``: the groups of every admission as bits (``build_cohort``)."""
    st = cohort.select(*ID, "subject_id", *K.CARE_UNITS, "age", "ED admit", "Height (m)", "Weight (kg)",
                       *K.STATIC_DOMAINS.keys())
    for c, dom in K.STATIC_DOMAINS.items():
        st = grid.one_hot(st, c, dom, prefix=c)
    med = Q.column_medians(st, ["Height (m)", "Weight (kg)"])
    st = Q.fill_with_stats(st, ["Height (m)", "Weight (kg)"], med)
    st = st.withColumn("BMI", F.col("Weight (kg)") / (F.col("Height (m)") * F.col("Height (m)")))

    groups = C.group_names()
    disch = t["admissions"].select("hadm_id", "dischtime")
    words = [c for c in dx.columns if c not in ("subject_id", "hadm_id")]
    facts = dx.where(F.coalesce(*words).isNotNull()).join(disch, "hadm_id")
    probes = cohort.select(*ID, "subject_id").join(disch, "hadm_id")
    prior = J.prior_words(probes, facts, "subject_id", "dischtime", "dischtime", words, words)
    prior = prior.withColumns({f"{K.PRIOR_PREFIX}{g}": J.flag_of(words, i) for i, g in enumerate(groups)}).drop(*words)
    prior = C.prior_score(prior, C.moore_weights(), prefix=K.PRIOR_PREFIX)
    return st.join(prior.drop("subject_id", "dischtime"), ID, "left").drop("subject_id")


# ---------------------------------------------------------------- P4
def clean_measurements(t: dict[str, DataFrame], cohort: DataFrame, label_map: DataFrame) -> DataFrame:
    """Labelled chart events inside the stay window, units and devices
    fixed, per-label 1 %/99 % outliers dropped (device and code labels exempt)."""
    ce = filters.keep_keys(t["chartevents"], cohort.select("hadm_id"), "hadm_id")
    ce = ce.join(label_map, "itemid").withColumn("valuenum", X.try_num("valuenum"))
    ce = filters.update_when(ce, [
        (F.col("label") == "Temperature Fahrenheit", "valuenum", X.fahrenheit_to_celsius("valuenum")),
        (F.col("label") == "Temperature Fahrenheit", "label", "Temperature"),
        (F.col("label") == "Temperature Celsius", "label", "Temperature"),
    ])
    ce = filters.drop_literal(ce, "label", K.DEVICE_LABEL, "value", "None")
    dev = X.value_map("value", K.DEVICE_MAP)
    ce = ce.withColumn("valuenum", F.when(F.col("label") == K.DEVICE_LABEL, F.lit(1.0)).otherwise(F.col("valuenum")))
    ce = ce.withColumn("label", F.when(F.col("label") == K.DEVICE_LABEL, dev).otherwise(F.col("label")))
    ce = ce.where(F.col("label").isNotNull())  # unmapped device text (option noted in SURVEY 7.5)
    is_code = F.col("label") == K.CODE_STATUS_LABEL
    full = is_code & (F.col("value") == K.FULL_CODE)
    ce = ce.withColumn("valuenum", F.when(is_code, F.lit(1.0)).otherwise(F.col("valuenum")))
    ce = ce.withColumn("label", F.when(full, F.lit(K.FULL_CODE)).when(is_code, F.lit(K.DNR)).otherwise(F.col("label")))
    stays_ = cohort.select("hadm_id", *[c for c in ID if c != "hadm_id"], "intime", "outtime")
    # the limits and the rows they apply to read the same written rows
    ce = cut(J.events_in_stay(ce.select("hadm_id", "charttime", "valuenum", "label"), stays_, "hadm_id", "charttime"))
    exempt_rows = F.col("label").startswith(K.DEVICE_PREFIX) | F.col("label").isin(K.DNR, K.FULL_CODE)
    lim = Q.quantile_limits(ce.where(~exempt_rows), "label", "valuenum", K.OUTLIER_LO, K.OUTLIER_HI)
    x = ce.join(lim, "label", "left")
    outside = X.true_or_false((F.col("valuenum") < F.col("lo_limit")) | (F.col("valuenum") > F.col("hi_limit")))
    return x.where(exempt_rows | ~outside).drop("lo_limit", "hi_limit")


# ---------------------------------------------------------------- P5
def hourly_panel(t: dict[str, DataFrame], cohort: DataFrame, ce: DataFrame, labels: list[str]) -> DataFrame:
    """P5: contiguous hourly panel with derived ratios, imputed oxygen
    fraction, device / code-status flags, spread inputs and urine output."""
    V = K.V
    # R3, then a reliable lineage cut ("cache after R3"): every later branch
    # (statistics, bounds, joins) reads the written grid instead of the events
    p = cut(grid.hourly_grid(ce, ID, "charttime", "label", "valuenum", labels))
    for lab in V.values():
        if lab not in p.columns:
            p = p.withColumn(lab, F.lit(None).cast("double"))
    bounds = p.groupBy(*ID).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))
    p = p.withColumn("Hours since ICU admit", W.hours_since_start(ID))
    p = p.join(cohort.select(*ID, "admittime"), ID, "left") \
         .withColumn("Hours since admit", X.hours_between("hour", "admittime")).drop("admittime")
    p = p.withColumn("SBP", F.coalesce(V["asbp"], V["nisbp"])).withColumn("DBP", F.coalesce(V["adbp"], V["nidbp"]))
    p = p.withColumn("Shock Index", X.safe_div(V["hr"], "SBP"))
    p = p.withColumn("BUN Cr Ratio", X.safe_div(V["bun"], V["cr"]))
    p = p.withColumn("MAP", F.lit(2.0 / 3.0) * F.col("DBP") + F.lit(1.0 / 3.0) * F.col("SBP"))
    par_in = [V["cvp"], V["hr"], "MAP"]
    meds = Q.column_medians(p.select(*par_in), par_in).select(*[Q_(c).alias(f"_m{i}") for i, c in enumerate(par_in)])
    p = p.crossJoin(F.broadcast(meds))  # one row of whole-panel medians
    filled = [F.coalesce(W.ffill_col(c, ID), F.col(f"_m{i}")) for i, c in enumerate(par_in)]
    p = p.withColumn("PAR", X.safe_div(filled[1] * filled[0], filled[2])).drop(*[f"_m{i}" for i in range(3)])
    p = p.withColumn("PaO2 Imputed", F.coalesce(W.ffill_col(V["pao2"], ID), F.lit(float(K.PAO2_DEFAULT))))
    fi = F.coalesce(W.ffill_col(V["fio2"], ID), F.col(V["flow"]) * K.FIO2_PER_LPM + K.FIO2_ROOM_AIR)
    p = p.withColumn("FiO2 Imputed", X.clip_upper(fi, K.FIO2_CAP))
    p = p.withColumn("FiO2 Imputed", F.coalesce(W.ffill_col("FiO2 Imputed", ID), F.lit(float(K.FIO2_ROOM_AIR))) / 100)
    p = p.withColumn("PaO2 FiO2 Ratio", X.safe_div("PaO2 Imputed", "FiO2 Imputed"))
    p = p.withColumn("SpO2 FiO2 Ratio", X.safe_div(V["spo2"], "FiO2 Imputed"))
    dev_cols = [c for c in labels if c.startswith(K.DEVICE_PREFIX)]
    p = p.withColumns({c: X.true_or_false(F.coalesce(W.ffill_col(c, ID, limit=K.DEVICE_LIMIT_ROWS), F.lit(0.0)) == 1)
                       for c in dev_cols})
    if K.DNR in p.columns and K.FULL_CODE in p.columns:
        p = W.latest_state(p, ID, K.DNR, K.FULL_CODE)

    # inputs spread over hours
    ie = t["inputevents"].join(t["d_items"].select("itemid", "label"), "itemid", "left")
    ie = ie.join(cohort.select("hadm_id", *[c for c in ID if c != "hadm_id"]), "hadm_id")
    ie = ie.withColumn("hourly", grid.hourly_amount("starttime", "endtime", "totalamount"))
    slices = {lab: F.col("label") == lab for lab in K.INPUT_LABELS}
    slices.update({name: F.col("ordercategoryname") == cat for name, cat in K.INPUT_CATEGORIES.items()})
    # a row stands once under every input name it belongs to; then one trim per
    # name, one spread, one conditional sum and one join for all of them
    names = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in slices.items()]), lambda n: n.isNotNull())
    ie = ie.select(*ID, "starttime", "endtime", "hourly", F.explode(names).alias("input"))
    ie = Q.trim_outliers(ie, "input", "hourly", K.OUTLIER_LO, K.OUTLIER_HI, keep_null=False)
    spread = grid.spread_intervals(ie, [*ID, "input"], "starttime", "endtime", "hourly", "amount")
    spread = spread.groupBy(*ID, "hour").agg(*[F.sum(F.when(F.col("input") == n, F.col("amount"))).alias(n)
                                              for n in slices])
    p = grid.attach_hourly(p, spread, ID, list(slices), default=0.0)

    # urine output: limits over all patients, then the cohort, then nearest hour
    oe = t["outputevents"].where(F.col("itemid").isin(K.URINE_ITEMS))
    oe = Q.trim_outliers(oe, None, "value", K.URINE_LO, K.URINE_HI, keep_null=False)
    oe = oe.join(cohort.select("hadm_id", *[c for c in ID if c != "hadm_id"]), "hadm_id")
    m = grid.asof_to_grid(oe, bounds, ID, "charttime")
    urine = m.groupBy(*ID, "hour").agg(F.sum("value").alias("Urine Output"))
    p = grid.attach_hourly(p, urine, ID, ["Urine Output"])
    return p.withColumn("Urine Output", W.rolling_mean("Urine Output", ID, 24, default=0.0))


# ---------------------------------------------------------------- P6 / P7
def add_outcome(panel: DataFrame, cohort: DataFrame) -> DataFrame:
    """Death within 24 h of each hour (true also after death)."""
    x = panel.join(cohort.select(*ID, "deathtime"), ID, "left")
    return x.withColumn(LABEL, W.horizon_label("deathtime", "hour", K.HORIZON_HOURS)).drop("deathtime")


def add_scores(panel: DataFrame, mode: str = "reference") -> DataFrame:
    """Six organ scores 0-4 from forward-filled inputs, their rolling max
    and the 24 h horizon max; consciousness total from the GCS columns."""
    gcs = [c for c in panel.columns if "GCS" in c]
    p = panel
    if gcs:
        mx = p.agg(*[F.max(Q_(c)).alias(f"_mx{i}") for i, c in enumerate(gcs)])
        p = p.crossJoin(F.broadcast(mx))  # one row of whole-panel maxima
        tot = None
        for i, c in enumerate(gcs):
            term = F.coalesce(W.ffill_col(c, ID), F.col(f"_mx{i}"), F.lit(0.0))
            tot = term if tot is None else tot + term
        p = p.withColumn("GCS Total", tot).drop(*[f"_mx{i}" for i in range(len(gcs))])
    else:
        p = p.withColumn("GCS Total", F.lit(None).cast("double"))
    h = K.HORIZON_HOURS
    for name, src, op, cuts in K.SCORES:
        base = F.col(src) if name == "SOFA Neurological" else W.ffill_col(src, ID)
        p = p.withColumn(name, X.threshold_score(base, op, cuts))
        p = p.withColumn(f"{name} Rolling Max {h}h", W.rolling_max(name, ID, h))
        p = p.withColumn(f"{name} Future Max {h}h", W.score_horizon(name, ID, h, mode=mode))
    return p


# ---------------------------------------------------------------- P8
def dynamic_columns(panel: DataFrame) -> list[str]:
    """Columns of the panel that are neither keys, label nor horizon scores."""
    aux = [f"{n} Future Max {K.HORIZON_HOURS}h" for n, *_ in K.SCORES]
    return [c for c in panel.columns if c not in (*ID, "hour", LABEL, *aux)]


def export(static: DataFrame, panel: DataFrame, profile: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """The four outputs; dynamic columns more than 95 % NULL dropped.
    ``profile``: their NULL fractions, if taken when the panel was written."""
    h = K.HORIZON_HOURS
    keep = ["age", "ED admit", "BMI"] + [f"{c}, {v}" for c, dom in K.STATIC_DOMAINS.items() for v in dom]
    x_static = static.select(*ID, *[Q_(c) for c in keep if c in static.columns])
    aux = [f"{n} Future Max {h}h" for n, *_ in K.SCORES]
    y = panel.select(*ID, "hour", Q_(LABEL))
    y_aux = panel.select(*ID, "hour", *[Q_(c) for c in aux])
    dyn_cols = dynamic_columns(panel)
    x_dynamic = Q.drop_sparse(panel.select(*ID, "hour", *[Q_(c) for c in dyn_cols]), dyn_cols, 0.95, profile)
    return {"x_static": x_static, "y": y, "y_aux": y_aux, "x_dynamic": x_dynamic}


# ---------------------------------------------------------------- P9
def _stay_rows(y: DataFrame) -> DataFrame:
    """One row per stay: any positive step, steps, positive steps."""
    return y.groupBy(*ID).agg(F.coalesce(F.bool_or(LABEL), F.lit(False)).alias("_pos"), F.count(F.lit(1)).alias("_steps"),
                              F.count_if(Q_(LABEL)).alias("_steps_pos"))


def prepare(bundle: dict[str, DataFrame], n_quantiles: int = 1000, seed: int = 0, stages=None) -> dict[str, DataFrame]:
    """Stratified split, Train-fitted scaling (quantile for numeric,
    min-max for scores), mask and time-since-observed from unfilled data,
    forward fill then zero, packed per stay.  ``stages``: where the intermediate
    tables go (``sources/stages.py``); none: checkpoints."""
    st = stages or Memory()
    y = bundle["y"]
    rows = st.run("stays", lambda: {"stays": _stay_rows(y)}, observe={"stays": lambda df: report.stay_counts()})["stays"]
    ids = st.run("split", lambda: {"ids": prep.stratified_split(rows.select(*ID, "_pos"), ID, "_pos", seed=seed).select(
        *ID, "split")}, after=["stays"], params=seed)["ids"]
    with_split = st.run("with_split", lambda: {n: prep.apply_split(bundle[n], ids, ID) for n in ("x_static", "x_dynamic", "y_aux")},
                        after=["split"])
    out = {}
    for name, df in with_split.items():
        types = dict(df.dtypes)
        score_cols = [c for c in df.columns if "SOFA" in c]
        num = [c for c in df.columns if c not in (*ID, "hour", "split") and c not in score_cols
               and types[c] in ("double", "float", "int", "bigint")]
        bools = [c for c in df.columns if types[c] == "boolean"]
        train = df.where(F.col("split") == "Train")
        if num:
            df = prep.quantile_transform(df, prep.quantile_knots(train, num, n_quantiles))
        if score_cols:
            df = prep.minmax_transform(df, score_cols, prep.minmax_fit(train, score_cols))
        df = df.withColumns({c: Q_(c).cast("double") for c in bools})
        out[name] = df
    dyn = out["x_dynamic"]
    feats = [c for c in dyn.columns if c not in (*ID, "hour", "split")]
    mask = dyn.select(*ID, "hour", "split", *[W.observed_mask(c).cast("double").alias(c) for c in feats])
    delta = dyn.select(*ID, "hour", "split", *[W.time_since_observed(c, ID).alias(c) for c in feats])
    filled = {}
    for name in ("x_dynamic", "y_aux"):
        df = out[name]
        cols = [c for c in df.columns if c not in (*ID, "hour", "split")]
        df = W.ffill(df, cols, ID)
        filled[name] = df.withColumns({c: F.coalesce(Q_(c), F.lit(0.0)) for c in cols})
    static = out["x_static"]
    scols = [c for c in static.columns if c not in (*ID, "split")]
    static = static.withColumns({c: F.coalesce(Q_(c).cast("double"), F.lit(0.0)) for c in scols})
    packed = {}
    for name, df in (("x_dynamic", filled["x_dynamic"]), ("x_mask", mask), ("x_delta", delta),
                     ("y_aux", filled["y_aux"]),
                     ("y", prep.apply_split(y.withColumn(LABEL, F.col(LABEL).cast("double")), ids, ID))):
        cols = [c for c in df.columns if c not in (*ID, "hour", "split")]
        pk = prep.pack_sequences(df, [*ID, "split"], "hour", cols, out=name)
        packed[name] = prep.pad_to_split_max(pk, out=name, longest=prep.longest_by_split(df, ID))
    packed["x_static"] = static.select(*ID, "split", F.array(*[Q_(c) for c in scols]).alias("x_static"))
    return packed


# ---------------------------------------------------------------- P10 / P11
def evaluate_scored(scored: DataFrame, y: str = "y", p: str = "y_proba", split: str = "split") -> dict[str, DataFrame]:
    """P10: flatten valid steps, then ROC / PR points, areas and calibration
    per split (curves for the Test split as in the reference)."""
    test = scored.where(F.col(split) == "Test")
    return {"roc": E.roc_points(test, y, p), "pr": E.pr_points(test, y, p),
            "auroc": E.auroc(test, y, p), "auprc": E.average_precision(test, y, p),
            "calibration": E.calibration_bins(test, y, p), "assess": E.assess(test, y, p)}


def losses(scored: DataFrame, concepts, variables, y: str = "y", p: str = "y_proba", step: str = "step",
           maxsteps: str = "maxsteps", split: str = "split") -> DataFrame:
    """E6-E9 per split: primary, auxiliary and imputation loss and their
    weighted total."""
    a = E.masked_log_loss(scored, y, p, step, maxsteps, [split])
    b = E.masked_mse(scored, list(concepts), step, maxsteps, [split])
    c = E.observed_mse(scored, list(variables), [split])
    x = a.join(b, split).join(c, split)
    return x.withColumn("total", E.total_loss(F.col("log_loss"), F.col("mse"), F.col("observed_mse")))


def evaluate_packed(packed: DataFrame, keys, cols: list[str], actual: str, predicted: str,
                    arr: str = "x") -> dict[str, DataFrame]:
    """P10 from packed arrays (R7): valid steps, then quartiles of the predicted
    value per actual value (AG18)."""
    steps = prep.unpack_sequences(packed, keys, cols, arr)
    return {"steps": steps, "quartiles": E.quartiles_by_actual(steps, actual, predicted)}


def cut(df: DataFrame) -> DataFrame:
    """Reliable lineage cut into the shared checkpoint folder."""
    from stayline.session import cut_lineage
    return cut_lineage(df)


def panel_labels(label_map: DataFrame) -> list[str]:
    """Every column the panel can have: the labels of the (report-sized) label
    map, units merged, with the device and code-status labels."""
    rows = {r["label"] for r in label_map.select("label").distinct().collect()}
    merged = {"Temperature" if x in ("Temperature Fahrenheit", "Temperature Celsius") else x for x in rows}
    merged -= {K.DEVICE_LABEL, K.CODE_STATUS_LABEL}
    return sorted(merged | set(K.DEVICE_MAP.values()) | {K.DNR, K.FULL_CODE})


def run_extraction(t: dict[str, DataFrame], label_map: DataFrame, labels: list[str] | None = None,
                   out_dir: str | None = None, stages=None, buckets: int = 0) -> dict[str, DataFrame]:
    """P1-P8 end to end.  ``labels`` default to everything the label map can give.
    With ``out_dir`` the four outputs are written as Parquet (IO4; ``buckets``:
    bucketed by the stay) and the reports as CSV (IO5).  ``stages``
    (``sources/stages.py``): every stage is written under its digest and a restarted
    run reads what is finished; without, the tables are checkpointed."""
    labels = panel_labels(label_map) if labels is None else labels
    st = stages or Memory()

    def cohort_stage():
        cohort, dx = build_cohort(t)
        return {"cohort": add_body_size(t, cohort), "dx": dx}

    got = st.run("cohort", cohort_stage)
    cohort, dx = got["cohort"], got["dx"]
    static = st.run("static", lambda: {"static": static_features(t, cohort, dx)}, after=["cohort"])["static"]
    ce = st.run("measurements", lambda: {"ce": clean_measurements(t, cohort, label_map)}, after=["cohort"])["ce"]
    hourly = st.run("panel", lambda: {"panel": hourly_panel(t, cohort, ce, labels)}, after=["cohort", "measurements"],
                    params=labels)["panel"]
    # the NULL profile (AG10) is taken while the scored panel is written
    panel = st.run("scores", lambda: {"panel": add_scores(add_outcome(hourly, cohort))}, after=["cohort", "panel"],
                   observe={"panel": lambda df: Q.null_counts(df, dynamic_columns(df))})["panel"]
    profile = Q.observed_profile(st.metrics["scores"]["panel"], dynamic_columns(panel))
    bundle = export(static, panel, profile)
    if out_dir:
        save_bundle(bundle, f"{out_dir}/data", bucket_by=ID, buckets=buckets)
        reports = {"cohort": cohort_report(cohort), "body_size": body_size_histograms(cohort),
                   "prior_history": prior_report(static, cohort), **score_report(panel)}
        for name, df in reports.items():
            save_report(df, f"{out_dir}/reports/{name}")
    return bundle


def run_extraction_from(spark, in_dir: str, label_map_path: str, out_dir: str, buckets: int = 0) -> dict[str, DataFrame]:
    """P1-P8 from files (IO1, IO2), resumable: stages go to ``out_dir/stages`` and
    depend on the source files' names, lengths and times of change."""
    t, label_map = load_tables(spark, in_dir), load_label_map(spark, label_map_path)
    stages = Stages(spark, f"{out_dir}/stages", source_digest(spark, in_dir, label_map_path), ID, buckets)
    return run_extraction(t, label_map, out_dir=out_dir, stages=stages, buckets=buckets)


def explain_scored(scored: DataFrame, keys=ID, step: str = "step", n: int = 20, seed: int = 0,
                   concepts=(), variables=(), y: str = "y", p: str = "y_proba",
                   split: str = "split") -> dict[str, DataFrame]:
    """Explanation traces of ``n`` drawn positive Test stays (seeded
    hash order), reconstruction traces of the same stays, and imputation
    quality per split and variable (rows ordered by the Train missing share)."""
    test = scored.where(F.col(split) == "Test")
    pos = test.groupBy(*keys).agg(F.max(F.col(y).cast("int")).alias("_y"))
    ids = prep.sample_ids(pos, keys, n, seed=seed, where=F.col("_y") == 1)
    out = {"imputation_quality": E.train_order(E.imputation_quality(scored, split, list(variables)), split)}
    if concepts:
        out["explanation"] = E.explanation_trace(test, ids, keys, step, list(concepts), y, p)
    if variables:
        out["reconstruction"] = E.reconstruction_trace(test, ids, keys, step, list(variables))
    return out


def run_preparation(bundle: dict[str, DataFrame], out_dir: str, n_quantiles: int = 1000, seed: int = 0,
                    stages=None, buckets: int = 0) -> dict[str, DataFrame]:
    """P9 + IO6: prepare and write every packed table partitioned by split."""
    packed = prepare(bundle, n_quantiles, seed, stages)
    save_bundle(packed, out_dir, partition_by=["split"], bucket_by=ID, buckets=buckets)
    return packed


def prepare_from(spark, in_dir: str, out_dir: str, n_quantiles: int = 1000, seed: int = 0, buckets: int = 0,
                 resume: bool = False) -> dict[str, DataFrame]:
    """P9 from files: load the extraction's bundle (IO3), prepare and write, and
    report string columns (IO7), cohort size (AG12) and prevalence (AG13), both
    counted while the stays are written.  ``resume``: intermediate tables are
    stages below ``out_dir/stages``."""
    bundle = load_bundle(spark, in_dir)
    st = Stages(spark, f"{out_dir}/stages", source_digest(spark, in_dir), ID, buckets) if resume else Memory()
    packed = run_preparation(bundle, f"{out_dir}/data", n_quantiles, seed, st, buckets)
    counts = st.metrics["stays"]["stays"]
    save_report(report.observed_size(spark, counts), f"{out_dir}/reports/cohort_size")
    save_report(report.observed_prevalence(spark, counts), f"{out_dir}/reports/prevalence")
    strings = column_type_profile(bundle["x_static"].drop("session_no"), ["hadm_id"])
    save_report(strings, f"{out_dir}/reports/string_columns")
    return packed
