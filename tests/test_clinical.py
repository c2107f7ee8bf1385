"""Clinical compositions end to end on tiny synthetic hospital tables, with the
reference's printed diagnostics turned into invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stayline.functions import constants as K
from stayline.plans import clinical as P

T0 = dt.datetime(2150, 1, 1)
LABELS = ["Heart Rate", "Non Invasive Blood Pressure systolic", "Non Invasive Blood Pressure diastolic",
          "Creatinine (serum)", "BUN", "INR", "Total Bilirubin", "O2 saturation pulseoxymetry",
          "Inspired O2 Fraction", "Flow Rate (L/min)", "GCS - Eye Opening", "GCS - Verbal Response",
          "Central Venous Pressure", "Arterial O2 pressure", "O2 Delivery Device: NIPPV", K.DNR, K.FULL_CODE]
ITEMS = {f"9{i:03d}": lab for i, lab in enumerate(LABELS[:-5])}


def _tables(spark):
    rnd = random.Random(11)
    tr, pat, adm, dx, ce, ie, oe = [], [], [], [], [], [], []
    for s in range(8):
        sid, hid = f"s{s}", f"h{s}"
        start = T0 + dt.timedelta(days=s)
        end = start + dt.timedelta(days=9)
        tr.append((sid, hid, "Medical Intensive Care Unit (MICU)", start, start + dt.timedelta(days=4)))
        tr.append((sid, hid, "Surgical ICU (SICU)", start + dt.timedelta(days=4, hours=2), end))
        tr.append((sid, hid, "Medicine", start - dt.timedelta(days=1), start))
        pat.append((sid, "2150", str(40 + s), "M" if s % 2 else "F"))
        death = end + dt.timedelta(hours=10) if s % 3 == 0 else None
        adm.append((sid, hid, start - dt.timedelta(days=1), end + dt.timedelta(days=1), death,
                    "EW EMER.", "EMERGENCY ROOM", "HOME", "Medicare", "WHITE", start - dt.timedelta(hours=3)))
        # an earlier admission of the same subject with a diagnosis
        adm.append((sid, hid + "p", start - dt.timedelta(days=40), start - dt.timedelta(days=35), None,
                    "ELECTIVE", "OTHER", "HOME", "Other", "ASIAN", None))
        dx.append((sid, hid, "1", "I50.1 ", "10"))
        dx.append((sid, hid + "p", "1", "E66.0", "10"))
        for h in range(0, 9 * 24, 3):
            t = start + dt.timedelta(hours=h, minutes=rnd.randint(0, 59))
            for item, lab in ITEMS.items():
                if rnd.random() < 0.6:
                    ce.append((sid, hid, item, t, None, str(round(rnd.uniform(1, 150), 1)), None))
        ce.append((sid, hid, "9999", start + dt.timedelta(hours=5), "CPAP mask ", None, None))
        ce.append((sid, hid, "9998", start + dt.timedelta(hours=6), "DNR / DNI", None, None))
        ce.append((sid, hid, "226730", start + dt.timedelta(hours=1), None, "70", "Inch"))
        ce.append((sid, hid, "224639", start + dt.timedelta(hours=1), None, "80", "kg"))
        ie.append((hid, "7001", start + dt.timedelta(hours=10, minutes=10), start + dt.timedelta(hours=12, minutes=50),
                   9.0, "01-Drips"))
        ie.append((hid, "7002", start + dt.timedelta(hours=20), start + dt.timedelta(hours=22), 300.0,
                   "02-Fluids (Crystalloids)"))
        for h in range(0, 9 * 24, 4):
            oe.append((hid, "226559", start + dt.timedelta(hours=h, minutes=20), float(rnd.randint(10, 400))))
    t = {
        "transfers": spark.createDataFrame(tr, "subject_id string, hadm_id string, careunit string, intime timestamp_ntz, outtime timestamp_ntz"),
        "patients": spark.createDataFrame(pat, "subject_id string, anchor_year string, anchor_age string, gender string"),
        "admissions": spark.createDataFrame(adm, "subject_id string, hadm_id string, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, admission_type string, admission_location string, discharge_location string, insurance string, ethnicity string, edregtime timestamp_ntz"),
        "diagnoses_icd": spark.createDataFrame(dx, "subject_id string, hadm_id string, seq_num string, icd_code string, icd_version string"),
        "d_icd_diagnoses": spark.createDataFrame([("I50.1 ", "10", "heart failure")], "icd_code string, icd_version string, long_title string"),
        "d_items": spark.createDataFrame([(k, v, None) for k, v in ITEMS.items()] +
                                         [("7001", "Packed Red Blood Cells", None), ("7002", "Saline", None),
                                          ("226730", "Height", None), ("224639", "Weight", None)],
                                         "itemid string, label string, type string"),
        "chartevents": spark.createDataFrame(ce, "subject_id string, hadm_id string, itemid string, charttime timestamp_ntz, value string, valuenum string, valueuom string"),
        "inputevents": spark.createDataFrame(ie, "hadm_id string, itemid string, starttime timestamp_ntz, endtime timestamp_ntz, totalamount double, ordercategoryname string"),
        "outputevents": spark.createDataFrame(oe, "hadm_id string, itemid string, charttime timestamp_ntz, value double"),
    }
    lm = spark.createDataFrame([(k, v) for k, v in ITEMS.items()] + [("9999", K.DEVICE_LABEL), ("9998", K.CODE_STATUS_LABEL)],
                               "itemid string, label string")
    return t, lm


@pytest.fixture(scope="module")
def extracted(spark):
    t, lm = _tables(spark)
    cohort, dx_long = P.build_cohort(t)
    cohort = P.cut(P.add_body_size(t, cohort))
    return t, lm, cohort, dx_long


def test_cohort_one_stay_per_subject(extracted):
    _, _, cohort, _ = extracted
    rows = cohort.collect()
    assert len(rows) == 8
    assert len({r["subject_id"] for r in rows}) == 8
    r0 = [r for r in rows if r["subject_id"] == "s0"][0]
    assert r0["MICU"] and r0["SICU"] and not r0["CCU"]
    assert r0["(Elixhauser) Congestive heart failure"] is True
    assert abs(r0["Height (m)"] - 1.778) < 1e-9 and r0["Weight (kg)"] == 80.0
    assert r0[P.DEATH] is True
    assert r0["LOS (h)"] >= K.FINAL_MIN_LOS_HOURS


def test_static_prior_history(spark, extracted):
    t, _, cohort, dx_long = extracted
    st = P.static_features(t, cohort, dx_long).collect()
    assert len(st) == 8
    assert all(r["(Prior Elixhauser) Obesity"] for r in st)
    assert all(r[K.PRIOR_SCORE] == -5 for r in st)


def test_panel_scores_export_prepare(spark, extracted):
    t, lm, cohort, dx_long = extracted
    ce = P.clean_measurements(t, cohort, lm)
    labels = sorted(set(LABELS))
    panel = P.hourly_panel(t, cohort, ce, labels)
    panel = P.cut(P.add_scores(P.add_outcome(panel, cohort)))
    pr = panel.select(*P.ID, "hour").collect()
    assert len(pr) == len({(r["hadm_id"], r["session_no"], r["hour"]) for r in pr})
    span = panel.groupBy(*P.ID).agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    for r in span.collect():
        assert r["n"] == int((r["b"] - r["a"]).total_seconds() // 3600) + 1
    for name, *_ in K.SCORES:
        bad = panel.where((F.col(name) < 0) | (F.col(name) > 4) |
                          (F.col(f"{name} Rolling Max 24h") < F.col(name))).count()
        assert bad == 0
    assert panel.where(F.col("Packed Red Blood Cells") > 0).count() >= 1
    bundle = P.export(P.static_features(t, cohort, dx_long), panel)
    assert set(bundle) == {"x_static", "y", "y_aux", "x_dynamic"}
    packed = P.prepare(bundle, n_quantiles=50)
    ys = packed["y"].select(*P.ID, "split", "maxsteps").collect()
    assert len(ys) == 8 and {r["split"] for r in ys} <= {"Train", "Test", "Val"}
    xd = packed["x_dynamic"].first()
    assert len(xd["x_dynamic"]) >= xd["maxsteps"]


def test_extraction_writes_outputs_and_reports(spark, tmp_path_factory):
    """IO4 / IO5: what is written is read back and held against rows worked out
    by hand from the synthetic tables."""
    t, lm = _tables(spark)
    out = str(tmp_path_factory.mktemp("extraction"))
    P.run_extraction(t, lm, out_dir=out)
    data = {n: spark.read.parquet(f"{out}/data/{n}") for n in ("x_static", "y", "y_aux", "x_dynamic")}
    y = data["y"].where(F.col("hadm_id") == "h0").orderBy("hour").collect()
    # subject 0 dies 10 h after leaving at T0 + 9 d; hours from 24 h before death are positive
    death = T0 + dt.timedelta(days=9, hours=10)
    assert all(r[P.LABEL] == (r["hour"] >= death - dt.timedelta(hours=24)) for r in y) and any(r[P.LABEL] for r in y)
    assert data["y"].where((F.col("hadm_id") == "h1") & F.col(f"`{P.LABEL}`")).isEmpty()
    dyn = {r["hour"]: r for r in data["x_dynamic"].where(F.col("hadm_id") == "h0").collect()}
    # 9 units from 10:10 to 12:50: three in each of three hours, none elsewhere
    assert [dyn[T0 + dt.timedelta(hours=h)]["Packed Red Blood Cells"] for h in (9, 10, 11, 12, 13)] == [0, 3, 3, 3, 0]
    # the mask device of hour 5 holds for its limit of hours, the code status from hour 6 on
    assert dyn[T0 + dt.timedelta(hours=5)]["O2 Delivery Device: NIPPV"] and not dyn[T0 + dt.timedelta(hours=4)][
        "O2 Delivery Device: NIPPV"]
    st = {r["hadm_id"]: r for r in data["x_static"].collect()}
    assert st["h0"]["age"] == 40 and st["h0"]["gender, Female"] and st["h1"]["gender, Male"]
    assert st["h0"]["BMI"] == pytest.approx(80 / 1.778 ** 2)
    report = spark.read.option("header", True).csv(f"{out}/reports/cohort")
    kinds = {r["variable"]: r["kind"] for r in report.collect()}
    assert kinds["age"] == "numeric" and kinds["ED admit"] == "binary" and kinds["Insurance"] == "categorical"
    for name in ("body_size", "prior_history", "scores", "bins SOFA Renal"):
        assert spark.read.option("header", True).csv(f"{out}/reports/{name}").count() > 0

    P.prepare_from(spark, f"{out}/data", f"{out}/prepared", n_quantiles=20)
    size = spark.read.option("header", True).csv(f"{out}/prepared/reports/cohort_size").first()
    assert size["n_stays"] == "8" and size["n_positive"] == "3"  # subjects 0, 3 and 6 die
    packed = spark.read.parquet(f"{out}/prepared/data/y")
    steps = {r["hadm_id"]: r["n"] for r in data["y"].groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["hadm_id"]: r["maxsteps"] for r in packed.collect()} == steps
    assert {r["split"] for r in packed.select("split").distinct().collect()} == {"Train", "Test", "Val"}


def test_losses_and_quartiles(spark):
    rows = [("Test", 0, 2, 1, 0.5, 1.0, 0.0, 2.0, 1.0, 1), ("Test", 1, 2, 0, 0.5, 0.0, 0.0, 3.0, 3.0, 1),
            ("Test", 2, 2, 1, 0.1, 9.0, 0.0, None, 5.0, 0)]
    s = spark.createDataFrame(rows, "split string, step int, maxsteps int, y int, y_proba double, ct double, cp double, "
                                    "o double, r double, m int")
    got = P.losses(s, [("ct", "cp")], [("o", "r", "m")]).first()
    assert got["log_loss"] == pytest.approx(0.6931471805599453) and got["mse"] == 0.5 and got["observed_mse"] == 0.5
    assert got["total"] == pytest.approx(0.6931471805599453 + 0.5 + 0.1 * 0.5)
    packed = spark.createDataFrame([("a", [[1.0, 0.2], [1.0, 0.4], [0.0, 0.0]], 2), ("b", [[1.0, 0.6]], 1)],
                                   "id string, x array<array<double>>, maxsteps int")
    ev = P.evaluate_packed(packed, "id", ["actual", "pred"], "actual", "pred")
    q = ev["quartiles"].first()
    assert ev["steps"].count() == 3 and (q["actual"], q["median"]) == (1.0, 0.4)
    assert q["down"] == pytest.approx(0.1) and q["up"] == pytest.approx(0.1)


def test_hospital_tables_read_written_stays(spark):
    """The stays are built once for all tables: no table's plan numbers sessions again."""
    from stayline.plans import q_clinical
    t, _ = q_clinical.hospital(spark, "/root/testdata/sf0.001")
    for name in ("transfers", "patients", "admissions", "diagnoses_icd", "inputevents", "chartevents"):
        assert "Window" not in t[name]._jdf.queryExecution().optimizedPlan().toString(), name


def test_limits_and_rows_read_the_same_written_measurements(spark, extracted):
    """The interval join stands before a written table, not once for the limits and once for the rows."""
    t, lm, cohort, _ = extracted
    ce = P.clean_measurements(t, cohort, lm)
    assert "_st__cell" not in ce._jdf.queryExecution().optimizedPlan().toString()


def test_body_size_reads_a_written_cohort(spark, monkeypatch):
    """The cohort joins the chart events and the result: it is built once, before both."""
    from stayline.plans import q_clinical
    got, add = [], P.add_body_size
    monkeypatch.setattr(P, "add_body_size", lambda t, co: got.append(co) or add(t, co))
    assert q_clinical._body_size(spark, "/root/testdata/sf0.001").count() == got[0].count()
    assert "Join" not in got[0]._jdf.queryExecution().optimizedPlan().toString()


def test_prepared_stays_are_packed_once(spark):
    """The longest stay of a split is counted, not taken from stays packed a second time."""
    from stayline.plans import q_clinical
    plan = q_clinical._prepared(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 2  # labels and mask


def test_stays_come_from_one_record_per_user_and_day(spark, monkeypatch):
    """Sessions are numbered over days, not over all events, and have the same ends."""
    from stayline.plans import base
    d, got, one = "/root/testdata/sf0.001", [], base.stays.sessionize
    monkeypatch.setattr(base.stays, "sessionize", lambda df, *a, **k: got.append(df.count()) or one(df, *a, **k))
    from stayline.plans import q_clinical
    q_clinical.hospital(spark, d)
    ev = base.table(spark, d, "events")
    assert got == [ev.select("user_id", F.to_date("ts")).distinct().count()]
    cols = ["user_id", "session_no", "intime", "outtime"]
    assert sorted(map(tuple, base.stay_bounds(spark, d).collect())) == sorted(
        map(tuple, base.stay_table(spark, d).select(*cols).collect()))


def test_items_go_to_the_chart_events(spark, extracted, monkeypatch):
    """Two item numbers are two tasks: the chart events are not shuffled by item."""
    t, _, cohort, _ = extracted
    seen, cut = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    cols = ["subject_id", "hadm_id", "discharge_location", *[c for c in cohort.columns if c in ("Admission type", "Admission location", "Ethnicity")]]
    out = P.add_body_size(t, cohort.select(*cols))
    assert "hashpartitioning(itemid" not in seen[0]
    one = out.where("subject_id = 's0'").first()
    assert abs(one["Height (m)"] - 1.778) < 1e-9 and one["Weight (kg)"] == 80.0


def test_groups_of_an_admission_are_written_as_bits(spark, extracted):
    """Flags and prior history read the same written row per admission: the diagnoses are
    grouped once.  An admission without a group is kept, one without a diagnosis is not."""
    t, _, cohort, dx = extracted
    assert "Join" not in dx._jdf.queryExecution().optimizedPlan().toString()
    assert dx.count() == t["diagnoses_icd"].select("hadm_id").distinct().count()
    more = dict(t, diagnoses_icd=t["diagnoses_icd"].where("hadm_id NOT IN ('h1', 'h2')").union(
        spark.createDataFrame([("s2", "h2", "1", "ZZZ", "10")], t["diagnoses_icd"].schema)))
    co, _ = P.build_cohort(more)
    rows = {r["hadm_id"]: r for r in co.collect()}
    assert "h1" not in rows and len(rows) == 7
    assert not any(v for c, v in rows["h2"].asDict().items() if c.startswith("(Elixhauser)"))
