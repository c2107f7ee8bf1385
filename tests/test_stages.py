"""Bucketed layout, resumable stages and figures taken in the writing pass."""

import pytest
from pyspark.sql import functions as F

from stayline.operators import prep, quality as Q, report
from stayline.plans import clinical as P
from stayline.sources.bucketed import layout, load_bucketed, save_bucketed
from stayline.sources.stages import Memory, Stages, source_digest
from stayline.sources.tables import list_names, load_bundle, load_tables, save_bundle
from tests.test_clinical import _tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _panel(spark):
    return spark.range(600).select((F.col("id") % 40).cast("string").alias("hadm_id"), (F.col("id") % 2).alias("session_no"),
                                   F.col("id").alias("hour"), (F.col("id") * 1.5).alias("a, b (c)"),
                                   F.when(F.col("id") % 5 > 0, F.col("id")).alias("tick"))


def test_bucketed_round_trip_without_an_exchange(spark, tmp_path, no_broadcast):
    a = save_bucketed(_panel(spark), f"{tmp_path}/a", P.ID, 4)
    ids = save_bucketed(_panel(spark).select(*P.ID).distinct().withColumn("split", F.lit("Train")), f"{tmp_path}/ids", P.ID, 4)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, _panel(spark).collect()))
    assert layout(spark, f"{tmp_path}/a")["buckets"] == 4 and layout(spark, f"{tmp_path}/none") is None
    again = load_bucketed(spark, f"{tmp_path}/a")
    joined = prep.apply_split(again, ids, P.ID)
    assert "Exchange" not in _plan(joined) and joined.count() == 600
    packed = prep.pack_sequences(joined, [*P.ID, "split"], "hour", ["a, b (c)"])
    assert "Exchange" not in _plan(packed) and packed.count() == 40
    save_bucketed(_panel(spark).limit(10).drop("hour"), f"{tmp_path}/a", P.ID, 4)  # another schema, overwritten
    assert load_bucketed(spark, f"{tmp_path}/a").columns == ["hadm_id", "session_no", "a, b (c)", "tick"]
    with pytest.raises(ValueError):
        load_bucketed(spark, f"{tmp_path}/ids/none")


def test_bucketed_and_partitioned_bundle(spark, tmp_path):
    tables = {"x": _panel(spark).withColumn("split", F.when(F.col("hour") % 3 == 0, "Test").otherwise("Train")),
              "plain": spark.range(3), "some_cols": spark.range(1)}
    save_bundle(tables, str(tmp_path), partition_by=["split"], bucket_by=P.ID, buckets=3)
    assert list_names(spark, str(tmp_path)) == ["plain", "some_cols", "x"] == list_names(spark, f"file://{tmp_path}/")
    got = load_bundle(spark, str(tmp_path))
    assert set(got) == {"x", "plain"}
    assert sorted(map(str, got["x"].where("split = 'Test'").collect())) == sorted(map(str, tables["x"].where("split = 'Test'").collect()))
    assert "split" in _plan(got["x"].where("split = 'Test'")).split("PartitionFilters")[1]
    assert load_tables(spark, str(tmp_path))["plain"].count() == 3


def test_preparation_reads_stays_without_an_exchange(spark, tmp_path, no_broadcast):
    """Joins and groupings on the stay of bucketed tables."""
    t, lm = _tables(spark)
    st = Stages(spark, f"{tmp_path}/stages", "", P.ID, 4)
    P.run_extraction(t, lm, out_dir=str(tmp_path), stages=st, buckets=4)
    bundle = load_bundle(spark, f"{tmp_path}/data")
    st2 = Stages(spark, f"{tmp_path}/prepared", "", P.ID, 4)
    packed = P.prepare(bundle, 20, stages=st2)
    y, ids = bundle["y"], st2.run("split", None, after=["stays"], params=0)["ids"]
    assert "Exchange" not in _plan(P._stay_rows(y))
    assert "Exchange" not in _plan(prep.apply_split(bundle["x_dynamic"], ids, P.ID))
    one = prep.pack_sequences(prep.apply_split(y.withColumn(P.LABEL, F.col(P.LABEL).cast("double")), ids, P.ID),
                              [*P.ID, "split"], "hour", [P.LABEL])
    assert "Exchange" not in _plan(one)
    steps = prep.unpack_sequences(one, [*P.ID, "split"], [P.LABEL])
    assert "Exchange" not in _plan(steps.join(ids.drop("split"), P.ID)) and steps.count() == y.count()
    assert {r["hadm_id"]: r["maxsteps"] for r in packed["y"].collect()} == {
        r["hadm_id"]: r["count"] for r in y.groupBy("hadm_id").count().collect()}


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    t, lm = _tables(spark)
    calls = []
    for f in ("build_cohort", "add_body_size", "static_features", "clean_measurements", "hourly_panel", "add_scores"):
        real = getattr(P, f)
        monkeypatch.setattr(P, f, lambda *a, _f=f, _r=real: calls.append(_f) or _r(*a))
    good = P.add_scores

    def broken(*a):
        raise RuntimeError("lost in P7")

    monkeypatch.setattr(P, "add_scores", broken)
    with pytest.raises(RuntimeError, match="P7"):
        P.run_extraction(t, lm, out_dir=str(tmp_path), stages=Stages(spark, f"{tmp_path}/stages", "v1"))
    assert calls == ["build_cohort", "add_body_size", "static_features", "clean_measurements", "hourly_panel"]
    calls.clear()
    monkeypatch.setattr(P, "add_scores", good)
    st = Stages(spark, f"{tmp_path}/stages", "v1")
    bundle = P.run_extraction(t, lm, out_dir=str(tmp_path), stages=st)
    assert calls == ["add_scores"] and st.ran == ["scores"]
    calls.clear()
    st = Stages(spark, f"{tmp_path}/stages", "v1")
    again = P.run_extraction(t, lm, stages=st)
    assert calls == [] and st.ran == [] and again["x_dynamic"].columns == bundle["x_dynamic"].columns
    # the observed profile drops the same columns as a scan of the panel
    panel = st.run("scores", None, after=["cohort", "panel"])["panel"]
    dyn = P.dynamic_columns(panel)
    assert Q.observed_profile(st.metrics["scores"]["panel"], dyn) == pytest.approx(
        {r["column"]: r["null_frac"] for r in Q.null_profile(panel, dyn).collect()})
    assert again["x_dynamic"].columns == Q.drop_sparse(panel.select(*P.ID, "hour", *[F.col(f"`{c}`") for c in dyn]), dyn).columns
    calls.clear()
    st = Stages(spark, f"{tmp_path}/stages", "v2")  # other source files
    monkeypatch.setattr(P, "clean_measurements", broken)
    with pytest.raises(RuntimeError):
        P.run_extraction(t, lm, stages=st)
    assert calls[:2] == ["build_cohort", "add_body_size"]


def test_half_written_stages_are_written_again(spark, tmp_path):
    st = Stages(spark, str(tmp_path))
    st.run("a", lambda: {"x": spark.range(5)})
    df = spark.range(9)
    st.digest["b"] = "0" * 64
    df.write.parquet(f"{st.folder}/b-junk/x")
    got = Stages(spark, str(tmp_path))
    assert got.run("a", None)["x"].count() == 5 and got.ran == []
    assert got.run("b", lambda: {"x": df, "y": df.limit(2)}, after=["a"], params=[1])["y"].count() == 2 and got.ran == ["b"]
    assert got.run("b", lambda: {"x": df}, after=["a"], params=[2])["x"].count() == 9 and got.ran == ["b", "b"]


def test_source_digest_follows_the_files(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    one = source_digest(spark, f"{tmp_path}/in")
    assert one == source_digest(spark, f"{tmp_path}/in")
    spark.range(6).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert one != source_digest(spark, f"{tmp_path}/in")


@pytest.mark.parametrize("kind", ["stages", "memory"])
def test_reports_from_the_writing_pass(spark, tmp_path, kind):
    y = spark.range(1000).select((F.col("id") % 37).cast("string").alias("hadm_id"), F.lit(1).alias("session_no"),
                                 F.col("id").alias("hour"), F.when(F.col("id") % 11 > 0, (F.col("id") % 37 < 9) & (F.col("id") % 4 == 0)).alias(P.LABEL))
    st = Memory() if kind == "memory" else Stages(spark, str(tmp_path))
    rows = st.run("stays", lambda: {"stays": P._stay_rows(y)}, observe={"stays": lambda df: report.stay_counts()})["stays"]
    m = st.metrics["stays"]["stays"]
    y = y.withColumnRenamed(P.LABEL, "_y").withColumn("_y", F.coalesce("_y", F.lit(False)))
    assert rows.count() == 37
    assert report.observed_size(spark, m).collect() == report.cohort_size(y, P.ID, "_y").collect()
    assert sorted(report.observed_prevalence(spark, m).collect()) == sorted(report.label_prevalence(y, P.ID, "_y").collect())
