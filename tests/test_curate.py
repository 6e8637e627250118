from pyspark.sql import functions as F

from runlens.operators import curate, derive
from runlens.sources.summary import Summary

COLS = "scenario string, iteration int, model_run string, year int, F_5 double"


def panel(spark, runs, years=(2046, 2047, 2048), scenario="no_rt"):
    return spark.createDataFrame([(scenario, 1, r, y, 0.5) for r in runs for y in years], COLS)


def test_prepare_cut(spark):
    df = panel(spark, ["m_OM", "m_EM_2047", "m_EM_init", "Base", ""])
    got = {(r.model_run, r.year) for r in curate.prepare_runs(df).collect()}
    assert got == {("m_OM", y) for y in (2046, 2047, 2048)} | {("m_EM_2047", 2046), ("m_EM_2047", 2047)}
    uncut = curate.prepare_runs(df, offset=0, min_gap=None)
    assert uncut.count() == 9
    assert uncut.where("year = 2046 and label is not null").first().years_until_terminal == 1


def test_unknown_scenario_goes(spark):
    df = panel(spark, ["m_OM"]).unionByName(panel(spark, ["m_OM"], scenario="other"))
    kept = curate.prepare_runs(df, curate.scenario_dim(spark))
    assert {r.scenario for r in kept.select("scenario").distinct().collect()} == {"no_rt"}


def test_latest_runs(spark):
    df = panel(spark, ["m_OM", "m_EM_2044", "m_EM_2047", "m_EM_init"])
    by_label = curate.latest_runs(df).select("model_run").distinct().collect()
    by_number = curate.latest_runs_by_number(df).select("model_run").distinct().collect()
    assert {r[0] for r in by_label} == {r[0] for r in by_number} == {"m_OM", "m_EM_2047"}


def test_merge_renames_drops_and_fills(spark):
    old = panel(spark, ["m_OM"], (2001,), "flat_x_flat_rt_34").unionByName(
        panel(spark, ["m_OM"], (2001,), "flat_x_flat_all_yrs")
    )
    new = panel(spark, ["m_OM"], (2001,), "flat_x_flat_rt_2").withColumn("extra", F.lit(1.0))
    s_old, s_new = Summary(old, old, old), Summary(new, new, new)
    merged = curate.merge_summaries(s_old, s_new, r"rt_34$", [("_all_yrs", "_34_all_yrs"), ("_rt_2", "_rt_34")])
    got = {(r.scenario, r.extra) for r in merged.ts.collect()}
    assert got == {("flat_x_flat_all_yrs", None), ("flat_x_flat_rt_34", 1.0)}


def test_retention_and_selectivity(spark):
    df = spark.createDataFrame(
        [("s", 1, "m_OM", 1.0, 10.0, 2.0, 0.5, None)],
        "scenario string, iteration int, model_run string, Retain_L_asymptote_logit_a double, "
        "Retain_L_infl_a double, Retain_L_width_a double, AgeSel_P1_event_5 double, AgeSel_P2_event_5 double",
    )
    curve = derive.retention_curves(derive.retention_params(df), 100)
    assert curve.count() == 101
    assert curve.where("x = 10").first().y == 0.5
    sel = derive.age_selectivity(df).collect()
    assert [(r.model_run, r.age, r.selectivity) for r in sel] == [("m", 0, 0.5)]


def test_sectors_and_totals(spark, ts):
    one = ts.limit(1)
    r = one.first()
    got = {x.sector: x.value for x in derive.sectors(one, ["year"]).collect()}
    assert got == {"commercial": r.deadB_1 + r.deadB_2, "recreational": r.deadB_4, "event": r.deadB_5}
    total = derive.retained_total(one).first().retainB_all
    assert abs(total - sum(r[f"retainB_{i}"] for i in range(1, 5))) < 1e-9
