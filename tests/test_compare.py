import math

import pytest
from pyspark.sql import functions as F

from runlens.functions.semantics import ROW_KEYS, metric_columns
from runlens.operators import compare as cmp

LABEL = 2001


def table(df, keys=ROW_KEYS):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def close(a, b):
    if a is None or b is None:
        return a is b
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def assert_same(a, b):
    a, b = table(a), table(b)
    assert a.keys() == b.keys() and a
    for k in a:
        for c in a[k]:
            assert a[k][c] == b[k][c] or close(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_truth_rows_are_unique(ts):
    om = ts.where(F.col("model_run").contains("_OM"))
    assert om.groupBy("scenario", "iteration", "year").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("kind", ["ratio", "residual", "bias", "inverse"])
def test_one_label_equals_the_join(ts, kind):
    metrics = cmp.named_metrics()
    whole = cmp.compare(ts, metrics, kind).where(F.col("label") == LABEL)
    assert_same(cmp.compare(ts, metrics, kind, LABEL), whole)


def test_ratio_wide_equals_long(ts):
    names = ["F_1", "F_5", "SpawnBio", "rec_dev"]
    metrics = {n: F.col(n) for n in names}
    assert_same(cmp.ratio_all(ts, metrics), cmp.ratio_all_long(ts, metrics))


def test_bias_is_ratio_minus_one(ts):
    m = {"x": F.col("SpawnBio")}
    ratio, bias = table(cmp.compare(ts, m, "ratio", LABEL)), table(cmp.compare(ts, m, "bias", LABEL))
    for k in ratio:
        assert close(bias[k]["x"], None if ratio[k]["x"] is None else (ratio[k]["x"] - 1) * 100)


def test_scaling_both_sides_keeps_ratios(ts):
    m = {"x": F.col("SpawnBio")}
    assert_same(cmp.compare(ts, m, "ratio"), cmp.compare(ts.withColumn("SpawnBio", F.col("SpawnBio") * 4), m, "ratio"))


def test_estimate_equal_to_truth_has_no_residual(ts):
    om = ts.where(F.col("model_run").contains("_OM"))
    copy = om.withColumns({"model_run": F.lit("m_EM_2001"), "label": F.lit(LABEL)})
    both = om.unionByName(copy)
    res = cmp.compare(both, cmp.all_metrics(ts), "residual", LABEL)
    assert res.count() == om.count()
    cols = metric_columns(res)
    assert res.where(" or ".join(f"{c} <> 0" for c in cols)).isEmpty()


def test_duplicate_truth_is_an_error(ts):
    doubled = ts.unionByName(ts.where(F.col("model_run").contains("_OM")))
    with pytest.raises(Exception, match="more than one truth"):
        cmp.compare(doubled, {"x": F.col("F_1")}, "ratio", LABEL).collect()


def test_estimate_without_truth_stays(ts):
    em = ts.where(F.col("model_run").contains("_EM"))
    got = cmp.compare(em, {"x": F.col("F_1")}, "ratio", LABEL)
    assert got.count() == em.where(F.col("label") == LABEL).count()
    assert got.where("x is not null").isEmpty()


def test_zero_rules(spark):
    rows = [("s", 1, y, r, lab, v) for y, em, om in [(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 3.0, 2.0)]
            for r, lab, v in (("m_EM_2001", LABEL, em), ("m_OM", None, om))]
    df = spark.createDataFrame(rows, "scenario string, iteration int, year int, model_run string, label int, v double")
    m = {"v": F.col("v")}

    def get(*args, **kw):
        return [r.v for r in cmp.compare(df, m, *args, **kw).orderBy("year").collect()]

    assert get("ratio", LABEL, both_zero=1.0, den_zero=0.001) == [1.0, 3000.0, 1.5]
    assert get("re", LABEL, both_zero=1.0) == [1.0, math.inf, 0.5]
    assert get("re", LABEL, null_to=0.0) == [0.0, math.inf, 0.5]
    assert get("ape", LABEL, null_to=0.0) == [0.0, math.inf, 50.0]
    assert get("inverse", LABEL) == [None, 0.0, 2 / 3]
    assert get("abs", LABEL) == [0.0, 3.0, 1.0]


def test_one_label_plan_reads_once_and_shuffles_once(ts):
    df = cmp.ratio_all(ts, {"F_5": F.col("F_5")}, LABEL).select("scenario", "year", "F_5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "SortAggregate" not in plan
    assert "F_1" not in plan and "SpawnBio" not in plan


@pytest.mark.parametrize("label", [None, LABEL])
@pytest.mark.parametrize("twice", ["base_OM", "base_EM_2001"])
def test_a_second_row_raises_even_where_label_is_dropped(spark, label, twice):
    rows = [("a", 1, 2000, run, 2001 if "EM" in run else None, 2.0) for run in ("base_OM", "base_EM_2001", twice)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, year int, model_run string, label int, x double")
    ratio = cmp.compare(df, {"x": F.col("x")}, "ratio", label)
    with pytest.raises(Exception, match="more than one truth or estimate"):
        ratio.groupBy("scenario").agg(F.avg("x")).collect()


def test_all_labels_keep_estimates_without_a_truth(spark):
    rows = [("a", 1, 2000, "base_EM_init", None, 3.0), ("a", 1, 2000, "base_EM_2001", 2001, 2.0)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, year int, model_run string, label int, x double")
    got = cmp.pair(df, {"x": F.col("x")}).collect()
    assert sorted((r.model_run, r.x_em, r.x_om) for r in got) == [("base_EM_2001", 2.0, None), ("base_EM_init", 3.0, None)]


def test_long_ratio_groups_once_per_row(spark):
    """A task's memory follows the rows, not their cells: no aggregation by the metric."""
    rows = [("s", 1, 2000, "s_OM", None, 2.0, 0.0), ("s", 1, 2000, "s_EM_1998", 1998, 1.0, 0.0),
            ("s", 1, 2000, "s_EM_2001", 2001, None, 5.0), ("s", 2, 2000, "s_EM_1998", 1998, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, year int, model_run string, label int, a double, b double")
    long = cmp.ratio_all_long(df)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan.lower() and plan.count("Aggregate") == 2
    assert sorted(map(tuple, long.collect()), key=str) == sorted(map(tuple, cmp.ratio_all(df).select(long.columns).collect()), key=str)
