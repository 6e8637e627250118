import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import student
from runlens.functions.semantics import (
    clean_nan, is_finite, label_year, role, rounded, safe_ratio, strict,
)

INF, NAN = math.inf, math.nan
CASES = [None, 0.0, 1.0, -1.0, 4.0]


def expected(num, den, both_zero, den_zero):
    if num is None or den is None:
        return None
    if num == 0 and den == 0:
        return both_zero
    if den == 0:
        if den_zero == "inf":
            return INF if num > 0 else -INF
        return None if den_zero == "null" else num / den_zero
    return num / den


@pytest.mark.parametrize("both_zero", [None, 0.0, 1.0])
@pytest.mark.parametrize("den_zero", ["inf", "null", 0.001])
def test_safe_ratio_grid(spark, both_zero, den_zero):
    rows = [(a, b) for a in CASES for b in CASES]
    df = spark.createDataFrame(rows, "num double, den double")
    got = df.select("num", "den", safe_ratio(F.col("num"), F.col("den"), both_zero, den_zero).alias("r"))
    for r in got.collect():
        assert r.r == expected(r.num, r.den, both_zero, den_zero), r


def test_nan_is_missing_and_infinity_is_a_value(spark):
    df = clean_nan(spark.createDataFrame([(NAN,), (INF,), (1.0,), (None,)], "x double"))
    assert [r.x for r in df.collect()] == [None, INF, 1.0, None]
    finite = df.select(F.coalesce(is_finite(F.col("x")), F.lit(False)).alias("f"))
    assert [r.f for r in finite.collect()] == [False, False, True, False]
    assert df.select(safe_ratio(F.lit(INF), F.lit(INF)).alias("r")).first().r is None


def test_strict_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    got = dict(df.groupBy("k").agg(strict(F.avg("x"), F.col("x"))).collect())
    assert got == {"a": None, "b": 3.0}


def test_run_names(spark):
    names = ["base_OM", "base_EM_init", "base_EM_2047", "", "Base", "x_EM_998"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(label_year(F.col("n")).alias("y"), role(F.col("n")).alias("r")).collect()
    assert [g.y for g in got] == [None, None, 2047, None, None, None]
    assert [g.r for g in got] == ["OM", "EM", "EM", "Other", "Other", "EM"]


def test_type_7_quantile_and_sample_sd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    r = df.select(F.percentile("x", 0.25), F.stddev_samp("x")).first()
    assert r[0] == 1.75 and math.isclose(r[1], 4.031128874149275)
    assert df.limit(1).select(F.stddev_samp("x")).first()[0] is None


def test_rounding_sends_ties_one_way(spark):
    df = spark.createDataFrame([(0.016875,), (-0.016875,), (INF,), (2.0,)], "x double")
    assert [r.x for r in rounded(df, 5).collect()] == [0.01688, -0.01688, INF, 2.0]


def test_t_quantiles(spark):
    known = {1: 12.706204736432, 2: 4.302652729911, 10: 2.228138851965, 30: 2.042272456301,
             200: 1.971896223633, 1000: 1.962339080761}
    df = spark.createDataFrame([(k,) for k in [0, *known]], "df int")
    got = dict(df.select("df", student.t_quantile(F.col("df"))).collect())
    assert got[0] is None
    for k, v in known.items():
        assert math.isclose(got[k], v, rel_tol=1e-9), (k, got[k])
