from collections import defaultdict

import pytest
from pyspark.sql import Row
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.plans import sampling, scenarios, schedules


def template(spark, n, fleets=(5,)):
    rows = [(2000 + i, 1, f, 0.0) for i in range(n) for f in fleets]
    return spark.createDataFrame(rows, "yr int, seas int, fltsvy int, catch double")


def iterations(spark, n):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("iteration"))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 5), st.integers(0, 12), st.integers(1, 30), st.integers(0, 10**6))
def test_balanced_schedule(spark, n, extra, iters, seed):
    years = n + extra
    df = schedules.balanced_random_schedule(
        template(spark, years, (4, 5)), iterations(spark, iters), n, 0.05, 0.25, 0.1, seed
    )
    rows = df.collect()
    assert len(rows) == iters * years
    drawn = defaultdict(dict)
    for r in rows:
        if r.catch > 0:
            drawn[r.iteration][r.yr] = r.catch
    assert set(drawn) == set(range(1, iters + 1))
    for sizes in drawn.values():
        assert len(sizes) == n and abs(sum(sizes.values()) / n - 0.1) < 1e-12
    uses = [sum(2000 + i in sizes for sizes in drawn.values()) for i in range(years)]
    assert max(uses) - min(uses) <= 1


@pytest.mark.parametrize("n", [17, 16, 40])
def test_balanced_schedule_over_many_iterations(spark, n):
    df = schedules.balanced_random_schedule(
        template(spark, 51), iterations(spark, 2000), n, 0.05, 0.25, 0.1, 3
    )
    uses = [r["count"] for r in df.where("catch > 0").groupBy("yr").count().collect()]
    assert len(uses) == 51 and sum(uses) == 2000 * n and max(uses) - min(uses) <= 1


def test_balanced_schedule_is_repeatable(spark):
    def run():
        df = schedules.balanced_random_schedule(
            template(spark, 9), iterations(spark, 25), 4, 0.05, 0.25, 0.1, 7
        )
        return sorted(map(tuple, df.collect()))

    assert run() == run()


def test_regular_and_random_schedules(spark):
    t = template(spark, 7, (4, 5))
    regular = schedules.regular_schedule(t, 3, 0.2).collect()
    assert sorted(r.yr for r in regular if r.catch == 0.2) == [2000, 2003, 2006] and len(regular) == 7
    chosen = schedules.random_schedule(t, 3, 0.2, 1).collect()
    assert len(chosen) == 7 and sum(r.catch == 0.2 for r in chosen) == 3
    picks = {
        tuple(sorted(r.yr for r in schedules.random_schedule(t, 3, 0.2, s).collect() if r.catch))
        for s in range(6)
    }
    assert len(picks) > 1


def test_grid_and_scaled_schedule(spark):
    models = spark.createDataFrame([("flat",), ("young",)], "model string")
    grid = scenarios.scenario_grid(models, "_rt_2")
    assert {(r.scenario, round(r.multiplier, 4)) for r in grid.collect()} == {
        ("flat_x_flat_rt_2", 1.0), ("flat_x_young_rt_2", 1.0),
        ("young_x_flat_rt_2", 2.3333), ("young_x_young_rt_2", 2.3333),
    }
    base = schedules.regular_schedule(template(spark, 2), 1, 0.3)
    rows = scenarios.scaled_schedule(base, grid).where("scenario = 'young_x_flat_rt_2'").collect()
    assert {(r.side, round(r.catch, 6), r.catch_se, r.fixed) for r in rows} == {
        ("OM", 0.7, None, None), ("EM", 0.3, 0.01, 0)
    }


def test_product_holds_no_array_of_the_dimension(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([("u",), ("u",), (None,)], "c string")
    got = sorted(map(str, scenarios.product(left, right).collect()))
    assert got == sorted(str(Row(a=r.a, b=r.b, c=c)) for r in left.collect() for c in ("u", "u", None))
    assert scenarios.product(left, right.where("false")).count() == 0
    plan = scenarios.product(left, right)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect" not in plan


@pytest.mark.parametrize("names,want", [(["a"], "a"), (["b", "a"], "b, and a"), (["c", "a", "b"], "c, a, and b")])
def test_scenario_label(spark, names, want):
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "scenario string, ordinal int")
    assert scenarios.scenario_label(dim).first().label == want


def test_catch_se_plan(spark):
    obs = spark.createDataFrame(
        [(1999, 1, 9.0), (2001, 1, 0.1), (2002, 1, 0.3), (2001, 3, 0.5)], "year int, fleet int, catch_se double"
    )
    plan = sampling.future_rows(spark.createDataFrame([(1,), (2,), (3,)], "fleet int"), 2002, 2)
    got = {(r.yr, r.fltsvy): r.se for r in sampling.catch_se_plan(plan, obs, [1, 2], 2000).collect()}
    assert got == {(2003, 1): 0.2, (2004, 1): 0.2, (2003, 2): None, (2004, 2): None}


def test_index_plan(spark):
    obs = spark.createDataFrame(
        [(1995, 1, 9.0), (2001, 1, 0.2), (2002, 1, None), (1999, 2, 0.4)], "year int, index int, se_log double"
    )
    got = sampling.index_plan(obs, 2002, 3).collect()
    assert sorted((r.yr, r.seas, r.fltsvy, r.se) for r in got) == [(y, 7, 1, 0.2) for y in (2003, 2004, 2005)]


def test_length_plan(spark):
    rows = [(y, 1, 1, 4.0) for y in (1999, 2000, 2001, 2002)]  # partition 1: four rows, every 2 years
    rows += [(y, 1, 0, float(y - 2000)) for y in (2001, 2002, 2003)]  # 2003 is provisional
    rows += [(1970, 1, 2, 1.0), (1998, 2, 0, 5.0)]  # too old; inactive fleet
    obs = spark.createDataFrame(rows, "yr int, fltsvy int, part int, nsamp double")
    got = sampling.length_plan(obs, 2002, 4).collect()
    assert {(r.yr, r.part, r.nsamp) for r in got} == {
        (2003, 1, 4.0), (2005, 1, 4.0),
        (2003, 0, 3.0), (2004, 0, 2.0), (2005, 0, 2.0), (2006, 0, 2.0),
    }


def test_age_plan(spark):
    obs = spark.createDataFrame(
        [(2001, 7, 1, 10.0), (2002, 1, 1, 20.0), (1990, 7, 1, 30.0), (1995, 7, 2, 1.0)],
        "yr int, seas int, fltsvy int, nsamp double",
    )
    got = sampling.age_plan(obs, 2002, 2).collect()
    assert [(r.yr, r.seas, r.fltsvy, r.nsamp) for r in sorted(got)] == [(2003, 7, 1, 20.0), (2004, 7, 1, 20.0)]
