import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import quantiles as q
from runlens.operators import summarise as sm

PROBS = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def skewed(spark, seed=1):
    """A hot group with ties, and small groups with missing and infinite values."""
    rng = random.Random(seed)
    rows = [("hot", 1, float(rng.randint(0, 40))) for _ in range(3000)]
    rows += [("hot", 2, rng.gauss(1e6, 1.0)) for _ in range(4000)]
    rows += [("same", 1, 7.0)] * 500
    rows += [("odd", i % 5, rng.choice([None, 1.0, -2.5, math.nan, math.inf, -math.inf])) for i in range(60)]
    rows += [("none", 1, None), (None, 1, 3.0), (None, 1, 5.0), ("one", 1, 2.0)]
    return spark.createDataFrame(rows, "k string, j int, x double").repartition(16)


def by_key(df, keys=("k", "j")):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    return a == b or math.isclose(a, b, rel_tol=tol, abs_tol=1e-9)


def test_group_stats_equal_direct(spark):
    df = skewed(spark)
    direct = by_key(q.direct_stats(df, ["k", "j"], F.col("x"), PROBS))
    spread = by_key(q.group_stats(df, ["k", "j"], F.col("x"), PROBS))
    assert direct.keys() == spread.keys()
    for k in direct:
        for c in direct[k]:
            if c == "sd" and k[0] == "odd":
                continue  # infinite values: both NULL or NaN-free, checked below
            assert same(direct[k][c], spread[k][c], 1e-7 if c == "sd" else 1e-9), (k, c, direct[k], spread[k])


def test_quantiles_match_numpy(spark):
    df = skewed(spark).where("k = 'hot'")
    got = by_key(q.group_stats(df, ["k", "j"], F.col("x"), PROBS))
    for j in (1, 2):
        x = np.array([r.x for r in df.where(F.col("j") == j).collect()])
        for i, p in enumerate(PROBS):
            assert math.isclose(got["hot", j][f"q{i}"], np.quantile(x, p), rel_tol=1e-12)
        assert math.isclose(got["hot", j]["sd"], x.std(ddof=1), rel_tol=1e-7)


def test_quantiles_of_many_values(spark):
    """Groups with far more values than bins stay exact."""
    rng = random.Random(9)
    rows = [("hot", rng.gauss(0, 1) ** 5) for _ in range(9000)] + [("tiny", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(16)
    got = by_key(q.group_stats(df, ["k"], F.col("x"), PROBS), ("k",))
    for k in ("hot", "tiny"):
        want = np.quantile([v for g, v in rows if g == k], PROBS)
        assert np.allclose([got[(k,)][f"q{i}"] for i in range(len(PROBS))], want, rtol=1e-12)


def test_the_plan_does_not_depend_on_the_size(spark, ts):
    import re

    def shape(df):
        plan = sm.summarise(df, ["scenario"], "F_5", {"m": "median"})._jdf.queryExecution().optimizedPlan().toString()
        return [re.match(r"[\s:+-]*(\w+)", line)[1] for line in plan.splitlines()]

    many = ts
    for _ in range(3):
        many = many.unionByName(many)
    small, large = shape(ts), shape(many)
    assert "Window" in small and [x for x in large if x not in ("Union", "Relation", "Project", "Filter")] == [
        x for x in small if x not in ("Union", "Relation", "Project", "Filter")
    ]
    bounded = sm.summarise(ts, ["scenario"], "F_5", {"m": "median"}, bounded=True)
    assert "percentile(" in bounded._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_strict_and_lenient(spark, strict):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 4.0)], "k string, x double")
    got = by_key(sm.summarise(df, ["k"], "x", {"mean": "mean", "med": "median"}, strict=strict), ("k",))
    assert got[("b",)]["med"] == 2.5
    assert got[("a",)]["mean"] == (None if strict else 1.0)


def box(x):
    x = np.sort(np.array(x))
    lo, mid, hi = np.quantile(x, [0.25, 0.5, 0.75])
    keep = x[(x >= lo - 1.5 * (hi - lo)) & (x <= hi + 1.5 * (hi - lo))]
    return len(x), keep.min(), lo, mid, hi, keep.max(), len(x) - len(keep)


def check_box(spark):
    rng = random.Random(3)
    data = {k: [round(rng.gauss(0, 1) ** 3, 2) for _ in range(n)] for k, n in (("a", 300), ("b", 7), ("c", 1))}
    rows = [(k, v) for k, xs in data.items() for v in xs] + [("a", math.inf), ("a", math.nan), ("b", None)]
    got = sm.boxplot_stats(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()
    for r in got:
        assert np.allclose([float(v) for v in r[1:]], [float(v) for v in box(data[r.k])]), r
    assert len(got) == 3


def test_boxplot(spark):
    check_box(spark)


def test_t_interval(spark):
    x = [1.0, 2.0, 4.0, 10.0]
    rows = [("a", v) for v in x] + [("a", math.inf), ("a", None), ("b", 3.0)]
    got = by_key(sm.t_interval(spark.createDataFrame(rows, "k string, x double"), ["k"], "x"), ("k",))
    half = 3.182446305284 * statistics.stdev(x) / 2
    assert math.isclose(got[("a",)]["lower"], 4.25 - half, rel_tol=1e-9)
    assert math.isclose(got[("a",)]["upper"], 4.25 + half, rel_tol=1e-9)
    assert got[("b",)]["mean"] == 3.0 and got[("b",)]["lower"] is None


def test_histogram(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", rng.random() * 10) for i in range(500)]
    lo, hi = min(v for _, v in rows), max(v for _, v in rows)
    width = (hi - lo) / 9
    edges = lo - width / 2 + width * np.arange(11)
    got = sm.histogram(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()
    for k in "ab":
        want, _ = np.histogram([v for g, v in rows if g == k], edges)
        have = {r.bin: r.n for r in got if r.k == k}
        assert [have.get(i, 0) for i in range(10)] == list(want)
    flat = sm.histogram(spark.createDataFrame([("a", 2.0)] * 3, "k string, x double"), ["k"], "x").collect()
    assert [(r.bin, r.n) for r in flat] == [(0, 3)]


def test_iteration_order_does_not_matter(ts):
    turned = ts.withColumn("iteration", 1000 - F.col("iteration"))
    stats = {"m": 0.5, "q": 0.25}
    a = by_key(sm.summarise(ts, ["scenario", "year"], "F_1", stats), ("scenario", "year"))
    b = by_key(sm.summarise(turned, ["scenario", "year"], "F_1", stats), ("scenario", "year"))
    assert a == b


def test_two_level_medians(spark):
    rows = [("r", "r", "r", i, 1, float(i * 10)) for i in (1, 2, 3)] + [
        ("r", "r", "r", i, 2, float(i * 20)) for i in (1, 2, 3)
    ] + [("s", "a", "b", 1, 1, 99.0)]
    df = spark.createDataFrame(rows, "scenario string, om_name string, em_name string, iteration int, year int, x double")
    means = sm.iteration_mean(df, ["scenario", "om_name", "em_name", "iteration"], "x", (1, 2))
    assert sm.reference_median(means, ["em_name"], "r").first().median_value == 30.0
    own = sm.self_reference_median(means.withColumn("type", F.lit("t")), ["type"]).collect()
    assert [(r.em_name, r.median_value) for r in own] == [("r", 30.0)]


def test_event_years(spark):
    rows = [("s", 1, "m_OM", y, f) for y, f in ((1, 0.1), (2, 0.0), (3, 0.2))] + [
        ("s", 1, "m_EM_2001", y, f) for y, f in ((3, 0.3), (1, 0.1), (2, 0.0))
    ] + [("s", 2, "m_OM", 1, 0.1)]
    df = spark.createDataFrame(rows, "scenario string, iteration int, model_run string, year int, F_5 double")
    got = {r.iteration: (r.em_years, r.om_years, r.is_equal) for r in sm.event_year_match(df).collect()}
    assert got == {1: ("1,3", "1,3", True), 2: (None, "1", None)}


def test_terminal_groups(spark):
    df = spark.createDataFrame([(g,) for g in (0, 3, 4, 6, 7, None)], "g int")
    got = [r[0] for r in df.select(sm.terminal_group(F.col("g"))).collect()]
    assert got == ["0-3", "0-3", "3-6", "3-6", "6+", "Other"]


def test_one_hot_and_many_small_groups(spark):
    """Both forms of the accumulator in one call: sorted cuts, and bounds with a second look."""
    hot = spark.range(60_000, numPartitions=8).selectExpr("'hot' as k", "0 as j", "cast(xxhash64(id) % 100000 as double) as x")
    small = spark.range(40_000, numPartitions=8).selectExpr(
        "'small' as k", "cast(id % 10000 as int) as j", "if(id % 7 = 0, null, cast(id * id % 1009 as double)) as x"
    )
    df = hot.unionByName(small)
    want = by_key(q.direct_stats(df, ["k", "j"], F.col("x"), PROBS))
    got = by_key(q.group_stats(df, ["k", "j"], F.col("x"), PROBS))
    assert len(got) == 10_001 and want["hot", 0]["n"] > q.CUTS
    for k in want:
        assert all(same(want[k][c], got[k][c], 1e-9) for c in want[k]), (k, want[k], got[k])


@pytest.mark.parametrize("n", [q.CUTS - 1, q.CUTS, q.CUTS + 1, 3 * q.CUTS])
def test_both_sides_of_the_accumulators_bound(spark, n):
    for values in (lambda i: i, lambda i: i % 3, lambda i: -1.0 if i else math.inf):
        df = spark.createDataFrame([("a", float(values(i))) for i in range(n)], "k string, x double").repartition(8)
        got = q.group_stats(df, ["k"], F.col("x"), PROBS).first()
        want = q.direct_stats(df, ["k"], F.col("x"), PROBS).first()
        assert all(same(got[f"q{i}"], want[f"q{i}"]) for i in range(len(PROBS))), (got, want)


def test_many_metrics_are_one_shuffled_row_a_group(spark):
    """Names of keys and metrics may be any, and the shuffle has no row a metric."""
    df = spark.range(1000, numPartitions=4).selectExpr("cast(id % 3 as int) as n", "cast(id % 2 as int) as variable", "id * 1D as a", "id % 11 * 1D as v0")
    got = q.many_stats(df, ["n", "variable"], {"a": F.col("a"), "v0": F.col("v0")}, [0.5], "metric").collect()
    for r in got:
        x = [i if r["metric"] == "a" else i % 11 for i in range(1000) if i % 3 == r[0] and i % 2 == r[1]]
        assert r["q0"] == statistics.median(x) and r["total"] == sum(x)
    assert len(got) == 12
    values = df.selectExpr("n as k0", "a as v0", "v0 as v1")
    out = q._accumulated(values, ["k0"], ["a", "b"], [0.5])
    out.collect()
    tracked = [p for p in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())]
    assert tracked and all(p.startswith("k0") for p in tracked)


def test_outliers_are_all_listed(spark):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(5000)] + [("a", 50.0)] * 3 + [("b", float(i)) for i in range(10)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(8)
    x = np.array([v for k, v in rows if k == "a"])
    lo, hi = np.quantile(x, [0.25, 0.75])
    want = sorted(v for v in x if v < lo - 1.5 * (hi - lo) or v > hi + 1.5 * (hi - lo))
    got = sm.boxplot_outliers(df, ["k"], "x").collect()
    assert sorted(v for r in got for v in [r["value"]] * r["n"]) == want and {r["k"] for r in got} == {"a"}
    box = {r["k"]: r for r in sm.boxplot_stats(df, ["k"], "x").collect()}
    assert box["a"]["n_outliers"] == len(want) and box["b"]["n_outliers"] == 0 and box["b"]["upper_whisker"] == 9.0


def test_retention_by_blocks_sorts_rows_once(spark):
    """Groups of side-by-side lengths have the medians of long rows, from an eighth of the rows."""
    from runlens.operators import derive

    rows = [("a", i, None if i % 7 == 0 else i / 9, i % 5 + 0.5, None if i == 3 else 1 / (i + 1)) for i in range(3000)]
    params = spark.createDataFrame(rows, "g string, i int, infl double, width double, asym double")
    long = sm.summarise(derive.retention_curves(params, 9), ["g", "x"], "y", {"m": "median", "n": "n", "top": "max"})
    blocks = derive.retention_blocks(params, 9, 4)
    assert blocks.count() == 3 * 3000
    wide = sm.summarise_blocks(blocks, ["g"], "x", ["y0", "y1", "y2", "y3"], 9, {"m": "median", "n": "n", "top": "max"})
    got, want = (sorted(map(tuple, d.select("g", "x", "m", "n", "top").collect())) for d in (wide, long))
    assert len(got) == 10 and got == want
