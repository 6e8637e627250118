import pytest
from conftest import TINY
from pyspark.sql import functions as F

from runlens.operators import report
from runlens.operators.curate import latest_runs, prepare_runs, scenario_dim, with_label
from runlens.sources import fixtures as fx
from runlens.sources.reports import KINDS, report_long, write_reports
from runlens.sources.scratch import scratch_dir, stored
from runlens.sources.summary import (
    load_run_reports, load_summary, normalise_names, read_table, write_summary, write_table,
)


def test_summary_round_trip(spark, tmp_path):
    s = fx.summary(spark, TINY)
    write_summary(s, str(tmp_path))
    back = load_summary(spark, str(tmp_path))
    for table in ("ts", "dq", "scalar"):
        a, b = normalise_names(getattr(s, table)), getattr(back, table)
        assert sorted(a.columns) == sorted(b.columns)
        assert a.exceptAll(b.select(a.columns)).isEmpty() and a.count() == b.count()
    assert "Value_F" in back.dq.columns
    assert (tmp_path / "ts" / "scenario=no_rt").is_dir()


def test_hot_scenario_is_written_by_many_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 100 < 99, "hot").otherwise("cold").alias("scenario"),
        F.xxhash64("id").alias("x"),
    )
    spark.conf.set(size, "200KB")
    try:
        write_table(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset(size)
    hot = list((tmp_path / "t" / "scenario=hot").glob("*.parquet"))
    cold = list((tmp_path / "t" / "scenario=cold").glob("*.parquet"))
    assert len(hot) > 2 and len(cold) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_reports_prune_partitions(spark, tmp_path):
    wide = fx.at_age(spark, TINY)
    path = str(tmp_path / "natage")
    write_table(wide, path, ("scenario", "run"))
    picked = load_run_reports(spark, path, run_suffix="_EM_2001").where(F.col("scenario") == "no_rt")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "run" in filters and "scenario" in filters
    want = wide.where("run = 'base_EM_2001' and scenario = 'no_rt'").count()
    assert picked.count() == want > 0
    assert load_run_reports(spark, path, truth=True).select("run").distinct().collect() == [("base_OM",)]


def test_filters_and_columns_reach_the_scan(ts):
    picked = ts.where((F.col("year") >= 1996) & (F.col("label") == 2001)).select("scenario", "F_5")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,1996)" in plan and "EqualTo(label,2001)" in plan
    assert "SpawnBio" not in plan


class Session:
    """Only what `scratch_dir` asks of a session."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, self
        self.master = master


def test_scratch_uses_the_shared_folder():
    shared = Session("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert scratch_dir(shared, "x").startswith("hdfs:///shared/x-")
    assert scratch_dir(shared, "x") != scratch_dir(shared, "x")
    unset = Session("yarn", **{"spark.sql.warehouse.dir": "hdfs:///warehouse"})
    assert scratch_dir(unset, "x").startswith("hdfs:///warehouse/scratch/x-")


def test_partition_values_survive(spark, tmp_path):
    rows = spark.createDataFrame([("034", 1.0), ("2001", 2.0), ("a b", 3.0)], "scenario string, x double")
    write_table(rows, str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"))
    assert sorted((r.scenario, r.x) for r in back.collect()) == [("034", 1.0), ("2001", 2.0), ("a b", 3.0)]
    for blank in ("", None):
        bad = spark.createDataFrame([(blank, 1.0)], "scenario string, x double")
        with pytest.raises(Exception, match="blank partition value"):
            write_table(bad, str(tmp_path / f"bad{blank}"))


def test_nothing_is_overwritten_unasked(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "scenario string, x double")
    write_table(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)already exists"):
        write_table(rows, str(tmp_path / "t"))
    write_table(rows, str(tmp_path / "t"), mode="overwrite")


def test_stored_reads_back(spark):
    assert stored(spark.range(3), "x").count() == 3


def test_report_table(spark):
    df = spark.createDataFrame([("rt_2_x_rt_2", 1.125), ("no_rt", 1.135)], "scenario string, v double")
    got = report.report_table(df, {"scenario": "Scenario", "v": "Value (%)"}, 2, scenario_dim(spark))
    assert got.columns == ["Scenario", "Value (%)"]
    assert [tuple(r) for r in got.collect()] == [("no_rt", 1.14), ("rt_2_x_rt_2", 1.12)]


def files_read(df):
    """Files that the scans of a plan opened, by Spark's own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan
    total, leaves = 0, plan.collectLeaves().iterator()
    while leaves.hasNext():
        metrics = leaves.next().metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
    return total


def test_one_label_of_many_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path / "ts")
    rows = spark.range(12).selectExpr(
        "'s' as scenario", "cast(id as int) as iteration", "1990 + cast(id as int) as year",
        "if(id < 2, 'x_OM', concat('x_EM_', 2000 + id)) as model_run", "1.5D as F_5",
    )
    write_table(with_label(rows), path, ("scenario", "label"))
    table = read_table(spark, path, ("scenario", "label"))
    every = prepare_runs(table, min_gap=None)
    assert files_read(every) == 11  # ten labels, and truth without one
    one = every.where("label = 2007")
    assert files_read(one) == 1 and [r.model_run for r in one.collect()] == ["x_EM_2007"]
    want = prepare_runs(rows, min_gap=None)
    assert sorted(map(tuple, every.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # a label that comes from another table prunes at run time
    asked = spark.createDataFrame([(2005, "a"), (2006, "b")], "label int, name string").where("name = 'a'")
    picked = every.join(F.broadcast(asked), "label")
    assert "dynamicpruning" in picked._jdf.queryExecution().executedPlan().toString()
    assert [r.model_run for r in picked.collect()] == ["x_EM_2005"]
    assert {r.model_run for r in latest_runs(table).collect()} == {"x_OM", "x_EM_2011"}


def test_report_kinds_read_their_own_files(spark, tmp_path):
    reports = fx.reports(spark, TINY)
    write_reports(reports, str(tmp_path))
    for kind, spec in KINDS.items():
        long = report_long(spark, str(tmp_path), kind, "_EM_2001")
        plan = long._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan
        wide = reports[spec.source].where("endswith(run, '_EM_2001')")
        wide = wide.where("beg_mid = 'B'") if spec.beg else wide
        wide = wide.where(F.col("label").endswith(f"_{spec.factor}")) if spec.factor else wide
        numbers = [c for c in wide.columns if c.isdigit()]
        assert long.count() == len(numbers) * wide.count() > 0
        total = wide.select(sum(F.col(c) for c in numbers).alias("t")).agg(F.sum("t")).first()[0]
        assert long.agg(F.sum(spec.value)).first()[0] == pytest.approx(total)
    one = report_long(spark, str(tmp_path), "size_selectivity", year=1996, fleet=4)
    some = report_long(spark, str(tmp_path), "size_selectivity", fleet=4).where("Yr = 1996")
    assert one.exceptAll(some).isEmpty() and one.count() == some.count() > 0


def test_report_as_text(spark, tmp_path):
    df = spark.createDataFrame([("b, \"x\"", 1.5, 2), (None, None, 3)], "`Run, name` string, v double, n int")
    report.write_report(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.csv"))) == 1
    assert [tuple(r) for r in report.read_report(df, str(tmp_path / "t")).collect()] == [("b, \"x\"", 1.5, 2), (None, None, 3)]


def test_registered_values_are_the_stored_ones(spark):
    from runlens.workloads.queries import QUERIES

    raw = prepare_runs(fx.ts(spark, TINY), scenario_dim(spark))
    got = QUERIES["prepare_ts"](spark, TINY)
    cents = [c for c in raw.columns if c.startswith(("deadB", "SpawnBio", "Bio_smry", "Recruit"))]
    keys = ["scenario", "iteration", "year", "model_run"]
    assert got.select(*keys, *cents).exceptAll(raw.select(*keys, *cents)).isEmpty()
