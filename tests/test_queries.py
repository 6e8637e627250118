"""Registered queries against their SQL twins on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from conftest import TINY

import __spark_entry__ as entry
from runlens.workloads.queries import QUERIES

@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(TINY).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name):
    df = QUERIES[name](spark, TINY)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = multiset(df.columns, df.collect()), multiset(columns, cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert want


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["scenario", "year", "variable", "median_ratio", "lower_quartile", "upper_quartile"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", ["ratio_all", "event_magnitude", "scaled_schedule", "event_histogram", "scenario_grid"])
def test_no_cross_products(spark, name):
    plan = QUERIES[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["ratio_all", "relative_error_all", "ratio_all_dq", "percent_bias", "residuals"])
def test_the_input_is_read_once(spark, name):
    """Records that the tasks of all its jobs read, by Spark's own counters.

    Not among them: quantiles look at large groups a second time, and `event_year_match` first looks for
    the latest label.
    """
    rows = spark.read.parquet(f"{TINY}/lineitem.parquet").count()
    before = records_read(spark)
    QUERIES[name](spark, TINY).collect()
    assert 0 < records_read(spark) - before < 1.5 * rows


def records_read(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, store = sc._jvm, sc._jsc.sc().statusStore()
    none = sc._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().inputRecords()
    return total
