"""Ensemble tables derived from the driver's Parquet tables (see FIXTURES.md).

Measures are summed as integers of 1/10000 and scaled back once: exact, the same in
any order of rows, and cheaper than a wide decimal. Every table is one aggregation,
so hot keys are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.literals import literal_table
from runlens.sources.summary import Summary

# The panel's scenario names by l_partkey % 8.
PANEL_SCENARIOS = [
    "no_rt", "no_rt_x_rt_2", "rt_2_x_no_rt", "rt_2_x_rt_2",
    "rt_2_x_all_yrs", "flat_x_flat_rt_2", "flat_x_young_rt_2", "young_x_young_all_yrs",
]
INDEX_SCENARIOS = ["no_rt", "rt_2_x_rt_2", "flat_x_flat_rt_2"]
RUNS = ["Base", "base_OM", "base_EM_1998", "base_EM_2001", "base_EM_init"]
FLEETS = range(1, 6)
AGES = range(21)
UNIT = 10000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(x: str) -> str:
    return f"cast(rint(({x}) * {UNIT}D) as bigint)"


def _total(units: str, fleet: int | None = None) -> str:
    """Sum of integer units, of one fleet if given, scaled back."""
    picked = units if fleet is None else f"if(fleet = {fleet}, {units}, 0L)"
    return f"sum({picked}) / {UNIT}D"


def _named(df: DataFrame, code: str, names: list[str], column: str) -> DataFrame:
    """Add the names of a code. As a join with a tiny dimension, a filter on names is
    evaluated once per name; an expression would be inlined into it again and again.
    """
    dim = literal_table(df.sparkSession, [code, column], list(enumerate(names)))
    return df.join(dim, code)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the panel's key columns, coded as integers, and integer measures."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"cast(l_partkey % {len(PANEL_SCENARIOS)} as int) as scenario_code",
        "cast(l_suppkey as int) as iteration",
        """case when l_linenumber = 7 then 0
                when l_linestatus = 'F' then 1
                when l_returnflag = 'A' then 2
                when l_returnflag = 'R' then 3
                else 4 end as run_code""",
        "year(l_shipdate) as year",
        "l_linenumber as fleet",
        "l_partkey",
        "l_orderkey",
        "l_suppkey",
        "l_tax",
        "l_discount",
        "l_quantity",
        f"{_units('l_extendedprice')} as price",
        f"{_units('l_extendedprice * (1 + l_tax)')} as taxed",
        f"{_units('l_discount')} as disc",
        f"{_units('l_tax')} as tax",
        f"{_units('l_quantity')} as qty",
        f"{_units('l_quantity * (1 - l_discount)')} as net",
    )


def _by_fleet(prefix: str, units: str, fleets=FLEETS) -> list[str]:
    return [f"{_total(units, f)} as {prefix}{f}" for f in fleets]


def _agg(df: DataFrame, keys: list[str], aggs: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(a) for a in aggs])


def _panel(df: DataFrame, keys: list[str], aggs: list[str], run: str = "model_run") -> DataFrame:
    """Aggregate by scenario, run and `keys`.

    Groups are hashed and shuffled by their integer codes; names come afterwards.
    """
    out = _agg(df, ["scenario_code", "run_code", *keys], aggs)
    measures = [f"`{c}`" for c in out.columns if c not in ("scenario_code", "run_code", *keys)]
    named = _named(out, "scenario_code", PANEL_SCENARIOS, "scenario")
    return _named(named, "run_code", RUNS, run).selectExpr("scenario", *keys, run, *measures)


def ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(
        _runs(spark, sf_dir),
        ["iteration", "year"],
        [
            *_by_fleet("F_", "disc"),
            *_by_fleet("deadB_", "qty"),
            *[f"cast(count_if(fleet = {f}) as double) as deadN_{f}" for f in FLEETS],
            *_by_fleet("retainB_", "net", range(1, 5)),
            f"{_total('price')} as SpawnBio",
            f"{_total('taxed')} as Bio_smry",
            "cast(count(1) as double) as Recruit_0",
            f"{_total('tax - disc')} as rec_dev",
            f"{_total('tax')} as SPRratio",
        ],
    )


def dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived quantities under their raw, dotted names."""
    return _panel(
        _runs(spark, sf_dir),
        ["iteration", "year"],
        [
            f"{_total('price')} as `Value.SSB`",
            "cast(count(1) as double) as `Value.Recr`",
            f"{_total('tax')} as `Value.SPRratio`",
            f"{_total('qty')} as `Value.Bratio`",
            f"{_total('disc')} as `Value.F`",
        ],
    )


def scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    retention = [
        agg
        for f in (1, 2)
        for agg in (
            f"max(if(fleet = {f}, l_discount, null)) as Retain_L_asymptote_logit_fleet{f}",
            f"max(if(fleet = {f}, l_quantity, null)) as Retain_L_infl_fleet{f}",
            f"1 + max(if(fleet = {f}, l_tax, null)) as Retain_L_width_fleet{f}",
        )
    ]
    return _panel(
        _runs(spark, sf_dir),
        ["iteration"],
        [
            f"{_total('disc')} as max_grad",
            f"{_total('tax')} as SR_LN_R0",
            f"{_total('price')} as SSB_Unfished",
            f"{_total('qty')} as SSB_SPR",
            "max(l_tax) as F_MSY",
            *[f"{_total('disc', f)} as AgeSel_P{f}_event_5" for f in FLEETS],
            *retention,
        ],
    )


def summary(spark: SparkSession, sf_dir: str) -> Summary:
    return Summary(ts(spark, sf_dir), dq(spark, sf_dir), scalar(spark, sf_dir))


def at_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at age in the reports' wide layout, one column per age."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 21 as age")
    rows = (
        _runs(spark, sf_dir)
        .join(part, F.expr("l_partkey = p_partkey"))
        .withColumns({"beg_mid": F.expr("if(fleet % 2 = 0, 'B', 'M')")})
        .withColumnRenamed("year", "Yr")
    )
    return _panel(
        rows,
        ["iteration", "Yr", "beg_mid", "fleet"],
        [f"sum(if(age = {a}, qty, 0L)) / {UNIT}D as `{a}`" for a in AGES],
        run="run",
    )


LENGTHS = range(20, 70, 10)


def reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The reports of all runs in their wide layouts: columns by age or by length."""
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size % 21 as age", f"{LENGTHS.start} + {LENGTHS.step} * (p_size % {len(LENGTHS)}) as length"
    )
    rows = (
        _runs(spark, sf_dir)
        .join(part, F.expr("l_partkey = p_partkey"))
        .withColumns(
            {
                "beg_mid": F.expr("if(fleet % 2 = 0, 'B', 'M')"),
                "age_label": F.expr("concat(year, '_', fleet, if(l_suppkey % 2 = 0, '_Asel2', '_Asel'))"),
                "size_label": F.expr(
                    "concat(year, '_', fleet, case l_suppkey % 3 when 0 then '_Lsel' when 1 then '_Dead' else '_Keep' end)"
                ),
            }
        )
        .withColumnRenamed("year", "Yr")
    )

    def wide(keys: list[str], by: str, numbers: range, units: str) -> DataFrame:
        sums = [f"sum(if({by} = {a}, {units}, 0L)) / {UNIT}D as `{a}`" for a in numbers]
        return _panel(rows, ["iteration", "Yr", "fleet", *keys], sums, run="run")

    return {
        "natage": wide(["beg_mid"], "age", AGES, "qty"),
        "batage": wide(["beg_mid"], "age", AGES, "price"),
        "catage": wide([], "age", AGES, "net"),
        "ageselex": wide(["age_label"], "age", AGES, "disc").withColumnRenamed("age_label", "label"),
        "sizeselex": wide(["size_label"], "length", LENGTHS, "tax").withColumnRenamed("size_label", "label"),
    }


def cpue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and expected abundance indices."""
    rows = table(spark, sf_dir, "events").selectExpr(
        f"cast(user_id % {len(INDEX_SCENARIOS)} as int) as scenario_code",
        "cast(user_id % 10 as int) as iteration",
        "if(event_id % 2 = 0, 'OM', 'EM') as model",
        "event_type as fleet_name",
        "dayofmonth(ts) as yr",
        f"{_units('value')} as value",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )
    out = _agg(
        rows,
        ["scenario_code", "iteration", "model", "fleet_name", "yr"],
        [f"{_total('value')} as obs", "cast(sum(k) as double) as exp"],
    )
    return _named(out, "scenario_code", INDEX_SCENARIOS, "scenario").drop("scenario_code")


def plan_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "year(o_orderdate) as order_year")
    rows = _runs(spark, sf_dir).join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "order_year as year", "fleet", "tax", "qty"
    )
    return _agg(
        rows,
        ["year", "fleet"],
        ["1 as seas", f"{_total('tax')} / count(1) as catch_se", f"{_total('qty')} as catch"],
    )


_ACTIVE = "fleet <> 3 or year < 1999"


def plan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).where(_ACTIVE).withColumnRenamed("fleet", "index")
    return _agg(rows, ["year", "index"], [f"{_total('disc')} / count(1) as se_log"])


def plan_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length or age composition samples by year, fleet and partition."""
    rows = _runs(spark, sf_dir).where(_ACTIVE).selectExpr(
        "year as yr", "7 as seas", "fleet as fltsvy", "cast(l_suppkey % 3 as int) as part", "qty"
    )
    return _agg(rows, ["yr", "seas", "fltsvy", "part"], [f"{_total('qty')} as nsamp"])


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule template: one row per year of the event fleet, nothing scheduled."""
    return (
        _runs(spark, sf_dir)
        .select("year")
        .distinct()
        .selectExpr("year as yr", "1 as seas", "5 as fltsvy", "0D as catch")
    )


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate numbers starting at 1."""
    return _runs(spark, sf_dir).selectExpr("iteration + 1 as iteration").distinct()
