"""Reshape metrics and derive new ones."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.semantics import safe_ratio

# Sector names by fleet number; 6 stands for fleets 1 and 2 together.
SECTORS = {"4": "recreational", "5": "event", "6": "commercial"}
RETENTION = {"asymptote_logit": "asym", "infl": "infl", "width": "width"}


def to_long(df: DataFrame, columns: list[str], names_to: str, values_to: str,
            keep: list[str]) -> DataFrame:
    """One row per key and column."""
    return df.select(*keep, *columns).unpivot(keep, columns, names_to, values_to)


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def fleet_long(df: DataFrame, prefix: str, keep: list[str], values_to: str = "value") -> DataFrame:
    """`<prefix><n>` columns as (fleet INT, value)."""
    cols = [c for c in prefixed(df, prefix) if re.fullmatch(rf"{re.escape(prefix)}\d+", c)]
    long = to_long(df, cols, "fleet", values_to, keep)
    return long.withColumn("fleet", F.regexp_extract("fleet", r"(\d+)$", 1).cast("int"))


def sectors(df: DataFrame, keep: list[str], prefix: str = "deadB_", values_to: str = "value",
            positive_only: bool = False) -> DataFrame:
    """Removals of the commercial, recreational and event sectors.

    `positive_only` keeps rows in which the event took something.
    """
    if positive_only:
        df = df.where(F.col(f"{prefix}5") > 0)
    wide = df.withColumn(f"{prefix}6", F.col(f"{prefix}1") + F.col(f"{prefix}2"))
    cols = [f"{prefix}{n}" for n in SECTORS]
    long = to_long(wide, cols, "sector", values_to, keep)
    sector = F.lit(None).cast("string")
    for n, label in SECTORS.items():
        sector = F.when(F.col("sector") == f"{prefix}{n}", label).otherwise(sector)
    return long.withColumn("sector", sector)


def row_total(df: DataFrame, prefix: str) -> Column:
    """Sum over all columns with a prefix; NULL if any is NULL."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in prefixed(df, prefix)])


def retained_total(df: DataFrame) -> DataFrame:
    return df.withColumn("retainB_all", row_total(df, "retainB"))


def retention_params(df: DataFrame) -> DataFrame:
    """`Retain_L_<parameter>_<fleet>` columns as one row per run and fleet.

    The columns of a fleet are packed into a struct and exploded: no shuffle, where
    unpivot followed by a pivot would group every run again.
    """
    pattern = re.compile(rf"Retain_L_({'|'.join(RETENTION)})_(.*)")
    fleets: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if m := pattern.fullmatch(c):
            fleets.setdefault(m[2], {})[RETENTION[m[1]]] = c
    rows = [
        F.struct(
            F.lit(fleet).alias("fleet"),
            *[
                (F.col(cols[p]) if p in cols else F.lit(None)).cast("double").alias(p)
                for p in RETENTION.values()
            ],
        )
        for fleet, cols in fleets.items()
    ]
    return df.select("scenario", "iteration", "model_run", F.inline(F.array(*rows)))


def logistic(x: Column, width: Column, infl: Column, asym: Column) -> Column:
    return F.try_divide(asym, 1 + F.exp(-F.try_divide(x - infl, width)))


def retention_curves(params: DataFrame, x_max: int = 100) -> DataFrame:
    """Retention at every length 0..x_max."""
    return params.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(x_max)))).withColumn(
        "y", logistic(F.col("x").cast("double"), F.col("width"), F.col("infl"), F.col("asym"))
    )


def retention_blocks(params: DataFrame, x_max: int = 100, size: int = 8) -> DataFrame:
    """`retention_curves` with `size` lengths side by side: y0.. of a row are those at x, x + 1, ..;
    beyond x_max they are null.
    """
    first = params.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(x_max), F.lit(size))))
    at = [F.col("x") + i for i in range(size)]
    return first.withColumns(
        {
            f"y{i}": F.when(x <= x_max, logistic(x.cast("double"), F.col("width"), F.col("infl"), F.col("asym")))
            for i, x in enumerate(at)
        }
    )


def age_selectivity(scalar: DataFrame, event: str = "event_5") -> DataFrame:
    """Distinct truth selectivity at age from `AgeSel_P<n>_<event>`; age = n - 1."""
    pattern = re.compile(rf"AgeSel_P(\d+)_{re.escape(event)}")
    cols = [c for c in scalar.columns if pattern.fullmatch(c)]
    truth = scalar.where(F.col("model_run").contains("_OM"))
    long = to_long(truth, cols, "age", "selectivity", ["model_run"])
    return (
        long.where(F.col("selectivity").isNotNull())
        .select(
            F.regexp_replace("model_run", "_OM", "").alias("model_run"),
            (F.regexp_extract("age", r"AgeSel_P(\d+)_", 1).cast("int") - 1).alias("age"),
            "selectivity",
        )
        .distinct()
        .withColumn("selectivity_logistic", 1 / (1 + F.exp(-F.col("selectivity"))))
    )


def unfished_recruits(scalar: DataFrame) -> DataFrame:
    return scalar.select(
        "scenario", "iteration", "model_run", F.exp("SR_LN_R0").alias("r0")
    )


def unfished_recruits_ratio(scalar: DataFrame, label: int) -> DataFrame:
    """Estimated over true unfished recruitment per scenario and iteration."""
    run = F.col("model_run")
    picked = unfished_recruits(
        scalar.where(run.endswith("_OM") | run.endswith(f"_EM_{label}"))
    )
    wide = picked.groupBy("scenario", "iteration").agg(
        F.max(F.when(run.endswith("_OM"), F.col("r0"))).alias("om"),
        F.max(F.when(~run.endswith("_OM"), F.col("r0"))).alias("em"),
    )
    return wide.withColumn("ratio_r0", safe_ratio(F.col("em"), F.col("om")))


def term_series(ts: DataFrame, dq: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """Long series of SSB, event mortality, retained total and SPR ratio.

    `labels` keeps truth runs and the runs of those label years.
    """
    keep = ["scenario", "iteration", "model_run", "year"]
    a = to_long(retained_total(ts), ["SpawnBio", "F_5", "retainB_all"], "variable", "value", keep)
    b = to_long(dq, ["Value_SPRratio"], "variable", "value", keep)
    out = a.unionByName(b)
    if labels is not None:
        out = out.where(F.col("model_run").rlike("|".join([*map(str, labels), "OM"])))
    return out


def at_age_long(df: DataFrame, keep: list[str], values_to: str, index_to: str = "age",
                where: Column | None = None) -> DataFrame:
    """Columns with all-digit names (ages, lengths) as (index INT, value)."""
    if where is not None:
        df = df.where(where)
    cols = [c for c in df.columns if re.fullmatch(r"\d+", c)]
    long = to_long(df, cols, index_to, values_to, keep)
    return long.withColumn(index_to, F.col(index_to).cast("int"))
