"""Sampling plans: which observations a projected year will have, and how precise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.compare import strict_mean


def _projected(end_year: int, n_years: int, step: Column | int = 1) -> Column:
    return F.explode(F.sequence(F.lit(end_year + 1), F.lit(end_year + n_years), F.lit(step)
                                if isinstance(step, int) else step))


def future_rows(fleets: DataFrame, end_year: int, n_years: int, seas: int = 1) -> DataFrame:
    """One plan row per projected year and fleet."""
    return fleets.select("fleet").distinct().select(
        _projected(end_year, n_years).alias("yr"), F.lit(seas).alias("seas"), "fleet"
    )


def catch_se_plan(plan: DataFrame, observed: DataFrame, fleets: list[int], after: int) -> DataFrame:
    """Mean observed standard error after a year, for the plan rows of some fleets.

    Observations match a plan row by fleet alone, so they are averaged per fleet
    before the join instead of being repeated for every projected year.
    """
    se = (
        observed.where(F.col("year") > after)
        .groupBy("fleet")
        .agg(strict_mean("catch_se").alias("se"))
    )
    rows = plan.where(F.col("fleet").isin(fleets)).select("yr", "seas", "fleet").distinct()
    return rows.join(se, "fleet", "left").select(
        "yr", "seas", F.col("fleet").alias("fltsvy"), "se"
    )


def index_plan(observed: DataFrame, end_year: int, n_years: int, recent: int = 2,
               after: int = 2000) -> DataFrame:
    """Indices seen in the last `recent` years, projected every year with their mean SE."""
    active = (
        observed.groupBy("index")
        .agg(
            F.max("year").alias("last_year"),
            F.avg(F.when(F.col("year") > after, F.col("se_log"))).alias("se"),
        )
        .where(F.col("last_year") > end_year - recent)
    )
    return active.select(
        _projected(end_year, n_years).alias("yr"),
        F.lit(7).alias("seas"),
        F.col("index").alias("fltsvy"),
        "se",
    )


def discard_plan(plan: DataFrame, closed: list[int]) -> DataFrame:
    """Plan rows without the closed fleets."""
    return plan.where(~F.col("fltsvy").isin(closed))


def length_plan(observed: DataFrame, end_year: int, n_years: int, recent: int = 2,
                history: int = 20, seas: int = 7) -> DataFrame:
    """Length samples of the fleets seen recently, by partition.

    Partitions 0 and 2 are sampled every year with their mean size of the last
    `history` years; a provisional observation of the first projected year replaces
    the mean there. Partition 1 is sampled every round(10 / rows) years.
    """
    in_history = F.col("yr") > end_year - history
    first = F.col("yr") == end_year + 1
    parts = (
        observed.groupBy("fltsvy", "part")
        .agg(
            F.max("yr").alias("last_year"),
            F.count_if(in_history).alias("n_rows"),
            F.avg(F.when(in_history, F.col("nsamp"))).alias("mean_nsamp"),
            F.max(F.when(first, F.col("nsamp"))).alias("provisional"),
        )
        .withColumn("fleet_last", F.max("last_year").over(Window.partitionBy("fltsvy")))
        .where(
            (F.col("fleet_last") > end_year - recent)
            & (F.col("n_rows") > 0)
            & F.col("part").isin(0, 1, 2)
        )
    )
    every = F.greatest(F.bround(10 / F.col("n_rows")).cast("int"), F.lit(1))
    step = F.when(F.col("part") == 1, every).otherwise(F.lit(1))
    rows = parts.withColumn("plan_year", _projected(end_year, n_years, step))
    nsamp = F.when(
        (F.col("part") != 1) & (F.col("plan_year") == end_year + 1),
        F.coalesce("provisional", "mean_nsamp"),
    ).otherwise(F.col("mean_nsamp"))
    return rows.select(
        F.col("plan_year").alias("yr"),
        F.lit(seas).alias("seas"),
        "fltsvy",
        F.lit(0).alias("sex"),
        "part",
        nsamp.alias("nsamp"),
    )


def age_plan(observed: DataFrame, end_year: int, n_years: int, recent: int = 2,
             history: int = 20) -> DataFrame:
    """Age samples of the fleets seen recently; the season is that of the earliest recent row."""
    yr = F.col("yr")
    is_recent = yr > end_year - recent
    fleets = (
        observed.groupBy("fltsvy")
        .agg(
            F.count_if(is_recent).alias("n_recent"),
            F.min(F.when(is_recent, F.struct("yr", "seas"))).alias("first_recent"),
            F.avg(F.when(yr > end_year - history, F.col("nsamp"))).alias("nsamp"),
        )
        .where(F.col("n_recent") > 0)
    )
    # fixed values of the plan's remaining columns
    constants = {"sex": 1, "part": 2, "ageerr": 1, "lbin_lo": -1, "lbin_hi": -1}
    return fleets.select(
        _projected(end_year, n_years).alias("yr"),
        F.col("first_recent.seas").alias("seas"),
        "fltsvy",
        *[F.lit(v).alias(k) for k, v in constants.items()],
        "nsamp",
    )


def frequency_table(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
