"""Scenario grids and their schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reference age span over the ages each selectivity shape covers.
MULTIPLIERS = {"flat": 21 / 21, "young": 21 / 9, "old": 21 / 17.25, "mid": 21 / 16.75}


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of `left` with every row of `right`, a dimension.

    The dimension's rows are numbered; a row of `left` is repeated for every number, and the
    numbers are joined. No value holds the whole dimension, whatever its size.
    """
    order = Window.orderBy(*right.columns)
    numbered = right.select("*", (F.row_number().over(order) - 1).alias("product_cell"))
    n = right.select(F.count(F.lit(1)).cast("int")).scalar()
    cells = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    return left.select("*", cells.alias("product_cell")).join(numbered, "product_cell").drop("product_cell")


def scenario_grid(models: DataFrame, suffix: str = "",
                  multipliers: dict[str, float] = MULTIPLIERS) -> DataFrame:
    """Every truth model with every estimation model.

    `models` is a dimension with one column `model`.
    """
    listed = models.select("model").distinct()
    multiplier = F.lit(None).cast("double")
    for name, value in multipliers.items():
        multiplier = F.when(F.col("om") == name, F.lit(value)).otherwise(multiplier)
    pairs = product(listed.withColumnRenamed("model", "om"), listed.withColumnRenamed("model", "em"))
    return pairs.select(
        "om",
        "em",
        F.concat("om", F.lit("_x_"), "em", F.lit(suffix)).alias("scenario"),
        multiplier.alias("multiplier"),
    )


def scaled_schedule(schedule: DataFrame, grid: DataFrame, catch_se: float = 0.01,
                    fixed: int = 0) -> DataFrame:
    """The schedule of every scenario, for truth and estimate.

    The truth's mortality is multiplied by the truth model's factor; the estimate sees
    the base schedule with a standard error and a flag that tells whether it is fixed.
    """
    rows = product(schedule, grid.select("scenario", "multiplier"))
    sides = F.array(
        F.struct(
            F.lit("OM").alias("side"),
            (F.col("catch") * F.col("multiplier")).alias("event_catch"),
            F.lit(None).cast("double").alias("catch_se"),
            F.lit(None).cast("int").alias("fixed"),
        ),
        F.struct(
            F.lit("EM").alias("side"),
            F.col("catch").alias("event_catch"),
            F.lit(catch_se).alias("catch_se"),
            F.lit(fixed).alias("fixed"),
        ),
    )
    keep = [c for c in schedule.columns if c != "catch"]
    return rows.select("scenario", *keep, F.inline(sides)).withColumnRenamed("event_catch", "catch")


def scenario_label(dim: DataFrame) -> DataFrame:
    """Scenario names in ordinal order as "a, b, and c"; one row."""
    listed = F.array_sort(F.collect_set(F.struct("ordinal", "scenario")))
    names = F.transform(listed, lambda s: s["scenario"])
    return dim.select(names.alias("names")).select(
        F.when(F.size("names") < 2, F.array_join("names", ""))
        .otherwise(
            F.concat(
                F.array_join(F.slice("names", F.lit(1), F.size("names") - 1), ", "),
                F.lit(", and "),
                F.element_at("names", -1),
            )
        )
        .alias("label")
    )
