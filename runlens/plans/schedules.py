"""Event schedules over a template with one row per year and fleet.

Random choices order by the MD5 of "seed|...": the same on every run and in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_schedule(template: DataFrame, every: int, mortality: float, fleet: int = 5) -> DataFrame:
    """Events in the template's first year and every `every` years after it."""
    start = template.select(F.min("yr")).scalar()
    hit = (F.col("fltsvy") == fleet) & ((F.col("yr") - start) % every == 0)
    return template.where(F.col("fltsvy") == fleet).withColumn(
        "catch", F.when(hit, F.lit(mortality)).otherwise(F.col("catch"))
    )


def random_schedule(template: DataFrame, n: int, mortality: float, seed: int,
                    fleet: int = 5) -> DataFrame:
    """Events in n distinct years drawn from the template's range of years."""
    span = template.select(F.min("yr").alias("first"), F.max("yr").alias("last"))
    drawn = (
        span.select(F.explode(F.sequence("first", "last")).alias("yr"))
        .orderBy(_hash(seed, "yr"), "yr")
        .limit(n)
        .withColumn("drawn", F.lit(True))
    )
    return (
        template.where(F.col("fltsvy") == fleet)
        .join(drawn, "yr", "left")
        .withColumn("catch", F.when(F.col("drawn"), F.lit(mortality)).otherwise(F.col("catch")))
        .drop("drawn")
    )


def _hash(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def _uniform(key: Column) -> Column:
    """The first 12 hex digits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def _balanced_slots(slots: DataFrame, listed: Column, seed: int) -> DataFrame:
    """iteration, yr: `m` distinct years an iteration, where 2 * m is at most the number of years.

    slots: iteration, m (the same in all rows), j (0 to m - 1); listed: array of rows with `yr`. All draws in a row fill cycles;
    a cycle is one order of all years, so uses differ by one at most. Where an iteration takes
    its first years from one cycle's end and the rest from the next one's start, the former are
    fixed by a hash of their cycle alone and come last in it; the next cycle starts with others.
    So every cycle is ordered on its own, in parallel.
    """
    n_years = F.size(listed)
    placed = slots.withColumn("p", (F.col("iteration") - 1) * F.col("m") + F.col("j")).select(
        "iteration",
        "m",
        F.floor(F.col("p") / n_years).alias("cycle"),
        F.pmod("p", n_years).alias("place"),
    )
    by_cycle = Window.partitionBy("cycle")
    m, cycle = F.col("m"), F.col("cycle")
    tail = F.row_number().over(by_cycle.orderBy(_hash(seed, F.lit("tail"), cycle, "yr"), "yr"))
    last_tail = F.row_number().over(by_cycle.orderBy(_hash(seed, F.lit("tail"), cycle - 1, "yr"), "yr"))
    part = (
        F.when(tail <= F.pmod((cycle + 1) * n_years, m), 2)
        .when(last_tail <= F.pmod(cycle * n_years, m), 1)
        .otherwise(0)
    )
    order = (
        placed.select("cycle", "m").distinct()
        .withColumn("rows", listed)
        .select("cycle", "m", F.explode("rows.yr").alias("yr"))
        .withColumn("part", part)
        .select(
            "cycle",
            "yr",
            (F.row_number().over(by_cycle.orderBy("part", _hash(seed, F.lit("order"), cycle, "yr"), "yr")) - 1)
            .alias("place"),
        )
    )
    return placed.join(order, ["cycle", "place"]).select("iteration", "yr")


def balanced_random_schedule(template: DataFrame, iterations: DataFrame, n: int, lo: float,
                             hi: float, mean: float, seed: int, fleet: int = 5) -> DataFrame:
    """n distinct event years per iteration, spread over all years.

    Uses of any two years differ by one at most, over all iterations from 1 on. More than half of
    the years are drawn by drawing, as evenly, those left out. Magnitudes are uniform on
    [lo, hi), rescaled so that each iteration's mean is `mean`.
    """
    rows = template.where(F.col("fltsvy") == fleet)
    # the template of one fleet has one row per year: attached to each row as one array
    listed = rows.select(F.array_sort(F.collect_set(F.struct("yr", "seas", "fltsvy", "catch")))).scalar()
    skipped = F.lit(2 * n) > F.size(listed)
    draws = iterations.select(
        "iteration", F.when(skipped, F.size(listed) - n).otherwise(F.lit(n)).alias("m")
    )
    enough = F.when(F.col("m") >= 0, F.col("m")).otherwise(F.raise_error(F.lit("fewer years than events")))
    slots = draws.withColumn("m", enough.cast("int")).where(F.col("m") > 0).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    )
    chosen = _balanced_slots(slots, listed, seed).groupBy("iteration").agg(
        F.array_sort(F.collect_list("yr")).alias("chosen")
    )
    none = F.expr("cast(array() as array<int>)")
    found = F.coalesce("chosen", none)
    drawn = F.when(F.size("rows") < 2 * n, F.array_except("rows.yr", found)).otherwise(found)
    raw = F.transform(
        "drawn", lambda y: lo + (hi - lo) * _uniform(_hash(seed, F.lit("size"), "iteration", y))
    )
    total = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    spot = F.array_position("drawn", F.col("yr"))
    return (
        draws.select("iteration").join(chosen, "iteration", "left")
        .withColumn("rows", listed)
        .withColumn("drawn", drawn)
        .withColumn("raw", raw)
        .withColumn("sizes", F.transform("raw", lambda u: u * mean * n / total))
        .select("iteration", "drawn", "sizes", F.inline("rows"))
        .select(
            "iteration",
            "yr",
            "seas",
            "fltsvy",
            F.when(spot > 0, F.try_element_at("sizes", spot.cast("int")))
            .otherwise(F.col("catch"))
            .alias("catch"),
        )
    )
