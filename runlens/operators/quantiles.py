"""Exact quantiles (linear interpolation between order statistics) of any group size.

One accumulator a group and metric, merged on the map side: counts, moments, extremes, and a
quantile summary (`percentile_approx`) of fixed size that is asked for CUTS + 1 evenly spaced cuts.

* Of up to CUTS values the summary holds every one, and the cuts are the sorted values
  themselves: every order statistic is read off them.
* Of more values the cuts bound each wanted rank from both sides. A second look at the rows of
  such groups counts the values below a bound and the equal ones between the bounds (about
  a thousandth of a group), where the rank is then found. Both are combined before the shuffle, so
  a group with a third of all rows is one row a task and few values; no value is shuffled twice.

Both forms stand in every plan and both are exact; which one a group takes depends on its own size
alone. What a wrong bound would lead to, a rank outside of it, raises an error. The accumulators are
written once to the scratch folder: one row a group and metric, so that the planner knows how many
groups need the second look, and skips it when none does.

Several metrics are accumulated side by side (`many_stats`): a row's keys are grouped once.

Where the caller knows from the keys that a group is small whatever the input (`bounded`: one
value a year of one run, say), one aggregation with `percentile` does the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.semantics import nan_to_null
from runlens.sources.scratch import stored

#: cuts of a summary (a power of two, so that their ranks are exact), and the summary's accuracy:
#: its rank error is a small part of the distance between two cuts
CUTS = 2048
ACCURACY = 8 * CUTS
STATS = ["n_rows", "n", "mean", "sd", "total", "least", "most"]


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the key columns of two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def interpolate(lo: Column, hi: Column, weight: Column) -> Column:
    """Between neighbours; the weighted form keeps an infinite neighbour infinite."""
    mixed = nan_to_null(lo * (1 - weight) + hi * weight)
    return F.when((lo == hi) | (weight == 0), lo).otherwise(mixed)


def _wanted(p: float, total: Column) -> tuple[Column, Column, Column]:
    """0-based lower and upper rank of a quantile, and the weight of the upper."""
    h = (total - 1) * F.lit(float(p))
    return F.floor(h), F.ceil(h), h - F.floor(h)


def _aggregates(v: str) -> list[Column]:
    """Count, moments and extremes of a column without NaN."""
    return [
        F.count(v).alias("n"),
        nan_to_null(F.avg(v)).alias("mean"),
        nan_to_null(F.stddev_samp(v)).alias("sd"),
        nan_to_null(F.sum(v)).alias("total"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    ]


def _accumulated(values: DataFrame, keys: list[str], names: list[str], probs: list[float]) -> DataFrame:
    """A row a group and metric: keys, variable, at (its number), the statistics, and the quantiles
    of small groups (q0..) or the bounds (i, a, b) of wanted ranks of others. values: keys, v0..
    """
    # a constant array; as a string it is one expression and not thousands
    shares = ",".join(str(i / CUTS) for i in range(CUTS + 1))
    cuts = F.expr(f"cast(split('{shares}', ',') as array<double>)")
    metrics = [
        F.struct(
            F.lit(name).alias("variable"),
            F.lit(i).alias("at"),
            *_aggregates(f"v{i}"),
            F.percentile_approx(f"v{i}", cuts, ACCURACY).alias("cuts"),
        ).alias(f"m{i}")
        for i, name in enumerate(names)
    ]
    wide = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *metrics)
    long = wide.select(*keys, "n_rows", F.inline(F.array(*[f"m{i}" for i in range(len(names))])))

    n = F.col("n")
    few = n <= CUTS

    def near(rank: Column) -> Column:
        return F.try_divide(rank * CUTS, n)

    def ranked(rank: Column) -> Column:
        """The order statistic of a small group: the cut whose rank it is."""
        return F.get("cuts", F.floor(near(rank + 1)).cast("int"))

    quantiles, bounds = [], []
    for i, p in enumerate(probs):
        lo, hi, weight = _wanted(p, n)
        quantiles.append(F.when(few, interpolate(ranked(lo), ranked(hi), weight)).alias(f"q{i}"))
        below, above = F.floor(near(lo)) - 1, F.ceil(near(hi + 1)) + 1
        bounds.append(
            F.struct(
                F.lit(i).alias("i"),
                F.when(below <= 0, F.col("least")).otherwise(F.get("cuts", below.cast("int"))).alias("a"),
                F.when(above >= CUTS, F.col("most")).otherwise(F.get("cuts", above.cast("int"))).alias("b"),
            )
        )
    return long.select(
        *keys, "variable", "at", *STATS, *quantiles, F.when(~few, F.array(*bounds)).alias("bounds")
    )


def _second_look(values: DataFrame, large: DataFrame, keys: list[str], n_metrics: int,
                 probs: list[float]) -> DataFrame:
    """keys, variable and quantiles q0.. of the groups of `large`, from their rows."""
    targets = large.select(*keys, "variable", "at", "n", F.inline("bounds"))
    value = F.get(F.array(*[f"v{i}" for i in range(n_metrics)]), F.col("at"))
    seen = (
        values.alias("x")
        .join(targets.alias("t"), same_keys("x", "t", keys))
        .select(*[f"t.{k}" for k in keys], "variable", "n", "i", "a", "b", value.alias("v"))
        .where("v <= b")
    )
    # everything below the bounds is one count, a null value
    group = [*keys, "variable", "i"]
    counts = seen.groupBy(*group, "n", F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_first("v"))
    placed = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i"))
    h = (F.col("n") - 1) * p

    def found(rank: Column) -> Column:
        hit = (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
        return F.coalesce(F.max(F.when(hit, F.col("v"))), F.raise_error(F.lit("rank outside of its bounds")).cast("double"))

    picked = placed.groupBy(*group, "n").agg(found(F.floor(h)).alias("lo"), found(F.ceil(h)).alias("hi"))
    q = interpolate(F.col("lo"), F.col("hi"), h - F.floor(h))
    return picked.groupBy(*keys, "variable").agg(
        *[F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(probs))]
    )


def many_stats(df: DataFrame, keys: list[str], metrics: dict[str, Column], probs: list[float],
               name: str = "variable") -> DataFrame:
    """keys, the metric's name, n_rows, n, mean, sd, total, least, most and quantiles q0.. of every metric."""
    ks = [f"k{i}" for i in range(len(keys))]  # whatever the keys are called, they meet no other column
    values = df.select(
        *[F.col(k).alias(i) for k, i in zip(keys, ks)],
        *[nan_to_null(c.cast("double")).alias(f"v{i}") for i, c in enumerate(metrics.values())],
    )
    first = stored(_accumulated(values, ks, list(metrics), probs), "accumulators")
    quantiles = [f"q{i}" for i in range(len(probs))]
    small = first.where(F.col("bounds").isNull()).select(*ks, "variable", *STATS, *quantiles)
    large = first.where(F.col("bounds").isNotNull())
    looked = _second_look(values, large, ks, len(metrics), probs)
    rest = large.alias("a").join(looked.alias("b"), same_keys("a", "b", [*ks, "variable"])).select(
        *[f"a.{c}" for c in [*ks, "variable", *STATS]], *[f"b.{q}" for q in quantiles]
    )
    return small.unionByName(rest).select(
        *[F.col(i).alias(k) for k, i in zip(keys, ks)], F.col("variable").alias(name), *STATS, *quantiles
    )


def direct_stats(df: DataFrame, keys: list[str], value: Column, probs: list[float]) -> DataFrame:
    """The same columns as `group_stats`, by one aggregation whose memory follows the group."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *_aggregates("v")]
    if probs:
        aggs.append(F.percentile("v", [float(p) for p in probs]).alias("q"))
    out = (
        df.select(*keys, nan_to_null(value.cast("double")).alias("v")).groupBy(*keys).agg(*aggs)
    )
    return out.withColumns(
        {f"q{i}": nan_to_null(F.col("q")[i]) for i in range(len(probs))}
    ).drop("q") if probs else out


def group_stats(df: DataFrame, keys: list[str], value: Column, probs: list[float],
                bounded: bool = False) -> DataFrame:
    """n_rows, n, mean, sd, total, least, most and quantiles q0..qk per group.

    `bounded`: the keys alone bound a group, so that one task may hold its values.
    """
    if not probs or bounded:
        return direct_stats(df, keys, value, probs)
    return many_stats(df, keys, {"value": value}, probs, "the metric").drop("the metric")
