"""Distribution summaries: one-level statistics, two-level medians, intervals, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.semantics import is_finite, role, safe_ratio
from runlens.functions.student import t_quantile
from runlens.operators.curate import with_role
from runlens.operators.quantiles import group_stats, many_stats, same_keys
from runlens.sources.scratch import stored

_SIMPLE = {"mean": "mean", "sd": "sd", "sum": "total", "min": "least", "max": "most"}
RIBBON = {"median_ratio": 0.5, "lower_quartile": 0.25, "upper_quartile": 0.75}
TERMINAL_RIBBON = {"mean_ratio": "mean", "lower_quartile": 0.25, "upper_quartile": 0.75}
INTERVAL95 = {"med_val": 0.5, "low": 0.025, "high": 0.975}


def _value(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def summarise(df: DataFrame, keys: list[str], col: str | Column,
              stats: dict[str, str | float], strict: bool = False,
              bounded: bool = False) -> DataFrame:
    """Named statistics of one value per group.

    `stats` maps an output name to "mean", "sd", "sum", "min", "max", "n", "median" or
    a quantile's probability. Missing values are skipped; `strict` makes the result
    missing instead when a group has any. `bounded`: see `group_stats`.
    """
    probs = sorted({0.5 if s == "median" else s for s in stats.values()
                    if s == "median" or isinstance(s, float)})
    base = group_stats(df, keys, _value(col), probs, bounded)
    out = []
    for name, s in stats.items():
        if s == "n":
            out.append(F.col("n").alias(name))
            continue
        source = _SIMPLE[s] if s in _SIMPLE else f"q{probs.index(0.5 if s == 'median' else s)}"
        c = F.col(source)
        if strict:
            c = F.when(F.col("n") == F.col("n_rows"), c)
        out.append(c.alias(name))
    return base.select(*keys, *out)


def summarise_blocks(df: DataFrame, keys: list[str], x: str, cols: list[str], x_max: int,
                     stats: dict[str, str | float]) -> DataFrame:
    """`summarise` of values that stand side by side: the i-th of `cols` is that at `x` + i, up to x_max.

    A row of `df` is grouped (and, with many groups, sorted) once and not once a value.
    """
    probs = sorted({0.5 if s == "median" else s for s in stats.values()
                    if s == "median" or isinstance(s, float)})
    base = many_stats(df, [*keys, x], {str(i): F.col(c) for i, c in enumerate(cols)}, probs, "the place")
    base = base.withColumn(x, F.col(x) + F.col("the place").cast("int")).where(F.col(x) <= x_max)
    return base.select(*keys, x, *[
        F.col("n" if s == "n" else _SIMPLE[s] if s in _SIMPLE else f"q{probs.index(0.5 if s == 'median' else s)}").alias(name)
        for name, s in stats.items()
    ])


def iteration_mean(df: DataFrame, keys: list[str], col: str | Column,
                   window: tuple[int, int] | None = None, name: str = "mean_value") -> DataFrame:
    """Strict mean over the years of a window, per group."""
    if window is not None:
        df = df.where(F.col("year").between(*window))
    return summarise(df, keys, col, {name: "mean"}, strict=True)


def reference_median(means: DataFrame, keys: list[str], scenario: str | None = None,
                     name: str = "median_value", col: str = "mean_value") -> DataFrame:
    """Median over iterations of `iteration_mean` for the designated scenario."""
    if scenario is not None:
        means = means.where(F.col("scenario") == scenario)
    return summarise(means, keys, col, {name: "median"}, strict=True)


def self_reference_median(means: DataFrame, keys: list[str], name: str = "median_value",
                          col: str = "mean_value") -> DataFrame:
    """Median per estimator where the truth is the estimator's own model."""
    own = means.where(F.col("om_name") == F.col("em_name"))
    return summarise(own, [*keys, "em_name"], col, {name: "median"}, strict=True)


def t_interval(df: DataFrame, keys: list[str], col: str | Column, level: float = 0.95) -> DataFrame:
    """Mean with its normal-theory confidence limits, over finite values only."""
    value = _value(col)
    base = group_stats(df.where(is_finite(value)), keys, value, [])
    half = (
        t_quantile(F.col("n") - 1, 0.5 + level / 2) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    )
    return base.select(
        *keys, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper")
    )


def _fenced(df: DataFrame, keys: list[str], col: str | Column, reach: float) -> tuple[DataFrame, DataFrame, Column]:
    """Finite rows (keys, v), a stored row of hinges and fences a group, and whether `v` is inside them.

    The rows are looked at up to three times, so they are written once, keys and value only, and
    what made them (joins, mostly) runs once.
    """
    value = _value(col).cast("double")
    rows = stored(df.where(is_finite(value)).select(*keys, value.alias("v")), "finite")
    spread = (F.col("q2") - F.col("q0")) * reach
    boxes = group_stats(rows, keys, F.col("v"), [0.25, 0.5, 0.75]).withColumns(
        {"low": F.col("q0") - spread, "high": F.col("q2") + spread}
    )
    return rows, stored(boxes, "boxes"), F.col("v").between(F.col("low"), F.col("high"))


#: groups with a value beyond a fence
_TAILED = "least < low or most > high"


def _tails(rows: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups that reach beyond their fences, with the fences."""
    tailed = boxes.where(_TAILED).select(*keys, "low", "high")
    return rows.alias("a").join(tailed.alias("b"), same_keys("a", "b", keys)).select("a.*", "low", "high")


def boxplot_stats(df: DataFrame, keys: list[str], col: str | Column, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers per group, over finite values only.

    Hinges are quartiles; whiskers end at the extreme values within `reach` hinge
    spreads of the hinges; values beyond are counted as outliers. Groups within their fences are
    known from their extremes; the rows of the others are looked at again, as partial extremes and
    counts, without a shuffle of values.
    """
    rows, boxes, inside = _fenced(df, keys, col, reach)
    looked = _tails(rows, boxes, keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    )
    tailed = boxes.where(_TAILED).alias("a").join(looked.alias("b"), same_keys("a", "b", keys)).select(
        "a.*", "lower_whisker", "upper_whisker", "n_outliers"
    )
    plain = boxes.where(f"not ({_TAILED})").selectExpr(
        "*", "least as lower_whisker", "most as upper_whisker", "0L as n_outliers"
    )
    return plain.unionByName(tailed).selectExpr(
        *[f"`{k}`" for k in keys], "n", "lower_whisker", "q0 as lower_hinge", "q1 as median",
        "q2 as upper_hinge", "upper_whisker", "n_outliers",
    )


def boxplot_outliers(df: DataFrame, keys: list[str], col: str | Column, reach: float = 1.5) -> DataFrame:
    """The values beyond the fences: keys, value, n (how often). One row each, so that a group may have any number."""
    rows, boxes, inside = _fenced(df, keys, col, reach)
    beyond = _tails(rows, boxes, keys).where(~inside)
    return beyond.groupBy(*keys, F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def stat_lines(df: DataFrame, metrics: list[str], label: int | None = None) -> DataFrame:
    """Mean, median and sd of every metric by year, scenario and role, in long form.

    All metrics are accumulated side by side; they become rows after the groups are made.
    """
    roles = with_role(df).where(F.col("role") != "Other")
    if label is not None:
        roles = roles.where((F.col("role") == "OM") | (F.col("label") == label))
    found = many_stats(roles, ["year", "scenario", "role"], {m: F.col(m) for m in metrics}, [0.5])
    return found.selectExpr("year", "scenario", "role as model_type", "variable", "mean", "q0 as median", "sd")


#: Upper edges of the buckets of years until the terminal year, and their names.
TERMINAL_EDGES = [3, 6]
TERMINAL_NAMES = ["0-3", "3-6", "6+"]
NO_BUCKET = "Other"


def bucket(value: Column, edges: list[float], names: list[str], missing: str | None = None) -> Column:
    """Name of the interval, closed on the right, that holds the value; edges ascending."""
    above = sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), above + 1)
    return F.when(value.isNull(), F.lit(missing)).otherwise(named)


def terminal_group(gap: Column) -> Column:
    """Bucket of the years until the label's terminal year."""
    return bucket(gap, TERMINAL_EDGES, TERMINAL_NAMES, NO_BUCKET)


def histogram(df: DataFrame, keys: list[str], col: str, bins: int = 10) -> DataFrame:
    """Counts in all equal-width bins shared by all groups, closed on the right.

    The first bin is centred on the overall minimum and the last on the maximum.
    """
    value = F.col(col)
    finite = df.where(is_finite(value))
    ends = finite.select(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = finite.select(*keys, value.alias("v"), ends.alias("ends")).select(
        *keys,
        "v",
        F.col("ends.lo").alias("lo"),
        ((F.col("ends.hi") - F.col("ends.lo")) / (bins - 1)).alias("width"),
    )
    # the small shift counts a value that sits on a break, up to rounding, as below it
    steps = F.try_divide(F.col("v") - F.col("lo"), F.col("width")) + 0.5 - 1e-8
    index = F.when(F.col("width") == 0, 0).otherwise(F.greatest(F.ceil(steps) - 1, F.lit(0)))
    counted = placed.withColumn("bin", index.cast("int")).groupBy(*keys).agg(
        F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)]).alias("counts"),
        F.max("lo").alias("lo"),
        F.max("width").alias("width"),
    )
    # empty bins are bins too; without a range there is one
    return (
        counted.select(*keys, "lo", "width", F.posexplode("counts").alias("bin", "n"))
        .where((F.col("width") > 0) | (F.col("bin") == 0))
        .select(*keys, "bin", "n", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_center"))
    )


def event_year_match(df: DataFrame) -> DataFrame:
    """Sorted event years of truth and estimate per run pair, and whether they agree.

    A run has few distinct years, so a set per group stays small.
    """
    kind = role(F.col("model_run"))

    def years_of(side: str) -> Column:
        found = F.array_sort(F.collect_set(F.when(kind == side, F.col("year"))))
        return F.when(F.size(found) > 0, F.array_join(found.cast("array<string>"), ","))

    return (
        df.where(F.col("F_5") > 0)
        .groupBy("scenario", "iteration")
        .agg(years_of("EM").alias("em_years"), years_of("OM").alias("om_years"))
        .withColumn("is_equal", F.col("em_years") == F.col("om_years"))
    )


def strict_sum(col: str) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def residual_share(paired: DataFrame, n_iterations: Column | None = None,
                   how: str = "sum") -> DataFrame:
    """Residuals of the three sectors relative to the removals, in percent.

    how="sum" relates sums to the truth's sums and gives the total per iteration.
    how="mean" relates means; its commercial share is relative to the estimate's mean.
    """
    sectors = ["commercial", "recreational", "event_dead"]
    agg = strict_sum if how == "sum" else strict_avg
    wide = paired.withColumns(
        {f"{s}_res": F.col(f"{s}_em") - F.col(f"{s}_om") for s in sectors}
    )
    base = wide.groupBy("scenario").agg(
        *[agg(f"{s}_{part}").alias(f"{s}_{part}") for s in sectors for part in ("res", "om", "em")]
    )

    def share(num: Column, den: Column) -> Column:
        return safe_ratio(num, den) * 100

    def over(part: str) -> Column:
        return sum((F.col(f"{s}_{part}") for s in sectors[1:]), F.col(f"{sectors[0]}_{part}"))

    com_base = "commercial_om" if how == "sum" else "commercial_em"
    total = over("res") if n_iterations is None else over("res") / n_iterations
    return base.select(
        "scenario",
        share(F.col("commercial_res"), F.col(com_base)).alias("share_commercial"),
        share(F.col("recreational_res"), F.col("recreational_om")).alias("share_recreational"),
        share(F.col("event_dead_res"), F.col("event_dead_om")).alias("share_event"),
        total.alias("total_residual"),
        share(over("res"), over("om")).alias("share_total"),
    )


def strict_avg(col: str) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))
