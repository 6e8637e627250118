"""Match estimates with their truth and derive errors.

`pair` is the only place that matches; all comparisons are expressions on its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.semantics import (
    YEAR_KEYS,
    metric_columns,
    nan_to_null,
    null_double,
    role,
    safe_ratio,
)
from runlens.operators.derive import to_long
from runlens.sources.scratch import stored

Metrics = dict[str, Column]


def named_metrics(catch: str = "deadB_") -> Metrics:
    """The named quantities of the residual and error tables."""
    return {
        "recruits": F.col("Recruit_0"),
        "F_5": F.col("F_5"),
        "ssb": F.col("SpawnBio"),
        "commercial": F.col(f"{catch}1") + F.col(f"{catch}2"),
        "recreational": F.col(f"{catch}4"),
        "event_dead": F.col("deadB_5"),
        "abundance": F.col("Bio_smry"),
    }


def mortality_metrics() -> Metrics:
    return {"commercial_F": F.col("F_1") + F.col("F_2"), "recreational_F": F.col("F_4")}


def all_metrics(df: DataFrame) -> Metrics:
    """Every double column under its own name."""
    return {c: F.col(c) for c in metric_columns(df)}


_REPEATED = "more than one truth or estimate row for a scenario, iteration and year"


def pair(df: DataFrame, metrics: Metrics, label: int | None = None) -> DataFrame:
    """Estimates with the truth of the same scenario, iteration and year.

    Returns the keys, model_run, label and `<metric>_em`, `<metric>_om`; an estimate
    without a truth keeps NULL there.

    Each key holds at most one truth, and one estimate of each run, so both sides are
    picked by one aggregation: one scan and one shuffle of the derived metrics. For one
    label year partial results are combined before the shuffle; for all labels a key's
    estimates are an array, as long as a run has label years. A second row for a side is an
    error, not a guess: every returned value depends on the check.
    """
    kind = role(F.col("model_run"))
    cols = [c.cast("double").alias(m) for m, c in metrics.items()]
    keys = [*YEAR_KEYS, "model_run", "label"]
    values = [f"{m}_{side}" for m in metrics for side in ("em", "om")]
    is_em, is_om = F.col("role") == "EM", F.col("role") == "OM"
    estimate = kind == "EM" if label is None else (kind == "EM") & (F.col("label") == label)
    sides = df.where((kind == "OM") | estimate).select(*keys, kind.alias("role"), *cols)

    def checked(ok: Column, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.raise_error(F.lit(_REPEATED)))

    truth = [F.max(F.when(is_om, F.col(m))).alias(f"{m}_om") for m in metrics]
    if label is None:
        row = F.struct("model_run", "label", *[F.col(m).alias(f"{m}_em") for m in metrics])
        grouped = sides.groupBy(*YEAR_KEYS).agg(
            F.collect_list(F.when(is_em, row)).alias("rows"), F.count_if(is_om).alias("n_om"), *truth
        )
        runs = F.transform("rows", lambda r: F.coalesce(r["model_run"], F.lit("")))
        ok = (F.col("n_om") <= 1) & (F.size(F.array_distinct(runs)) == F.size("rows"))
        # all rows come out of the checked array: no later pruning can skip it
        return grouped.select(
            *YEAR_KEYS, *[f"{m}_om" for m in metrics], F.inline(checked(ok, F.col("rows")))
        ).select(*keys, *values)

    picked = [F.max(F.when(is_em, F.col(m))).alias(f"{m}_em") for m in metrics]
    paired = sides.groupBy(*YEAR_KEYS).agg(
        F.max(F.when(is_em, F.col("model_run"))).alias("model_run"),
        F.count_if(is_em).alias("n_em"),
        F.count_if(is_om).alias("n_om"),
        *picked,
        *truth,
    )
    ok = (F.col("n_em") <= 1) & (F.col("n_om") <= 1)
    return paired.where(F.col("n_em") > 0).select(
        *YEAR_KEYS,
        checked(ok, F.col("model_run")).alias("model_run"),
        checked(ok, F.lit(label)).cast("int").alias("label"),
        *[checked(ok, F.col(v)).alias(v) for v in values],
    )


def error_of(kind: str, em: Column, om: Column, both_zero: float | None = None,
             den_zero: str | float = "inf") -> Column:
    """One error measure; see `safe_ratio` for the zero rules."""
    if kind == "ratio":
        return safe_ratio(em, om, both_zero, den_zero)
    if kind == "inverse":
        return safe_ratio(om, em, both_zero, den_zero)
    if kind == "residual":
        return nan_to_null(em - om)
    if kind == "abs":
        return nan_to_null(F.abs(em - om))
    relative = safe_ratio(em - om, om, both_zero, den_zero)
    if kind == "re":
        return relative
    if kind == "ape":
        return F.abs(relative) * 100
    if kind == "bias":
        return relative * 100
    raise ValueError(f"unknown kind {kind!r}")


def compare(df: DataFrame, metrics: Metrics, kind: str, label: int | None = None,
            both_zero: float | None = None, den_zero: str | float = "inf",
            null_to: float | None = None) -> DataFrame:
    """Errors of every metric, one row per estimate row, under the metrics' names."""
    paired = pair(df, metrics, label)
    errors = []
    for m in metrics:
        e = error_of(kind, F.col(f"{m}_em"), F.col(f"{m}_om"), both_zero, den_zero)
        errors.append((e if null_to is None else F.coalesce(e, F.lit(float(null_to)))).alias(m))
    return paired.select(*YEAR_KEYS, "model_run", "label", *errors)


def ratio_all(df: DataFrame, metrics: Metrics | None = None, label: int | None = None,
              den_zero: str | float = 0.001) -> DataFrame:
    """Estimate over truth: 0/0 is 1, a zero truth becomes `den_zero`."""
    return compare(df, metrics or all_metrics(df), "ratio", label, 1.0, den_zero)


def ratio_all_long(df: DataFrame, metrics: Metrics | None = None) -> DataFrame:
    """`ratio_all` by unpivot, ratio and pivot; an independent cross-check.

    The cells of a row follow each other and the pivot has one accumulator a row, so that a task's
    memory holds a row once, and not a group for each of its cells.
    """
    metrics = metrics or all_metrics(df)
    paired = pair(df, metrics)
    cells = [
        F.struct(F.lit(i).alias("metric"), F.col(f"{m}_em").alias("em"), F.col(f"{m}_om").alias("om"))
        for i, m in enumerate(metrics)
    ]
    keys = [*YEAR_KEYS, "model_run", "label"]
    long = paired.select(*keys, F.inline(F.array(*cells)))
    long = long.withColumn("ratio", safe_ratio(F.col("em"), F.col("om"), 1.0, 0.001))
    # `pair` gives one row a run and key, so a cell is one value
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == i, F.col("ratio"))).alias(m) for i, m in enumerate(metrics)]
    )


def error_vs_truth_mean(df: DataFrame, metrics: Metrics, null_to: float = 0.0) -> DataFrame:
    """Relative error against the truth's mean per year, over scenarios and iterations.

    The few-row table of means is written once: the planner knows its size and broadcasts it,
    so the estimates are not shuffled by year.
    """
    kind = role(F.col("model_run"))
    cols = [c.cast("double").alias(m) for m, c in metrics.items()]
    truth = (
        df.where(kind == "OM")
        .select("year", *cols)
        .groupBy("year")
        .agg(*[strict_mean(m).alias(f"{m}_om") for m in metrics])
    )
    truth = stored(truth, "truth-means")
    em = df.where(labelled_estimate()).select(*YEAR_KEYS, "model_run", "label", *cols)
    errors = [
        F.coalesce(
            error_of("re", F.col(m), F.col(f"{m}_om")), F.lit(null_to)
        ).alias(m)
        for m in metrics
    ]
    return em.join(truth, "year", "left").select(*YEAR_KEYS, "model_run", "label", *errors)


def labelled_estimate() -> Column:
    """Estimates except the initial fit, which has no label year."""
    run = F.col("model_run")
    return (role(run) == "EM") & ~run.contains("init")


def strict_mean(col: str) -> Column:
    return F.when(F.count(col) == F.count(F.lit(1)), nan_to_null(F.avg(col))).otherwise(null_double())


def truth_mean_ratio(df: DataFrame, columns: list[str], event_years_of: int | None = None,
                     null_to: float | None = None) -> DataFrame:
    """Estimates over the truth's mean over iterations, by scenario, year and column.

    `event_years_of` keeps only the years in which the truth of that iteration has an
    event (F_5 > 0), scenario by scenario.
    """
    kind = role(F.col("model_run"))
    truth = to_long(df.where(kind == "OM"), columns, "fleet", "value", ["scenario", "year"])
    truth = truth.groupBy("scenario", "year", "fleet").agg(strict_mean("value").alias("om_value"))
    truth = stored(truth, "truth-means")
    em = df.where(labelled_estimate())
    if event_years_of is not None:
        events = df.where(
            (kind == "OM") & (F.col("iteration") == event_years_of) & (F.col("F_5") > 0)
        ).select("scenario", "year")
        events = stored(events, "event-years")
        em = em.join(events, ["scenario", "year"], "left_semi")
    long = to_long(em, columns, "fleet", "value",
                   [*YEAR_KEYS, "model_run", "label", "years_until_terminal"])
    ratio = safe_ratio(F.col("value"), F.col("om_value"))
    if null_to is not None:
        ratio = F.coalesce(ratio, F.lit(null_to))
    return long.join(truth, ["scenario", "year", "fleet"], "left").withColumn("ratio", ratio)


def f_over_fmsy_ratio(df: DataFrame, scalar: DataFrame, columns: list[str],
                      f_msy_om: float = 0.259) -> DataFrame:
    """(F / mean F_MSY of that estimate) / (truth's mean F / f_msy_om)."""
    f_msy = (
        scalar.where(labelled_estimate())
        .groupBy("scenario", "model_run")
        .agg(strict_mean("F_MSY").alias("mean_f_msy"))
    )
    f_msy = stored(f_msy, "f-msy")
    rel = truth_mean_ratio(df, columns).join(f_msy, ["scenario", "model_run"], "left")
    return rel.withColumn(
        "ratio",
        safe_ratio(
            safe_ratio(F.col("value"), F.col("mean_f_msy")),
            safe_ratio(F.col("om_value"), F.lit(f_msy_om)),
        ),
    )


def relative_ssb(ts: DataFrame, scalar: DataFrame, label: int, window: tuple[int, int],
                 keep_rows: bool = False) -> DataFrame:
    """Mean SSB over the window over the run's unfished SSB, per scenario and iteration.

    `keep_rows` repeats the value once per year of the window.
    """
    def of_label(df: DataFrame) -> DataFrame:
        return df.where(F.col("model_run").contains(str(label)))

    base = of_label(scalar).select("scenario", "iteration", "SSB_Unfished")
    mean = (
        of_label(ts)
        .where(F.col("year").between(*window))
        .groupBy("scenario", "iteration")
        .agg(strict_mean("SpawnBio").alias("mean_ssb"), F.count(F.lit(1)).alias("n_rows"))
    )
    out = mean.join(base, ["scenario", "iteration"], "left").select(
        "scenario",
        "iteration",
        safe_ratio(F.col("mean_ssb"), F.col("SSB_Unfished")).alias("relative_ssb"),
        "n_rows",
    )
    if keep_rows:
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
        return out.drop("row", "n_rows")
    return out.drop("n_rows")


def ssb_over_spr(ts: DataFrame, scalar: DataFrame, label: int) -> DataFrame:
    """Yearly SSB over the run's SSB at the reference SPR."""
    em = ts.where(F.col("model_run").contains(f"EM_{label}"))
    ref = scalar.select("scenario", "iteration", "model_run", "SSB_SPR")
    return em.join(ref, ["scenario", "iteration", "model_run"], "left").select(
        *YEAR_KEYS, "model_run", safe_ratio(F.col("SpawnBio"), F.col("SSB_SPR")).alias("ssb_spr")
    )


def unfished_over_spr(scalar: DataFrame, label: int) -> DataFrame:
    return scalar.where(F.col("model_run").contains(str(label))).select(
        "scenario", "iteration", "model_run",
        safe_ratio(F.col("SSB_Unfished"), F.col("SSB_SPR")).alias("unfished_spr"),
    )
