"""The registered queries: every operator on the panel derived from the driver's tables.

Parameters follow FIXTURES.md. A query takes (spark, sf_dir) and returns a DataFrame;
doubles are rounded at the end so that they compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import names
from runlens.functions.semantics import (
    ROW_KEYS,
    YEAR_KEYS,
    metric_columns,
    nan_to_null,
    role,
    rounded,
)
from runlens.operators import compare as cmp
from runlens.operators import curate, derive, report
from runlens.operators import summarise as sm
from runlens.plans import sampling, scenarios, schedules
from runlens.sources import fixtures as fx
from runlens.sources.reports import KINDS, report_long, write_reports
from runlens.sources.scratch import scratch_dir
from runlens.sources.summary import (
    Summary,
    load_run_reports,
    load_summary,
    normalise_names,
    read_table,
    write_summary,
    write_table,
)

LABEL = 2001
EARLY_LABEL = 1998
START = 1996
SHORT = (1996, 1998)
LONG = (1996, 2001)
REFERENCE = "rt_2_x_rt_2"
EVENT_YEARS = [1995, 1998, 2000]
END_YEAR = 2001
N_YEARS = 51
AFTER = 1996
FLEET_F = [f"F_{f}" for f in range(1, 6)]
BIOMASS = [f"retainB_{f}" for f in range(1, 5)] + ["deadB_5"]
KEEP = ["iteration", "year", "model_run", "label", "years_until_terminal"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- the prepared tables -------------------------------------------------------------


def _ts(spark: SparkSession, d: str) -> DataFrame:
    return curate.prepare_runs(fx.ts(spark, d), curate.scenario_dim(spark))


def _ts_uncut(spark: SparkSession, d: str) -> DataFrame:
    return curate.prepare_runs(fx.ts(spark, d), offset=0, min_gap=None)


def _dq(spark: SparkSession, d: str) -> DataFrame:
    return curate.prepare_runs(normalise_names(fx.dq(spark, d)), curate.scenario_dim(spark))


def _scalar(spark: SparkSession, d: str) -> DataFrame:
    return curate.prepare_scalar(fx.scalar(spark, d), curate.scenario_dim(spark))


def _is_om() -> Column:
    return role(F.col("model_run")) == "OM"


def _of_label(df: DataFrame, label: int = LABEL) -> DataFrame:
    """Estimates of one label year."""
    return df.where((role(F.col("model_run")) == "EM") & (F.col("label") == label))


def _n_iterations(df: DataFrame) -> Column:
    return df.select(F.count_distinct("iteration")).scalar()


def _gap(offset: int = 3) -> Column:
    return F.col("label") + offset - F.col("year")


def _cols(columns: list[str]) -> cmp.Metrics:
    return {c: F.col(c) for c in columns}


def _in_windows(df: DataFrame) -> DataFrame:
    """Tag rows with each window they fall in; one pass for both windows."""
    tags = F.array_compact(
        F.array(
            F.when(F.col("year").between(*LONG), "long"),
            F.when(F.col("year").between(*SHORT), "short"),
        )
    )
    return df.withColumn("window", F.explode(tags))


# ---- A. load and curate --------------------------------------------------------------


@query
def load_summary_dq(spark, d):
    root = scratch_dir(spark, "summary")
    write_summary(fx.summary(spark, d), root)
    return rounded(load_summary(spark, root).dq.select(*ROW_KEYS, "Value_SSB", "Value_Recr",
                                                       "Value_SPRratio", "Value_Bratio", "Value_F"))


@query
def prepare_ts(spark, d):
    return rounded(_ts(spark, d))


@query
def prepare_dq(spark, d):
    return rounded(_dq(spark, d))


@query
def prepare_scalar(spark, d):
    return rounded(_scalar(spark, d))


@query
def prepare_ts_uncut(spark, d):
    return rounded(_ts_uncut(spark, d))


@query
def scenario_order(spark, d):
    counts = _ts(spark, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"))
    return curate.with_ordinal(counts, curate.scenario_dim(spark)).orderBy("ordinal")


@query
def split_roles(spark, d):
    df = curate.with_role(fx.ts(spark, d).select(*ROW_KEYS))
    return df.groupBy("scenario", "model_run", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("year").alias("n_years")
    )


@query
def latest_runs(spark, d):
    return rounded(curate.latest_runs(_ts_uncut(spark, d)).select(*ROW_KEYS, "SpawnBio", "F_5"))


@query
def latest_runs_by_number(spark, d):
    picked = derive.retained_total(curate.latest_runs_by_number(_ts_uncut(spark, d)))
    return rounded(picked.select(*ROW_KEYS, "max_number", "retainB_all"))


@query
def merge_summaries(spark, d):
    s = Summary(_ts(spark, d), _dq(spark, d), _scalar(spark, d))
    merged = curate.merge_summaries(
        s.map(lambda df: df.drop("F_4", "Value_F", "max_grad")),
        s,
        drop=r"flat_rt_2$",
        rename=[("_all_yrs", "_34_all_yrs"), ("_rt_2", "_rt_34")],
    )
    return rounded(merged.ts.select(*ROW_KEYS, "F_4", "F_5", "SpawnBio"))


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    return _ts(spark, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def parse_scenario(spark, d):
    base = curate.parse_scenario(_scenarios(spark, d))
    wide = names.estimator_name(F.col("scenario"), names.DESIGN_SUFFIXES)
    return base.withColumns(
        {
            "em_name_wide": wide,
            "om_ordinal": names.level_ordinal(F.col("om_name"), names.TRUTH_LEVELS),
            "em_ordinal": names.level_ordinal(F.col("em_name"), names.ESTIMATOR_LEVELS),
        }
    )


@query
def parse_scenario_parts(spark, d):
    return curate.parse_scenario_parts(_scenarios(spark, d))


@query
def classify_design(spark, d):
    base = curate.classify_design(_scenarios(spark, d))
    high = names.design_class(F.col("scenario"), "high")
    return base.withColumns({f"{k}_high": v for k, v in high.items()})


def _reports(spark: SparkSession, d: str) -> str:
    path = f"{scratch_dir(spark, 'reports')}/natage"
    write_table(fx.at_age(spark, d), path, ("scenario", "run"))
    return path


@query
def load_run_reports_latest(spark, d):
    return rounded(load_run_reports(spark, _reports(spark, d), run_suffix=f"_EM_{LABEL}"))


@query
def load_run_reports_truth(spark, d):
    return rounded(load_run_reports(spark, _reports(spark, d), truth=True))


@query
def at_age_long(spark, d):
    keep = ["scenario", "iteration", "run", "Yr", "fleet"]
    long = derive.at_age_long(fx.at_age(spark, d), keep, "n", where=F.col("beg_mid") == "B")
    return rounded(
        long.groupBy("scenario", "run", "Yr", "fleet", "age").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n").cast("bigint")).alias("total")
        )
    )


def _report_long(spark: SparkSession, d: str, kind: str) -> DataFrame:
    root = scratch_dir(spark, "reports")
    source = KINDS[kind].source
    write_reports({source: fx.reports(spark, d)[source]}, root)
    return rounded(report_long(spark, root, kind, f"_EM_{LABEL}"))


@query
def natage_long(spark, d):
    return _report_long(spark, d, "natage")


@query
def batage_long(spark, d):
    return _report_long(spark, d, "batage")


@query
def catage_long(spark, d):
    return _report_long(spark, d, "catage")


@query
def age_selectivity_long(spark, d):
    return _report_long(spark, d, "age_selectivity")


@query
def size_selectivity_long(spark, d):
    return _report_long(spark, d, "size_selectivity")


@query
def dead_selectivity_long(spark, d):
    return _report_long(spark, d, "dead_selectivity")


@query
def prepare_ts_by_label(spark, d):
    """The series stored by scenario and label; one label's estimates are read."""
    path = f"{scratch_dir(spark, 'summary')}/ts"
    write_table(curate.with_label(fx.ts(spark, d)), path, ("scenario", "label"))
    stored_ts = read_table(spark, path, ("scenario", "label"))
    return rounded(_of_label(curate.prepare_runs(stored_ts, curate.scenario_dim(spark))))


# ---- B. reshape and derive -----------------------------------------------------------


@query
def fleet_long(spark, d):
    return rounded(derive.fleet_long(_ts(spark, d), "F_", ROW_KEYS))


@query
def removals_by_sector(spark, d):
    return rounded(derive.sectors(_ts(spark, d), ROW_KEYS))


@query
def removals_by_sector_in_events(spark, d):
    return rounded(derive.sectors(_of_label(_ts(spark, d)), ROW_KEYS, positive_only=True))


@query
def retained_total(spark, d):
    return rounded(derive.retained_total(_ts(spark, d)).select(*ROW_KEYS, "retainB_all"))


@query
def retention_params(spark, d):
    return rounded(derive.retention_params(_scalar(spark, d)))


def _latest_or_truth(df: DataFrame) -> DataFrame:
    return df.where(F.col("model_run").rlike(f"{LABEL}|OM"))


LENGTHS = 100


@query
def retention_curves(spark, d):
    curves = derive.retention_curves(derive.retention_params(_scalar(spark, d)))
    return rounded(sm.summarise(curves, ["scenario", "fleet", "x"], "y",
                                {"n": "n", "mean_y": "mean", "max_y": "max"}))


@query
def retention_median(spark, d):
    params = derive.retention_params(_latest_or_truth(_scalar(spark, d)))
    curves = derive.retention_blocks(params.where(~F.col("fleet").contains("BLK")), LENGTHS, 8)
    return rounded(sm.summarise_blocks(curves, ["scenario", "fleet", "model_run"], "x", [f"y{i}" for i in range(8)],
                                       LENGTHS, {"median_y": "median"}))


@query
def age_selectivity(spark, d):
    return rounded(derive.age_selectivity(_scalar(spark, d)))


@query
def unfished_recruits(spark, d):
    return rounded(derive.unfished_recruits(_scalar(spark, d)))


@query
def unfished_recruits_ratio(spark, d):
    return rounded(derive.unfished_recruits_ratio(_scalar(spark, d), LABEL))


@query
def term_series(spark, d):
    return rounded(derive.term_series(_ts(spark, d), _dq(spark, d)))


@query
def term_series_short(spark, d):
    return rounded(derive.term_series(_ts(spark, d), _dq(spark, d), labels=[EARLY_LABEL]))


# ---- C. estimates versus truth -------------------------------------------------------


@query
def relative_error_all(spark, d):
    ts = _ts(spark, d)
    re = cmp.compare(ts, cmp.all_metrics(ts), "re", both_zero=1.0)
    return rounded(
        re.withColumns(
            {
                "F_commercial": nan_to_null(F.col("F_1") + F.col("F_2")),
                "retain_commercial": nan_to_null(F.col("retainB_1") + F.col("retainB_2")),
            }
        )
    )


def _nine() -> cmp.Metrics:
    return cmp.named_metrics("retainB_") | cmp.mortality_metrics()


@query
def relative_error_named(spark, d):
    return rounded(cmp.compare(_ts(spark, d), _nine(), "re", LABEL, null_to=0.0))


@query
def ratio_all(spark, d):
    return rounded(cmp.ratio_all(_ts(spark, d)))


@query
def ratio_all_long(spark, d):
    return rounded(cmp.ratio_all_long(_ts(spark, d)))


@query
def ratio_all_dq(spark, d):
    return rounded(cmp.ratio_all(_dq(spark, d), den_zero="inf"))


@query
def residuals(spark, d):
    return rounded(cmp.compare(_ts(spark, d), cmp.named_metrics(), "residual", LABEL))


@query
def absolute_error(spark, d):
    return rounded(cmp.compare(_ts(spark, d), cmp.named_metrics("retainB_"), "abs", LABEL))


@query
def absolute_pct_error(spark, d):
    return rounded(cmp.compare(_ts(spark, d), _nine(), "ape", LABEL, null_to=0.0))


def _bias(spark: SparkSession, d: str, kind: str = "bias") -> DataFrame:
    return cmp.compare(_ts(spark, d), cmp.named_metrics(), kind, LABEL)


@query
def percent_bias(spark, d):
    return rounded(_bias(spark, d))


@query
def percent_bias_numbers(spark, d):
    catch = cmp.named_metrics("deadN_")
    picked = {m: catch[m] for m in ("commercial", "recreational")}
    return rounded(cmp.compare(_ts(spark, d), picked, "bias", LABEL))


@query
def om_em_ratio(spark, d):
    return rounded(_bias(spark, d, "inverse"))


@query
def bratio_bias(spark, d):
    bias = cmp.compare(_dq(spark, d), _cols(["Value_Bratio"]), "bias", LABEL)
    return rounded(
        curate.parse_scenario(
            sm.iteration_mean(bias, ["scenario", "iteration"], "Value_Bratio", SHORT)
        ), 4
    )


@query
def ref_error_vs_om_mean(spark, d):
    metrics = {k: v for k, v in _nine().items() if k != "abundance"}
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    return rounded(cmp.error_vs_truth_mean(ts, metrics))


def _mean_band(df: DataFrame, keys: list[str], center: str) -> DataFrame:
    """A centre with one sd around it, by keys."""
    out = sm.summarise(df, keys, "ratio", {f"{center}_ratio": center, "sd_ratio": "sd"})
    mid, sd = F.col(f"{center}_ratio"), F.col("sd_ratio")
    return out.withColumns({"ymin": mid - sd, "ymax": mid + sd})


@query
def event_year_ratio(spark, d):
    cols = ["retainB_1", "retainB_2", "retainB_4", "deadB_1", "deadB_2", "deadB_4"]
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    ratio = cmp.truth_mean_ratio(ts, cols, event_years_of=1, null_to=0.0)
    return rounded(_mean_band(ratio, ["scenario", "fleet", "years_until_terminal"], "mean"))


@query
def f_ratio_vs_om_mean(spark, d):
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    band = _mean_band(cmp.truth_mean_ratio(ts, FLEET_F), ["scenario", "year", "fleet"], "mean")
    return rounded(band.where(F.col("mean_ratio").isNotNull()))


@query
def f_over_fmsy_ratio(spark, d):
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    ratio = cmp.f_over_fmsy_ratio(ts, _scalar(spark, d), FLEET_F)
    ratio = ratio.where(F.col("years_until_terminal") > 0)
    return rounded(_mean_band(ratio, ["scenario", "fleet", "years_until_terminal"], "median"))


@query
def relative_ssb(spark, d):
    out = cmp.relative_ssb(_ts(spark, d), _scalar(spark, d), LABEL, SHORT)
    return rounded(curate.parse_scenario(out))


@query
def relative_ssb_rows(spark, d):
    return rounded(cmp.relative_ssb(_ts(spark, d), _scalar(spark, d), LABEL, SHORT, keep_rows=True))


@query
def ssb_over_ssb_spr(spark, d):
    return rounded(cmp.ssb_over_spr(_ts(spark, d), _scalar(spark, d), LABEL), 4)


@query
def unfished_over_ssb_spr(spark, d):
    return rounded(cmp.unfished_over_spr(_scalar(spark, d), LABEL), 4)


# ---- D. distribution summaries -------------------------------------------------------


_F5_STATS = {"mean_F_5": "mean", "sd_F_5": "sd", "median_F_5": "median"}


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Years of the projection with an event, in truth and latest runs."""
    latest = curate.latest_runs(_ts(spark, d))
    return latest.where((F.col("F_5") > 0) & (F.col("year") >= START))


@query
def event_intensity(spark, d):
    stats = sm.summarise(_event_rows(spark, d), ["model_run", "scenario"], "F_5", _F5_STATS)
    return stats.withColumns({c: F.bround(c, 3) for c in metric_columns(stats)})


@query
def event_intensity_iter(spark, d):
    rows = _event_rows(spark, d).where(F.col("year") <= SHORT[1])
    keys = ["scenario", "iteration", "model_run"]
    return rounded(sm.summarise(rows, keys, "F_5", _F5_STATS, bounded=True).orderBy("scenario", "iteration"))


@query
def stat_lines(spark, d):
    ts = _ts(spark, d)
    return rounded(sm.stat_lines(ts, metric_columns(ts)), 5, {"sd": 4})


@query
def stat_lines_latest(spark, d):
    ts = _ts(spark, d)
    return rounded(sm.stat_lines(ts, ["F_5", "SpawnBio", "Recruit_0"], LABEL), 5, {"sd": 4})


@query
def stat_lines_dq(spark, d):
    dq = _dq(spark, d)
    return rounded(sm.stat_lines(dq, metric_columns(dq)), 5, {"sd": 4})


def _ratio_long(df: DataFrame, columns: list[str], label: int | None = LABEL) -> DataFrame:
    """Ratios of the projection in long form: keys, variable, ratio."""
    wide = cmp.ratio_all(df.where(F.col("year") >= START), _cols(columns), label)
    keep = [*ROW_KEYS, "label"]
    return derive.to_long(wide, columns, "variable", "ratio", keep).withColumn(
        "years_until_terminal", _gap()
    )


def _closed_fleet_is_one(df: DataFrame, variable: str) -> DataFrame:
    """The closed fleet removes nothing: its ratio is 1 by definition."""
    return df.withColumn(
        "ratio", F.when(F.col("variable") == variable, F.lit(1.0)).otherwise(F.col("ratio"))
    )


def _ribbon(df: DataFrame) -> DataFrame:
    return rounded(sm.summarise(df, ["scenario", "year", "variable"], "ratio", sm.RIBBON), 4)


def _terminal_ribbon(df: DataFrame) -> DataFrame:
    ahead = df.where(F.col("years_until_terminal") > 0)
    keys = ["scenario", "years_until_terminal", "variable"]
    return rounded(sm.summarise(ahead, keys, "ratio", sm.TERMINAL_RIBBON), 4)


@query
def ratio_ribbon_f(spark, d):
    return _ribbon(_closed_fleet_is_one(_ratio_long(_ts(spark, d), FLEET_F), "F_3"))


@query
def ratio_ribbon_event_f(spark, d):
    return _ribbon(_ratio_long(_ts(spark, d), ["F_5"]))


@query
def terminal_group(spark, d):
    gap = _of_label(_ts(spark, d)).where(F.col("year") >= START).withColumn(
        "years_group", sm.terminal_group(F.col("years_until_terminal"))
    )
    return gap.select(*ROW_KEYS, "years_until_terminal", "years_group")


@query
def ratio_ribbon_biomass(spark, d):
    return _ribbon(_closed_fleet_is_one(_ratio_long(_ts(spark, d), BIOMASS), "retainB_3"))


@query
def ratio_ribbon_recruit_ssb(spark, d):
    return _ribbon(_ratio_long(_ts(spark, d), ["Recruit_0", "SpawnBio"]))


@query
def ratio_ribbon_dq_f(spark, d):
    wide = cmp.ratio_all(
        _dq(spark, d).where(F.col("year") >= START), _cols(["Value_F"]), LABEL, den_zero="inf"
    )
    return rounded(sm.summarise(wide, ["scenario", "year"], "Value_F", sm.RIBBON), 4)


@query
def terminal_ribbon_f(spark, d):
    long = _ratio_long(_ts(spark, d), FLEET_F, None)
    return _terminal_ribbon(_closed_fleet_is_one(long, "F_3"))


@query
def terminal_ribbon_event_f(spark, d):
    return _terminal_ribbon(_ratio_long(_ts(spark, d), ["F_5"], None))


@query
def ratio_all_unfloored(spark, d):
    return rounded(cmp.ratio_all(_ts(spark, d), _cols([*FLEET_F, *BIOMASS]), den_zero="inf"))


@query
def terminal_ribbon_biomass(spark, d):
    long = _ratio_long(_ts(spark, d), BIOMASS, None)
    return _terminal_ribbon(_closed_fleet_is_one(long, "retainB_3"))


@query
def terminal_ribbon_recruit_ssb(spark, d):
    return _terminal_ribbon(_ratio_long(_ts(spark, d), ["Recruit_0", "SpawnBio"], None))


@query
def level_ribbon(spark, d):
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    em = ts.where(cmp.labelled_estimate())
    columns = [*FLEET_F, *BIOMASS, "Recruit_0", "SpawnBio"]
    long = derive.to_long(em, columns, "variable", "value", ["scenario", "year"])
    stats = {"median_value": 0.5, "lower_quartile": 0.25, "upper_quartile": 0.75}
    ribbon = sm.summarise(long, ["scenario", "year", "variable"], "value", stats)
    events = (
        ts.where(_is_om() & (F.col("iteration") == 1) & (F.col("F_5") > 0))
        .select("scenario", "year")
        .distinct()
        .withColumn("is_event_year", F.lit(True))
    )
    out = ribbon.join(events, ["scenario", "year"], "left")
    return rounded(out.fillna(False, "is_event_year"))


@query
def event_year_match(spark, d):
    rows = curate.latest_runs(_ts(spark, d)).where(F.col("year") >= START)
    return sm.event_year_match(rows)


_SECTORS = ["commercial", "recreational", "event_dead"]


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    metrics = {m: c for m, c in cmp.named_metrics().items() if m in _SECTORS}
    return cmp.compare(_ts(spark, d), metrics, "residual", LABEL)


def _residual_sums(res: DataFrame, n: Column) -> DataFrame:
    sums = [(sm.strict_sum(s) / n).alias(f"sum_{s}") for s in _SECTORS]
    return rounded(_in_windows(res).groupBy("window", "scenario").agg(*sums), 4)


@query
def residual_sums(spark, d):
    return _residual_sums(_residuals(spark, d), _n_iterations(_ts(spark, d)))


@query
def residual_sums_matched(spark, d):
    res = _residuals(spark, d).where(F.col("commercial").isNotNull())
    return _residual_sums(res, _n_iterations(_ts(spark, d)))


def _sector_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of the short window that have a truth, with both sides' removals."""
    metrics = {m: c for m, c in cmp.named_metrics().items() if m in _SECTORS}
    paired = cmp.pair(_ts(spark, d), metrics, LABEL)
    return paired.where(F.col("year").between(*SHORT) & F.col("commercial_om").isNotNull())


@query
def residual_share(spark, d):
    n = _n_iterations(_ts(spark, d))
    return rounded(sm.residual_share(_sector_pairs(spark, d), n), 4)


@query
def residual_mean_share(spark, d):
    return rounded(sm.residual_share(_sector_pairs(spark, d), how="mean"), 4)


@query
def mean_t_interval(spark, d):
    keep = ["scenario", "year"]
    long = derive.to_long(_residuals(spark, d), _SECTORS, "variable", "value", keep)
    return rounded(sm.t_interval(long, [*keep, "variable"], "value"), 4)


@query
def mean_t_interval_by_design(spark, d):
    ape = cmp.compare(_ts(spark, d), _nine(), "ape", LABEL, null_to=0.0)
    shown = ["ssb", "commercial", "recreational", "abundance"]
    keep = ["om_class", "em_class", "year"]
    long = derive.to_long(curate.classify_design(ape), shown, "variable", "value", keep)
    return rounded(sm.t_interval(long, [*keep, "variable"], "value"), 4)


def _levels_long(df: DataFrame) -> DataFrame:
    """Removals by sector, recruits and SSB of one label's estimates in the window."""
    rows = _of_label(df).where(F.col("year").between(*SHORT)).select(
        "scenario",
        "iteration",
        (F.col("deadB_1") + F.col("deadB_2")).alias("commercial"),
        F.col("deadB_4").alias("recreational"),
        F.col("deadB_5").alias("event"),
        F.col("Recruit_0").alias("recruits"),
        F.col("SpawnBio").alias("ssb"),
    )
    cols = ["commercial", "recreational", "event", "recruits", "ssb"]
    return derive.to_long(rows, cols, "type", "value", ["scenario", "iteration"])


_TYPED = ["scenario", "type", "iteration"]


def _level_means(spark: SparkSession, d: str) -> DataFrame:
    return sm.iteration_mean(_levels_long(_ts(spark, d)), _TYPED, "value")


@query
def iteration_mean(spark, d):
    return rounded(curate.parse_scenario(_level_means(spark, d)))


def _error_means(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Iteration means of an error measure, long by type."""
    types = ["commercial", "recreational", "recruits", "ssb"]
    err = _bias(spark, d, kind).where(F.col("year").between(*SHORT))
    long = derive.to_long(err, types, "type", "value", ["scenario", "iteration"])
    return sm.iteration_mean(long, _TYPED, "value")


@query
def reference_median(spark, d):
    levels = sm.reference_median(_level_means(spark, d), ["type"], REFERENCE)
    return rounded(levels)


def _reference_error_median(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Reference median of the finite iteration means of an error measure."""
    means = _error_means(spark, d, kind).where(F.abs("mean_value") < float("inf"))
    return rounded(sm.reference_median(means, ["type"], REFERENCE), 4)


@query
def reference_median_bias(spark, d):
    return _reference_error_median(spark, d, "bias")


@query
def reference_median_ratio(spark, d):
    return _reference_error_median(spark, d, "inverse")


@query
def self_reference_median(spark, d):
    means = curate.parse_scenario(_level_means(spark, d))
    return rounded(sm.self_reference_median(means, ["type"]))


@query
def iteration_mean_bias(spark, d):
    return rounded(curate.parse_scenario(_error_means(spark, d, "bias")), 4)


@query
def iteration_mean_om_em(spark, d):
    return rounded(curate.parse_scenario(_error_means(spark, d, "inverse")), 4)


@query
def boxplot_removals(spark, d):
    means = curate.parse_scenario(_level_means(spark, d))
    return rounded(sm.boxplot_stats(means, ["type", "em_name", "om_name"], "mean_value"), 5)


def _relative_error_long(spark: SparkSession, d: str) -> DataFrame:
    metrics = cmp.named_metrics("retainB_") | cmp.mortality_metrics()
    ts = _ts(spark, d).where(F.col("year") >= START)
    re = cmp.compare(ts, metrics, "re", both_zero=1.0)
    return derive.to_long(re, list(metrics), "variable", "value", ["scenario"])


@query
def boxplot_relative_error(spark, d):
    return rounded(sm.boxplot_stats(_relative_error_long(spark, d), ["scenario", "variable"], "value"))


@query
def boxplot_outliers(spark, d):
    return rounded(sm.boxplot_outliers(_relative_error_long(spark, d), ["scenario", "variable"], "value"))


@query
def boxplot_unfished_recruits(spark, d):
    r0 = derive.unfished_recruits(_scalar(spark, d))
    return rounded(sm.boxplot_stats(r0, ["scenario"], "r0"))


def _truth_levels(spark: SparkSession, d: str) -> DataFrame:
    om = _ts(spark, d).where(_is_om()).where(F.col("year").between(*LONG))
    return curate.parse_scenario(om).withColumn("Recreational", F.col("deadB_4"))


@query
def median_interval95(spark, d):
    rows = _truth_levels(spark, d)
    keys = ["om_name", "em_name", "year"]
    return rounded(sm.summarise(rows, keys, "Recreational", sm.INTERVAL95))


@query
def bias_interval95(spark, d):
    bias = cmp.compare(_ts(spark, d), {"ssb": F.col("SpawnBio")}, "bias", LABEL)
    rows = bias.where(F.col("year").between(*LONG))
    return rounded(sm.summarise(rows, ["scenario", "year"], "ssb", sm.INTERVAL95), 5)


@query
def median_interval_with_samples(spark, d):
    parts = curate.parse_scenario_parts(
        _ts(spark, d).where(_is_om()).where(F.col("year").between(*LONG))
    )
    keys = ["om_name", "em_name", "year"]
    summary = sm.summarise(parts, keys, "deadB_4", sm.INTERVAL95).withColumn("kind", F.lit("summary"))
    lines = parts.where(F.col("iteration").between(1, 5)).select(
        *keys, "iteration", F.col("deadB_4").alias("value"), F.lit("sample").alias("kind")
    )
    return rounded(summary.unionByName(lines, allowMissingColumns=True))


def _chosen_years(df: DataFrame) -> DataFrame:
    return df.where(F.col("year").isin(EVENT_YEARS))


@query
def event_year_levels(spark, d):
    rows = _chosen_years(_latest_or_truth(_ts(spark, d)))
    return rounded(sm.boxplot_stats(rows, ["scenario", "year", "model_run"], "F_5"))


@query
def event_histogram(spark, d):
    ts = _chosen_years(_ts(spark, d))
    keys = ["scenario", "year"]
    bars = sm.histogram(ts.where(role(F.col("model_run")) == "EM"), keys, "F_5")
    means = ts.groupBy(*keys).agg(
        F.avg(F.when(_is_om(), F.col("F_5"))).alias("om_mean"),
        F.avg(F.when(~_is_om(), F.col("F_5"))).alias("em_mean"),
    )
    return rounded(bars.join(means, keys, "left"))


@query
def event_magnitude(spark, d):
    ts = _ts_uncut(spark, d).where(F.col("year") >= START)
    size = ts.where(cmp.labelled_estimate()).groupBy("scenario").agg(
        F.sum("F_5").alias("F_5_sum"), F.sum("deadB_5").alias("catch_sum")
    )
    years = ts.where(_is_om() & (F.col("iteration") == 1) & (F.col("F_5") > 0))
    counts = years.groupBy("scenario").agg(F.count_distinct("year").alias("n_years"))
    return rounded(counts.join(size, "scenario", "right"), 4)


@query
def compare_iterations(spark, d):
    stats = sm.summarise(
        curate.with_role(_event_rows(spark, d)), ["scenario", "iteration", "role"], "F_5", _F5_STATS,
        bounded=True,  # years of one run
    )
    wide = stats.groupBy("scenario", "iteration").pivot("role", ["EM", "OM"]).agg(
        *[F.first(c).alias(c) for c in _F5_STATS]
    )
    return rounded(wide)


@query
def compare_event_years(spark, d):
    rows = curate.with_role(_event_rows(spark, d))
    wide = rows.groupBy(*YEAR_KEYS).pivot("role", ["EM", "OM"]).agg(F.first("F_5"))
    return rounded(wide.withColumnsRenamed({"EM": "EM_F_5", "OM": "OM_F_5"}))


@query
def convergence_check(spark, d):
    return rounded(
        _scalar(spark, d).select(
            "scenario",
            "iteration",
            "model_run",
            F.regexp_substr("model_run", F.lit(r"\d+")).alias("model_run_year"),
            "max_grad",
            (F.col("max_grad") > 1).alias("above_limit"),
        )
    )


@query
def convergence_failures(spark, d):
    return _scalar(spark, d).where(F.col("max_grad") > 1).select("iteration", "model_run", "scenario")


@query
def iteration_sums(spark, d):
    sums = sm.summarise(_levels_long(_ts(spark, d)), _TYPED, "value", {"sum_value": "sum"}, strict=True)
    shown = sums.where((F.col("type") != "event") | (F.col("sum_value") > 0))
    return rounded(curate.parse_scenario(shown))


@query
def at_age_median(spark, d):
    rows = fx.at_age(spark, d).where(
        (F.col("beg_mid") == "B") & (F.col("Yr") == EARLY_LABEL)
        & F.col("run").rlike(f"_EM_{LABEL}$|_OM")
    )
    rows = rows.withColumn("role", role(F.col("run")))
    keep = ["scenario", "role", "fleet"]
    long = derive.at_age_long(rows, keep, "n")
    out = sm.summarise(long, [*keep, "age"], "n", {"median_n": "median"})
    return rounded(out.withColumn("is_highlighted", F.col("scenario") == REFERENCE))


def _index_long(spark: SparkSession, d: str) -> DataFrame:
    """Both models' indices in long form; missing values dropped."""
    cpue = fx.cpue(spark, d)
    both = cpue.where(F.col("model").isin("EM", "OM"))
    keep = ["fleet_name", "scenario", "model", "yr"]
    return derive.to_long(both, ["obs", "exp"], "series", "value", keep).where(
        F.col("value").isNotNull()
    )


_INDEX_KEYS = ["fleet_name", "scenario", "model", "yr", "series"]


@query
def index_median(spark, d):
    return rounded(sm.summarise(_index_long(spark, d), _INDEX_KEYS, "value", {"median_value": "median"}))


@query
def index_median_zoomed(spark, d):
    rows = _index_long(spark, d).where(
        (F.col("fleet_name") == "click") & F.col("yr").between(2, 10)
    )
    return rounded(sm.summarise(rows, _INDEX_KEYS, "value", {"median_value": "median"}))


@query
def ratio_by_design(spark, d):
    columns = ["SpawnBio", "Recruit_0", "SPRratio", "rec_dev"]
    wide = cmp.ratio_all(_ts(spark, d), _cols(columns), LABEL)
    wide = curate.classify_design(wide, "high")
    keep = ["om_class", "em_class", "scenario", "year"]
    long = derive.to_long(wide, columns, "variable", "value", keep)
    return rounded(sm.summarise(long, [*keep, "variable"], "value", {"median_ratio": "median"}), 4)


# ---- E. plans and schedules ----------------------------------------------------------


@query
def catch_se_plan(spark, d):
    observed = fx.plan_catch(spark, d)
    plan = sampling.future_rows(observed.select("fleet"), END_YEAR, N_YEARS)
    return rounded(sampling.catch_se_plan(plan, observed, [1, 2, 4], AFTER))


@query
def index_plan(spark, d):
    return rounded(sampling.index_plan(fx.plan_index(spark, d), END_YEAR, N_YEARS, after=AFTER))


@query
def discard_plan(spark, d):
    plan = sampling.future_rows(fx.plan_catch(spark, d).select("fleet"), END_YEAR, N_YEARS)
    return sampling.discard_plan(plan.withColumnRenamed("fleet", "fltsvy"), [3])


@query
def length_plan(spark, d):
    return rounded(sampling.length_plan(fx.plan_comps(spark, d), END_YEAR, N_YEARS))


@query
def age_plan(spark, d):
    return rounded(sampling.age_plan(fx.plan_comps(spark, d), END_YEAR, N_YEARS))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Truth models of the panel that are selectivity shapes."""
    parsed = curate.parse_scenario(_scenarios(spark, d))
    return parsed.where(F.col("om_name").isin(names.SHAPES)).select(F.col("om_name").alias("model"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return scenarios.scenario_grid(_models(spark, d), "_rt_2")


@query
def scenario_grid(spark, d):
    return rounded(_grid(spark, d))


@query
def regular_schedule(spark, d):
    return schedules.regular_schedule(fx.years(spark, d), 2, 0.2)


@query
def random_schedule(spark, d):
    return schedules.random_schedule(fx.years(spark, d), 3, 0.2, 12345)


@query
def balanced_random_schedule(spark, d):
    return rounded(
        schedules.balanced_random_schedule(
            fx.years(spark, d), fx.iterations(spark, d), 2, 0.05, 0.25, 0.1, 12345
        )
    )


@query
def scaled_schedule(spark, d):
    base = schedules.regular_schedule(fx.years(spark, d), 3, 0.1)
    return rounded(scenarios.scaled_schedule(base, _grid(spark, d)))


@query
def scaled_random_schedule(spark, d):
    """The random schedule of every scenario; the estimate knows it with a large error, fixed."""
    base = schedules.random_schedule(fx.years(spark, d), 3, 0.1, 12345)
    return rounded(scenarios.scaled_schedule(base, _grid(spark, d), catch_se=0.5, fixed=1))


@query
def frequency_tables(spark, d):
    comps = fx.plan_comps(spark, d)
    catch = fx.plan_catch(spark, d).withColumn("se_class", F.bround("catch_se", 3))
    by_part = sampling.frequency_table(comps, ["fltsvy", "part"]).select(
        F.lit("fleet_part").alias("table_name"),
        F.col("fltsvy").cast("string").alias("a"),
        F.col("part").cast("string").alias("b"),
        "n",
    )
    by_season = sampling.frequency_table(comps, ["seas"]).select(
        F.lit("season").alias("table_name"),
        F.col("seas").cast("string").alias("a"),
        F.lit("").alias("b"),
        "n",
    )
    by_se = sampling.frequency_table(catch, ["fleet", "se_class"]).select(
        F.lit("fleet_se").alias("table_name"),
        F.col("fleet").cast("string").alias("a"),
        F.format_number("se_class", 3).alias("b"),
        "n",
    )
    return by_part.unionByName(by_season).unionByName(by_se)


@query
def scenario_label(spark, d):
    dim = curate.scenario_dim(spark).join(_scenarios(spark, d), "scenario", "left_semi")
    return scenarios.scenario_label(dim)


# ---- F. output -----------------------------------------------------------------------

REPORT_LABELS = {
    "scenario": "Scenario",
    "share_commercial": "Commercial residual, % of true removals",
    "share_recreational": "Recreational residual, % of true removals",
    "share_event": "Event residual, % of true removals",
    "total_residual": "Residual of all removals per iteration",
    "share_total": "All residuals, % of true removals",
}


@query
def report_table(spark, d):
    share = sm.residual_share(_sector_pairs(spark, d), _n_iterations(_ts(spark, d)))
    return report.report_table(share, REPORT_LABELS, 2, curate.scenario_dim(spark))


@query
def report_table_text(spark, d):
    table = report_table(spark, d)
    path = f"{scratch_dir(spark, 'reports')}/shares"
    report.write_report(table, path)
    return report.read_report(table, path)


@query
def write_summary_scalar(spark, d):
    root = scratch_dir(spark, "summary")
    write_summary(fx.summary(spark, d), root)
    return rounded(load_summary(spark, root).scalar)
