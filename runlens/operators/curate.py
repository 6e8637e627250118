"""Load-time curation: drop unusable runs, label the rest, pick and name runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import names
from runlens.functions.semantics import label_year, role
from runlens.sources.literals import literal_table
from runlens.sources.summary import Summary


def scenario_groups() -> dict[str, list[str]]:
    """The named scenario groups; shape designs are generated from their rule."""
    pairs = [(a, b) for a in names.SHAPES for b in names.SHAPES]
    groups = {"core": names.CORE_SCENARIOS, "all_years": names.EVERY_YEAR_SCENARIOS}
    for suffix in ("rt_2", "all_yrs", "rt_34", "34_all_yrs"):
        groups[f"selectivity_{suffix}"] = [f"{a}_x_{b}_{suffix}" for a, b in pairs]
    return groups


def scenario_dim(spark: SparkSession, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(scenario, ordinal, group) in display order."""
    groups = scenario_groups() if groups is None else groups
    flat = [(s, g) for g, members in groups.items() for s in members]
    rows = [(s, i, g) for i, (s, g) in enumerate(flat, start=1)]
    return literal_table(spark, ["scenario", "ordinal", "group"], rows)


def usable(model_run: Column) -> Column:
    """Neither blank nor a base-model run."""
    return (model_run != "") & ~model_run.contains("Base")


def prepare_runs(df: DataFrame, dim: DataFrame | None = None, offset: int = 3,
                 min_gap: int | None = 2) -> DataFrame:
    """Drop base runs, add the label year, cut each estimate at its data.

    An estimate keeps the years with label + offset - year > min_gap; one without a
    label has no gap and is dropped. Other rows are kept. `dim` restricts to known
    scenarios; `min_gap=None` cuts nothing. A stored label (see `with_label`) is used as it is, so
    that a filter on it, or a join with a table of labels, picks partitions.
    """
    run = F.col("model_run")
    out = df.where(usable(run))
    if "label" not in df.columns:
        out = out.withColumn("label", label_year(run))
    out = out.withColumn("years_until_terminal", F.col("label") + offset - F.col("year"))
    if min_gap is not None:
        out = out.where(
            F.when(run.contains("_EM"), F.col("years_until_terminal") > min_gap).otherwise(F.lit(True))
        )
    return out if dim is None else out.join(dim.select("scenario"), "scenario", "left_semi")


def with_label(df: DataFrame) -> DataFrame:
    """Add the label year, for a table that is stored by it: `write_table(..., ("scenario", "label"))`."""
    return df.withColumn("label", label_year(F.col("model_run")))


def prepare_scalar(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    out = df.where(usable(F.col("model_run")) & F.col("scenario").isNotNull())
    return out if dim is None else out.join(dim.select("scenario"), "scenario", "left_semi")


def with_ordinal(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach a scenario's ordinal and group; unknown scenarios keep NULL."""
    return df.join(dim, "scenario", "left")


def with_role(df: DataFrame) -> DataFrame:
    return df.withColumn("role", role(F.col("model_run")))


def latest_runs(df: DataFrame) -> DataFrame:
    """Truth runs, and runs whose name carries the largest label of the table."""
    run = F.col("model_run")
    label = F.col("label") if "label" in df.columns else label_year(run)
    latest = df.select(F.max(label).cast("string")).scalar()
    return df.where(run.contains("OM") | run.contains(latest))


def largest_number(text: Column) -> Column:
    """Largest run of digits anywhere in a string, NULL when there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    return F.array_max(F.transform(found, lambda x: x.cast("bigint")))


def latest_runs_by_number(df: DataFrame) -> DataFrame:
    """As `latest_runs`, by the largest number anywhere in the name."""
    run = F.col("model_run")
    numbered = df.withColumn("max_number", largest_number(run))
    top = df.select(F.max(largest_number(run))).scalar()
    return numbered.where(run.contains("OM") | (F.col("max_number") == top))


def merge_tables(old: DataFrame, new: DataFrame, drop: str | None = None,
                 rename: list[tuple[str, str]] = ()) -> DataFrame:
    """Old rows except scenarios matching `drop`, then new rows with renamed scenarios."""
    if drop is not None:
        old = old.where(~F.col("scenario").rlike(drop))
    scenario = F.col("scenario")
    for pattern, text in rename:
        scenario = F.regexp_replace(scenario, pattern, text)
    return old.unionByName(new.withColumn("scenario", scenario), allowMissingColumns=True)


def merge_summaries(old: Summary, new: Summary, drop: str | None = None,
                    rename: list[tuple[str, str]] = ()) -> Summary:
    return Summary(
        merge_tables(old.ts, new.ts, drop, rename),
        merge_tables(old.dq, new.dq, drop, rename),
        merge_tables(old.scalar, new.scalar, drop, rename),
    )


def parse_scenario(df: DataFrame, suffixes: tuple[str, ...] = names.BASE_SUFFIXES,
                   every_year: list[str] | None = None) -> DataFrame:
    """Add om_name and em_name."""
    s = F.col("scenario")
    return df.withColumns(
        {
            "om_name": names.truth_name(s),
            "em_name": names.estimator_name(s, suffixes, every_year),
        }
    )


def parse_scenario_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(names.split_parts(F.col("scenario")))


def classify_design(df: DataFrame, variant: str = "base") -> DataFrame:
    return df.withColumns(names.design_class(F.col("scenario"), variant))
