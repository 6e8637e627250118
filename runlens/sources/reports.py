"""Report tables of a campaign's runs: several kinds below one root, long rows from each.

A kind has columns named by numbers (ages, or lengths), and every kind its own set of them. A
kind is a directory below the root, partitioned by scenario and run, so that picking a kind and
runs opens their files only; its numeric columns are found in its own schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.derive import at_age_long
from runlens.sources.summary import load_run_reports, write_table


@dataclass(frozen=True)
class Kind:
    """index, value: names of the long columns; beg: only rows of the year's beginning; factor: the
    third part of the row's label `<year>_<fleet>_<factor>`."""

    source: str
    index: str
    value: str
    beg: bool = False
    factor: str | None = None


#: The kinds, the report each is taken from, and its rows.
KINDS = {
    "natage": Kind("natage", "age", "n", beg=True),
    "batage": Kind("batage", "age", "biomass", beg=True),
    "catage": Kind("catage", "age", "catch"),
    "age_selectivity": Kind("ageselex", "age", "selex", factor="Asel2"),
    "size_selectivity": Kind("sizeselex", "length", "selex", factor="Lsel"),
    "dead_selectivity": Kind("sizeselex", "length", "selex", factor="Dead"),
}


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """One directory a report; a scenario's or run's size does not matter to the tasks that write."""
    for name, df in reports.items():
        write_table(df, f"{root}/{name}", ("scenario", "run"))


def report_long(spark: SparkSession, root: str, kind: str, run_suffix: str | None = None,
                year: int | None = None, fleet: int | None = None) -> DataFrame:
    """Long rows of one kind, a row a number: one scan, and no shuffle.

    `year` and `fleet` pick rows whose label starts with them, for kinds with a label.
    """
    spec = KINDS[kind]
    wide = load_run_reports(spark, f"{root}/{spec.source}", run_suffix)
    if spec.beg:
        wide = wide.where(F.col("beg_mid") == "B")
    if spec.factor is not None:
        parts = [str(year) if year is not None else "[0-9]+", str(fleet) if fleet is not None else "[0-9]+", spec.factor]
        known = year is not None and fleet is not None
        label = F.col("label")
        wide = wide.where(label == "_".join(parts) if known else label.rlike("^" + "_".join(parts) + "$"))
    keep = [c for c in wide.columns if not c.isdigit() and c not in ("beg_mid", "label")]
    return at_age_long(wide, keep, spec.value, spec.index)
