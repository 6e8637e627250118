"""A summary is three tables: `ts` and `dq` by year, `scalar` by run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from runlens.functions.semantics import clean_nan

TABLES = ("ts", "dq", "scalar")


@dataclass(frozen=True)
class Summary:
    ts: DataFrame
    dq: DataFrame
    scalar: DataFrame

    def map(self, fn) -> "Summary":
        """Apply one DataFrame function to all three tables."""
        return Summary(*(fn(getattr(self, t)) for t in TABLES))


def normalise_names(df: DataFrame) -> DataFrame:
    """`Value.F` -> `Value_F`: dots in names would need back-ticks everywhere."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def read_table(spark: SparkSession, path: str,
               partition_by: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """Read one table; partition values stay the strings that were written."""
    schema = StructType(
        [
            StructField(f.name, StringType()) if f.name in partition_by and f.name != "label" else f
            for f in spark.read.parquet(path).schema.fields
        ]
    )
    return clean_nan(normalise_names(spark.read.schema(schema).parquet(path)))


def load_summary(spark: SparkSession, root: str) -> Summary:
    """Read the three tables below `root`; nothing is scanned until an action."""
    return Summary(*(read_table(spark, f"{root}/{t}") for t in TABLES))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("scenario",),
                mode: str = "error") -> None:
    """Write one table partitioned for pruning.

    Rows are clustered on the partition columns first, so a scenario ends in a few
    files and not in one per task. The rebalance lets adaptive execution split a
    scenario that holds most of the rows: no single task writes all of it. A blank partition
    value would come back as a missing one and is refused. An existing table is an error
    unless `mode` says otherwise.
    """
    for c, kind in df.dtypes:
        if c in partition_by and kind == "string":
            blank = F.raise_error(F.lit(f"blank partition value in {c}"))
            df = df.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", blank).otherwise(F.col(c)))
    clustered = df.hint("rebalance", *[F.col(c) for c in partition_by])
    clustered.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_summary(summary: Summary, root: str, partition_by: tuple[str, ...] = ("scenario",),
                  mode: str = "error") -> None:
    for t in TABLES:
        write_table(getattr(summary, t), f"{root}/{t}", partition_by, mode)


def load_run_reports(spark: SparkSession, path: str, run_suffix: str | None = None,
                     truth: bool = False) -> DataFrame:
    """Per-run report tables of all scenarios as one frame.

    The dataset is partitioned by scenario and run, so picking runs by the end of
    their name (`run_suffix`) or picking truth runs prunes directories before any
    file is opened. Iterations stay a column: a directory per iteration would be
    millions of small files in a large campaign.
    """
    df = read_table(spark, path, ("scenario", "run"))
    if truth:
        return df.where(F.col("run").contains("_OM"))
    if run_suffix is not None:
        return df.where(F.col("run").endswith(run_suffix))
    return df
