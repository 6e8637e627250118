"""Report tables: renamed columns, fixed digits, display order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def report_table(df: DataFrame, labels: dict[str, str], digits: int = 2,
                 dim: DataFrame | None = None) -> DataFrame:
    """Columns of `labels` under their new names, rounded half to even.

    With a scenario dimension the rows come in its display order.
    """
    doubles = {f.name for f in df.schema if isinstance(f.dataType, DoubleType)}
    if dim is not None:
        df = df.join(dim.select("scenario", "ordinal"), "scenario", "left").orderBy(
            F.col("ordinal").asc_nulls_last(), "scenario"
        )
    return df.select(
        *[
            (F.bround(c, digits) if c in doubles else F.col(c)).alias(new)
            for c, new in labels.items()
        ]
    )


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """A report table as one text file: comma-separated, with its column names as the first line.

    A report has a row a scenario, so one task writes it, in the table's order.
    """
    df.coalesce(1).write.mode(mode).csv(path, header=True, emptyValue="", nullValue="NA")


def read_report(df: DataFrame, path: str) -> DataFrame:
    """The text file that `write_report` made of `df`, with the types of `df`."""
    return df.sparkSession.read.schema(df.schema).csv(path, header=True, nullValue="NA")
