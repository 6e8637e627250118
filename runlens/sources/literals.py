"""Small dimension tables written as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value: str | int | float) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return repr(value)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table whose size the planner knows; it broadcasts without a job."""
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
