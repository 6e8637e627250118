"""Missing-value, zero and infinity rules, each an explicit parameter.

The rules these helpers encode: division never raises; NaN counts as missing
while infinities are values; a strict aggregate is missing as soon as one input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

INF = float("inf")
RUN_KEYS = ["scenario", "iteration"]
YEAR_KEYS = ["scenario", "iteration", "year"]
ROW_KEYS = [*YEAR_KEYS, "model_run"]


def null_double() -> Column:
    return F.lit(None).cast("double")


def nan_to_null(col: Column) -> Column:
    return F.nanvl(col, null_double())


def clean_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; infinities stay."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in floats})


def is_finite(col: Column) -> Column:
    """TRUE only for values that are neither NULL, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(INF))


def safe_ratio(num: Column, den: Column, both_zero: float | None = None,
               den_zero: str | float = "inf") -> Column:
    """num / den without errors.

    both_zero: value of 0/0 (None = missing).
    den_zero: "inf" gives a signed infinity, "null" gives NULL, and a number is
    used as the denominator in place of the zero.
    """
    if den_zero == "inf":
        over_zero = num * F.lit(INF)
    elif den_zero == "null":
        over_zero = null_double()
    else:
        over_zero = num / F.lit(float(den_zero))
    # short on purpose: dozens of these share one generated method, which the JVM only
    # compiles while it is small
    zero = F.when(den == 0, F.when(num == 0, F.lit(both_zero).cast("double")).otherwise(over_zero))
    return nan_to_null(F.coalesce(F.try_divide(num, den), zero))


def strict(agg: Column, col: Column) -> Column:
    """An aggregate that is NULL if any input of the group is NULL."""
    return F.when(F.count(col) == F.count(F.lit(1)), agg)


def label_year(model_run: Column) -> Column:
    """Trailing four digits of a run name as INT, NULL when there are none.

    No regular expression: the filter on it runs once per row of a scan.
    """
    tail = F.right(model_run, F.lit(4))
    digits = F.translate(tail, "0123456789", "")
    return F.when((F.length(tail) == 4) & (digits == ""), tail.cast("int"))


def role(model_run: Column) -> Column:
    """'OM' for truth runs, 'EM' for estimates, 'Other' for the rest."""
    return (
        F.when(model_run.contains("_OM"), "OM")
        .when(model_run.contains("_EM"), "EM")
        .otherwise("Other")
    )


def metric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Names of the double columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, DoubleType) and f.name not in skip]


def rounded(df: DataFrame, digits: int = 6, per_column: dict[str, int] | None = None) -> DataFrame:
    """Round every double column, so that results compare across engines.

    A billionth, away from zero, moves exact ties to one side: there the last bit of a sum, which
    depends on the order of the rows, would otherwise decide the digit. It is far below the last
    digit that is kept, so a value with no more digits than that comes back as it is.
    """
    per_column = per_column or {}
    return df.withColumns(
        {
            c: F.round(F.col(c) + F.signum(c) * F.lit(1e-9), per_column.get(c, digits))
            for c in metric_columns(df)
        }
    )
