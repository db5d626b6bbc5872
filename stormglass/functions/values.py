"""Value cleanup and schema checks. Missing is always NULL, never NaN."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\f\v"


def clean_number(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def lenient_double(c: Column) -> Column:
    """Cast to double; whatever is not a finite number becomes NULL."""
    return clean_number(c.try_cast("double"))


def clean_values(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Apply `clean_number` to the given, or all, floating-point columns."""
    wanted = set(df.columns if cols is None else cols)
    return df.select(*[
        clean_number(F.col(f.name)).alias(f.name)
        if f.name in wanted and isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ])


def clean_text(c: Column) -> Column:
    """Trimmed text; blank text becomes NULL."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def to_flag(df: DataFrame, name: str) -> Column:
    """Missing -> false, zero -> false, anything else -> true."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        flag = c
    elif isinstance(kind, T.StringType):
        flag = F.coalesce(F.btrim(c, F.lit(BLANKS)).try_cast("bigint") != 0, F.length(c) > 0)
    else:
        flag = c.try_cast("bigint") != 0
    return F.coalesce(flag, F.lit(False))


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "The input") -> DataFrame:
    """Fail while the plan is built, before any job, if columns are absent."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric columns that are not excluded."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def conform(df: DataFrame, cols: Sequence[str], kind: str = "double") -> DataFrame:
    """Exactly these columns in this order; absent ones are NULL."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c in cols])
