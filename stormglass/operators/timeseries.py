"""Window expressions and monthly alignment.

The builders take a window and return Columns, so that one `select` holding many of
them plans to a single sort. A window never lacks a partition key, and the rows per
key are bounded by the calendar because data arrives here aggregated per key and date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import fixed
from ..functions import lenient_double, require_columns


def by_time(keys: Sequence[str], order: str = "date") -> WindowSpec:
    if not keys:
        raise ValueError("a time window needs at least one key column")
    return Window.partitionBy(*keys).orderBy(order)


def _trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def diff(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return c - F.lag(c, k).over(w)


def pct_change(c: Column, w: WindowSpec, k: int = 12) -> Column:
    """Percent change over k rows; a zero base gives NULL."""
    return (F.try_divide(c, F.lag(c, k).over(w)) - 1) * 100


def rolling_mean(c: Column, w: WindowSpec, n: int) -> Column:
    f = _trailing(w, n)
    return F.when(F.count(c).over(f) == n, F.avg(c).over(f))


def rolling_std(c: Column, w: WindowSpec, n: int) -> Column:
    f = _trailing(w, n)
    return F.when(F.count(c).over(f) == n, F.stddev_samp(c).over(f))


def expanding_zscore(c: Column, w: WindowSpec, min_periods: int = fixed.MIN_PERIODS) -> Column:
    """Standardised with what was known up to the row; counts non-null values only."""
    f = _so_far(w)
    spread = F.nullif(F.stddev_samp(c).over(f), F.lit(0.0))
    return F.when(F.count(c).over(f) >= min_periods,
                  F.try_divide(c - F.avg(c).over(f), spread))


def filled(c: Column, w: WindowSpec, order: str = "date",
           max_age_months: int | None = None) -> Column:
    """Last known value; values before the series starts stay NULL."""
    f = _so_far(w)
    value = F.last(c, ignorenulls=True).over(f)
    if max_age_months is None:
        return value
    seen = F.last(F.when(c.isNotNull(), F.col(order)), ignorenulls=True).over(f)
    return F.when(seen >= F.add_months(F.col(order), -max_age_months), value)


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                 max_age_months: int | None = None) -> DataFrame:
    w = by_time(keys, order)
    return df.withColumns({c: filled(F.col(c), w, order, max_age_months) for c in cols})


def resample_month(obs: DataFrame, keys: Sequence[str], order: str,
                   aggs: Mapping[str, str]) -> DataFrame:
    """One row per key and month that has data: last non-null value or mean.

    Keeps `first_seen`, the earliest date in the month.
    """
    exprs = []
    for name, rule in aggs.items():
        c = F.col(name)
        if rule == "last":
            exprs.append(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(name))
        elif rule == "mean":
            exprs.append(F.avg(c).alias(name))
        else:
            raise ValueError(f"unknown monthly rule {rule!r} for {name}")
    return (obs.withColumn("_month", F.trunc(order, "MM"))
            .groupBy(*keys, "_month")
            .agg(F.min(order).alias("first_seen"), *exprs)
            .withColumnRenamed("_month", order))


def month_spine(monthly: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                keep_partial: bool = False) -> DataFrame:
    """Insert the missing months between the first and the last of each key.

    A month row is spread over the gap up to the next one, so no second scan and no
    join is needed. A first month that does not start on day one is left out, unless
    `keep_partial`.
    """
    w = by_time(keys, order)
    start = F.min("first_seen").over(Window.partitionBy(*keys))
    rows = monthly.withColumn("_next", F.lead(order).over(w)).withColumn("_start", start)
    if not keep_partial:
        rows = rows.where(F.col(order) >= F.col("_start"))
    until = F.coalesce(F.add_months("_next", -1), F.col(order))
    step = F.explode(F.sequence(F.col(order), until, F.expr("interval 1 month")))
    rows = rows.select("*", step.alias("_at"))
    own = F.col("_at") == F.col(order)
    return rows.select(*keys, F.col("_at").alias(order),
                       *[F.when(own, F.col(c)).alias(c) for c in cols])


def to_monthly(wide: DataFrame, keys: Sequence[str], order: str = "date",
               aggs: Mapping[str, str] = fixed.MONTHLY_RULES,
               keep_partial: bool = False) -> DataFrame:
    """Mixed-frequency table -> gap-free monthly table without nulls."""
    require_columns(wide, [*keys, order, *aggs], "The mixed-frequency table")
    cols = list(aggs)
    monthly = resample_month(wide, keys, order, aggs)
    spine = month_spine(monthly, keys, order, cols, keep_partial)
    return forward_fill(spine, keys, order, cols).dropna(subset=cols)


def create_features(df: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """The 24 engineered columns, from one window sort."""
    require_columns(df, [*keys, order, *fixed.SERIES], "The monthly table")
    df = df.withColumns({c: lenient_double(F.col(c)) for c in fixed.SERIES})
    w = by_time(keys, order)
    fed, unrate, cpi = F.col("FEDFUNDS"), F.col("UNRATE"), F.col("CPI")
    gdp, treasury, vix = F.col("GDP"), F.col("TREASURY"), F.col("VIX")
    windowed = {
        "FED_CHANGE": diff(fed, w),
        "TREASURY_CHANGE": diff(treasury, w),
        "VIX_CHANGE": diff(vix, w),
        "UNRATE_CHANGE": diff(unrate, w),
        "INFLATION_RATE": pct_change(cpi, w),
        "GDP_GROWTH": pct_change(gdp, w),
        "FED_3M_AVG": rolling_mean(fed, w, 3),
        "FED_6M_AVG": rolling_mean(fed, w, 6),
        "CPI_3M_AVG": rolling_mean(cpi, w, 3),
        "GDP_3M_AVG": rolling_mean(gdp, w, 3),
        "UNRATE_3M_AVG": rolling_mean(unrate, w, 3),
        "VIX_3M_AVG": rolling_mean(vix, w, 3),
        "FED_LAG1": F.lag(fed).over(w),
        "GDP_LAG1": F.lag(gdp).over(w),
        "CPI_LAG1": F.lag(cpi).over(w),
        "UNRATE_LAG1": F.lag(unrate).over(w),
        "TREASURY_LAG1": F.lag(treasury).over(w),
        "VIX_LAG1": F.lag(vix).over(w),
        "VIX_VOLATILITY": rolling_std(vix, w, 6),
        "FED_VOLATILITY": rolling_std(fed, w, 6),
    }
    momentum = {f"{p}_MOMENTUM": F.col(c) - F.col(f"{p}_3M_AVG")
                for p, c in (("FED", "FEDFUNDS"), ("GDP", "GDP"),
                             ("UNRATE", "UNRATE"), ("VIX", "VIX"))}
    return df.withColumns(windowed).withColumns(momentum)


def latest_rows(df: DataFrame, keys: Sequence[str], order: str = "date") -> DataFrame:
    """The last row of each key, found with a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def background(df: DataFrame, keys: Sequence[str], order: str = "date",
               n: int = 200) -> DataFrame:
    """The n rows before the latest one of each key."""
    recent = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (df.withColumn("_back", F.row_number().over(recent))
            .where(F.col("_back").between(2, n + 1)).drop("_back"))


def persistence_forecast(df: DataFrame, col: str = "ECON_STRESS") -> DataFrame:
    """Forecast that nothing changes."""
    return df.withColumn("prediction", F.col(col))


def preview(df: DataFrame, order: Sequence[str], n: int, tail: bool = False,
            need: Sequence[str] = ("ECON_STRESS",)) -> DataFrame:
    """First or last n rows in the given order that have the needed values."""
    cols = [F.col(c).desc() if tail else F.col(c).asc() for c in order]
    return df.dropna(subset=list(need)).orderBy(*cols).limit(n)
