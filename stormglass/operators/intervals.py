"""Date periods: labelling rows, finding runs, and windows around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import clean_text, to_flag
from ..storage import literal_table
from .timeseries import by_time


def periods_table(spark: SparkSession, periods=fixed.CRISIS_PERIODS) -> DataFrame:
    return literal_table(spark, [(i, *p) for i, p in enumerate(periods)],
                         "ord int, start date, end date, name string")


def period_days(periods: DataFrame, grain: str = "day") -> DataFrame:
    """Every date of every period with the name listed last for it."""
    at = F.explode(F.sequence("start", "end", F.expr(f"interval 1 {grain}")))
    return (periods.select(at.alias("_at"), "ord", "name")
            .groupBy("_at").agg(F.max_by("name", "ord").alias("_name")))


def label_periods(df: DataFrame, order: str, periods: DataFrame,
                  grain: str = "day") -> DataFrame:
    """Add CRISIS (0/1) and CRISIS_NAME ("None" outside all periods).

    Periods are spread over their dates, which turns the range condition into a hash
    join. `grain='month'` makes a smaller table, right where all dates are month starts.
    """
    days = period_days(periods, grain)
    return (df.join(days, df[order] == days["_at"], "left")
            .withColumns({"CRISIS": F.col("_at").isNotNull().cast("int"),
                          "CRISIS_NAME": F.coalesce("_name", F.lit("None"))})
            .drop("_at", "_name"))


def label_listed_periods(df: DataFrame, order: str = "date",
                         periods=fixed.CRISIS_PERIODS) -> DataFrame:
    """`label_periods` for a short configured list: conditions on the date, without a join."""
    name = F.lit(None).cast("string")
    for start, end, text in periods:  # a later period is tested first
        inside = F.col(order).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        name = F.when(inside, F.lit(text)).otherwise(name)
    return df.withColumns({"CRISIS": name.isNotNull().cast("int"),
                           "CRISIS_NAME": F.coalesce(name, F.lit("None"))})


def islands(df: DataFrame, keys: Sequence[str], order: str = "date", flag: str = "CRISIS",
            name: str = "CRISIS_NAME") -> DataFrame:
    """Runs of consecutive flagged rows with one name -> (keys, name, start, end)."""
    w = by_time(keys, order)
    label = F.coalesce(clean_text(F.col(name)), F.lit("Historical Crisis"))
    rows = df.select(*keys, order, F.when(to_flag(df, flag), label).alias("_label"))
    changed = ~F.col("_label").eqNullSafe(F.lag("_label").over(w))
    rows = (rows.withColumn("_changed", changed.cast("int"))
            .withColumn("_run", F.sum("_changed").over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return (rows.where(F.col("_label").isNotNull())
            .groupBy(*keys, "_run")
            .agg(F.first("_label").alias("name"), F.min(order).alias("start_date"),
                 F.max(order).alias("end_date"))
            .drop("_run"))


def trailing_window(df: DataFrame, keys: Sequence[str], order: str = "date",
                    years: int | None = None) -> DataFrame:
    """Rows of the last `years` years before the last date of each key; None keeps all."""
    if years is None:
        return df
    last = F.max(order).over(Window.partitionBy(*keys))
    return (df.withColumn("_last", last)
            .where(F.col(order) >= F.add_months("_last", -12 * years)).drop("_last"))


def event_replay(df: DataFrame, order: str, periods: DataFrame, before: int = 12,
                 after: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """Rows from `before` months ahead of each period until `after` months past it.

    Equi-join on the month (and keys, where periods have them), then the exact dates.
    """
    span = periods.select(
        *keys, F.col("name").alias("period_name"),
        F.add_months("start_date", -before).alias("_from"),
        F.add_months("end_date", after).alias("_to"))
    months = F.explode(F.sequence(F.trunc("_from", "MM"), F.col("_to"),
                                  F.expr("interval 1 month")))
    span = span.select("*", months.alias("_month"))
    rows = df.withColumn("_month", F.trunc(order, "MM"))
    return (rows.join(span, [*keys, "_month"])
            .where(F.col(order).between(F.col("_from"), F.col("_to")))
            .drop("_month", "_from", "_to"))


def visible_periods(periods: DataFrame, visible: DataFrame, keys: Sequence[str],
                    order: str = "date", selected: str | None = None) -> DataFrame:
    """Periods that end on or after the first visible date; or just the selected one."""
    if selected is not None:
        return periods.where(F.col("name") == selected)
    first = visible.groupBy(*keys).agg(F.min(order).alias("_first"))
    return (periods.join(first, list(keys))
            .where(F.col("end_date") >= F.col("_first")).drop("_first"))


def reverse_periods(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest period first."""
    return periods.orderBy(*keys, F.col("start_date").desc())
