"""Presentation of probabilities and contributions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .. import fixed


def warning_level(p: Column, threshold: Column | float) -> Column:
    """Named band of a probability. The 0.20 band is tested before the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (F.when(p.isNull(), None)
            .when(p < 0.20, "Low").when(p < t, "Guarded")
            .when(p < 0.60, "Elevated").when(p < 0.80, "High").otherwise("Critical"))


def warning_active(p: Column, threshold: Column | float) -> Column:
    return p >= threshold


def warning_tone(level: Column) -> Column:
    """Display tone of a band name, in any case; unknown or missing is safe."""
    name = F.lower(level)
    return (F.when(name.isin("critical", "high"), "danger")
            .when(name.isin("elevated", "guarded"), "warning").otherwise("safe"))


def bar_width(contribution: Column, within: WindowSpec) -> Column:
    """Bar length in percent of the largest contribution in the list, at least 8."""
    size = F.abs(F.coalesce(contribution, F.lit(0.0)))
    return F.greatest(F.lit(8.0),
                      size / F.greatest(F.max(size).over(within), F.lit(0.001)) * 100)


def as_percent(p: Column) -> Column:
    return F.round(p * 100, 1)


def interpretation(p: Column) -> Column:
    return F.format_string(
        "The model estimates a %.1f%% probability that economic stress will rise by at "
        "least five points within the next three months.", p * 100)


def warning_message(p: Column, threshold: Column | float) -> Column:
    return (F.when(warning_active(p, threshold), fixed.REACHED_TEXT)
            .otherwise(fixed.NOT_REACHED_TEXT))


def _number_text(c: Column, digits: int) -> Column:
    # format_string would write "null" for a missing value. A value whose shortest decimal
    # form lies exactly half-way is rounded up.
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def format_number(c: Column, digits: int = 1) -> Column:
    return F.coalesce(_number_text(c, digits), F.lit("—"))


def format_percent(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.concat(_number_text(c * 100, digits), F.lit("%")), F.lit("—"))


def gauge_percent(p: Column) -> Column:
    """Percent of a gauge, kept within 0 and 100."""
    return F.least(F.greatest(p * 100, F.lit(0.0)), F.lit(100.0))


def day_label(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit("Unavailable"))


def month_label(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM yyyy"), F.lit(""))


def year_label(d: Column) -> Column:
    return F.date_format(d, "yyyy")
