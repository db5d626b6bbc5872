"""Long/wide reshaping, the country-year panel and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import conform, require_columns
from ..storage import literal_table


def series_to_wide(obs: DataFrame, keys: Sequence[str], order: str = "date",
                   series: Sequence[str] = fixed.SERIES) -> DataFrame:
    """One row per key and date, one column per series: a single conditional aggregate.

    Equal to a chain of full outer joins on the date. Repeated (series, date) values
    are reduced to the largest, so that the result does not depend on row order.
    """
    picks = [F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series]
    return obs.where(F.col("series").isin(list(series))).groupBy(*keys, order).agg(*picks)


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Chained full outer joins, for frames that are not one long table."""
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), frames)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pivot_indicators(long: DataFrame, ids: Sequence[str], col: str, value: str,
                     names: Sequence[str], order: str | None = None) -> DataFrame:
    """Long -> wide with the first non-null value of each cell.

    "First" is by `order` where given, else the smallest value: both are repeatable.
    """
    def cell(name):
        hit = F.when(F.col(col) == name, F.col(value))
        if order is None:
            return F.min(hit)
        return F.min_by(hit, F.when(hit.isNotNull(), F.col(order)))
    return long.groupBy(*ids).agg(*[cell(n).alias(n) for n in names])


def code_year_spine(codes: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Every code with every year, both ends included."""
    return codes.select("*", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))
                        .alias("year"))


def countries_table(spark: SparkSession,
                    countries: Mapping[str, str] = fixed.PANEL_COUNTRIES) -> DataFrame:
    return literal_table(spark, list(countries.items()), "country_code string, country string")


def country_year_panel(long: DataFrame, countries: DataFrame,
                       years: tuple[int, int] = fixed.PANEL_YEARS,
                       indicators: Sequence[str] = tuple(fixed.PANEL_INDICATORS.values()),
                       order: str | None = None) -> DataFrame:
    """Complete country x year grid with one column per indicator, absent cells NULL."""
    require_columns(long, ["country_code", "country", "year", "indicator", "value"],
                    "The long indicator table")
    wide = pivot_indicators(long, ["country_code", "year"], "indicator", "value",
                            indicators, order)
    grid = code_year_spine(countries, years)
    return conform(grid.join(wide, ["country_code", "year"], "left"),
                   ["country_code", "country", "year", *indicators])


def coverage_report(panel: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Valid and missing cells per id and column, with the percentage that is valid.

    Counts per id are taken in one wide aggregate; only its small result is unpivoted.
    """
    counted = panel.groupBy(*ids).agg(F.count("*").alias("_rows"),
                                      *[F.count(c).alias(c) for c in cols])
    valid, rows = F.col("valid_values"), F.col("_rows")
    return (counted.unpivot([*ids, "_rows"], list(cols), "indicator", "valid_values")
            .select(*ids, "indicator", "valid_values",
                    (rows - valid).alias("missing_values"),
                    F.coalesce(F.try_divide(valid, rows) * 100, F.lit(0.0))
                    .alias("coverage_percentage")))


def sort_coverage(report: DataFrame, code: str = "country_code") -> DataFrame:
    return report.orderBy("coverage_percentage", code, "indicator")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column in one pass, as (column, missing) rows."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "missing")
