"""Result documents: history, risk snapshot, and the views served from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import (as_percent, clean_text, interpretation, lenient_double, require_columns,
                         to_flag, warning_message)
from .evaluate import summarise_folds
from .intervals import islands

HISTORY_FIELDS = {
    "economic_stress": "ECON_STRESS",
    "stress_change_1m": "STRESS_CHANGE_1M",
    "stress_change_3m": "STRESS_CHANGE_3M",
    "stress_volatility_6m": "STRESS_VOLATILITY_6M",
    "fed_funds_rate": "FEDFUNDS",
    "unemployment_rate": "UNRATE",
    "inflation_rate": "INFLATION_RATE",
    "gdp_growth": "GDP_GROWTH",
    "treasury_yield": "TREASURY",
    "vix": "VIX",
}


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def history_records(df: DataFrame, keys: Sequence[str], order: str = "date",
                    null_name: bool = False) -> DataFrame:
    """Chart-ready rows. `null_name` turns the "None" of unlabelled rows into NULL."""
    have = set(df.columns)

    def number(c):
        return lenient_double(F.col(c)) if c in have else F.lit(None).cast("double")
    name = clean_text(F.col("CRISIS_NAME")) if "CRISIS_NAME" in have \
        else F.lit(None).cast("string")
    if null_name:
        name = F.nullif(name, F.lit("None"))
    flag = to_flag(df, "CRISIS") if "CRISIS" in have else F.lit(False)
    return df.select(*keys, F.col(order).alias("date"),
                     *[number(c).alias(n) for n, c in HISTORY_FIELDS.items()],
                     flag.alias("crisis"), name.alias("crisis_name"))


def history_summary(df: DataFrame, keys: Sequence[str], order: str = "date",
                    col: str = "ECON_STRESS") -> DataFrame:
    """Latest, mean, extremes, first date of the peak, date range and count per key."""
    c = F.col(col)
    return df.where(c.isNotNull()).groupBy(*keys).agg(
        F.min(order).alias("start_date"), F.max(order).alias("end_date"),
        F.count("*").alias("observation_count"), F.max_by(c, F.col(order)).alias("latest_stress"),
        F.avg(c).alias("average_stress"), F.min(c).alias("minimum_stress"),
        F.max(c).alias("maximum_stress"),
        # Highest value first, earliest date among equals.
        F.max_by(F.col(order), F.struct(c, -F.unix_date(order))).alias("peak_stress_date"))


def history_document(df: DataFrame, keys: Sequence[str], order: str = "date",
                     label: Mapping[str, str] | None = None,
                     null_name: bool = False) -> DataFrame:
    """One nested row per key: metadata, summary, crisis_periods, series, notes.

    A list holds at most one element per month of one key.
    """
    require_columns(df, [*keys, order, "ECON_STRESS"], "The stress history")
    rows = df.where(F.col("ECON_STRESS").isNotNull())
    records = history_records(rows, keys, order, null_name)
    fields = [c for c in records.columns if c not in (*keys, "date")]
    item = F.struct(_iso("date").alias("date"), *fields)
    series = records.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("series"))
    if "CRISIS" in df.columns:
        runs = islands(rows, keys, order)
        span = F.struct("start_date", "end_date", "name")
        runs = (runs.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("_runs"))
                .select(*keys, F.transform("_runs", lambda r: F.struct(
                    r["name"].alias("name"), _iso(r["start_date"]).alias("start_date"),
                    _iso(r["end_date"]).alias("end_date"))).alias("crisis_periods")))
        series = series.join(runs, list(keys), "left")
    else:
        series = series.withColumn("crisis_periods", F.lit(None).cast(
            "array<struct<name:string,start_date:string,end_date:string>>"))
    empty = F.array().cast("array<struct<name:string,start_date:string,end_date:string>>")
    about = [F.lit(v).alias(k) for k, v in (label or {}).items()] or [F.col(k) for k in keys]
    return history_summary(rows, keys, order).join(series, list(keys)).select(
        *keys, F.lit("success").alias("status"),
        F.current_timestamp().alias("generated_at_utc"),
        F.struct(*about, F.lit("monthly").alias("frequency"),
                 _iso("start_date").alias("start_date"), _iso("end_date").alias("end_date"),
                 "observation_count").alias("metadata"),
        F.struct("latest_stress", "average_stress", "minimum_stress", "maximum_stress",
                 _iso("peak_stress_date").alias("peak_stress_date")).alias("summary"),
        F.coalesce("crisis_periods", empty).alias("crisis_periods"), "series",
        F.array(*[F.lit(x) for x in fixed.HISTORY_NOTES]).alias("notes"))


def match_dates(assessment: DataFrame, explanation: DataFrame,
                keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows with equal dates, rejected keys with the reason)."""
    a = assessment.withColumnRenamed("observation_date", "_a").withColumn("_in_a", F.lit(True))
    e = explanation.withColumnRenamed("observation_date", "_e")
    both = a.join(e, list(keys), "full_outer")
    reason = (F.when(F.col("_a").isNull(), "assessment has no observation date")
              .when(F.col("_e").isNull(), "explanation has no observation date")
              .when(F.col("_a") != F.col("_e"), F.format_string(
                  "dates do not match: %s versus %s", _iso("_a"), _iso("_e"))))
    both = both.withColumn("reason", reason)
    good = (both.where(F.col("reason").isNull()).drop("_e", "_in_a", "reason")
            .withColumnRenamed("_a", "observation_date"))
    return good, both.where(F.col("reason").isNotNull()).select(*keys, "reason")


def risk_document(assessment: DataFrame, explanation: DataFrame, folds: DataFrame,
                  keys: Sequence[str], feature_count: int, penalty: str = "L2",
                  c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(one nested risk snapshot per key, rejected keys).

    The validation figures are the means over `folds`, computed here.
    """
    good, rejected = match_dates(assessment, explanation, keys)
    means = summarise_folds(folds, [], total=()).drop("folds").first().asDict()
    validation = F.struct(F.lit(fixed.VALIDATION_METHOD).alias("method"),
                          *[F.lit(v).cast("double").alias(k) for k, v in means.items()])
    p, t = F.col("risk_probability"), F.col("warning_threshold")

    def categories(col):
        return F.transform(F.slice(col, 1, 4), lambda r: F.struct(
            r["group"].alias("category"), r["shap_value"].alias("contribution"),
            r["feature_count"].alias("feature_count")))

    def features(col):
        return F.transform(F.slice(col, 1, 5), lambda r: F.struct(
            r["feature"].alias("feature"), r["group"].alias("category"),
            r["value"].alias("value"), r["shap_value"].alias("contribution")))
    documents = good.select(
        *keys, F.lit("success").alias("status"),
        F.current_timestamp().alias("generated_at_utc"),
        F.struct(_iso("observation_date").alias("observation_date"), "current_stress",
                 "risk_probability", as_percent(p).alias("risk_probability_percent"),
                 "warning_threshold", as_percent(t).alias("warning_threshold_percent"),
                 "warning_active", "warning_level", "forecast_horizon_months")
        .alias("assessment"),
        F.struct(categories("grouped_increasing_risk").alias("categories_increasing_risk"),
                 categories("grouped_reducing_risk").alias("categories_reducing_risk"),
                 features("increasing_risk").alias("features_increasing_risk"),
                 features("reducing_risk").alias("features_reducing_risk")).alias("drivers"),
        F.struct(F.col("model_name").alias("name"), F.lit(penalty).alias("penalty"),
                 F.lit(c).alias("regularization_c"), F.lit(feature_count).alias("feature_count"),
                 F.lit(fixed.TARGET_TEXT).alias("target"), "forecast_horizon_months",
                 t.alias("decision_threshold"), validation.alias("validation"))
        .alias("model"),
        F.struct(interpretation(p).alias("summary"),
                 warning_message(p, t).alias("warning_message")).alias("interpretation"),
        F.array(*[F.lit(x) for x in fixed.LIMITATIONS]).alias("limitations"))
    return documents, rejected


def result_views(keys: Sequence[str], risk: DataFrame | None = None,
                 history: DataFrame | None = None, prefix: str = "us_") -> dict[str, DataFrame]:
    """Read-only selections of the snapshots, also registered as temporary views."""
    views = {}
    if risk is not None:
        views["latest_risk"] = risk
        views["assessment"] = risk.select(*keys, "status", "generated_at_utc", "assessment",
                                          "interpretation")
        views["explanation"] = risk.select(
            *keys, "status", F.col("assessment.observation_date").alias("observation_date"),
            "drivers", F.lit(fixed.EXPLANATION_NOTE).alias("explanation_note"))
        views["model"] = risk.select(*keys, "status", "model", "limitations")
        views["health"] = risk.select(
            *keys, F.lit("healthy").alias("status"),
            F.current_timestamp().alias("checked_at_utc"),
            F.lit(True).alias("snapshot_available"),
            F.col("assessment.observation_date").alias("observation_date"))
    if history is not None:
        views["stress_history"] = history
        views["crises"] = history.select(*keys, "status", "crisis_periods",
                                         F.lit(fixed.CRISES_NOTE).alias("note"))
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return views
