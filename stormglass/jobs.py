"""Whole runs on landed files: each job reads paths, writes paths and returns what it wrote.

A job hands over to the next one by files only, so that each can be run, and run again, by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .operators import documents, explain, index, models, profile, validation
from .operators.intervals import label_listed_periods
from .operators.reshape import series_to_wide
from .operators.timeseries import create_features, latest_rows, to_monthly
from .sources import load_model, read_series, save_model, write_documents, write_table

AUDIT_TABLES = ("feature_summary", "high_correlations", "constant_features")


def build_features(spark: SparkSession, series: str | Sequence[str], out: str, keys: Sequence[str] = ()) -> str:
    """Series files to the full monthly table with features, index, period labels and targets."""
    monthly = to_monthly(series_to_wide(read_series(spark, series, keys), keys), keys)
    stress = index.stress_index(create_features(monthly, keys), keys)
    return write_table(index.forward_targets(label_listed_periods(stress), keys), out)


def audit_features(spark: SparkSession, features: str, out: str, threshold: float = fixed.CORRELATION_THRESHOLD) -> dict[str, str]:
    """Profile, correlated pairs and constant columns of the training set, a table each below `out`."""
    found = profile.feature_audit(index.training_set(spark.read.parquet(features)), threshold)
    return {name: write_table(found[name], f"{out}/{name}") for name in AUDIT_TABLES}


def train(spark: SparkSession, features: str, out: str, keys: Sequence[str], threshold: float = fixed.ALERT_THRESHOLD,
          name: str = "Logistic Regression", fit: Callable = models.fit_logistic, k: int = 5) -> str:
    """The model of all labelled rows, its metadata, and the walk-forward metrics beside it."""
    rows = index.training_set(spark.read.parquet(features))
    folds, _ = validation.walk_forward(rows, keys, {name: fit}, threshold, k=k)
    write_table(folds, f"{out}/folds")
    return save_model(*validation.train_final(rows, keys, threshold, name=name, fit=fit), out)


def publish_history(spark: SparkSession, features: str, out: str, keys: Sequence[str]) -> DataFrame:
    """The history document of every key."""
    docs = documents.history_document(spark.read.parquet(features), keys)
    write_documents(docs, out)
    return docs


def publish_risk(spark: SparkSession, features: str, model: str, out: str, keys: Sequence[str]) -> DataFrame:
    """The risk document of every key whose assessment and explanation are of the same date."""
    rows = spark.read.parquet(features)
    fitted, metadata = load_model(spark, model)
    about = metadata.first()  # one row
    assessment = models.score_latest(latest_rows(rows, keys), fitted, keys, about["warning_threshold"], name=about["model_name"])
    attr = explain.with_groups(explain.attribution(rows, fitted.coefficients(spark), fitted.scaler.features, keys),
                               explain.groups_table(spark))
    dates = attr.groupBy(*keys).agg(F.max("date").alias("observation_date"))
    lists = explain.explanation_arrays(attr, keys).join(dates, list(keys))
    docs, _ = documents.risk_document(assessment, lists, spark.read.parquet(f"{model}/folds"), keys, len(fitted.scaler.features))
    write_documents(docs, out)
    return docs
