"""Classification, regression and fold metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .ranking import ranking_metrics

COUNTS = ("true_positives", "false_positives", "false_negatives", "true_negatives")


def _counts(actual: Column, warned: Column) -> list[Column]:
    yes, no = actual == 1, actual == 0
    return [F.count_if(yes & warned).alias("true_positives"),
            F.count_if(no & warned).alias("false_positives"),
            F.count_if(yes & ~warned).alias("false_negatives"),
            F.count_if(no & ~warned).alias("true_negatives")]


def confusion(df: DataFrame, by: Sequence[str] = (),
              threshold: float = fixed.ALERT_THRESHOLD, actual: str = "actual",
              probability: str = "probability") -> DataFrame:
    """The four counts; rows without a score or an outcome are in none of them."""
    warned = F.col(probability) >= threshold
    return df.groupBy(*by).agg(*_counts(F.col(actual), warned))


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; no division gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)

    def rate(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns({
        "accuracy": rate(tp + tn, tp + fp + fn + tn),
        "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn),
        "f1": rate(2 * tp, 2 * tp + fp + fn),
    })


def classification_metrics(df: DataFrame, by: Sequence[str] = (),
                           threshold: float = fixed.ALERT_THRESHOLD,
                           ranking: bool = True) -> DataFrame:
    """Counts and rates at a threshold, with the exact ranking metrics on request."""
    if not ranking:
        return with_rates(confusion(df, by, threshold))
    if not by:
        whole = df.withColumn("_all", F.lit(1))
        return classification_metrics(whole, ["_all"], threshold).drop("_all")
    return with_rates(confusion(df, by, threshold)).join(ranking_metrics(df, by), list(by))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = fixed.THRESHOLDS,
                    by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at each threshold, from one pass that does not multiply the rows."""
    p, known = F.col("probability"), F.col("probability").isNotNull()
    yes, no = known & (F.col("actual") == 1), known & (F.col("actual") == 0)
    hits = [F.count_if(yes & (p >= t)).alias(f"tp{i}") for i, t in enumerate(thresholds)]
    false = [F.count_if(no & (p >= t)).alias(f"fp{i}") for i, t in enumerate(thresholds)]
    one = scored.groupBy(*by).agg(F.count_if(yes).alias("_yes"), F.count_if(no).alias("_no"),
                                  *hits, *false)
    each = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"),
                 F.col(f"tp{i}").alias("true_positives"),
                 F.col(f"fp{i}").alias("false_positives"),
                 (F.col("_yes") - F.col(f"tp{i}")).alias("false_negatives"),
                 (F.col("_no") - F.col(f"fp{i}")).alias("true_negatives"))
        for i, t in enumerate(thresholds)]))
    return with_rates(one.select(*by, each.alias("r")).select(*by, "r.*"))


def best_row(df: DataFrame, best: Sequence[Column]) -> DataFrame:
    """The first row in the given order; the last order column should break ties."""
    return df.orderBy(*best).limit(1)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest F1; the lowest threshold among equals."""
    return best_row(sweep, [F.desc("f1"), F.asc("threshold")])


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                       predicted: str = "prediction") -> DataFrame:
    """MAE, RMSE and R2 over rows that have both values."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    return (df.where(e.isNotNull()).groupBy(*by)
            .agg(F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"),
                 F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"),
                 (F.var_pop(a) * F.count("*")).alias("_sst"))
            .withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_sst")))
            .drop("_sse", "_sst"))


def class_counts(df: DataFrame, by: Sequence[str] = (), actual: str = "actual") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"),
                               F.count_if(F.col(actual) == 1).alias("positives"),
                               F.count_if(F.col(actual) == 0).alias("negatives"))


def summarise_folds(folds: DataFrame, by: Sequence[str],
                    mean: Sequence[str] = ("precision", "recall", "f1", "pr_auc", "roc_auc"),
                    total: Sequence[str] = ("true_positives", "false_positives",
                                            "false_negatives")) -> DataFrame:
    """Mean rates and summed counts over folds; a missing ROC-AUC is left out of its mean."""
    return folds.groupBy(*by).agg(
        F.count("*").alias("folds"),
        *[F.avg(c).alias(f"average_{c}") for c in mean],
        *[F.sum(c).alias(f"total_{c}") for c in total])


def false_alarms_per_year(summary: DataFrame, start: Column, end: Column) -> DataFrame:
    """Total false positives over the years between two dates.

    The dates are columns, or literals where one period holds for all rows.
    """
    years = F.datediff(end, start) / 365.25
    return summary.withColumn("false_alarms_per_year",
                              F.try_divide(F.col("total_false_positives"), years))
