"""Composite index, its trends, period labels' targets and the training set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import require_columns
from .timeseries import by_time, diff, expanding_zscore, rolling_mean, rolling_std


def weighted_index(weights: Mapping[str, float] = fixed.INDEX_WEIGHTS) -> Column:
    """Weighted sum; NULL as soon as one part is NULL."""
    parts = [F.col(c) * w for c, w in weights.items()]
    return reduce(lambda a, b: a + b, parts)


def logistic_100(c: Column) -> Column:
    """Squash onto 0..100 without looking at any other row."""
    return 100 / (1 + F.exp(-c))


def index_trends(df: DataFrame, keys: Sequence[str], order: str = "date",
                 col: str = "ECON_STRESS") -> DataFrame:
    w, c = by_time(keys, order), F.col(col)
    df = df.withColumns({
        "STRESS_CHANGE_1M": diff(c, w, 1),
        "STRESS_CHANGE_3M": diff(c, w, 3),
        "STRESS_3M_AVG": rolling_mean(c, w, 3),
        "STRESS_VOLATILITY_6M": rolling_std(c, w, 6),
        "STRESS_ACCELERATION": diff(c, w, 1) - (F.lag(c, 1).over(w) - F.lag(c, 2).over(w)),
    })
    return df.withColumn("STRESS_GAP_3M", c - F.col("STRESS_3M_AVG"))


def stress_index(df: DataFrame, keys: Sequence[str], order: str = "date",
                 weights: Mapping[str, float] = fixed.INDEX_WEIGHTS,
                 min_periods: int = fixed.MIN_PERIODS) -> DataFrame:
    """Causal z-scores, weighted index on 0..100 and its trend columns."""
    require_columns(df, [*keys, order, *fixed.Z_INPUTS.values()], "The feature table")
    w = by_time(keys, order)
    scores = {z: expanding_zscore(F.col(c), w, min_periods) for z, c in fixed.Z_INPUTS.items()}
    return index_trends(
        df.withColumns(scores)
        .withColumn("RAW_ECON_STRESS", weighted_index(weights))
        .withColumn("ECON_STRESS", logistic_100(F.col("RAW_ECON_STRESS"))),
        keys, order)


def forward_targets(df: DataFrame, keys: Sequence[str], order: str = "date",
                    col: str = "ECON_STRESS", horizon: int = fixed.HORIZON_MONTHS,
                    rise: float = fixed.RISE_POINTS) -> DataFrame:
    """What the index and the labels will be `horizon` rows later; NULL where unknown."""
    require_columns(df, [*keys, order, col, "CRISIS"], "The labelled table")
    w = by_time(keys, order)
    df = df.withColumns({
        "TARGET_STRESS_3M": F.lead(col, horizon).over(w),
        "TARGET_CRISIS_3M": F.lead("CRISIS", horizon).over(w),
    }).withColumn("TARGET_STRESS_CHANGE_3M", F.col("TARGET_STRESS_3M") - F.col(col))
    change = F.col("TARGET_STRESS_CHANGE_3M")
    return df.withColumn("TARGET_RISK_RISING_3M",
                         F.when(change.isNotNull(), (change >= rise).cast("int")))


def target_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Known changes, their mean, and the class counts."""
    change, target = F.col("TARGET_STRESS_CHANGE_3M"), F.col(fixed.TARGET)
    return df.groupBy(*keys).agg(
        F.count(change).alias("valid_changes"),
        F.avg(change).alias("average_change"),
        F.count_if(target == 1).alias("rising"),
        F.count_if(target == 0).alias("stable_or_falling"))


def training_set(df: DataFrame) -> DataFrame:
    """Rows whose outcome is known."""
    known = ["TARGET_STRESS_CHANGE_3M", fixed.TARGET]
    require_columns(df, [fixed.LEVEL_TARGET, *known], "The training set")
    return df.dropna(subset=known)
