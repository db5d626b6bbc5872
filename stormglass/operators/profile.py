"""Column profiles, correlations and the feature audit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric_columns

MOMENTS = ("missing_count", "row_count", "variance", "mean", "standard_deviation",
           "minimum", "maximum")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-null values per column.

    The first grouping removes repeats before and after the shuffle, on (column, value),
    so neither a frequent value nor a single column lands in one task.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())
    return (long.groupBy("feature", "value").agg(F.lit(1).alias("_one"))
            .groupBy("feature").agg(F.count("*").alias("unique_values")))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing share, exact distinct count and moments, one row per numeric column."""
    cols = list(cols or numeric_columns(df))

    def moments(name):
        c = F.col(name).cast("double")
        return F.struct(
            F.count_if(c.isNull()).alias("missing_count"),
            F.count(F.lit(1)).alias("row_count"),
            F.var_samp(c).alias("variance"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("standard_deviation"),
            F.min(c).alias("minimum"), F.max(c).alias("maximum")).alias(name)

    # One scan, no shuffle of rows: the moments of all columns come in a single row.
    one = df.agg(*[moments(c) for c in cols])
    rows = one.unpivot([], cols, "feature", "m").select("feature", "m.*")
    missing = F.coalesce(F.try_divide(F.col("missing_count"), F.col("row_count")) * 100,
                         F.lit(0.0))
    return (rows.join(distinct_counts(df, cols), "feature", "left")
            .select("feature", "missing_count", missing.alias("missing_percentage"),
                    F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
                    *MOMENTS[2:]))


def constant_columns(profile: DataFrame) -> DataFrame:
    """Columns with one value or none, read off the smallest and the largest."""
    return profile.where(F.col("minimum").eqNullSafe(F.col("maximum"))).select("feature")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: r over rows that have both values, NULL if one of them is constant.

    The built-in `corr` raises a division by zero there in ANSI mode.
    """
    a, b = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair over the rows that have both values.

    Each task reduces its rows to column-by-column sums, and only those sums, whose size
    depends on the number of columns alone, are shuffled. NaN counts as missing; r is NULL
    for a constant column and for pairs without common rows.
    """
    cols = list(cols)
    # Shifting by the overall mean keeps the sums of squares from cancelling.
    wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    means = wide.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in cols])
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    i, j = np.triu_indices(len(cols), 1)

    def sums(batches):
        total = np.zeros((len(names), len(cols), len(cols)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sq = x * x
            total += np.stack([has.T @ has, x.T @ has, has.T @ x,
                               sq.T @ has, has.T @ sq, x.T @ x])
        yield pd.DataFrame({"i": i, "j": j, **{k: total[p][i, j] for p, k in enumerate(names)}})

    schema = "i int, j int, " + ", ".join(f"{k} double" for k in names)
    none = df.sparkSession.createDataFrame(
        [(int(a), int(b), *[0.0] * len(names)) for a, b in zip(i, j)], schema)
    merged = (wide.mapInPandas(sums, schema).union(none)
              .groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names]))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (F.col("sxx") - F.try_divide(sx * sx, n)) * (F.col("syy") - F.try_divide(sy * sy, n))
    r = F.try_divide(F.col("sxy") - F.try_divide(sx * sy, n), F.sqrt(F.nullif(spread, F.lit(0.0))))
    label = F.array(*[F.lit(c) for c in cols])
    return merged.select(label[F.col("i")].alias("feature_1"), label[F.col("j")].alias("feature_2"),
                         F.when((n > 1) & (spread > 0), r).alias("correlation"))


def high_correlations(df: DataFrame, cols: Sequence[str],
                      threshold: float = fixed.CORRELATION_THRESHOLD) -> DataFrame:
    """Pairs whose |r| reaches the threshold."""
    return (correlations(df, cols)
            .withColumn("absolute_correlation", F.abs("correlation"))
            .where(F.col("absolute_correlation") >= threshold))


def feature_audit(df: DataFrame, threshold: float = fixed.CORRELATION_THRESHOLD) -> dict:
    """Profile, constant columns and high correlations of the model inputs."""
    cols = numeric_columns(df, fixed.NOT_FEATURES)
    profile = profile_columns(df, cols)
    return {
        "feature_summary": profile.orderBy(F.desc("missing_percentage"), "feature"),
        "high_correlations": high_correlations(df, cols, threshold)
        .orderBy(F.desc("absolute_correlation"), "feature_1", "feature_2"),
        "constant_features": constant_columns(profile),
        "feature_count": len(cols),
    }
