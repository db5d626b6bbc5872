"""Linear attribution of a score and the driver tables built from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import conform, lenient_double
from ..storage import literal_table
from .timeseries import background, latest_rows


def groups_table(spark: SparkSession,
                 groups: Mapping[str, Sequence[str]] = fixed.FEATURE_GROUPS) -> DataFrame:
    rows = [(f, g) for g, features in groups.items() for f in features]
    return literal_table(spark, rows, "feature string, group string")


def with_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Add the group of each feature; unknown features get the default group."""
    return (df.join(groups, "feature", "left")
            .withColumn("group", F.coalesce("group", F.lit(fixed.OTHER_GROUP))))


def attribution(df: DataFrame, coef: DataFrame, features: Sequence[str], keys: Sequence[str],
                order: str = "date", n: int = 200) -> DataFrame:
    """beta * (scaled latest value - mean scaled background value), per key and feature.

    `coef` has one row per feature (median, mean, scale, beta). The mean of imputed
    values needs only a sum and a null count per feature, so the n background rows are
    reduced to one row per key before they are unpivoted to features.
    """
    ready = conform(df, [*keys, order, *features]).withColumns(
        {c: lenient_double(F.col(c)) for c in features})
    latest = latest_rows(ready, keys, order).unpivot(
        [*keys, order], list(features), "feature", "value")
    past = background(ready, keys, order, n).groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.coalesce(F.sum(c), F.lit(0.0)).alias("total"), F.count(c).alias("known"))
          .alias(c) for c in features])
    past = past.unpivot([*keys, "_rows"], list(features), "feature", "_past")
    rows = latest.join(past, [*keys, "feature"]).join(coef, "feature")
    unknown = F.col("_rows") - F.col("_past.known")
    mean = (F.col("_past.total") + unknown * F.col("median")) / F.col("_rows")
    phi = F.col("beta") * (F.coalesce("value", "median") - mean) / F.col("scale")
    return rows.select(*keys, order, "feature", "value", phi.alias("shap_value"),
                       F.abs(phi).alias("absolute_shap"))


def group_totals(attr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed and absolute contribution and the number of features of each group."""
    return attr.groupBy(*keys, "group").agg(
        F.sum("shap_value").alias("shap_value"),
        F.sum(F.abs("shap_value")).alias("absolute_shap"),
        F.count("feature").alias("feature_count"))


def top_rows(df: DataFrame, keys: Sequence[str], best, name: str, top: int | None) -> DataFrame:
    """The first `top` rows of every key in the order of `best`, then by name."""
    w = Window.partitionBy(*keys).orderBy(best, F.col(name))
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def driver_tables(attr: DataFrame, keys: Sequence[str], top: int = 8) -> dict[str, DataFrame]:
    """Individual and grouped drivers: by size, raising the risk, lowering the risk."""
    value = F.col("shap_value")
    groups = group_totals(attr, keys)
    up, down = F.desc("shap_value"), F.asc("shap_value")
    return {
        "top_contributions": top_rows(attr, keys, F.desc("absolute_shap"), "feature", top),
        "increasing_risk": top_rows(attr.where(value > 0), keys, up, "feature", top),
        "reducing_risk": top_rows(attr.where(value < 0), keys, down, "feature", top),
        "grouped_contributions": top_rows(groups, keys, F.desc("absolute_shap"), "group", None),
        "grouped_increasing_risk": top_rows(groups.where(value > 0), keys, up, "group", None),
        "grouped_reducing_risk": top_rows(groups.where(value < 0), keys, down, "group", None),
    }


def explanation_arrays(attr: DataFrame, keys: Sequence[str], top: int = 8) -> DataFrame:
    """All driver lists as nested arrays, one row per key.

    A key has one row per feature here, so the collected lists are bounded by the number
    of features.
    """
    item = F.struct("feature", "group", "value", "shap_value", "absolute_shap")
    groups = group_totals(attr, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("group", "shap_value", "absolute_shap", "feature_count"))
        .alias("_groups"))
    lists = attr.groupBy(*keys).agg(F.collect_list(item).alias("_items")).join(groups, list(keys))

    def ordered(col, measure, name, keep=None, limit=None):
        rows = F.col(col) if keep is None else F.filter(col, keep)
        sign = -1 if measure != "-shap_value" else 1
        field = measure.lstrip("-")
        keyed = F.transform(rows, lambda r: F.struct((r[field] * sign).alias("by"),
                                                     r[name].alias("name"), r.alias("row")))
        done = F.transform(F.array_sort(keyed), lambda r: r["row"])
        return done if limit is None else F.slice(done, 1, limit)

    def up(r):
        return r["shap_value"] > 0

    def down(r):
        return r["shap_value"] < 0
    return lists.select(
        *keys,
        ordered("_items", "absolute_shap", "feature", None, top).alias("top_contributions"),
        ordered("_items", "shap_value", "feature", up, top).alias("increasing_risk"),
        ordered("_items", "-shap_value", "feature", down, top).alias("reducing_risk"),
        ordered("_groups", "absolute_shap", "group").alias("grouped_contributions"),
        ordered("_groups", "shap_value", "group", up).alias("grouped_increasing_risk"),
        ordered("_groups", "-shap_value", "group", down).alias("grouped_reducing_risk"))
