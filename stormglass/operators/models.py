"""Linear fits from shared scans, trees on Spark ML, with imputation and scaling as plain column expressions.

A fitted model is a small table of numbers or a Spark ML model; scoring is a projection,
so it needs no shuffle. Training frames are scanned many times: pass a materialised table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import (conform, lenient_double, numeric_columns, warning_active,
                         warning_level)
from ..storage import literal_table
from . import boosting, together

COEF_SCHEMA = "feature string, median double, mean double, scale double, beta double"
SEED = 42


def model_inputs(df: DataFrame, keys: Sequence[str] = (),
                 target: str = fixed.TARGET) -> tuple[DataFrame, list[str]]:
    """Labelled rows with an int label, and the names of the numeric features."""
    cols = numeric_columns(df, [*fixed.NOT_FEATURES, *keys])
    return df.where(F.col(target).isNotNull()), cols


# --- imputation and scaling ----------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """Per feature: median to impute, then mean and population deviation to scale by."""

    median: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.median)

    def narrow(self, cols: Sequence[str]) -> Scaler:
        """The same for some of the features, in their order."""
        keep = [c for c in cols if c in self.median]
        return Scaler(*[{c: part[c] for c in keep} for part in (self.median, self.mean, self.scale)])

    def imputed(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(self.median[name]))

    def scaled(self, name: str) -> Column:
        return (self.imputed(name) - self.mean[name]) / self.scale[name]


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Exact medians, then moments of the imputed columns. All-null columns are left out."""
    found = together.scalers(together.training_sets(df, cols, cols[0]))[0]
    if not found[0]:
        raise ValueError("no feature has a value")
    return Scaler(*found)


def class_balance(df: DataFrame, target: str = fixed.TARGET) -> tuple[int, int]:
    """(negatives, positives)."""
    row = df.agg(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).first()
    return row[0], row[1]


def _balanced(target: str, neg: int, pos: int) -> Column:
    n = neg + pos
    return F.when(F.col(target) == 1, n / (2 * pos)).otherwise(n / (2 * neg))


def _assembled(df: DataFrame, columns: Mapping[str, Column], label: Column,
               weight: Column | None = None) -> DataFrame:
    """Only label, weight and the feature vector."""
    out = df.select(label.cast("double").alias("label"),
                    (F.lit(1.0) if weight is None else weight).alias("weight"),
                    *[c.alias(n) for n, c in columns.items()])
    return (VectorAssembler(inputCols=list(columns), outputCol="features").transform(out)
            .select("label", "weight", "features"))


# --- logistic regression -------------------------------------------------------


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients in scaled space."""

    scaler: Scaler
    beta: dict[str, float]
    intercept: float

    def log_odds(self) -> Column:
        terms = [self.scaler.scaled(c) * b for c, b in self.beta.items() if b != 0.0]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def score(self, df: DataFrame, col: str = "probability") -> DataFrame:
        return df.withColumn(col, self.probability())

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """One row per feature, and one named "(intercept)"."""
        s = self.scaler
        rows = [(c, s.median[c], s.mean[c], s.scale[c], b) for c, b in self.beta.items()]
        return literal_table(spark, [*rows, ("(intercept)", None, None, None, self.intercept)],
                             COEF_SCHEMA)


def logistic_from_table(coef: DataFrame) -> LogisticModel:
    """Model from its coefficient table, which has one row per feature."""
    rows = coef.collect()
    named = {r["feature"]: r for r in rows}
    intercept = named.pop("(intercept)")["beta"]
    scaler = Scaler(*[{c: r[k] for c, r in named.items()} for k in ("median", "mean", "scale")])
    return LogisticModel(scaler, {c: r["beta"] for c, r in named.items()}, intercept)


def _ratio(penalty: str, l1_ratio: float | None) -> float:
    return {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]


def fit_logistic(df: DataFrame, cols: Sequence[str], target: str = fixed.TARGET, C: float = 1.0,
                 penalty: str = "l2", l1_ratio: float | None = None,
                 scaler: Scaler | None = None, max_iter: int = 60,
                 tol: float = 1e-8) -> LogisticModel:
    """Median-imputed, standardised, class-balanced logistic regression.

    Minimises C * sum(weight * loss) + penalty on scaled inputs by proximal Newton steps, one scan each. tol bounds the
    optimality residual for each unit of weight; a fit that does not reach it within max_iter scans is an error.
    """
    scaler = scaler or fit_scaler(df, cols)
    sets = together.training_sets(df, scaler.features, target)
    setting = together.Setting("Logistic Regression", 0, C, _ratio(penalty, l1_ratio))
    ((beta, intercept, *_),) = together.fit_logistic_all(
        sets, [setting], [(scaler.median, scaler.mean, scaler.scale)], tol, max_iter)
    return LogisticModel(scaler, beta, intercept)


def fit_scorecard(df: DataFrame, cols: Sequence[str], target: str = fixed.TARGET,
                  scaler: Scaler | None = None) -> LogisticModel:
    """Scorecard without a solver: each scaled feature weighs as much as its correlation with the label.

    One scan after the scaler's. A constant feature, or a label of one class, has weight 0.
    """
    scaler = scaler or fit_scaler(df, cols)
    (moments,) = together.co_moments(together.training_sets(df, scaler.features, target), scaler.median)
    return LogisticModel(scaler, together.correlations_with_target(moments, scaler.median), 0.0)


def nonzero_coefficients(model: LogisticModel, eps: float = 1e-8) -> int:
    return sum(abs(b) > eps for b in model.beta.values())


# --- trees, baseline, regression -----------------------------------------------


@dataclass(frozen=True)
class TreeModel:
    """A fitted Spark ML tree ensemble on imputed inputs."""

    scaler: Scaler
    model: Any
    classifier: bool = True

    def score(self, df: DataFrame, col: str = "probability") -> DataFrame:
        names = [f"_in{i}" for i in range(len(self.scaler.features))]
        ready = df.withColumns({n: self.scaler.imputed(c)
                                for n, c in zip(names, self.scaler.features)})
        ready = VectorAssembler(inputCols=names, outputCol="_features").transform(ready).drop(*names)
        out = self.model.transform(ready)
        value = (vector_to_array("_probability")[1] if self.classifier else F.col("_prediction"))
        return out.withColumn(col, value).drop("_features", "_probability", "_prediction", "_raw")

    def importance(self, spark: SparkSession, top: int = 15) -> DataFrame:
        """The most important features, largest first."""
        rows = list(zip(self.scaler.features, map(float, self.model.featureImportances.toArray())))
        return (literal_table(spark, rows, "feature string, importance double")
                .orderBy(F.desc("importance"), "feature").limit(top))


CLASSIFIER_COLUMNS = {"labelCol": "label", "weightCol": "weight"}


def _named(model):
    model.setFeaturesCol("_features").setPredictionCol("_prediction")
    if hasattr(model, "setProbabilityCol"):
        model.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return model


def fit_forest(df: DataFrame, cols: Sequence[str], target: str = fixed.TARGET, trees: int = 500,
               depth: int = 10, min_leaf: int = 3, scaler: Scaler | None = None) -> TreeModel:
    """Class-balanced random forest; each split looks at the square root of the features."""
    scaler = scaler or fit_scaler(df, cols)
    weight = _balanced(target, *class_balance(df, target))
    data = _assembled(df, {c: scaler.imputed(c) for c in scaler.features}, F.col(target), weight)
    fit = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                 featureSubsetStrategy="sqrt", seed=SEED,
                                 **CLASSIFIER_COLUMNS).fit(data)
    return TreeModel(scaler, _named(fit))


@dataclass(frozen=True)
class BoostedModel:
    """Boosted trees with leaf penalties on imputed inputs."""

    scaler: Scaler
    cols: list[str]
    trees: boosting.Boosted

    def score(self, df: DataFrame, col: str = "probability") -> DataFrame:
        inputs = [self.scaler.imputed(c) if c in self.scaler.median else F.lit(0.0) for c in self.cols]
        return df.withColumn(col, 1 / (1 + F.exp(-self.trees.margin(inputs))))


def fit_boosted(df: DataFrame, cols: Sequence[str], target: str = fixed.TARGET,
                scaler: Scaler | None = None, **settings) -> BoostedModel:
    """Boosted trees; positives weigh negatives / positives. `settings`: those of `boosting.Boosting`."""
    scaler = scaler or fit_scaler(df, cols)
    ((model,),) = _all_boosted(together.training_sets(df, scaler.features, target), [scaler], [settings], [scaler.features])
    return model


@dataclass(frozen=True)
class MajorityModel:
    """Always the more frequent class; the smaller label on a tie."""

    label: int

    def score(self, df: DataFrame, col: str = "probability") -> DataFrame:
        return df.withColumn(col, F.lit(float(self.label)))


def fit_majority(df: DataFrame, cols: Sequence[str] = (), target: str = fixed.TARGET,
                 scaler: Scaler | None = None) -> MajorityModel:
    neg, pos = class_balance(df, target)
    return MajorityModel(int(pos > neg))


def fit_forest_regressor(df: DataFrame, cols: Sequence[str], target: str = fixed.LEVEL_TARGET,
                         trees: int = 500, depth: int = 12, min_leaf: int = 2,
                         scaler: Scaler | None = None) -> TreeModel:
    scaler = scaler or fit_scaler(df, cols)
    data = _assembled(df, {c: scaler.imputed(c) for c in scaler.features}, F.col(target))
    fit = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                featureSubsetStrategy="all", labelCol="label", seed=SEED).fit(data)
    return TreeModel(scaler, _named(fit), classifier=False)


@dataclass(frozen=True)
class LinearModel:
    """Least squares on scaled inputs."""

    scaler: Scaler
    beta: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def score(self, df: DataFrame, col: str = "prediction") -> DataFrame:
        terms = [self.scaler.scaled(c) * b for c, b in self.beta.items()]
        return df.withColumn(col, reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))


def fit_linear(df: DataFrame, cols: Sequence[str], target: str = fixed.LEVEL_TARGET,
               scaler: Scaler | None = None) -> LinearModel:
    """Ordinary least squares by the normal equations. Scaling the target would not change the predictions."""
    scaler = scaler or fit_scaler(df, cols)
    (moments,) = together.co_moments(together.training_sets(df, scaler.features, target), scaler.median)
    return LinearModel(scaler, *together.least_squares(moments, scaler.median, scaler.scale))


# --- the same fits for many training sets at once ------------------------------


def _all_logistic(sets: together.TrainingSets, scalers: Sequence[Scaler], options: Sequence[dict],
                  cols: Sequence[Sequence[str]]) -> list[list[LogisticModel]]:
    settings = [together.Setting(str(o), f, o.get("C", 1.0), _ratio(o.get("penalty", "l2"), o.get("l1_ratio")), tuple(use))
                for o, use in zip(options, cols) for f in range(sets.count)]
    fitted = iter(together.fit_logistic_all(sets, settings, [(s.median, s.mean, s.scale) for s in scalers]))
    return [[LogisticModel(scalers[f].narrow(use), *next(fitted)[:2]) for f in range(sets.count)] for use in cols]


def _all_scorecards(sets, scalers, options, cols) -> list[list[LogisticModel]]:
    moments = together.co_moments(sets, scalers[-1].median)
    out = []
    for use in cols:
        narrow = [s.narrow(use) for s in scalers]
        out.append([LogisticModel(s, together.correlations_with_target(m, s.median), 0.0) for s, m in zip(narrow, moments)])
    return out


def _all_linear(sets, scalers, options, cols) -> list[list[LinearModel]]:
    moments = together.co_moments(sets, scalers[-1].median)
    return [[LinearModel(s, *together.least_squares(m, s.median, s.scale))
             for s, m in zip([s.narrow(use) for s in scalers], moments)] for use in cols]


# Fits whose training sets share their scans: (sets, scalers, options, columns) -> models by option and set.
def _all_boosted(sets, scalers, options, cols) -> list[list[BoostedModel]]:
    fitted = [boosting.fit_all(sets, [s.median for s in scalers], boosting.Boosting(**o), use) for o, use in zip(options, cols)]
    return [[BoostedModel(s, list(sets.cols), trees) for s, trees in zip(scalers, row)] for row in fitted]


TOGETHER = {fit_logistic: _all_logistic, fit_scorecard: _all_scorecards, fit_linear: _all_linear, fit_boosted: _all_boosted}


# --- scoring the latest rows ---------------------------------------------------


def score_latest(latest: DataFrame, model: LogisticModel, keys: Sequence[str],
                 threshold: float = fixed.ALERT_THRESHOLD, order: str = "date",
                 name: str = "Logistic Regression") -> DataFrame:
    """Assessment of the latest row of every key; absent features count as missing."""
    features = model.scaler.features
    ready = conform(latest, [*keys, order, *dict.fromkeys([*features, "ECON_STRESS"])])
    ready = ready.withColumns({c: lenient_double(F.col(c)) for c in features})
    p = F.col("risk_probability")
    return (model.score(ready, "risk_probability")
            .select(*keys, F.col(order).alias("observation_date"),
                    F.col("ECON_STRESS").alias("current_stress"), p,
                    F.lit(float(threshold)).alias("warning_threshold"),
                    warning_active(p, threshold).alias("warning_active"),
                    warning_level(p, threshold).alias("warning_level"),
                    F.lit(fixed.HORIZON_MONTHS).alias("forecast_horizon_months"),
                    F.lit(name).alias("model_name")))


def log_loss_gradient(df: DataFrame, model: LogisticModel, target: str, C: float) -> float:
    """Largest absolute gradient of the L2 objective at the model, per unit of weight."""
    neg, pos = class_balance(df, target)
    p = model.probability()
    pull = _balanced(target, neg, pos) * (p - F.col(target))
    row = df.agg(F.sum(pull).alias("b"),
                 *[F.sum(pull * model.scaler.scaled(c)).alias(c) for c in model.beta]).first()
    n = neg + pos
    parts = [row["b"] / n, *[(row[c] + b / C) / n for c, b in model.beta.items()]]
    return max(map(math.fabs, parts))
