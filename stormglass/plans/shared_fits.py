"""Fits on two features over the walk-forward folds, which SQL can repeat step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import models, together, validation
from ..storage import literal_table
from . import oracle
from .chain import KEYS
from .results import training
from .spec import Query

PAIR = ["UNRATE", "VIX"]
PENALTIES = (1.0, 0.1, 0.01)


def _folds(spark, t, target):
    return validation.prepare_folds(training(spark, t)[1], KEYS, target=target, cols=PAIR)


def scalers(spark, t):
    """Median, mean and deviation of both features in every training set."""
    data = _folds(spark, t, fixed.TARGET)
    rows = [(f.fold, c, s.median[c], s.mean[c], s.scale[c])
            for f in data.folds for s in [data.scalers[f.fold]] for c in s.features]
    return literal_table(spark, rows, "fold int, feature string, median double, mean double, scale double")


def penalised(spark, t):
    """Weights of all penalties and folds, with whether each is at its optimum."""
    data = _folds(spark, t, fixed.TARGET)
    sets = validation.fold_training_sets(data)
    settings = [together.Setting(f"L2 C={c:.2f}", i, c) for c in PENALTIES for i in range(len(data.folds))]
    scaled = [(s.median, s.mean, s.scale) for s in (data.scalers[f.fold] for f in data.folds)]
    fitted = together.fit_logistic_all(sets, settings, scaled)
    rows = [(s.name, data.folds[s.set].fold, intercept, beta[PAIR[0]], beta[PAIR[1]], residual < 1e-6)
            for s, (beta, intercept, residual, _) in zip(settings, fitted)]
    return literal_table(spark, rows, "model string, fold int, intercept double, first_weight double, second_weight double, "
                                      "at_optimum boolean")


def linear(spark, t):
    """Least-squares predictions of every test row from the normal equations of its fold."""
    data = _folds(spark, t, fixed.LEVEL_TARGET)
    scored, _ = validation.out_of_fold(data, {"Linear Regression": models.fit_linear}, score="prediction")
    return scored.select("fold", *KEYS, "date", F.col("actual"), "prediction")


def _sql(target: str) -> str:
    a, b = PAIR
    return f"""{oracle.targets().replace("targets AS (", "targets AS MATERIALIZED (")},
known AS MATERIALIZED (SELECT *, CAST({target} AS DOUBLE) AS y FROM targets
  WHERE {target} IS NOT NULL AND TARGET_STRESS_CHANGE_3M IS NOT NULL AND {fixed.TARGET} IS NOT NULL),
placed AS MATERIALIZED (SELECT entity, date, y, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b,
  dense_rank() OVER (ORDER BY date) AS pos, (SELECT count(DISTINCT date) FROM known) AS n FROM known),
folds AS (SELECT CAST(unnest(generate_series(1, 5)) AS BIGINT) AS fold),
mid AS (SELECT fold, median(a) AS ma, median(b) AS mb FROM placed, folds WHERE pos <= n - (6 - fold) * (n // 6) GROUP BY fold),
train AS MATERIALIZED (SELECT fold, y, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM placed, folds JOIN mid USING (fold)
  WHERE pos <= n - (6 - fold) * (n // 6)),
moments AS MATERIALIZED (SELECT fold, any_value(ma) AS ma, any_value(mb) AS mb, avg(a) AS ua, avg(b) AS ub, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
  covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, avg(y) AS uy, count(*) AS rows
  FROM train JOIN mid USING (fold) GROUP BY fold)"""


# Newton's method on the weighted log loss, one row of the recursion for each fold, penalty and step.
_NEWTON = f"""{_sql(fixed.TARGET)},
z AS MATERIALIZED (SELECT fold, y, (a - ua) / sa AS a, (b - ub) / sb AS b,
  CASE WHEN y = 1 THEN 1 / (2 * uy) ELSE 1 / (2 * (1 - uy)) END AS w FROM train JOIN moments USING (fold)),
steps(fold, c, k, i, u, v) AS (
  SELECT fold, c, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM folds, (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in PENALTIES)}]) AS c)
  UNION ALL
  SELECT fold, c, k + 1,
    i - (gi * (haa * hbb - hab * hab) - ga * (hia * hbb - hib * hab) + gb * (hia * hab - hib * haa)) / det,
    u - (-gi * (hia * hbb - hab * hib) + ga * (hii * hbb - hib * hib) - gb * (hii * hab - hia * hib)) / det,
    v - (gi * (hia * hab - haa * hib) - ga * (hii * hab - hia * hib) + gb * (hii * haa - hia * hia)) / det
  FROM (SELECT *, hii * (haa * hbb - hab * hab) - hia * (hia * hbb - hab * hib) + hib * (hia * hab - haa * hib) AS det FROM (
    SELECT fold, c, k, any_value(i) AS i, any_value(u) AS u, any_value(v) AS v, sum(w * (p - y)) AS gi,
      sum(w * (p - y) * a) + any_value(u) / c AS ga, sum(w * (p - y) * b) + any_value(v) / c AS gb,
      sum(w * p * (1 - p)) AS hii, sum(w * p * (1 - p) * a) AS hia, sum(w * p * (1 - p) * b) AS hib,
      sum(w * p * (1 - p) * a * a) + 1 / c AS haa, sum(w * p * (1 - p) * a * b) AS hab, sum(w * p * (1 - p) * b * b) + 1 / c AS hbb
    FROM (SELECT s.fold, c, k, i, u, v, a, b, y, w, 1 / (1 + exp(-(i + u * a + v * b))) AS p FROM steps AS s JOIN z ON z.fold = s.fold
      WHERE k < 12)
    GROUP BY fold, c, k)))"""


def queries() -> list[Query]:
    by_feature = " UNION ALL ".join(
        f"SELECT fold, '{c}' AS feature, m{x} AS median, u{x} AS mean, s{x} AS scale FROM moments" for c, x in zip(PAIR, "ab"))
    return [
        Query("a19_a20_scalers_by_fold", scalers, {"fold": "i", "feature": "s", "median": "f6", "mean": "f6", "scale": "f6"},
              by_feature, _sql(fixed.TARGET)),
        Query("m2_m3_penalties_by_fold", penalised,
              {"model": "s", "fold": "i", "intercept": "f5", "first_weight": "f5", "second_weight": "f5", "at_optimum": "b"},
              """SELECT 'L2 C=' || printf('%.2f', c) AS model, fold, i AS intercept, u AS first_weight, v AS second_weight,
                 true AS at_optimum FROM steps WHERE k = 12""", "RECURSIVE " + _NEWTON),
        Query("m9_m16_linear_by_fold", linear,
              {"fold": "i", "entity": "s", "date": "d", "actual": "f6", "prediction": "f6"},
              """SELECT fold, entity, date, y AS actual, uy + (coalesce(a, ma) - ua) * (cay * sb * sb - cby * cab) / (sa * sa * sb * sb - cab * cab)
                 + (coalesce(b, mb) - ub) * (cby * sa * sa - cay * cab) / (sa * sa * sb * sb - cab * cab) AS prediction
                 FROM placed, folds JOIN moments USING (fold)
                 WHERE pos > n - (6 - fold) * (n // 6) AND pos <= n - (5 - fold) * (n // 6)""", _sql(fixed.LEVEL_TARGET)),
    ]
