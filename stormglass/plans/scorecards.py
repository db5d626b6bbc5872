"""Validation, tuning, comparison, scoring and storage with the scorecard fit, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import index, models, validation
from ..operators.timeseries import latest_rows
from ..sources import load_model, save_model
from ..storage import materialise, scratch_path
from . import chain, oracle
from .chain import KEYS
from .results import FOLD, SUMMARY
from .spec import Query

NAME = "Scorecard"
FITS = {NAME: models.fit_scorecard}
FULL = [*fixed.SERIES, *chain.FEATURES, *fixed.Z_INPUTS, "ECON_STRESS", *chain.TRENDS]
RATES = {"precision": "f4", "recall": "f4", "f1": "f4", "true_positives": "i",
         "false_positives": "i", "false_negatives": "i", "true_negatives": "i"}


def training(spark, t):
    full = materialise(chain.targets(spark, t), "features")
    return full, index.training_set(full)


def walk(which, unit="date", threshold=0.5):
    return lambda s, t: validation.walk_forward(training(s, t)[1], KEYS, FITS, threshold, unit=unit)[which]


def benchmark(spark, t):
    fits = {validation.BASELINE: models.fit_majority, **FITS}
    return validation.benchmark(training(spark, t)[1], KEYS, fits=fits)[0]


def latest(spark, t):
    full, rows = training(spark, t)
    rows, cols = models.model_inputs(rows, KEYS)
    return models.score_latest(latest_rows(full, KEYS), models.fit_scorecard(rows, cols), KEYS)


def saved(spark, t):
    """Fit, save, load, and score with what was loaded."""
    full, rows = training(spark, t)
    model, metadata = validation.train_final(rows, KEYS, fixed.ALERT_THRESHOLD, fit=models.fit_scorecard)
    loaded, meta = load_model(spark, save_model(model, metadata, scratch_path(spark, "model")))
    m = meta.first()  # one row
    return models.score_latest(latest_rows(full, KEYS), loaded, KEYS).withColumns(
        {c: F.lit(m[c]) for c in ("training_rows", "feature_count")})


# --- SQL ------------------------------------------------------------------------

_KNOWN = "known AS MATERIALIZED (SELECT * FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL)"
_BY_DATE = "SELECT *, dense_rank() OVER (ORDER BY date) AS pos, (SELECT count(DISTINCT date) FROM known) AS n FROM known"
_BY_ROW = "SELECT *, row_number() OVER (ORDER BY date, md5(entity), entity) AS pos, count(*) OVER () AS n FROM known"
_ALL = "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back FROM targets"
_TRAIN = "pos <= n - (6 - fold) * (n // 6)"
_TEST = "pos > n - (6 - fold) * (n // 6) AND pos <= n - (5 - fold) * (n // 6)"


def scored_sql(sets, placed=_BY_DATE, train=_TRAIN, test=_TEST, folds=5) -> str:
    """Scores of the test rows of each fold by a scorecard of its training rows, for each feature set."""
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    long = " UNION ALL ".join(f"SELECT {{0}}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM placed"
                              for c in every).format("* EXCLUDE (" + ", ".join(every) + ")")
    members = ", ".join(f"('{name}', '{c}')" for name, cols in sets.items() for c in cols)
    targets = oracle.targets().replace("targets AS (", "targets AS MATERIALIZED (")
    return f"""{targets},
{_KNOWN},
placed AS MATERIALIZED ({placed}),
long AS MATERIALIZED (SELECT *, TARGET_RISK_RISING_3M AS actual FROM ({long})),
folds AS (SELECT CAST(unnest(generate_series(1, {folds})) AS BIGINT) AS fold),
sets(model, feature) AS (VALUES {members}),
medians AS (SELECT fold, feature, median(value) AS median FROM long, folds WHERE {train} GROUP BY fold, feature),
moments AS (SELECT fold, feature, any_value(median) AS median, avg(x) AS mean, stddev_pop(x) AS dev,
                   covar_pop(x, actual) / nullif(stddev_pop(x) * stddev_pop(actual), 0) AS r
            FROM (SELECT *, coalesce(value, median) AS x FROM long JOIN medians USING (feature)
                  WHERE {train} AND median IS NOT NULL) GROUP BY fold, feature),
coef AS MATERIALIZED (SELECT *, CASE WHEN dev > 1e-12 * abs(mean) THEN r / dev ELSE 0 END AS beta FROM moments),
scored AS MATERIALIZED (
  SELECT model, fold, entity, date, any_value(actual) AS actual,
         1 / (1 + exp(-sum(coalesce(beta, 0) * (coalesce(value, median) - mean)))) AS probability
  FROM long JOIN coef USING (feature) JOIN sets USING (feature) WHERE {test} GROUP BY model, fold, entity, date)"""


def fold_sql(sets, threshold, **how) -> str:
    """The CTEs up to `folded`: the metrics of every model and fold."""
    by = "model, fold"
    return f"""{scored_sql(sets, **how)},
{oracle.confusion(by, str(threshold))},
{oracle.ranking(by)},
facts AS (SELECT model, fold, min(date) AS test_start, max(date) AS test_end, sum(actual) AS positive_cases
          FROM scored GROUP BY model, fold),
folded AS (SELECT * FROM rates JOIN auc USING (model, fold) JOIN ap USING (model, fold)
           JOIN facts USING (model, fold))"""


_SUMMARY_SQL = """SELECT model, count(*) AS folds, avg(precision) AS average_precision,
    avg(recall) AS average_recall, avg(f1) AS average_f1, avg(pr_auc) AS average_pr_auc,
    avg(roc_auc) AS average_roc_auc, sum(true_positives) AS total_true_positives,
    sum(false_positives) AS total_false_positives, sum(false_negatives) AS total_false_negatives
    FROM folded GROUP BY model"""


def queries() -> list[Query]:
    one = {NAME: FULL}
    both = {f"Full {len(FULL)}-Feature Model": FULL, "Curated Feature Model": list(fixed.CURATED_FEATURES)}
    alert = fixed.ALERT_THRESHOLD
    sweep = " UNION ALL ".join(
        f"SELECT {x} AS threshold, * FROM (WITH {oracle.confusion(threshold=str(x))} SELECT * FROM rates)"
        for x in fixed.THRESHOLDS)
    split = scored_sql(one, train="pos <= floor(n * 0.8)", test="pos > floor(n * 0.8)", folds=1)
    split = split.replace("scored AS MATERIALIZED", "fitted AS MATERIALIZED")
    split += f""",
scored AS MATERIALIZED (SELECT * FROM fitted UNION ALL
  SELECT '{validation.BASELINE}', fold, entity, date, actual, CASE WHEN (
    SELECT 2 * sum(TARGET_RISK_RISING_3M) > count(*) FROM placed WHERE pos <= floor(n * 0.8))
    THEN 1.0 ELSE 0.0 END FROM fitted),
{oracle.confusion("model", "0.5")},
{oracle.ranking("model")}"""
    now = scored_sql(one, _ALL, "actual IS NOT NULL", "back = 1", 1)
    return [
        Query("m14_scorecard_folds", walk(0), FOLD, "SELECT * FROM folded", fold_sql(one, 0.5)),
        Query("m14_scorecard_folds_by_row", walk(0, "row", alert), FOLD, "SELECT * FROM folded",
              fold_sql(one, alert, placed=_BY_ROW)),
        Query("m14_scorecard_summary", walk(1), SUMMARY, _SUMMARY_SQL, fold_sql(one, 0.5)),
        Query("m17_scorecard_tuning",
              lambda s, t: validation.tune_threshold(training(s, t)[1], KEYS, fit=models.fit_scorecard)[0],
              {"threshold": "f2", **RATES}, sweep, scored_sql(one)),
        Query("m18_scorecard_feature_sets",
              lambda s, t: validation.compare_feature_sets(training(s, t)[1], KEYS,
                                                           fit=models.fit_scorecard)[1],
              SUMMARY, _SUMMARY_SQL, fold_sql(both, alert)),
        Query("m11_m12_scorecard_benchmark", benchmark,
              {"model": "s", "accuracy": "f4", "precision": "f4", "recall": "f4", "f1": "f4",
               "roc_auc": "f4", "pr_auc": "f4"},
              "SELECT * FROM rates JOIN auc USING (model) JOIN ap USING (model)", split),
        Query("m21_scorecard_latest", latest,
              {"entity": "s", "observation_date": "d", "current_stress": "f6",
               "risk_probability": "f4", "warning_active": "b", "warning_level": "s"},
              f"""SELECT entity, date AS observation_date, ECON_STRESS AS current_stress,
                  probability AS risk_probability, probability >= {alert} AS warning_active,
                  CASE WHEN probability < 0.2 THEN 'Low' WHEN probability < {alert} THEN 'Guarded'
                  WHEN probability < 0.6 THEN 'Elevated' WHEN probability < 0.8 THEN 'High'
                  ELSE 'Critical' END AS warning_level
                  FROM scored JOIN (SELECT entity, date, ECON_STRESS FROM targets) USING (entity, date)""", now),
        Query("s9_saved_scorecard", saved,
              {"entity": "s", "observation_date": "d", "risk_probability": "f4", "training_rows": "i",
               "feature_count": "i"},
              """SELECT entity, date AS observation_date, probability AS risk_probability,
                 (SELECT count(*) FROM known) AS training_rows, (SELECT count(*) FROM coef) AS feature_count
                 FROM scored""", now),
    ]
