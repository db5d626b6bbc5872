"""Queries over fitted models and result documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import fixed
from ..operators import documents, explain, index, models, together, validation
from ..operators.timeseries import latest_rows
from ..sources import load_model, read_documents, save_model, write_documents
from ..storage import literal_table, materialise, scratch_path
from . import chain, oracle
from .chain import KEYS
from .spec import Query

FOLD = {"model": "s", "fold": "i", "test_start": "d", "test_end": "d", "positive_cases": "i",
        "precision": "f4", "recall": "f4", "f1": "f4", "pr_auc": "f4", "roc_auc": "f4",
        "true_positives": "i", "false_positives": "i", "false_negatives": "i",
        "true_negatives": "i"}
SUMMARY = {"model": "s", "folds": "i", "average_precision": "f4", "average_recall": "f4",
           "average_f1": "f4", "average_pr_auc": "f4", "average_roc_auc": "f4",
           "total_true_positives": "i", "total_false_positives": "i",
           "total_false_negatives": "i"}


def training(spark, t):
    """The full feature table, written once, and its labelled rows."""
    full = materialise(chain.targets(spark, t), "features")
    return full, index.training_set(full)


def inputs(spark, t):
    """What a fit sees: label, class weight and the number of features of every row."""
    _, rows = training(spark, t)
    rows, cols = models.model_inputs(rows, KEYS)
    return rows.select("entity", "date", F.col(fixed.TARGET).alias("label"),
                       F.lit(len(cols)).alias("features"))


def logistic(penalty, ratio=None):
    def build(spark, t):
        _, rows = training(spark, t)
        rows, cols = models.model_inputs(rows, KEYS)
        fit = models.fit_logistic(rows, cols, penalty=penalty, l1_ratio=ratio, C=0.3)
        return fit.coefficients(spark)
    return build


def nonzero(spark, t):
    """All penalties on one training set, fitted side by side."""
    _, rows = training(spark, t)
    rows, cols = models.model_inputs(rows, KEYS)
    rows = materialise(rows.select(*KEYS, "date", fixed.TARGET, *cols), "inputs")
    sets = together.training_sets(rows, cols, fixed.TARGET)
    settings = [together.Setting(name, 0, c, {"l2": 0.0, "l1": 1.0}.get(p, r))
                for name, p, c, r in validation.REGULARISATION_GRID]
    return together.residual_table(spark, settings, together.fit_logistic_all(sets, settings, together.scalers(sets)))


def majority(spark, t):
    _, rows = training(spark, t)
    return models.fit_majority(rows).score(rows)


def importance(fit, target=fixed.TARGET):
    def build(spark, t):
        _, rows = training(spark, t)
        rows, cols = models.model_inputs(rows, KEYS, target)
        return fit(rows, cols, target=target).importance(spark, 15)
    return build


def fitted_scores(fit, target, col):
    def build(spark, t):
        _, rows = training(spark, t)
        rows, cols = models.model_inputs(rows, KEYS, target)
        return fit(rows, cols, target=target).score(rows, col)
    return build


def final(spark, t):
    full, rows = training(spark, t)
    model, metadata = validation.train_final(rows, KEYS, fixed.ALERT_THRESHOLD)
    return full, model, metadata


def saved_model(spark, t):
    """Save, load, and score with what was loaded."""
    full, model, metadata = final(spark, t)
    path = save_model(model, metadata, scratch_path(spark, "model"))
    loaded, meta = load_model(spark, path)
    scored = models.score_latest(latest_rows(full, KEYS), loaded, KEYS)
    m = meta.first()  # one row
    return scored.withColumns({c: F.lit(m[c]) for c in ("training_rows", "feature_count")})


def latest_scores(spark, t):
    full, model, _ = final(spark, t)
    return models.score_latest(latest_rows(full, KEYS), model, KEYS)


def explanation(spark, full, model):
    attr = explain.attribution(full, model.coefficients(spark), model.scaler.features, KEYS)
    return explain.with_groups(attr, explain.groups_table(spark))


def explained(spark, t):
    full, model, _ = final(spark, t)
    return explanation(spark, full, model)


def risk_documents(spark, t):
    full, rows = training(spark, t)
    model, _ = validation.train_final(rows, KEYS, fixed.ALERT_THRESHOLD)
    folds, _ = validation.walk_forward(rows, KEYS, {"Logistic Regression": models.fit_logistic},
                                       fixed.ALERT_THRESHOLD)
    assessment = models.score_latest(latest_rows(full, KEYS), model, KEYS)
    attr = explanation(spark, full, model)
    dates = attr.groupBy(*KEYS).agg(F.max("date").alias("observation_date"))
    lists = explain.explanation_arrays(attr, KEYS).join(dates, KEYS)
    docs, _ = documents.risk_document(assessment, lists, folds, KEYS,
                                      len(model.scaler.features))
    return docs


def flat_risk(spark, t):
    d = risk_documents(spark, t)
    return d.select(
        "entity", "status", "assessment.*", F.size("drivers.features_reducing_risk").alias("down"),
        F.size("drivers.categories_increasing_risk").alias("categories_up"),
        F.col("model.validation.average_recall").alias("average_recall"),
        F.col("interpretation.warning_message").alias("message"),
        F.to_json(F.struct("drivers", "limitations")).alias("body"))


def risk_views(spark, t):
    views = documents.result_views(KEYS, risk=risk_documents(spark, t))
    return views["assessment"].join(views["explanation"].select("entity", "observation_date",
                                                                "drivers"), "entity").select(
        "entity", "assessment.warning_level", "observation_date",
        F.col("interpretation.summary").alias("summary"),
        F.col("drivers.features_increasing_risk")[0]["feature"].alias("first_driver"))


def history(spark, t):
    return documents.history_document(chain.labelled(spark, t), KEYS)


def flat_history(spark, t):
    h = history(spark, t)
    return h.select("entity", "status", F.col("metadata.start_date").alias("start_date"),
                    F.col("metadata.end_date").alias("end_date"),
                    F.col("metadata.observation_count").alias("observation_count"),
                    "summary.*", F.size("crisis_periods").alias("periods"),
                    F.size("series").alias("points"), F.size("notes").alias("notes"),
                    F.element_at("series", 1)["date"].alias("first_point"),
                    F.element_at("series", -1)["economic_stress"].alias("last_point"))


def landed_history(spark, t):
    """Write the documents as JSON, read them back strictly, and unnest the series."""
    docs = history(spark, t)
    path = write_documents(docs, scratch_path(spark, "history"))
    back = read_documents(spark, path, docs.schema)
    return back.select("entity", F.explode("series").alias("p")).select("entity", "p.*")


def crisis_view(spark, t):
    views = documents.result_views(KEYS, history=history(spark, t))
    return views["crises"].select("entity", F.explode("crisis_periods").alias("p"), "note").select(
        "entity", "p.*", "note")


def history_view(spark, t):
    views = documents.result_views(KEYS, history=history(spark, t))
    return views["stress_history"].select("entity", "status", F.explode("series").alias("p")).select(
        "entity", "status", "p.*")


def date_check(spark, t):
    """Explanations that are current, a month old, or absent, by entity."""
    rows = chain.monthly(t)
    last = latest_rows(rows.select("entity", "date"), KEYS)
    a = last.select("entity", F.col("date").alias("observation_date"))
    a = a.where(F.col("entity") != "HOUSEHOLD")
    e = last.where(F.col("entity") != "MACHINERY").select(
        "entity", F.when(F.col("entity") == "BUILDING", F.add_months("date", -1))
        .otherwise(F.col("date")).alias("observation_date"))
    good, bad = documents.match_dates(a, e, KEYS)
    return bad.unionByName(good.select("entity", F.lit("accepted").alias("reason")))


def queries() -> list[Query]:
    o = oracle
    risk = fixed.TARGET
    known = o.targets() + ",\nknown AS (SELECT * FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL)"
    coef = {"feature": "s", "median": "f4", "mean": "f4", "scale": "f4", "beta": "f4"}
    level = {"entity": "s", "date": "d", "TARGET_STRESS_3M": "f6", "prediction": "f4"}
    chance = {"entity": "s", "date": "d", risk: "i", "probability": "f4"}

    def wf(call, fits, which):
        return lambda s, t: call(training(s, t)[1], KEYS, fits)[which]
    return [
        Query("m1_model_inputs", inputs, {"entity": "s", "date": "d", "label": "i", "features": "i"},
              "SELECT entity, date, TARGET_RISK_RISING_3M AS label, 42 AS features FROM known", known),
        Query("m2_logistic_l2", logistic("l2"), coef),
        Query("m3_logistic_l1", logistic("l1"), coef),
        Query("m3_logistic_elastic_net", logistic("elasticnet", 0.5), coef),
        Query("m4_nonzero_coefficients", nonzero, {"model": "s", "retained_features": "i"}),
        Query("m5_forest_scores", fitted_scores(models.fit_forest, risk, "probability"), chance),
        Query("m6_boosted_scores", fitted_scores(models.fit_boosted, risk, "probability"), chance),
        Query("m7_majority_class", majority, chance,
              """SELECT *, CASE WHEN 2 * (SELECT sum(TARGET_RISK_RISING_3M) FROM known) >
                 (SELECT count(*) FROM known) THEN 1.0 ELSE 0.0 END AS probability FROM known""", known),
        Query("m8_forest_regression", fitted_scores(models.fit_forest_regressor, fixed.LEVEL_TARGET,
                                                    "prediction"), level),
        Query("m9_linear_regression", fitted_scores(models.fit_linear, fixed.LEVEL_TARGET,
                                                    "prediction"), level),
        Query("t5_feature_importance", importance(models.fit_forest),
              {"feature": "s", "importance": "f4"}),
        Query("m11_m12_benchmark", lambda s, t: validation.benchmark(training(s, t)[1], KEYS)[0],
              {"model": "s", "accuracy": "f4", "precision": "f4", "recall": "f4", "f1": "f4",
               "roc_auc": "f4", "pr_auc": "f4"}),
        Query("m10_m13_regression_benchmark",
              lambda s, t: validation.benchmark_regression(training(s, t)[1], KEYS)[0],
              {"model": "s", "rows": "i", "mae": "f4", "rmse": "f4", "r2": "f4"}),
        Query("m14_walk_forward_folds", wf(validation.walk_forward, validation.CLASSIFIERS, 0), FOLD),
        Query("m14_walk_forward_summary", wf(validation.walk_forward, validation.CLASSIFIERS, 1),
              SUMMARY),
        Query("m15_boosted_comparison",
              wf(partial(validation.walk_forward, threshold=fixed.ALERT_THRESHOLD),
                 validation.BOOSTED, 1), SUMMARY),
        Query("m16_walk_forward_regression",
              lambda s, t: validation.walk_forward_regression(training(s, t)[1], KEYS)[1],
              {"folds": "i", "average_model_rmse": "f4", "average_persistence_rmse": "f4",
               "average_improvement_percent": "f4", "folds_won": "i"}),
        Query("m17_tuned_threshold", lambda s, t: validation.tune_threshold(training(s, t)[1], KEYS)[0],
              {"threshold": "f2", "precision": "f4", "recall": "f4", "f1": "f4",
               "true_positives": "i", "false_positives": "i", "false_negatives": "i",
               "true_negatives": "i"}),
        Query("m18_feature_sets",
              lambda s, t: validation.compare_feature_sets(training(s, t)[1], KEYS)[1], SUMMARY),
        Query("m19_regularisation",
              lambda s, t: validation.compare_regularisation(training(s, t)[1], KEYS)[1],
              {**SUMMARY, "average_retained_features": "f2", "false_alarms_per_year": "f4"}),
        Query("m20_final_metadata", lambda s, t: final(s, t)[2],
              {"model_name": "s", "target": "s", "forecast_horizon_months": "i",
               "warning_threshold": "f2", "training_rows": "i", "positive_training_cases": "i",
               "negative_training_cases": "i", "training_start": "d", "training_end": "d",
               "feature_count": "i"},
              """SELECT 'Logistic Regression' AS model_name, 'TARGET_RISK_RISING_3M' AS target,
                 3 AS forecast_horizon_months, 0.35 AS warning_threshold, count(*) AS training_rows,
                 sum(TARGET_RISK_RISING_3M) AS positive_training_cases,
                 count(*) - sum(TARGET_RISK_RISING_3M) AS negative_training_cases,
                 min(date) AS training_start, max(date) AS training_end, 42 AS feature_count
                 FROM known""", known),
        Query("m21_latest_scores", latest_scores,
              {"entity": "s", "observation_date": "d", "current_stress": "f6",
               "risk_probability": "f4", "warning_active": "b", "warning_level": "s"}),
        Query("s9_saved_model", saved_model,
              {"entity": "s", "observation_date": "d", "risk_probability": "f4",
               "training_rows": "i", "feature_count": "i"}),
        Query("m23_explained_latest", explained,
              {"entity": "s", "date": "d", "feature": "s", "group": "s", "value": "f6",
               "shap_value": "f4"}),
        Query("j9_date_consistency", date_check, {"entity": "s", "reason": "s"},
              """SELECT entity, CASE WHEN entity = 'HOUSEHOLD' THEN 'assessment has no observation date'
                 WHEN entity = 'MACHINERY' THEN 'explanation has no observation date'
                 WHEN entity = 'BUILDING' THEN 'dates do not match: ' || strftime(last, '%Y-%m-%d')
                   || ' versus ' || strftime(last - INTERVAL 1 MONTH, '%Y-%m-%d')
                 ELSE 'accepted' END AS reason
                 FROM (SELECT entity, max(date) AS last FROM monthly GROUP BY entity)""", o.monthly()),
        Query("c10_history_document", flat_history,
              {"entity": "s", "status": "s", "start_date": "s", "end_date": "s",
               "observation_count": "i", "latest_stress": "f6", "average_stress": "f6",
               "minimum_stress": "f6", "maximum_stress": "f6", "peak_stress_date": "s",
               "periods": "i", "points": "i", "notes": "i", "first_point": "s", "last_point": "f6"},
              """SELECT r.entity, 'success' AS status, strftime(min(date), '%Y-%m-%d') AS start_date,
                 strftime(max(date), '%Y-%m-%d') AS end_date, count(*) AS observation_count,
                 arg_max(ECON_STRESS, date) AS latest_stress, avg(ECON_STRESS) AS average_stress,
                 min(ECON_STRESS) AS minimum_stress, max(ECON_STRESS) AS maximum_stress,
                 strftime(arg_max(date, ECON_STRESS), '%Y-%m-%d') AS peak_stress_date,
                 coalesce(any_value(i.periods), 0) AS periods, count(*) AS points, 3 AS notes,
                 strftime(min(date), '%Y-%m-%d') AS first_point,
                 arg_max(ECON_STRESS, date) AS last_point FROM retained r
                 LEFT JOIN (SELECT entity, count(*) AS periods FROM islands GROUP BY entity) i
                   ON r.entity = i.entity GROUP BY r.entity""", o.islands()),
        Query("s7_s8_document_round_trip", landed_history,
              {"entity": "s", "date": "s", "economic_stress": "f6", "stress_change_3m": "f6",
               "vix": "f6", "crisis": "b", "crisis_name": "s"},
              """SELECT entity, strftime(date, '%Y-%m-%d') AS date, ECON_STRESS AS economic_stress,
                 STRESS_CHANGE_3M AS stress_change_3m, VIX AS vix, CRISIS = 1 AS crisis,
                 CRISIS_NAME AS crisis_name FROM retained""", o.islands()),
        Query("c12_stress_history_view", history_view,
              {"entity": "s", "status": "s", "date": "s", "economic_stress": "f6", "crisis_name": "s"},
              """SELECT entity, 'success' AS status, strftime(date, '%Y-%m-%d') AS date,
                 ECON_STRESS AS economic_stress, CRISIS_NAME AS crisis_name FROM retained""", o.islands()),
        Query("c12_crisis_view", crisis_view,
              {"entity": "s", "name": "s", "start_date": "s", "end_date": "s", "note": "s"},
              f"""SELECT entity, name, strftime(start_date, '%Y-%m-%d') AS start_date,
                 strftime(end_date, '%Y-%m-%d') AS end_date, '{fixed.CRISES_NOTE}' AS note
                 FROM islands""", o.islands()),
        Query("c11_risk_document", flat_risk,
              {"entity": "s", "status": "s", "observation_date": "s", "risk_probability": "f4",
               "risk_probability_percent": "f1", "warning_level": "s", "down": "i",
               "categories_up": "i", "average_recall": "f4", "message": "s"}),
        Query("c12_risk_views", risk_views,
              {"entity": "s", "warning_level": "s", "observation_date": "s", "summary": "s",
               "first_driver": "s"}),
    ]
