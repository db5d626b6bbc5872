"""Whole runs on landed files, with the scorecard fit, and what is served from their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed, jobs
from ..operators import documents, evaluate, models, validation
from ..sources import macro_obs, read_documents, write_table
from ..storage import scratch_path
from . import chain, oracle
from .chain import KEYS
from .scorecards import _ALL, _BY_ROW, FITS, FULL, NAME, fold_sql, scored_sql, training
from .spec import Query


def features(spark, t):
    """Land a file for each entity and series, and run the feature job on them."""
    series = write_table(macro_obs(t), scratch_path(spark, "series"), ["entity", "series"], "csv")
    return jobs.build_features(spark, series, scratch_path(spark, "features"), KEYS)


def risk(spark, t):
    """The risk documents, read back from where the jobs have written them."""
    table = features(spark, t)
    model = jobs.train(spark, table, scratch_path(spark, "model"), KEYS, name=NAME, fit=models.fit_scorecard)
    path = scratch_path(spark, "risk")
    docs = jobs.publish_risk(spark, table, model, path, KEYS)
    return read_documents(spark, path, docs.schema)


def flat_risk(spark, t):
    d = risk(spark, t)
    return d.select(
        "entity", "status", "assessment.observation_date", "assessment.current_stress", "assessment.risk_probability",
        "assessment.warning_level", F.col("interpretation.warning_message").alias("message"),
        *[F.size(f"drivers.{c}").alias(c) for c in ("categories_increasing_risk", "categories_reducing_risk",
                                                    "features_increasing_risk", "features_reducing_risk")],
        F.get("drivers.features_increasing_risk", F.lit(0))["feature"].alias("first_feature"),
        F.get("drivers.categories_increasing_risk", F.lit(0))["category"].alias("first_category"),
        F.col("model.name").alias("model"), F.col("model.feature_count").alias("feature_count"),
        F.col("model.target").alias("target"), F.col("model.decision_threshold").alias("threshold"),
        F.col("model.validation.method").alias("method"),
        F.col("model.validation.average_recall").alias("average_recall"),
        F.col("model.validation.average_roc_auc").alias("average_roc_auc"), F.size("limitations").alias("limitations"))


def views(spark, t):
    """What each view says of an entity, one row each."""
    v = documents.result_views(KEYS, risk=risk(spark, t))
    detail = {
        "latest_risk": F.concat_ws("|", "assessment.warning_level", "model.name"),
        "assessment": F.concat_ws("|", "assessment.observation_date", "interpretation.warning_message"),
        "explanation": F.concat_ws("|", "observation_date", F.get("drivers.features_increasing_risk", F.lit(0))["feature"],
                                   "explanation_note"),
        "model": F.concat_ws("|", "model.name", "model.feature_count", F.size("limitations")),
        "health": F.concat_ws("|", "observation_date", F.col("snapshot_available").cast("string"))}
    rows = [v[name].select(F.lit(name).alias("view"), "entity", "status", d.alias("detail")) for name, d in detail.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def landed_history(spark, t):
    """The series of the history documents that the job has written."""
    path = scratch_path(spark, "history")
    docs = jobs.publish_history(spark, features(spark, t), path, KEYS)
    return read_documents(spark, path, docs.schema).select("entity", F.explode("series").alias("p")).select("entity", "p.*")


def audit(spark, t):
    """The three tables of the audit, read back and stacked."""
    paths = jobs.audit_features(spark, features(spark, t), scratch_path(spark, "audit"))
    summary, pairs, constant = (spark.read.parquet(paths[name]) for name in jobs.AUDIT_TABLES)
    none = F.lit(None)
    return (summary.select(F.lit("summary").alias("part"), "feature", none.cast("string").alias("other"),
                           "missing_percentage", "mean", none.cast("double").alias("correlation"))
            .unionByName(pairs.select(F.lit("pair").alias("part"), F.col("feature_1").alias("feature"),
                                      F.col("feature_2").alias("other"), "correlation"), True)
            .unionByName(constant.select(F.lit("constant").alias("part"), "feature"), True))


def alarm_years(spark, t):
    """False alarms a year over the rows from position n // 6 on, counted from 0."""
    data = validation.prepare_folds(training(spark, t)[1], KEYS, unit="row")
    scored, _ = validation.out_of_fold(data, FITS)
    summary = evaluate.summarise_folds(validation.fold_metrics(scored, data, fixed.ALERT_THRESHOLD), ["model"])
    return evaluate.false_alarms_per_year(summary, *[F.lit(d) for d in validation.fold_period(data, 5)])


def queries() -> list[Query]:
    alert = fixed.ALERT_THRESHOLD
    groups = ", ".join(f"('{f}', '{g}')" for g, fs in fixed.FEATURE_GROUPS.items() for f in fs)
    now = scored_sql({NAME: FULL}, _ALL, "actual IS NOT NULL", "back = 1", 1) + f""",
past AS (SELECT entity, feature, avg(coalesce(value, median)) AS past FROM long JOIN coef USING (feature)
         WHERE back BETWEEN 2 AND 201 GROUP BY entity, feature),
groups(feature, "group") AS (VALUES {groups}),
attributed AS MATERIALIZED (
  SELECT entity, feature, coalesce("group", 'Other Indicators') AS "group",
         coalesce(beta, 0) * (coalesce(value, median) - past) AS shap
  FROM long JOIN coef USING (feature) JOIN past USING (entity, feature) LEFT JOIN groups USING (feature)
  WHERE back = 1),
totals AS (SELECT entity, "group", sum(shap) AS shap FROM attributed GROUP BY entity, "group"),
by_feature AS (SELECT entity, least(5, count(*) FILTER (shap > 0)) AS features_increasing_risk,
  least(5, count(*) FILTER (shap < 0)) AS features_reducing_risk,
  arg_max(feature, shap) FILTER (shap > 0) AS first_feature FROM attributed GROUP BY entity),
by_group AS (SELECT entity, least(4, count(*) FILTER (shap > 0)) AS categories_increasing_risk,
  least(4, count(*) FILTER (shap < 0)) AS categories_reducing_risk,
  arg_max("group", shap) FILTER (shap > 0) AS first_category FROM totals GROUP BY entity),
validated AS (SELECT * FROM (WITH {fold_sql({NAME: FULL}, alert)}
  SELECT avg(recall) AS average_recall, avg(roc_auc) AS average_roc_auc FROM folded)),
document AS (
  SELECT entity, 'success' AS status, date AS observation_date, ECON_STRESS AS current_stress,
    probability AS risk_probability, CASE WHEN probability < 0.2 THEN 'Low' WHEN probability < {alert} THEN 'Guarded'
      WHEN probability < 0.6 THEN 'Elevated' WHEN probability < 0.8 THEN 'High' ELSE 'Critical' END AS warning_level,
    CASE WHEN probability >= {alert} THEN '{fixed.REACHED_TEXT}' ELSE '{fixed.NOT_REACHED_TEXT}' END AS message,
    by_feature.* EXCLUDE (entity), by_group.* EXCLUDE (entity), '{NAME}' AS model,
    (SELECT count(*) FROM coef) AS feature_count, '{fixed.TARGET_TEXT}' AS target, {alert} AS threshold,
    '{fixed.VALIDATION_METHOD}' AS method, validated.*, {len(fixed.LIMITATIONS)} AS limitations
  FROM scored JOIN (SELECT entity, date, ECON_STRESS FROM targets) USING (entity, date)
  JOIN by_feature USING (entity) JOIN by_group USING (entity), validated)"""
    day = "strftime(observation_date, '%Y-%m-%d')"
    said = {"latest_risk": "warning_level, model", "assessment": f"{day}, message",
            "explanation": f"{day}, first_feature, '{fixed.EXPLANATION_NOTE}'",
            "model": "model, feature_count, limitations", "health": f"{day}, 'true'"}
    view_sql = " UNION ALL ".join(
        f"SELECT '{name}' AS view, entity, '{'healthy' if name == 'health' else 'success'}' AS status, "
        f"concat_ws('|', {what}) AS detail FROM document" for name, what in said.items())
    known = oracle.targets().replace("targets AS (", "targets AS MATERIALIZED (") + \
        ",\nknown AS MATERIALIZED (SELECT * FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL)"
    summary_sql = " UNION ALL ".join(
        f"SELECT 'summary' AS part, '{c}' AS feature, NULL AS other, 100.0 * (count(*) - count({c})) / count(*) "
        f"AS missing_percentage, avg({c}) AS mean, NULL AS correlation FROM known" for c in FULL)
    pair_sql = " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, corr({a}, {b}) AS r FROM known"
                                  for i, a in enumerate(FULL) for b in FULL[i + 1:])
    constant_sql = " UNION ALL ".join(f"SELECT 'constant', '{c}', NULL, NULL, NULL, NULL FROM known "
                                      f"HAVING min({c}) IS NOT DISTINCT FROM max({c})" for c in FULL)
    numbers = ("categories_increasing_risk", "categories_reducing_risk", "features_increasing_risk",
               "features_reducing_risk", "feature_count", "limitations")
    return [
        Query("c11_landed_risk_document", flat_risk,
              {"entity": "s", "status": "s", "observation_date": "s", "current_stress": "f6", "risk_probability": "f4",
               "warning_level": "s", "message": "s", "first_feature": "s", "first_category": "s", "model": "s", "target": "s",
               "threshold": "f2", "method": "s", "average_recall": "f4", "average_roc_auc": "f4", **dict.fromkeys(numbers, "i")},
              f"SELECT * REPLACE ({day} AS observation_date) FROM document", now),
        Query("c12_served_views", views, {"view": "s", "entity": "s", "status": "s", "detail": "s"}, view_sql, now),
        Query("c10_landed_history", landed_history,
              {"entity": "s", "date": "s", "economic_stress": "f6", "crisis_name": "s"},
              """SELECT entity, strftime(date, '%Y-%m-%d') AS date, ECON_STRESS AS economic_stress,
                 CRISIS_NAME AS crisis_name FROM targets WHERE ECON_STRESS IS NOT NULL""", oracle.targets()),
        Query("c7_landed_audit", audit,
              {"part": "s", "feature": "s", "other": "s", "missing_percentage": "f4", "mean": "f4", "correlation": "f6"},
              f"""{summary_sql} UNION ALL SELECT 'pair', feature, other, NULL, NULL, r FROM ({pair_sql})
                  WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= {fixed.CORRELATION_THRESHOLD}
                  UNION ALL {constant_sql}""", known),
        Query("a22_alarm_years_by_row", alarm_years,
              {"model": "s", "total_false_positives": "i", "false_alarms_per_year": "f6"},
              """SELECT model, sum(false_positives) AS total_false_positives, sum(false_positives) / (date_diff('day',
                 (SELECT min(date) FROM placed WHERE pos = n // 6 + 1), (SELECT max(date) FROM placed)) / 365.25)
                 AS false_alarms_per_year FROM folded GROUP BY model""",
              fold_sql({NAME: FULL}, alert, placed=_BY_ROW)),
    ]
