"""Queries over scored rows, positions, folds, attribution and presentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import (as_percent, bar_width, format_number, format_percent, interpretation,
                         warning_active, warning_level, warning_message, warning_tone)
from ..operators import evaluate, explain, folds, index, ranking
from ..operators.profile import pearson
from ..operators.timeseries import persistence_forecast
from ..sources import scored_documents, scored_lines
from ..storage import materialise
from . import chain, oracle
from .chain import KEYS
from .spec import Query

COUNTS = dict.fromkeys(evaluate.COUNTS, "i")
RATES = {"accuracy": "f6", "precision": "f6", "recall": "f6", "f1": "f6"}
CURATED = list(fixed.CURATED_FEATURES)


def summary(spark, t):
    """Folds by document number, one model per language."""
    rows = scored_documents(t).withColumn("fold", F.col("id") % 5)
    return evaluate.summarise_folds(
        evaluate.classification_metrics(rows, ["grp", "fold"]), ["grp"])


def alarms(spark, t):
    """False alarms a year by entity of a rule: warn when the index is above 50."""
    rows = index.training_set(chain.targets(spark, t)).select(
        "entity", "date", F.col(fixed.TARGET).alias("actual"),
        (F.col("ECON_STRESS") / 100).alias("probability"))
    counts = rows.groupBy("entity").agg(
        F.min("date").alias("_start"), F.max("date").alias("_end"),
        F.count_if((F.col("actual") == 0) & (F.col("probability") >= 0.5))
        .alias("total_false_positives"))
    return evaluate.false_alarms_per_year(counts, F.col("_start"), F.col("_end"))


def placed_rows(spark, t):
    return folds.ordinal(index.training_set(chain.targets(spark, t)), "date", KEYS, "row")


def customer_positions(spark, t):
    """Every order numbered by date: dates hold many rows each."""
    orders = t["orders"].select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return folds.ordinal(orders, "date", ["o_orderkey"], "row")


def split(spark, t):
    orders = t["orders"].select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))
    return folds.chronological_split(orders, "date", 0.8, "row", ["o_orderkey"]).groupBy(
        "is_train").agg(F.count("*").alias("rows"), F.min("date").alias("first"),
                        F.max("date").alias("last"), F.avg("o_totalprice").alias("mean_price"))


def fold_table(unit):
    def build(spark, t):
        rows = materialise(index.training_set(chain.targets(spark, t)).select(
            "entity", "date", fixed.TARGET), "training")
        placed, bounds = folds.walk_forward_folds(rows, "date", 5, unit, KEYS)
        return folds.fold_summary(placed, bounds, "date", fixed.TARGET)
    return build


def fold_rows(spark, t):
    rows = materialise(index.training_set(chain.targets(spark, t)).select(
        "entity", "date", fixed.TARGET), "training")
    placed, bounds = folds.walk_forward_folds(rows, "date", 5, "row", KEYS, gap=3)
    return folds.assign_test_folds(placed, bounds)


def scorecard(rows):
    """Coefficients taken from the data itself: the correlation of a feature with the target."""
    medians = ranking.exact_medians(rows, CURATED)
    stats = rows.agg(*[F.struct(
        F.lit(medians[c]).alias("median"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("scale"),
        pearson(F.col(c), F.col(fixed.TARGET)).alias("beta")).alias(c)
        for c in CURATED])
    return stats.unpivot([], CURATED, "feature", "s").select("feature", "s.*")


def attributed(spark, t, last=200):
    rows = materialise(chain.targets(spark, t), "features")
    labelled = rows.where(F.col(fixed.TARGET).isNotNull())
    attr = explain.attribution(rows, scorecard(labelled), CURATED, KEYS, n=last)
    return explain.with_groups(attr, explain.groups_table(spark))


def drivers(name, top=5):
    def build(spark, t):
        return explain.driver_tables(attributed(spark, t), KEYS, top)[name]
    return build


def nested_drivers(spark, t):
    """The nested lists, flattened again: the same rows as the flat tables."""
    docs = explain.explanation_arrays(attributed(spark, t), KEYS, 5)
    return docs.select("entity", F.posexplode("reducing_risk").alias("pos", "r")).select(
        "entity", (F.col("pos") + 1).alias("rank"), "r.feature", "r.group", "r.shap_value")


LISTS = ("top_contributions", "increasing_risk", "reducing_risk")
GROUP_LISTS = ("grouped_contributions", "grouped_increasing_risk", "grouped_reducing_risk")


def listed_driver(name):
    """A function of one element; a second parameter would receive its position."""
    label = "group" if name in GROUP_LISTS else "feature"
    return lambda r: F.struct(F.lit(name).alias("list"), r[label].alias("name"), r["shap_value"].alias("shap_value"))


def all_nested_drivers(spark, t):
    """All six nested lists, flattened again."""
    docs = explain.explanation_arrays(attributed(spark, t), KEYS, 5)
    same = [F.transform(name, listed_driver(name)) for name in (*LISTS, *GROUP_LISTS)]
    numbered = [F.transform(a, lambda r, i: F.struct((i + 1).alias("rank"), r.alias("r"))) for a in same]
    return docs.select("entity", F.inline(F.concat(*numbered))).select("entity", "rank", "r.*")


def event_groups(spark, t):
    """Every event looked up by type, most types unknown to the groups."""
    events = t["events"].select("event_id", F.when(F.col("event_id") % 7 == 0, "VIX")
                                .when(F.col("event_id") % 7 == 1, "GDP_GROWTH")
                                .otherwise(F.col("event_type")).alias("feature"))
    return explain.with_groups(events, explain.groups_table(spark))


def presented(spark, t):
    rows = scored_documents(t)
    p = F.col("probability")
    level = warning_level(p, 0.35)
    return rows.select(
        "id", level.alias("level"), warning_level(p, 0.1).alias("low_threshold_level"),
        warning_active(p, 0.35).alias("active"), warning_tone(level).alias("tone"),
        as_percent(p).alias("percent"), warning_message(p, 0.35).alias("message"),
        interpretation(p).alias("sentence"), format_percent(p).alias("percent_text"),
        format_number(F.when(p > 0.3, p * 10), 2).alias("number_text"))


def bars(spark, t):
    attr = attributed(spark, t)
    return attr.select("entity", "feature", bar_width(
        F.col("shap_value"), Window.partitionBy("entity")).alias("width"))


def queries() -> list[Query]:
    o = oracle
    docs, lines = o.SCORED_DOCUMENTS, o.SCORED_LINES
    known = o.targets() + ",\nknown AS (SELECT * FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL)"
    placed = known + ",\nplaced AS (SELECT *, row_number() OVER (ORDER BY date, " \
        "md5(entity), entity) AS pos, count(*) OVER () AS n FROM known)"
    placed_dates = known + ",\nplaced AS (SELECT *, dense_rank() OVER (ORDER BY date) AS pos, " \
        "(SELECT count(DISTINCT date) FROM known) AS n FROM known)"
    fold_sql = """SELECT fold, count(*) FILTER (pos < n - (6 - fold) * (n // 6) + 1) AS train_rows,
        count(*) FILTER (hit) AS test_rows, min(CASE WHEN hit THEN date END) AS test_start,
        max(CASE WHEN hit THEN date END) AS test_end,
        count(*) FILTER (hit AND TARGET_RISK_RISING_3M = 1) AS positive_cases
        FROM (SELECT *, pos BETWEEN n - (6 - fold) * (n // 6) + 1 AND n - (5 - fold) * (n // 6) AS hit
              FROM placed, (SELECT unnest(generate_series(1, 5)) AS fold)) GROUP BY fold"""
    fold_out = {"fold": "i", "train_rows": "i", "test_rows": "i", "test_start": "d",
                "test_end": "d", "positive_cases": "i"}
    ranking_out = {"positives": "i", "negatives": "i", "roc_auc": "f6", "pr_auc": "f6"}

    def ranking_sql(by=""):
        if by:
            return f"SELECT * FROM auc JOIN ap USING ({by})"
        return "SELECT * FROM auc, ap"
    sweep_sql = " UNION ALL ".join(
        f"SELECT {x} AS threshold, * FROM (WITH {o.confusion(threshold=str(x))} SELECT * FROM rates)"
        for x in fixed.THRESHOLDS)
    coef = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, median({c}) AS median, avg({c}) AS mean, stddev_pop({c}) AS scale, "
        f"corr({c}, TARGET_RISK_RISING_3M) AS beta FROM known" for c in CURATED)
    latest = " UNION ALL ".join(
        f"SELECT entity, date, '{c}' AS feature, {c} AS value FROM backed WHERE back = 1"
        for c in CURATED)
    past = " UNION ALL ".join(
        f"SELECT entity, '{c}' AS feature, avg(coalesce({c}, (SELECT median FROM coef "
        f"WHERE feature = '{c}'))) AS past FROM backed WHERE back BETWEEN 2 AND 201 GROUP BY entity"
        for c in CURATED)
    groups = ", ".join(f"('{f}', '{g}')" for g, fs in fixed.FEATURE_GROUPS.items() for f in fs)
    attr = f"""{o.targets().replace("targets AS (", "targets AS MATERIALIZED (")},
known AS (SELECT * FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL),
coef AS MATERIALIZED ({coef}),
backed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back
                        FROM targets),
latest AS ({latest}),
past AS ({past}),
groups(feature, "group") AS (VALUES {groups}),
attributed AS (
  SELECT entity, date, feature, value, beta * (coalesce(value, median) - past) / scale AS shap_value,
         coalesce("group", 'Other Indicators') AS "group"
  FROM latest JOIN past USING (entity, feature) JOIN coef USING (feature)
  LEFT JOIN groups USING (feature)),
totals AS (SELECT entity, "group", sum(shap_value) AS shap_value, sum(abs(shap_value)) AS absolute_shap,
                  count(*) AS feature_count FROM attributed GROUP BY entity, "group")"""
    top = 'SELECT * FROM (SELECT *, abs(shap_value) AS absolute_shap, row_number() OVER ' \
          '(PARTITION BY entity ORDER BY {0}, feature) AS rank FROM attributed WHERE {1}) WHERE rank <= 5'
    item = {"entity": "s", "rank": "i", "feature": "s", "group": "s", "value": "f6",
            "shap_value": "f6", "absolute_shap": "f6"}
    group = {"entity": "s", "rank": "i", "group": "s", "shap_value": "f6", "absolute_shap": "f6",
             "feature_count": "i"}
    level = """CASE WHEN probability < 0.2 THEN 'Low' WHEN probability < {0} THEN 'Guarded'
               WHEN probability < 0.6 THEN 'Elevated' WHEN probability < 0.8 THEN 'High'
               ELSE 'Critical' END"""
    sentence = "'The model estimates a ' || printf('%.1f', probability * 100) || '% probability " \
               "that economic stress will rise by at least five points within the next three months.'"
    return [
        Query("a14_confusion", lambda s, t: evaluate.confusion(scored_lines(t), ["grp"], 0.5),
              {"grp": "s", **COUNTS}, "SELECT * FROM counts",
              f"{lines},\n{o.confusion('grp', '0.5')}"),
        Query("a15_rates", lambda s, t: evaluate.with_rates(
            evaluate.confusion(scored_documents(t), ["grp"])),
              {"grp": "s", **COUNTS, **RATES}, "SELECT * FROM rates", f"{docs},\n{o.confusion('grp')}"),
        Query("a15_rates_without_warnings", lambda s, t: evaluate.with_rates(
            evaluate.confusion(scored_lines(t), [], 2.0)), {**COUNTS, **RATES},
              "SELECT * FROM rates", f"{lines},\n{o.confusion(threshold='2.0')}"),
        Query("a16_roc_auc", lambda s, t: ranking.roc_auc(scored_lines(t)), {"roc_auc": "f9"},
              "SELECT * FROM auc", f"{lines},\n{o.ranking()}"),
        Query("a17_average_precision", lambda s, t: ranking.average_precision(scored_lines(t)),
              {"pr_auc": "f9"}, "SELECT * FROM ap", f"{lines},\n{o.ranking()}"),
        Query("a16_a17_by_group", lambda s, t: ranking.ranking_metrics(scored_documents(t), ["grp"]),
              {"grp": "s", **ranking_out}, ranking_sql("grp"), f"{docs},\n{o.ranking('grp')}"),
        Query("a16_one_class", lambda s, t: ranking.ranking_metrics(
            scored_lines(t).where("actual = 0"), ["grp"]), {"grp": "s", **ranking_out},
              ranking_sql("grp"), f"{lines},\none_class AS (SELECT * FROM scored WHERE actual = 0),\n"
                                  f"{o.ranking('grp', 'one_class')}"),
        Query("x1_prefix_sum_in_ranges", lambda s, t: ranking.ranking_metrics(
            scored_lines(t), ["grp"], bounds=ranking.score_bounds(
                scored_lines(t), "probability", rows_per_bucket=500)),
              {"grp": "s", **ranking_out}, ranking_sql("grp"), f"{lines},\n{o.ranking('grp')}"),
        Query("x1_running_totals", lambda s, t: ranking.prefix_sum(
            t["lineitem"].select("l_returnflag", "l_extendedprice", F.lit(1).alias("rows")),
            ["l_returnflag"], "l_extendedprice", ["rows"], descending=False,
            bounds=[20_000.0, 40_000.0, 40_001.0, 60_000.0, 80_000.0]),
              {"l_returnflag": "s", "l_extendedprice": "f2", "rows": "i", "cum_rows": "i"},
              """SELECT l_returnflag, l_extendedprice, count(*) AS rows,
                 sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS cum_rows
                 FROM lineitem GROUP BY 1, 2"""),
        Query("a18_regression_metrics", lambda s, t: evaluate.regression_metrics(
            persistence_forecast(index.training_set(chain.targets(s, t))), KEYS,
            fixed.LEVEL_TARGET), {"entity": "s", "rows": "i", "mae": "f6", "rmse": "f6", "r2": "f6"},
              """SELECT entity, count(*) AS rows, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
                 1 - sum(e * e) / (var_pop(TARGET_STRESS_3M) * count(*)) AS r2
                 FROM (SELECT *, TARGET_STRESS_3M - ECON_STRESS AS e FROM known) GROUP BY entity""",
              known),
        Query("a13_class_counts", lambda s, t: evaluate.class_counts(
            index.training_set(chain.targets(s, t)), KEYS, fixed.TARGET),
              {"entity": "s", "rows": "i", "positives": "i", "negatives": "i"},
              """SELECT entity, count(*) AS rows, sum(TARGET_RISK_RISING_3M) AS positives,
                 count(*) - sum(TARGET_RISK_RISING_3M) AS negatives FROM known GROUP BY entity""",
              known),
        Query("a10_fold_summary", summary,
              {"grp": "s", "folds": "i", "average_precision": "f6", "average_recall": "f6",
               "average_f1": "f6", "average_pr_auc": "f6", "average_roc_auc": "f6",
               "total_true_positives": "i", "total_false_positives": "i",
               "total_false_negatives": "i"},
              """SELECT grp, count(*) AS folds, avg(precision) AS average_precision,
                 avg(recall) AS average_recall, avg(f1) AS average_f1, avg(pr_auc) AS average_pr_auc,
                 avg(roc_auc) AS average_roc_auc, sum(true_positives) AS total_true_positives,
                 sum(false_positives) AS total_false_positives,
                 sum(false_negatives) AS total_false_negatives
                 FROM rates JOIN auc USING (grp, fold) JOIN ap USING (grp, fold) GROUP BY grp""",
              f"{docs},\nfolded AS (SELECT *, id % 5 AS fold FROM scored),\n"
              f"{o.confusion('grp, fold', source='folded')},\n{o.ranking('grp, fold', 'folded')}"),
        Query("a22_false_alarms_per_year", alarms,
              {"entity": "s", "total_false_positives": "i", "false_alarms_per_year": "f6"},
              """SELECT entity, fp AS total_false_positives, fp / (date_diff('day', lo, hi) / 365.25)
                 AS false_alarms_per_year FROM (SELECT entity, min(date) AS lo, max(date) AS hi,
                 count(*) FILTER (TARGET_RISK_RISING_3M = 0 AND ECON_STRESS / 100 >= 0.5) AS fp
                 FROM known GROUP BY entity)""", known),
        Query("m17_threshold_sweep", lambda s, t: evaluate.threshold_sweep(scored_lines(t)),
              {"threshold": "f2", **COUNTS, **RATES}, sweep_sql, lines),
        Query("m17_t4_best_threshold", lambda s, t: evaluate.best_threshold(
            evaluate.threshold_sweep(scored_documents(t))), {"threshold": "f2", **COUNTS, **RATES},
              f"SELECT * FROM ({sweep_sql}) ORDER BY f1 DESC, threshold LIMIT 1", docs),
        Query("t2_sorted_sweep", lambda s, t: evaluate.threshold_sweep(
            scored_documents(t), (0.3, 0.5), ["grp"]).orderBy(F.desc("f1"), "threshold", "grp"),
              {"grp": "s", "threshold": "f2", **COUNTS, **RATES},
              " UNION ALL ".join(
                  f"SELECT {x} AS threshold, * FROM (WITH {o.confusion('grp', str(x))} "
                  f"SELECT * FROM rates)" for x in (0.3, 0.5)), docs),

        Query("x2_row_ordinal", placed_rows, {"entity": "s", "date": "d", "pos": "i"},
              "SELECT * FROM placed", placed),
        Query("x2_order_positions", customer_positions, {"o_orderkey": "i", "date": "d", "pos": "i"},
              """SELECT o_orderkey, date, row_number() OVER (ORDER BY date,
                 md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS pos
                 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)"""),
        Query("w14_chronological_split", split,
              {"is_train": "b", "rows": "i", "first": "d", "last": "d", "mean_price": "f4"},
              """SELECT pos <= floor(n * 0.8) AS is_train, count(*) AS rows, min(date) AS first,
                 max(date) AS last, avg(o_totalprice) AS mean_price
                 FROM (SELECT *, row_number() OVER (ORDER BY date, md5(CAST(o_orderkey AS VARCHAR)),
                   o_orderkey) AS pos, count(*) OVER () AS n
                   FROM (SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders)) GROUP BY 1"""),
        Query("w15_walk_forward_rows", fold_table("row"), fold_out, fold_sql, placed),
        Query("w15_walk_forward_dates", fold_table("date"), fold_out, fold_sql, placed_dates),
        Query("j10_fold_alignment", fold_rows,
              {"entity": "s", "date": "d", "fold": "i", "TARGET_RISK_RISING_3M": "i"},
              """SELECT *, 5 - (n - pos) // (n // 6) AS fold FROM placed
                 WHERE pos > n - 5 * (n // 6)""", placed),

        Query("m22_attribution", attributed,
              {"entity": "s", "date": "d", "feature": "s", "group": "s", "value": "f6",
               "shap_value": "f6"}, "SELECT * FROM attributed", attr),
        Query("t3_top_contributions", drivers("top_contributions"), item,
              top.format("abs(shap_value) DESC", "true"), attr),
        Query("t3_p12_increasing_risk", drivers("increasing_risk"), item,
              top.format("shap_value DESC", "shap_value > 0"), attr),
        Query("t3_p12_reducing_risk", drivers("reducing_risk"), item,
              top.format("shap_value", "shap_value < 0"), attr),
        Query("a11_grouped_contributions", drivers("grouped_contributions"), group,
              """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY absolute_shap DESC, "group")
                 AS rank FROM totals""", attr),
        Query("m23_grouped_increasing_risk", drivers("grouped_increasing_risk"), group,
              """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY shap_value DESC, "group")
                 AS rank FROM totals WHERE shap_value > 0""", attr),
        Query("m23_grouped_reducing_risk", drivers("grouped_reducing_risk"), group,
              """SELECT *, row_number() OVER (PARTITION BY entity ORDER BY shap_value, "group")
                 AS rank FROM totals WHERE shap_value < 0""", attr),
        Query("a21_nested_drivers", nested_drivers,
              {"entity": "s", "rank": "i", "feature": "s", "group": "s", "shap_value": "f6"},
              top.format("shap_value", "shap_value < 0"), attr),
        Query("a21_all_nested_drivers", all_nested_drivers,
              {"entity": "s", "list": "s", "rank": "i", "name": "s", "shap_value": "f6"},
              " UNION ALL ".join(
                  f"""SELECT entity, '{name}' AS list, rank, "{col}" AS name, shap_value FROM (
                      SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {best}, "{col}") AS rank
                      FROM {source} WHERE {which}) WHERE rank <= {most}"""
                  for names, source, col, size, most in (
                      (LISTS, "attributed", "feature", "abs(shap_value)", 5),
                      (GROUP_LISTS, "totals", "group", "absolute_shap", 1000))
                  for name, best, which in zip(
                      names, (f"{size} DESC", "shap_value DESC", "shap_value"),
                      ("true", "shap_value > 0", "shap_value < 0"))), attr),
        Query("j8_group_lookup", event_groups, {"event_id": "i", "feature": "s", "group": "s"},
              """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'VIX' WHEN 1 THEN 'GDP_GROWTH'
                 ELSE event_type END AS feature, CASE event_id % 7 WHEN 0 THEN 'Market Volatility'
                 WHEN 1 THEN 'Economic Growth' ELSE 'Other Indicators' END AS "group" FROM events"""),
        Query("f1_f6_presentation", presented,
              {"id": "i", "level": "s", "low_threshold_level": "s", "active": "b", "tone": "s",
               "percent": "f1", "message": "s", "sentence": "s", "percent_text": "s",
               "number_text": "s"},
              f"""SELECT id, {level.format(0.35)} AS level, {level.format(0.1)} AS low_threshold_level,
                 probability >= 0.35 AS active, CASE WHEN probability >= 0.6 THEN 'danger'
                 WHEN probability >= 0.2 THEN 'warning' ELSE 'safe' END AS tone,
                 probability * 100 AS percent, CASE WHEN probability >= 0.35
                 THEN '{fixed.REACHED_TEXT}' ELSE '{fixed.NOT_REACHED_TEXT}' END AS message,
                 {sentence} AS sentence, printf('%.1f', probability * 100) || '%' AS percent_text,
                 CASE WHEN probability > 0.3 THEN printf('%.2f', probability * 10) ELSE '—' END
                 AS number_text FROM scored""", docs),
        Query("f4_bar_width", bars, {"entity": "s", "feature": "s", "width": "f6"},
              """SELECT entity, feature, greatest(8, abs(shap_value) / greatest(max(abs(shap_value))
                 OVER (PARTITION BY entity), 0.001) * 100) AS width FROM attributed""", attr),
    ]
