"""Queries over the monthly pipeline: sources, alignment, features, index, labels, periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import (clean_text, clean_values, conform, day_label, gauge_percent,
                         lenient_double, month_label, numeric_columns, to_flag, year_label)
from ..operators import index, intervals, reshape, timeseries
from ..operators.documents import history_records, history_summary
from ..sources import (macro_obs, read_observation_json, read_series, read_wide, write_documents,
                       write_table)
from ..storage import scratch_path
from . import chain, oracle
from .chain import KEYS, FEATURES, INDEX, TRENDS
from .spec import Query

OBS = {"entity": "s", "series": "s", "date": "d", "value": "f4"}
ROW = {"entity": "s", "date": "d"}
SERIES6 = dict.fromkeys(fixed.SERIES, "f6")


def f6(*names):
    return dict.fromkeys(names, "f6")


def _w():
    return timeseries.by_time(KEYS)


def s1_series_csv(spark, t):
    path = write_table(macro_obs(t), scratch_path(spark, "series"), ["entity", "series"], "csv")
    return read_series(spark, path, KEYS)


def s2_wide_csv(spark, t):
    path = write_table(chain.wide(t).select("entity", "date", *fixed.SERIES),
                       scratch_path(spark, "wide"), fmt="csv")
    return read_wide(spark, path, KEYS)


def s3_observation_json(spark, t):
    """Land one document per entity and series, with "." for dates it has no value on."""
    cells = chain.wide(t).unpivot(["entity", "date"], list(fixed.SERIES), "series", "value")
    item = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"),
                    F.coalesce(F.col("value").cast("string"), F.lit(".")).alias("value"))
    docs = cells.groupBy("entity", "series").agg(F.collect_list(item).alias("observations"))
    path = write_documents(docs, scratch_path(spark, "observations"))
    return read_observation_json(spark, path, ["entity", "series"])


def full_outer(spark, t):
    obs = macro_obs(t)
    frames = [obs.where(F.col("series") == s).select("entity", "date", F.col("value").alias(s))
              for s in fixed.SERIES]
    return reshape.outer_merge(frames, ["entity", "date"])


def lenient(spark, t):
    e = t["events"]
    return e.select("event_id", lenient_double(F.get_json_object("props", "$.k")).alias("k"),
                    lenient_double(F.col("event_type")).alias("type_number"),
                    lenient_double(F.col("value")).alias("value"))


def dirty_values(e):
    who = F.col("user_id") % 10
    return (F.when(who == 0, F.lit(float("nan"))).when(who == 1, F.lit(float("inf")))
            .when(who == 2, F.lit(float("-inf"))).otherwise(F.col("value")))


def cleaned(spark, t):
    e = t["events"]
    return clean_values(e.select("event_id", dirty_values(e).alias("value")))


def texts(spark, t):
    text = (F.when(F.col("event_id") % 3 == 0, F.lit(" \t "))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), "event_type", F.lit(" \n"))))
    return t["events"].select("event_id", clean_text(text).alias("text"))


def flags(spark, t):
    e = t["events"].select(
        "event_id", F.col("value"), (F.col("value") > 50).alias("yes"),
        F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "")
        .when(F.col("event_id") % 4 == 2, F.lit(" 0 ")).otherwise(F.col("event_type")).alias("text"))
    return e.select("event_id", *[to_flag(e, c).alias(f"{c}_flag") for c in ("value", "yes", "text")])


def replay(spark, t):
    rows = chain.labelled(spark, t).where(F.col("ECON_STRESS").isNotNull())
    return intervals.event_replay(rows, "date", intervals.islands(rows, KEYS), keys=KEYS)


def visible(spark, t):
    rows = chain.labelled(spark, t).where(F.col("ECON_STRESS").isNotNull())
    shown = intervals.trailing_window(rows, KEYS, years=1)
    return intervals.visible_periods(intervals.islands(rows, KEYS), shown, KEYS)


def islands(spark, t):
    rows = chain.labelled(spark, t).where(F.col("ECON_STRESS").isNotNull())
    return intervals.islands(rows, KEYS)


def all_islands(spark, t):
    """Alternating labels from the data: quarters whose first month had many urgent orders."""
    m = chain.monthly(t).select(
        "entity", "date", (F.col("FEDFUNDS") > 20).cast("int").alias("CRISIS"),
        F.when(F.month("date") <= 4, "early").when(F.month("date") <= 8, " ").otherwise("late")
        .alias("CRISIS_NAME"))
    return intervals.islands(m, KEYS)


def day_labels(spark, t):
    obs = macro_obs(t).where(F.col("series") == "VIX").select("entity", "date", "value")
    return intervals.label_periods(obs, "date", overlapping(spark))


OVERLAPPING = (("1996-01-10", "1996-06-15", "first"), ("1996-06-01", "1996-08-01", "second"),
               ("1996-03-05", "1996-03-05", "one day"), ("2000-02-29", "2001-12-31", "last"))


def overlapping(spark):
    return intervals.periods_table(spark, OVERLAPPING)


def _over_sql():
    rows = ", ".join(f"({i}, DATE '{a}', DATE '{b}', '{n}')"
                     for i, (a, b, n) in enumerate(OVERLAPPING))
    return f'(VALUES {rows}) AS p(ord, "start", "end", name)'


def spine(spark, t):
    w = chain.wide(t)
    cols = list(fixed.SERIES)
    return timeseries.month_spine(
        timeseries.resample_month(w, KEYS, "date", fixed.MONTHLY_RULES), KEYS, "date", cols)


def aged_fill(spark, t):
    """Fill customers' quarterly totals for two months at most."""
    s = timeseries.month_spine(
        timeseries.resample_month(chain.wide(t, "o_custkey"), KEYS, "date", {"GDP": "last"}),
        KEYS, "date", ["GDP"], keep_partial=True)
    return timeseries.forward_fill(s, KEYS, "date", ["GDP"], max_age_months=2)


def queries() -> list[Query]:
    o = oracle
    seg = {
        "wide": o.wide(), "monthly": o.monthly(), "features": o.features(), "stress": o.stress(),
        "labelled": o.labelled(), "targets": o.targets(), "islands": o.islands(),
    }
    islands_cols = {"entity": "s", "name": "s", "start_date": "d", "end_date": "d"}
    label = {"CRISIS": "i", "CRISIS_NAME": "s"}
    target = {"TARGET_STRESS_3M": "f6", "TARGET_STRESS_CHANGE_3M": "f6",
              "TARGET_RISK_RISING_3M": "n", "TARGET_CRISIS_3M": "n"}
    record = {"entity": "s", "date": "d", "economic_stress": "f6", "stress_change_1m": "f6",
              "stress_change_3m": "f6", "stress_volatility_6m": "f6", "fed_funds_rate": "f6",
              "unemployment_rate": "f6", "inflation_rate": "f6", "gdp_growth": "f6",
              "treasury_yield": "f6", "vix": "f6", "crisis": "b", "crisis_name": "s"}

    def feature_query(name, cols):
        return Query(name, lambda s, t: chain.features(t), {**ROW, **f6(*cols)},
                     "SELECT * FROM features", seg["features"])

    def stress_query(name, cols):
        return Query(name, lambda s, t: chain.stress(t), {**ROW, **f6(*cols)},
                     "SELECT * FROM stress", seg["stress"])
    return [
        Query("s0_macro_obs", lambda s, t: macro_obs(t), OBS, "SELECT * FROM obs", o.obs()),
        Query("s1_series_csv", s1_series_csv, OBS, "SELECT * FROM obs", o.obs()),
        Query("s2_wide_csv", s2_wide_csv, {**ROW, **SERIES6}, "SELECT * FROM wide", seg["wide"]),
        Query("s3_observation_json", s3_observation_json, OBS, "SELECT * FROM obs", o.obs()),

        Query("p1_project_rename",
              lambda s, t: t["supplier"].select("s_suppkey", F.col("s_acctbal").alias("balance")),
              {"s_suppkey": "i", "balance": "f2"},
              "SELECT s_suppkey, s_acctbal AS balance FROM supplier"),
        Query("p2_drop_excluded",
              lambda s, t: chain.targets(s, t).drop(*fixed.NOT_FEATURES, "NOT_THERE"),
              {"entity": "s", **f6(*fixed.ALL_FEATURES)},
              f"SELECT entity, {', '.join(fixed.ALL_FEATURES)} FROM targets", seg["targets"]),
        Query("p3_numeric_columns",
              lambda s, t: t["part"].select(*numeric_columns(t["part"], ["p_partkey"])),
              {"p_size": "i", "p_retailprice": "f2"}, "SELECT p_size, p_retailprice FROM part"),
        Query("p4_drop_nulls", lambda s, t: chain.features(t).dropna(
            subset=["INFLATION_RATE", "VIX_VOLATILITY"]),
              {**ROW, "INFLATION_RATE": "f6", "VIX_VOLATILITY": "f6"},
              "SELECT * FROM features WHERE INFLATION_RATE IS NOT NULL AND VIX_VOLATILITY IS NOT NULL",
              seg["features"]),
        Query("p6_conform_columns",
              lambda s, t: conform(t["customer"], ["c_custkey", "missing_one", "c_acctbal"]),
              {"c_custkey": "i", "missing_one": "f2", "c_acctbal": "f2"},
              "SELECT c_custkey, CAST(NULL AS DOUBLE) AS missing_one, c_acctbal FROM customer"),
        Query("p7_closed_interval",
              lambda s, t: macro_obs(t).where(F.col("date").between("1996-02-01", "1996-05-31")),
              OBS, "SELECT * FROM obs WHERE date >= DATE '1996-02-01' AND date <= DATE '1996-05-31'",
              o.obs()),
        Query("p8_lenient_cast", lenient,
              {"event_id": "i", "k": "f4", "type_number": "f4", "value": "f4"},
              """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
                 TRY_CAST(event_type AS DOUBLE) AS type_number, value FROM events"""),
        Query("p9_clean_values", cleaned, {"event_id": "i", "value": "f4"},
              """SELECT event_id, CASE WHEN user_id % 10 > 2 THEN value END AS value FROM events"""),
        Query("p10_clean_text", texts, {"event_id": "i", "text": "s"},
              """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN trim(event_type) END AS text
                 FROM events"""),
        Query("p11_flags", flags,
              {"event_id": "i", "value_flag": "b", "yes_flag": "b", "text_flag": "b"},
              """SELECT event_id, coalesce(trunc(value) <> 0, false) AS value_flag,
                 coalesce(value > 50, false) AS yes_flag,
                 event_id % 4 = 3 AND length(event_type) > 0 AS text_flag FROM events"""),
        Query("p13_history_records",
              lambda s, t: history_records(chain.labelled(s, t).dropna(subset=["ECON_STRESS"]), KEYS),
              record,
              """SELECT entity, date, ECON_STRESS AS economic_stress,
                 STRESS_CHANGE_1M AS stress_change_1m, STRESS_CHANGE_3M AS stress_change_3m,
                 STRESS_VOLATILITY_6M AS stress_volatility_6m, FEDFUNDS AS fed_funds_rate,
                 UNRATE AS unemployment_rate, INFLATION_RATE AS inflation_rate,
                 GDP_GROWTH AS gdp_growth, TREASURY AS treasury_yield, VIX AS vix,
                 CRISIS = 1 AS crisis, CRISIS_NAME AS crisis_name
                 FROM labelled WHERE ECON_STRESS IS NOT NULL""", seg["labelled"]),
        *[Query(f"p14_trailing_{n}y",
                lambda s, t, n=n: intervals.trailing_window(chain.monthly(t), KEYS, years=n),
                {**ROW, **SERIES6},
                f"""SELECT m.* FROM monthly m JOIN (SELECT entity, max(date) AS last FROM monthly
                    GROUP BY entity) USING (entity) WHERE date >= last - INTERVAL {n} YEAR""",
                seg["monthly"]) for n in (1, 5, 10, 20)],
        Query("p14_trailing_all", lambda s, t: intervals.trailing_window(chain.monthly(t), KEYS),
              {**ROW, **SERIES6}, "SELECT * FROM monthly", seg["monthly"]),
        Query("p15_event_replay", replay, {**ROW, "period_name": "s", "ECON_STRESS": "f6"},
              """SELECT r.entity, r.date, r.ECON_STRESS, i.name AS period_name FROM retained r
                 JOIN islands i ON r.entity = i.entity
                  AND r.date BETWEEN i.start_date - INTERVAL 12 MONTH AND i.end_date + INTERVAL 6 MONTH""",
              seg["islands"]),
        Query("p16_selected_period",
              lambda s, t: intervals.visible_periods(all_islands(s, t), chain.monthly(t), KEYS, selected="early"),
              islands_cols,
              """SELECT entity, name, min(date) AS start_date, max(date) AS end_date FROM (
                   SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date)
                     - row_number() OVER (PARTITION BY entity, hit ORDER BY date) AS run
                   FROM (SELECT entity, date, 'early' AS name, FEDFUNDS > 20 AND month(date) <= 4 AS hit
                         FROM monthly)) WHERE hit GROUP BY entity, name, run""", seg["monthly"]),
        Query("p16_visible_periods", visible, islands_cols,
              """SELECT i.* FROM islands i JOIN (
                   SELECT entity, min(date) AS first FROM retained r JOIN (
                     SELECT entity, max(date) AS last FROM retained GROUP BY entity) USING (entity)
                   WHERE date >= last - INTERVAL 1 YEAR GROUP BY entity) USING (entity)
                 WHERE end_date >= first""", seg["islands"]),

        Query("j1_series_to_wide", lambda s, t: chain.wide(t), {**ROW, **SERIES6},
              "SELECT * FROM wide", seg["wide"]),
        Query("j1_full_outer_merge", full_outer, {**ROW, **SERIES6}, "SELECT * FROM wide",
              seg["wide"]),
        Query("j5_period_labels", lambda s, t: intervals.label_periods(
            chain.stress(t), "date", intervals.periods_table(s), "month"), {**ROW, **label},
              "SELECT * FROM labelled", seg["labelled"]),
        Query("j5_c4_listed_period_labels", lambda s, t: chain.labelled(s, t), {**ROW, **label},
              "SELECT * FROM labelled", seg["labelled"]),
        Query("j5_overlapping_day_labels", day_labels, {**ROW, "value": "f4", **label},
              f"""SELECT entity, date, value,
                  CASE WHEN count(ord) > 0 THEN 1 ELSE 0 END AS CRISIS,
                  coalesce(arg_max(name, ord), 'None') AS CRISIS_NAME
                  FROM (SELECT * FROM obs WHERE series = 'VIX') o
                  LEFT JOIN {_over_sql()} ON date BETWEEN p."start" AND p."end"
                  GROUP BY entity, date, value""", o.obs()),
        Query("a1_a2_resample_month",
              lambda s, t: timeseries.resample_month(chain.wide(t), KEYS, "date", fixed.MONTHLY_RULES),
              {**ROW, **SERIES6}, "SELECT * FROM resampled", seg["monthly"]),
        Query("a3_month_spine", spine, {**ROW, **SERIES6}, "SELECT * FROM filled", seg["monthly"]),
        Query("a12_history_summary",
              lambda s, t: history_summary(chain.stress(t), KEYS),
              {"entity": "s", "start_date": "d", "end_date": "d", "observation_count": "i",
               "latest_stress": "f6", "average_stress": "f6", "minimum_stress": "f6",
               "maximum_stress": "f6", "peak_stress_date": "d"},
              """SELECT entity, min(date) AS start_date, max(date) AS end_date,
                 count(*) AS observation_count, arg_max(ECON_STRESS, date) AS latest_stress,
                 avg(ECON_STRESS) AS average_stress, min(ECON_STRESS) AS minimum_stress,
                 max(ECON_STRESS) AS maximum_stress,
                 (SELECT min(x.date) FROM stress x WHERE x.entity = s.entity
                   AND x.ECON_STRESS = max(s.ECON_STRESS)) AS peak_stress_date
                 FROM stress s WHERE ECON_STRESS IS NOT NULL GROUP BY entity""", seg["stress"]),
        Query("a13_target_summary",
              lambda s, t: index.target_summary(chain.targets(s, t), KEYS),
              {"entity": "s", "valid_changes": "i", "average_change": "f6", "rising": "i",
               "stable_or_falling": "i"},
              """SELECT entity, count(TARGET_STRESS_CHANGE_3M) AS valid_changes,
                 avg(TARGET_STRESS_CHANGE_3M) AS average_change,
                 count(*) FILTER (TARGET_RISK_RISING_3M = 1) AS rising,
                 count(*) FILTER (TARGET_RISK_RISING_3M = 0) AS stable_or_falling
                 FROM targets GROUP BY entity""", seg["targets"]),

        feature_query("w1_differences", ["FED_CHANGE", "TREASURY_CHANGE", "VIX_CHANGE",
                                         "UNRATE_CHANGE"]),
        feature_query("w2_percent_changes", ["INFLATION_RATE", "GDP_GROWTH"]),
        feature_query("w3_rolling_means", ["FED_3M_AVG", "FED_6M_AVG", "CPI_3M_AVG", "GDP_3M_AVG",
                                           "UNRATE_3M_AVG", "VIX_3M_AVG"]),
        feature_query("w4_rolling_deviations", ["VIX_VOLATILITY", "FED_VOLATILITY"]),
        Query("w5_j7_forward_fill",
              lambda s, t: timeseries.forward_fill(spine(s, t), KEYS, "date", list(fixed.SERIES)),
              {**ROW, **SERIES6}, "SELECT * FROM carried", seg["monthly"]),
        Query("w5_fill_with_max_age", aged_fill, {**ROW, "GDP": "f4"},
              """SELECT entity, date,
                 coalesce(GDP, lag(GDP, 1) OVER w, lag(GDP, 2) OVER w) AS GDP
                 FROM (SELECT s.entity, s.date, g.GDP FROM (
                   SELECT entity, CAST(unnest(generate_series(date_trunc('month', min(date)),
                     date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE) AS date
                   FROM wide GROUP BY entity) s
                   LEFT JOIN (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS date,
                     arg_max(GDP, CASE WHEN GDP IS NOT NULL THEN date END) AS GDP
                     FROM wide GROUP BY 1, 2) g USING (entity, date))
                 WINDOW w AS (PARTITION BY entity ORDER BY date)""", o.wide("o_custkey")),
        feature_query("w6_lags", ["FED_LAG1", "GDP_LAG1", "CPI_LAG1", "UNRATE_LAG1",
                                  "TREASURY_LAG1", "VIX_LAG1"]),
        feature_query("w7_momentum", ["FED_MOMENTUM", "GDP_MOMENTUM", "UNRATE_MOMENTUM",
                                      "VIX_MOMENTUM"]),
        stress_query("w8_expanding_zscore", list(fixed.Z_INPUTS)),
        stress_query("w9_w10_composite_index", ["RAW_ECON_STRESS", "ECON_STRESS"]),
        stress_query("w11_index_trends", TRENDS),
        Query("w12_forward_targets", lambda s, t: chain.targets(s, t), {**ROW, **target},
              "SELECT * FROM targets", seg["targets"]),
        Query("w13_islands", islands, islands_cols, "SELECT * FROM islands", seg["islands"]),
        Query("w13_alternating_islands", all_islands, islands_cols,
              """SELECT entity, name, min(date) AS start_date, max(date) AS end_date FROM (
                   SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date)
                     - row_number() OVER (PARTITION BY entity, hit, name ORDER BY date) AS run
                   FROM (SELECT entity, date, FEDFUNDS > 20 AS hit,
                     CASE WHEN month(date) <= 4 THEN 'early' WHEN month(date) <= 8
                          THEN 'Historical Crisis' ELSE 'late' END AS name FROM monthly))
                 WHERE hit GROUP BY entity, name, run""", seg["monthly"]),
        Query("w16_latest_rows", lambda s, t: timeseries.latest_rows(chain.features(t), KEYS),
              {**ROW, **SERIES6, "VIX_MOMENTUM": "f6"},
              """SELECT * FROM features QUALIFY row_number() OVER
                 (PARTITION BY entity ORDER BY date DESC) = 1""", seg["features"]),
        *[Query(name, lambda s, t, n=n: timeseries.background(chain.monthly(t), KEYS, n=n),
                {**ROW, **SERIES6},
                f"""SELECT * FROM monthly QUALIFY row_number() OVER
                    (PARTITION BY entity ORDER BY date DESC) BETWEEN 2 AND {n + 1}""", seg["monthly"])
          for name, n in (("w17_background", 30), ("w17_background_200", 200))],
        Query("w18_persistence",
              lambda s, t: timeseries.persistence_forecast(index.training_set(chain.targets(s, t))),
              {**ROW, "prediction": "f6", "TARGET_STRESS_3M": "f6"},
              """SELECT entity, date, ECON_STRESS AS prediction, TARGET_STRESS_3M FROM targets
                 WHERE TARGET_STRESS_CHANGE_3M IS NOT NULL""", seg["targets"]),
        *[Query(f"t6_preview_{'tail' if tail else 'head'}",
                lambda s, t, tail=tail: timeseries.preview(
                    chain.stress(t), ["date", "entity"], 7, tail),
                {**ROW, "ECON_STRESS": "f6"},
                f"""SELECT * FROM stress WHERE ECON_STRESS IS NOT NULL
                    ORDER BY date {'DESC' if tail else 'ASC'}, entity {'DESC' if tail else 'ASC'}
                    LIMIT 7""", seg["stress"]) for tail in (False, True)],
        Query("u2_reversed_periods",
              lambda s, t: islands(s, t).groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list(
                  F.struct("start_date", "name")))).alias("p")).select(
                  "entity", F.posexplode("p").alias("pos", "p")).select("entity", "pos", "p.name"),
              {"entity": "s", "pos": "i", "name": "s"},
              """SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY start_date DESC) - 1
                 AS pos, name FROM islands""", seg["islands"]),
        Query("scalar_date_labels",
              lambda s, t: chain.monthly(t).select("entity", "date", month_label(F.col("date"))
                                                   .alias("month"), year_label(F.col("date"))
                                                   .alias("year"), day_label(F.col("date"))
                                                   .alias("day"), gauge_percent(
                                                       F.col("VIX") - 1.2).alias("gauge")),
              {**ROW, "month": "s", "year": "s", "day": "s", "gauge": "f6"},
              "SELECT entity, date, strftime(date, '%b %Y') AS month, strftime(date, '%Y') AS year, "
              "strftime(date, '%b %-d, %Y') AS day, least(greatest((VIX - 1.2) * 100, 0), 100) "
              "AS gauge FROM monthly", seg["monthly"]),

        Query("c1_monthly_table", lambda s, t: chain.monthly(t), {**ROW, **SERIES6},
              "SELECT * FROM monthly", seg["monthly"]),
        Query("c2_features", lambda s, t: chain.features(t), {**ROW, **SERIES6, **f6(*FEATURES)},
              "SELECT * FROM features", seg["features"]),
        Query("c3_stress_index", lambda s, t: chain.stress(t),
              {**ROW, **f6(*INDEX), **f6(*TRENDS)}, "SELECT * FROM stress", seg["stress"]),
        Query("c5_full_feature_table", lambda s, t: chain.targets(s, t),
              {**ROW, **SERIES6, **f6(*FEATURES, *INDEX, *TRENDS), **label, **target},
              "SELECT * FROM targets", seg["targets"]),
        Query("c6_training_set", lambda s, t: index.training_set(chain.targets(s, t)),
              {**ROW, "ECON_STRESS": "f6", "TARGET_STRESS_CHANGE_3M": "f6",
               "TARGET_RISK_RISING_3M": "i"},
              """SELECT * FROM targets WHERE TARGET_STRESS_CHANGE_3M IS NOT NULL
                 AND TARGET_RISK_RISING_3M IS NOT NULL""", seg["targets"]),
        # Every customer is an entity: the window, label and target operators at scale.
        Query("c5_customer_targets", lambda s, t: chain.targets(s, t, "o_custkey", 6),
              {**ROW, "INFLATION_RATE": "f4", "ECON_STRESS": "f4", "STRESS_CHANGE_3M": "f4",
               **label, "TARGET_RISK_RISING_3M": "n"},
              "SELECT * FROM targets", o.targets("o_custkey", 6)),
    ]
