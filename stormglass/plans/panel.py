"""Queries over the country-year panel, envelopes and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric_columns
from ..operators import profile, reshape
from ..operators.ranking import exact_medians
from ..operators.models import fit_scaler
from ..sources import (explode_envelopes, indicator_long, read_envelopes, validate_envelopes,
                       write_table)
from ..sources.tables import INDICATORS, nation_countries, panel_years
from ..storage import literal_table, materialise, scratch_path
from . import chain, oracle
from .spec import Query, rounded, rounded_sql

LONG = {"country_code": "s", "country": "s", "year": "i", "indicator_code": "s",
        "indicator": "s", "value": "f4"}
PANEL = {"country_code": "s", "country": "s", "year": "i",
         **dict.fromkeys(INDICATORS.values(), "f4")}
COVERAGE = {"country_code": "s", "country": "s", "indicator": "s", "valid_values": "i",
            "missing_values": "i", "coverage_percentage": "f6"}
PROFILE = {"feature": "s", "missing_count": "i", "missing_percentage": "f6",
           "unique_values": "i", "variance": "f4", "mean": "f4", "standard_deviation": "f4",
           "minimum": "f4", "maximum": "f4"}
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def full_panel(t):
    return reshape.country_year_panel(indicator_long(t), nation_countries(t), panel_years(t),
                                      tuple(INDICATORS.values()))


def every_indicator(spark, t):
    """The files of all indicators stacked: each frame reads only its own folder."""
    stored = materialise(indicator_long(t), "indicators", ["indicator"])
    return reshape.union_all([stored.where(F.col("indicator") == n) for n in INDICATORS.values()])


def envelopes(t):
    """One envelope per indicator, with rows of unknown codes, bad years and text values."""
    rows = indicator_long(t)
    bad_year = F.when(F.col("year") == 1997, F.lit("n/a")).otherwise(F.col("year").cast("string"))
    value = F.when(F.col("year") == 1998, F.lit("unknown")).otherwise(F.col("value").cast("string"))
    item = F.struct(F.col("country_code").alias("countryiso3code"), bad_year.alias("date"),
                    value.alias("value"))
    docs = rows.groupBy("indicator_code", "indicator").agg(F.collect_list(item).alias("r"))
    body = F.concat(F.lit('[{"page":1},'),
                    F.to_json("r", {"ignoreNullFields": "false"}), F.lit("]"))
    return docs.select("indicator_code", "indicator", body.alias("payload"))


def envelope_rows(spark, t):
    good, _ = validate_envelopes(envelopes(t))
    countries = nation_countries(t).where(F.col("country_code") < "N20")
    return explode_envelopes(good, countries)


def mixed_envelopes(t):
    """A good or broken envelope per supplier, by its nation."""
    kind = F.col("s_nationkey") % 6
    key = F.col("s_suppkey").cast("string")
    payload = (F.when(kind == 0, F.concat(F.lit('{"id":'), key, F.lit("}")))
               .when(kind == 1, F.concat(F.lit('[{"page":'), key, F.lit("}]")))
               .when(kind == 2, F.concat(F.lit('[{"message":"bad '), key, F.lit('"},null]')))
               .when(kind == 3, F.concat(F.lit('[{"page":1},{"id":'), key, F.lit("}]")))
               .when(kind == 4, F.lit('[{"page":1},null]'))
               .otherwise(F.concat(F.lit('[{"page":1},[{"countryiso3code":"'), key,
                                   F.lit('","date":"2001","value":1}]]'))))
    return t["supplier"].select("s_suppkey", payload.alias("payload"))


def rejected_envelopes(spark, t):
    good, bad = validate_envelopes(mixed_envelopes(t))
    return bad.unionByName(good.select("s_suppkey", F.lit("accepted").alias("reason")))


def envelope_files(spark, t):
    """Land the envelopes as files named by their indicator, then scan them."""
    docs = envelopes(t).select(F.col("payload").alias("value"), "indicator_code")
    path = scratch_path(spark, "envelopes")
    docs.write.partitionBy("indicator_code").text(path)
    names = spark.read.text(path).select("indicator_code", F.col("value").alias("payload"))
    names = names.join(literal_table(spark, list(INDICATORS.items()),
                                     "indicator_code string, indicator string"), "indicator_code")
    good, _ = validate_envelopes(names)
    return explode_envelopes(good, nation_countries(t))


def table_sink(spark, t):
    path = write_table(full_panel(t), scratch_path(spark, "panel"), ["year"])
    return spark.read.parquet(path)


def csv_sink(spark, t):
    schema = "country_code string, country string, indicator string, valid_values long, " \
             "missing_values long, coverage_percentage double"
    path = write_table(coverage(t), scratch_path(spark, "coverage"), fmt="csv")
    return spark.read.schema(schema).option("header", True).csv(path)


def coverage(t):
    return reshape.coverage_report(full_panel(t), ["country_code", "country"],
                                   list(INDICATORS.values()))


def feature_rows(spark, t):
    """Labelled rows, written once because they are scanned repeatedly.

    Rounded, since distinct counts would tell apart numbers that differ in the last bit.
    """
    rows = chain.targets(spark, t).dropna(subset=["TARGET_RISK_RISING_3M"])
    cols = numeric_columns(rows, fixed.NOT_FEATURES)
    return materialise(rows.select(*[rounded(F.col(c), 6).alias(c) for c in cols]), "audit"), cols


def feature_profile(spark, t):
    rows, cols = feature_rows(spark, t)
    return profile.profile_columns(rows, cols)


def feature_correlations(spark, t):
    rows, cols = feature_rows(spark, t)
    return profile.high_correlations(rows, cols)


def scaler_rows(spark, t):
    s = fit_scaler(t["lineitem"], LINE)
    rows = [(c, s.median[c], s.mean[c], s.scale[c]) for c in s.features]
    return literal_table(spark, rows, "feature string, median double, mean double, scale double")


def scaled_lines(spark, t):
    """Every line imputed and scaled; the scaler sees lines without tax as missing."""
    rows = t["lineitem"].withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    s = fit_scaler(rows, ["tax", "l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", s.scaled("tax").alias("tax"),
                       s.scaled("l_quantity").alias("quantity"))


def medians_by_ranking(spark, t):
    """The route for large data: bracket, count, rank what is inside."""
    found = exact_medians(t["lineitem"], LINE)
    return literal_table(spark, list(found.items()), "feature string, median double")


def _profile_sql(source, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count,
            100.0 * (count(*) - count({c})) / nullif(count(*), 0) AS missing_percentage,
            count(DISTINCT {c}) AS unique_values, var_samp({c}) AS variance, avg({c}) AS mean,
            stddev_samp({c}) AS standard_deviation, min({c}) AS minimum, max({c}) AS maximum
            FROM {source}""" for c in cols)


def _corr_sql(source, cols, threshold):
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS correlation FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"""SELECT *, abs(correlation) AS absolute_correlation FROM ({pairs})
               WHERE correlation IS NOT NULL AND NOT isnan(correlation)
                 AND abs(correlation) >= {threshold}"""


def queries() -> list[Query]:
    o = oracle
    line_nums = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, " \
                "CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem)"
    correlation = {"feature_1": "s", "feature_2": "s", "correlation": "f6",
                   "absolute_correlation": "f6"}
    model_cols = [*fixed.SERIES, *chain.FEATURES, *fixed.Z_INPUTS, "ECON_STRESS",
                  "STRESS_CHANGE_1M", "STRESS_CHANGE_3M", "STRESS_3M_AVG", "STRESS_VOLATILITY_6M",
                  "STRESS_ACCELERATION", "STRESS_GAP_3M"]
    training = o.targets() + ",\ntraining AS MATERIALIZED (SELECT " + ", ".join(
        f"{rounded_sql(c, 6)} AS {c}" for c in model_cols) + \
        " FROM targets WHERE TARGET_RISK_RISING_3M IS NOT NULL)"
    coverage_sql = " UNION ALL ".join(
        f"""SELECT country_code, country, '{n}' AS indicator, count({n}) AS valid_values,
            count(*) - count({n}) AS missing_values, 100.0 * count({n}) / count(*)
            AS coverage_percentage FROM panel GROUP BY country_code, country"""
        for n in INDICATORS.values())
    line_stats = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, median({c}) AS median, avg({c}) AS mean,
            stddev_pop({c}) AS scale FROM {line_nums} AS n""" for c in LINE)
    return [
        Query("s4_envelope_validation", rejected_envelopes, {"s_suppkey": "i", "reason": "s"},
              """SELECT s_suppkey, CASE s_nationkey % 6 WHEN 0 THEN 'unexpected response type'
                 WHEN 1 THEN 'response did not contain data'
                 WHEN 2 THEN 'error: bad ' || CAST(s_suppkey AS VARCHAR)
                 WHEN 3 THEN 'observation data has an invalid structure'
                 ELSE 'accepted' END AS reason FROM supplier"""),
        Query("s5_j6_envelope_rows", envelope_rows, LONG,
              """SELECT * REPLACE (CASE WHEN year <> 1998 THEN value END AS value)
                 FROM indicator_long WHERE year <> 1997 AND country_code < 'N20'""",
              o.indicator_long()),
        Query("s5_envelope_files", envelope_files, LONG,
              """SELECT * REPLACE (CASE WHEN year <> 1998 THEN value END AS value)
                 FROM indicator_long WHERE year <> 1997""", o.indicator_long()),
        Query("s6_table_sink", table_sink, PANEL, "SELECT * FROM panel", o.panel()),
        Query("s6_csv_sink", csv_sink, COVERAGE, coverage_sql, o.panel()),
        Query("u1_union_all", lambda s, t: reshape.union_all(
            [indicator_long(t).where(F.col("indicator") == n) for n in list(INDICATORS.values())[:3]]),
              LONG, "SELECT * FROM indicator_long WHERE indicator IN "
                    "('order_count', 'revenue_millions', 'average_price')", o.indicator_long()),
        Query("u1_union_all_indicators", every_indicator, LONG, "SELECT * FROM indicator_long",
              o.indicator_long()),
        Query("j2_left_lookup",
              lambda s, t: t["customer"].join(nation_countries(t).select(
                  F.substring("country_code", 2, 2).cast("int").alias("c_nationkey"), "country"),
                  "c_nationkey", "left"),
              {"c_custkey": "i", "country": "s"},
              """SELECT c_custkey, n_name AS country FROM customer
                 LEFT JOIN nation ON c_nationkey = n_nationkey"""),
        Query("j4_code_year_spine",
              lambda s, t: reshape.code_year_spine(nation_countries(t), panel_years(t)),
              {"country_code": "s", "country": "s", "year": "i"}, "SELECT * FROM grid", o.panel()),
        Query("a4_pivot_first",
              lambda s, t: reshape.pivot_indicators(
                  indicator_long(t), ["country_code", "year"], "indicator", "value",
                  list(INDICATORS.values()), order="indicator_code"),
              {"country_code": "s", "year": "i", **dict.fromkeys(INDICATORS.values(), "f4")},
              "SELECT * FROM cells", o.panel()),
        Query("a5_t2_coverage", lambda s, t: reshape.sort_coverage(coverage(t)), COVERAGE,
              coverage_sql, o.panel()),
        Query("j3_c8_country_year_panel", lambda s, t: full_panel(t), PANEL, "SELECT * FROM panel",
              o.panel()),
        Query("c9_world_coverage",
              lambda s, t: reshape.coverage_report(
                  full_panel(t).withColumn("world", F.lit("all")), ["world"],
                  list(INDICATORS.values())),
              {"world": "s", "indicator": "s", "valid_values": "i", "missing_values": "i",
               "coverage_percentage": "f6"},
              " UNION ALL ".join(
                  f"SELECT 'all' AS world, '{n}' AS indicator, count({n}) AS valid_values, "
                  f"count(*) - count({n}) AS missing_values, 100.0 * count({n}) / count(*) "
                  f"AS coverage_percentage FROM panel" for n in INDICATORS.values()), o.panel()),
        Query("a6_null_counts", lambda s, t: reshape.null_counts(chain.wide(t), list(fixed.SERIES)),
              {"column": "s", "missing": "i"},
              " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing "
                                 f"FROM wide" for c in fixed.SERIES), o.wide()),
        Query("a7_column_profile", lambda s, t: profile.profile_columns(t["lineitem"], LINE),
              {**PROFILE, "variance": "f2", "standard_deviation": "f2", "mean": "f3"},
              _profile_sql(line_nums, LINE)),
        Query("a7_feature_profile", feature_profile, PROFILE,
              _profile_sql("training", model_cols), training),
        Query("a8_correlations", lambda s, t: profile.high_correlations(t["lineitem"], LINE, 0.0),
              correlation, _corr_sql(line_nums, LINE, 0)),
        Query("a8_correlations_by_sums",
              lambda s, t: profile.high_correlations(t["lineitem"], LINE, 0.0),
              correlation, _corr_sql(line_nums, LINE, 0)),
        Query("a8_c7_high_feature_correlations", feature_correlations, correlation,
              _corr_sql("training", model_cols, fixed.CORRELATION_THRESHOLD), training),
        Query("a9_constant_columns",
              lambda s, t: profile.constant_columns(profile.profile_columns(
                  t["lineitem"].withColumn("fixed_number", F.lit(3.0)), [*LINE, "fixed_number"])),
              {"feature": "s"},
              f"""SELECT feature FROM ({_profile_sql(line_nums, LINE)}
                  UNION ALL SELECT 'fixed_number', 0, 0, 1, 0, 3, 0, 3, 3) WHERE unique_values <= 1"""),
        Query("a19_medians", medians_by_ranking, {"feature": "s", "median": "f6"},
              f"SELECT feature, median FROM ({line_stats})"),
        Query("a19_a20_scaler", scaler_rows,
              {"feature": "s", "median": "f4", "mean": "f3", "scale": "f3"}, line_stats),
        Query("a20_scaled_rows", scaled_lines,
              {"l_orderkey": "i", "l_linenumber": "i", "tax": "f6", "quantity": "f6"},
              """SELECT l_orderkey, l_linenumber, (tax - avg(tax) OVER ()) / stddev_pop(tax) OVER ()
                 AS tax, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()
                 AS quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity,
                 coalesce(nullif(l_tax, 0), (SELECT median(nullif(l_tax, 0)) FROM lineitem)) AS tax
                 FROM lineitem)"""),
    ]
