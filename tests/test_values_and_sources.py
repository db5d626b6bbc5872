import json

import pytest
from helpers import day, rows
from pyspark.sql import functions as F

from stormglass import fixed, functions as fn
from stormglass.operators import reshape, profile
from stormglass.sources import (explode_envelopes, read_documents, read_envelopes,
                                read_observation_json, read_series, series_catalogue, snapshot_status,
                                validate_envelopes, write_documents)

NAN, INF = float("nan"), float("inf")


def values(spark, kind, *items):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def got(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_numbers_that_are_not_finite_become_null(spark):
    df = values(spark, "double", 1.5, NAN, INF, -INF, None)
    assert got(fn.clean_values(df), "v") == [1.5, None, None, None, None]


def test_lenient_cast(spark):
    df = values(spark, "string", "1.5", " 2 ", ".", "x", "NaN", "Infinity", None)
    assert got(df, fn.lenient_double(F.col("v"))) == [1.5, 2.0, None, None, None, None, None]


def test_text_and_flags(spark):
    assert got(values(spark, "string", " a b\n", "\t ", "", None), fn.clean_text(F.col("v"))) == \
        ["a b", None, None, None]
    df = values(spark, "string", "0", " 1 ", "yes", "", "0.5", None)
    assert got(df, fn.to_flag(df, "v")) == [False, True, True, False, True, False]
    df = values(spark, "double", 0.0, 0.5, -2.0, None)
    assert got(df, fn.to_flag(df, "v")) == [False, False, True, False]


def test_schema_helpers(spark):
    df = values(spark, "string", "a")
    with pytest.raises(ValueError, match="missing columns: a, b"):
        fn.require_columns(df, ["b", "i", "a"])
    assert fn.conform(df, ["z", "i"]).columns == ["z", "i"]
    assert fn.numeric_columns(df, []) == ["i"] and fn.numeric_columns(df, ["i"]) == []


def test_bands_follow_the_order_of_the_chain(spark):
    df = values(spark, "double", 0.19, 0.2, 0.34, 0.35, 0.6, 0.8, None)
    assert got(df, fn.warning_level(F.col("v"), 0.35)) == \
        ["Low", "Guarded", "Guarded", "Elevated", "High", "Critical", None]
    low = values(spark, "double", 0.15)
    assert got(low, fn.warning_level(F.col("v"), 0.1)) == ["Low"]
    assert got(low, fn.warning_active(F.col("v"), 0.1)) == [True]
    tones = values(spark, "string", "Critical", "HIGH", "guarded", "Low", None)
    assert got(tones, fn.warning_tone(F.col("v"))) == ["danger", "danger", "warning", "safe", "safe"]


def test_number_texts(spark):
    df = values(spark, "double", 0.1234, None)
    assert got(df, fn.format_percent(F.col("v"))) == ["12.3%", "—"]
    assert got(df, fn.format_number(F.col("v"), 2)) == ["0.12", "—"]


def test_series_files_take_their_name_from_the_file(spark, tmp_path):
    (tmp_path / "CPIAUCSL.csv").write_text("date,value\n2000-01-01,1.5\n2000-02-01,\n")
    (tmp_path / "GDP.csv").write_text("date,value\n2000-01-01,7\n")
    assert rows(read_series(spark, str(tmp_path)), "series", "date") == [
        ("CPI", day("2000-01-01"), 1.5), ("CPI", day("2000-02-01"), None),
        ("GDP", day("2000-01-01"), 7.0)]


def test_observation_documents(spark, tmp_path):
    doc = {"observations": [{"date": "2000-01-01", "value": "1.5"}, {"date": "2000-01-02", "value": "."},
                            {"date": "2000-01-03", "value": "-2"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text('{"observations": []}')
    assert rows(read_observation_json(spark, str(tmp_path), whole_files=True), "date") == [
        (day("2000-01-01"), 1.5), (day("2000-01-03"), -2.0)]


def test_envelopes_are_checked_in_order(spark):
    texts = ['{"a": 1}', "not json", '[{"page": 1}]', '[{"message": [1]}, 5]', '[{"page": 1}, null]',
             '[{"page": 1}, {"x": 1}]', '[{"page": 1}, []]', "[]"]
    good, bad = validate_envelopes(values(spark, "string", *texts), "v")
    reasons = {r.i: r.reason for r in bad.collect()}
    assert reasons == {
        0: "unexpected response type", 1: "unexpected response type",
        2: "response did not contain data", 3: "error: [1]",
        5: "observation data has an invalid structure", 7: "response did not contain data"}
    assert sorted(r.i for r in good.collect()) == [4, 6]


def test_envelope_rows(spark, tmp_path):
    records = [{"countryiso3code": "IND", "date": "2001", "value": 1.5},
               {"countryiso3code": "IND", "date": "x", "value": 2},
               {"countryiso3code": "XXX", "date": "2001", "value": 3},
               {"countryiso3code": "USA", "date": "2002", "value": None},
               {"countryiso3code": "USA", "date": None, "value": 1},
               {"countryiso3code": "PAK", "date": "2003", "value": "text"}]
    (tmp_path / "FP.CPI.TOTL.ZG.json").write_text(json.dumps([{"page": 1}, records]))
    (tmp_path / "NE.TRD.GNFS.ZS.json").write_text('[{"message": "no"}]')
    good, bad = read_envelopes(spark, str(tmp_path), reshape.countries_table(spark))
    assert rows(good.select("country", "year", "indicator", "value"), "country") == [
        ("India", 2001, "inflation", 1.5), ("Pakistan", 2003, "inflation", None),
        ("United States", 2002, "inflation", None)]
    assert [r.indicator for r in bad.collect()] == ["trade_gdp"]
    assert explode_envelopes(good.select(
        "indicator_code", "indicator", F.lit(None).cast("string").alias("records")),
        reshape.countries_table(spark)).count() == 0


def test_documents_need_a_path_and_sound_json(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_documents(spark, str(tmp_path / "none"), "a int")
    gone = snapshot_status(spark, str(tmp_path / "none"), "a int").first()
    assert gone.snapshot_available is False and "none" in gone.detail
    path = write_documents(values(spark, "string", "x", None), str(tmp_path / "docs"))
    assert snapshot_status(spark, path, "i int, v string").first()[:] == (True, 2, None)
    assert rows(read_documents(spark, path, "i int, v string"), "i") == [(0, "x"), (1, None)]
    (tmp_path / "bad.json").write_text('{"i": 1')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_documents(spark, str(tmp_path / "bad.json"), "i int").collect()


def long_rows(spark):
    return spark.createDataFrame(
        [("IND", "India", 2000, "gdp_growth", None, 0), ("IND", "India", 2000, "gdp_growth", 3.0, 1),
         ("IND", "India", 2000, "gdp_growth", 2.0, 2), ("USA", "United States", 2025, "inflation", 4.0, 0)],
        "country_code string, country string, year int, indicator string, value double, ord int")


def test_panel_is_complete_and_takes_the_first_value(spark):
    panel = reshape.country_year_panel(long_rows(spark), reshape.countries_table(spark), order="ord")
    assert panel.count() == 156
    assert panel.columns == ["country_code", "country", "year", *fixed.PANEL_INDICATORS.values()]
    assert panel.where("country_code = 'IND' AND year = 2000").first().gdp_growth == 3.0
    report = reshape.coverage_report(panel, ["country_code", "country"],
                                     list(fixed.PANEL_INDICATORS.values()))
    assert report.count() == 60
    assert report.agg(F.sum("valid_values"), F.sum("missing_values")).first()[:] == (2, 1558)
    last = reshape.sort_coverage(report).collect()[-1]
    assert (last.country_code, last.indicator) == ("USA", "inflation")
    assert last.coverage_percentage == pytest.approx(100 / 26)


def test_long_to_wide_equals_chained_outer_joins(spark):
    obs = spark.createDataFrame(
        [("a", "CPI", day("2000-01-01"), 1.0), ("a", "GDP", day("2000-01-01"), 2.0),
         ("a", "VIX", day("2000-01-05"), 3.0)], "entity string, series string, date date, value double")
    wide = reshape.series_to_wide(obs, ["entity"], series=["CPI", "GDP", "VIX"])
    parts = [obs.where(F.col("series") == s).select("entity", "date", F.col("value").alias(s))
             for s in ("CPI", "GDP", "VIX")]
    assert rows(wide, "date") == rows(reshape.outer_merge(parts, ["entity", "date"]), "date")


def numbers(spark):
    data = [(float(i), float(i * i % 7), None if i % 3 else float(-i), 4.0) for i in range(30)]
    return spark.createDataFrame(data, "a double, b double, c double, d double")


def test_profile_matches_pandas(spark):
    pdf = numbers(spark).toPandas()
    for r in profile.profile_columns(numbers(spark)).collect():
        s = pdf[r.feature]
        assert (r.missing_count, r.unique_values) == (s.isna().sum(), s.nunique())
        assert (r.variance, r.mean, r.minimum, r.maximum) == pytest.approx(
            (s.var(), s.mean(), s.min(), s.max()))
    constant = profile.constant_columns(profile.profile_columns(numbers(spark))).collect()
    assert [r.feature for r in constant] == ["d"]


def test_correlations_match_pandas(spark):
    expected = numbers(spark).toPandas().corr()
    found = {(r.feature_1, r.feature_2): r.correlation
             for r in profile.correlations(numbers(spark), list("abcd")).collect()}
    assert len(found) == 6
    for (x, y), r in found.items():
        assert r is None if "d" in (x, y) else r == pytest.approx(expected.loc[x, y])
    high = profile.high_correlations(numbers(spark), list("abcd"), 0.9).collect()
    assert [(r.feature_1, r.feature_2) for r in high] == [("a", "c")]


def test_correlations_do_not_depend_on_the_number_of_columns(spark):
    df = spark.createDataFrame(
        [(1e9 + i * 1e-3, float(i % 7), float("nan") if i == 3 else i * 0.5) for i in range(50)],
        "a double, b double, c double")
    many = df.select("*", *[F.col("b").alias(f"x{i}") for i in range(47)])

    def found(frame, cols):
        return {(r.feature_1, r.feature_2): r.correlation for r in profile.correlations(frame, cols).collect()}
    few, all_ = found(df, list("abc")), found(many, many.columns)
    assert len(all_) == 50 * 49 // 2
    assert {k: all_[k] for k in few} == few
    expected = df.toPandas().corr()
    assert few["b", "c"] == pytest.approx(expected.loc["b", "c"])
    assert set(found(df.limit(0), list("abc")).values()) == {None}


def test_audit(spark):
    audit = profile.feature_audit(numbers(spark).withColumn("RAW_ECON_STRESS", F.lit(1.0)))
    assert audit["feature_count"] == 4 and audit["high_correlations"].count() == 1
    assert audit["feature_summary"].first().feature == "c"


def test_catalogue_and_labels(spark):
    known = {r.column: (r.series_id, r.rule) for r in series_catalogue(spark).collect()}
    assert set(known) == set(fixed.SERIES) and known["TREASURY"] == ("DGS10", "mean")
    df = spark.createDataFrame([(0, day("2026-07-01"), 1.5), (1, None, -0.5)], "i int, d date, p double")
    assert got(df, fn.day_label(F.col("d"))) == ["Jul 1, 2026", "Unavailable"]
    assert got(df, fn.month_label(F.col("d"))) == ["Jul 2026", ""]
    assert got(df, fn.gauge_percent(F.col("p"))) == [100.0, 0.0]
