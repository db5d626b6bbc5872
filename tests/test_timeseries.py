import math
import statistics

import pytest
from helpers import column, day, month, rows
from pyspark.sql import functions as F

from stormglass import fixed
from stormglass.operators import index, timeseries as ts


def series(spark, values, entity="a"):
    return spark.createDataFrame([(entity, month(i), v) for i, v in enumerate(values)],
                                 "entity string, date date, x double")


def apply(df, build):
    return column(df.withColumn("y", build(F.col("x"), ts.by_time(["entity"]))), "y")


def test_rolling_mean_needs_n_values_that_are_not_null(spark):
    df = series(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0])
    assert apply(df, lambda c, w: ts.rolling_mean(c, w, 3)) == [None, None, 2.0, None, None, None, 6.0]


def test_rolling_std_is_the_sample_deviation(spark):
    got = apply(series(spark, [1.0, 2.0, 4.0, 8.0]), lambda c, w: ts.rolling_std(c, w, 3))
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx(statistics.stdev([1, 2, 4]))
    assert got[3] == pytest.approx(statistics.stdev([2, 4, 8]))


def test_percent_change_and_zero_base(spark):
    got = apply(series(spark, [0.0, 4.0, 5.0]), lambda c, w: ts.pct_change(c, w, 1))
    assert got == [None, None, 25.0]


def test_expanding_score_counts_valid_values_not_rows(spark):
    values = [None, None] + [float(i * i) for i in range(24)]
    got = apply(series(spark, values), ts.expanding_zscore)
    assert got[:-1] == [None] * 25
    known = values[2:]
    assert got[-1] == pytest.approx((known[-1] - statistics.mean(known)) / statistics.stdev(known))


def test_expanding_score_of_a_constant_is_null(spark):
    assert apply(series(spark, [3.0] * 26), ts.expanding_zscore) == [None] * 26


def test_fill_leaves_leading_nulls_and_respects_age(spark):
    df = series(spark, [None, 1.0, None, None, None, 2.0, None])
    assert apply(df, lambda c, w: ts.filled(c, w)) == [None, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0]
    assert apply(df, lambda c, w: ts.filled(c, w, "date", 2)) == [None, 1.0, 1.0, 1.0, None, 2.0, 2.0]


def test_window_without_keys_is_refused():
    with pytest.raises(ValueError):
        ts.by_time([])


def test_month_takes_last_known_value_and_mean(spark):
    obs = spark.createDataFrame(
        [("a", day("2000-01-03"), 1.0, 1.0), ("a", day("2000-01-20"), None, 3.0),
         ("a", day("2000-02-01"), 5.0, None)], "entity string, date date, x double, y double")
    got = rows(ts.resample_month(obs, ["entity"], "date", {"x": "last", "y": "mean"})
               .select("date", "x", "y"), "date")
    assert got == [(day("2000-01-01"), 1.0, 2.0), (day("2000-02-01"), 5.0, None)]


def monthly_x(spark, first, keep=False):
    obs = spark.createDataFrame(
        [("a", day(first), 1.0), ("a", day("2000-02-10"), 2.0), ("a", day("2000-05-01"), 5.0)],
        "entity string, date date, x double")
    return rows(ts.to_monthly(obs, ["entity"], "date", {"x": "last"}, keep).select("date", "x"), "date")


def test_partial_first_month_is_dropped_and_gaps_are_carried(spark):
    rest = [(day("2000-02-01"), 2.0), (day("2000-03-01"), 2.0), (day("2000-04-01"), 2.0),
            (day("2000-05-01"), 5.0)]
    assert monthly_x(spark, "2000-01-02") == rest
    assert monthly_x(spark, "2000-01-02", keep=True) == [(day("2000-01-01"), 1.0)] + rest
    assert monthly_x(spark, "2000-01-01") == [(day("2000-01-01"), 1.0)] + rest


def table(spark, n=60, entities=("a", "b")):
    out = []
    for k, e in enumerate(entities):
        for i in range(n):
            wave = math.sin(i * 0.7 + k)
            out.append((e, month(i), 5 + wave, 6 - wave * 0.3 + i * 0.01, 100 + i + wave,
                        1000 + 3 * i + 5 * wave, 4 + wave * 0.2, 20 + 7 * wave))
    return spark.createDataFrame(
        out, "entity string, date date, " + ", ".join(f"{c} double" for c in fixed.SERIES))


def full(df):
    return index.stress_index(ts.create_features(df, ["entity"]), ["entity"])


def test_all_feature_columns_exist_once(spark):
    got = full(table(spark))
    assert set(fixed.ALL_FEATURES) <= set(got.columns)
    assert len(got.columns) == len(set(got.columns)) == 2 + 42 + 1
    assert len(fixed.ALL_FEATURES) == 42 and len(set(fixed.ALL_FEATURES)) == 42


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="VIX"):
        ts.create_features(table(spark).drop("VIX"), ["entity"])


def test_index_starts_after_a_year_and_the_24th_valid_value(spark):
    first = column(full(table(spark)).where("entity = 'a' AND ECON_STRESS IS NOT NULL"), "date")[0]
    assert first == month(12 + 23)


def test_trend_columns_miss_as_many_leading_values_as_their_frames(spark):
    known = full(table(spark)).where("entity = 'a' AND ECON_STRESS IS NOT NULL")
    trends = ["STRESS_CHANGE_1M", "STRESS_3M_AVG", "STRESS_GAP_3M", "STRESS_ACCELERATION",
              "STRESS_CHANGE_3M", "STRESS_VOLATILITY_6M"]
    got = known.agg(*[F.count_if(F.col(c).isNull()) for c in trends]).first()
    assert list(got) == [1, 2, 2, 2, 3, 5]


def test_future_rows_never_change_past_values(spark):
    long, short = full(table(spark, 60)), full(table(spark, 50))
    cut = long.where(F.col("date") < F.lit(month(50)))
    assert rows(cut, "entity", "date") == rows(short, "entity", "date")


def test_input_order_and_other_entities_do_not_matter(spark):
    base = rows(full(table(spark)).where("entity = 'a'"), "date")
    mixed = table(spark, entities=("a", "b", "c")).orderBy(F.rand(3)).repartition(5)
    assert rows(full(mixed).where("entity = 'a'"), "date") == base


def test_index_is_null_as_soon_as_a_part_is(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0, 1.0)],
                               ", ".join(f"{c} double" for c in fixed.INDEX_WEIGHTS))
    got = [r[0] for r in df.select(index.weighted_index()).collect()]
    assert got[0] == pytest.approx(0.6) and got[1] is None
    mid = df.select(index.logistic_100(F.lit(0.0))).first()[0]
    assert mid == 50.0


def test_targets_are_null_at_the_end_and_five_points_count(spark):
    df = spark.createDataFrame(
        [("a", month(i), v, c) for i, (v, c) in enumerate(
            [(10.0, 0), (20.0, 0), (30.0, 1), (15.0, 1), (24.9, 0), (None, 0)])],
        "entity string, date date, ECON_STRESS double, CRISIS int")
    got = index.forward_targets(df, ["entity"])
    assert column(got, "TARGET_RISK_RISING_3M") == [1, 0, None, None, None, None]
    assert column(got, "TARGET_CRISIS_3M") == [1, 0, 0, None, None, None]
    assert column(index.training_set(got), "date") == [month(0), month(1)]
    s = index.target_summary(got).first()
    assert (s.valid_changes, s.rising, s.stable_or_falling) == (2, 1, 1)


def test_latest_background_and_preview(spark):
    df = series(spark, [float(i) for i in range(10)])
    assert rows(ts.latest_rows(df, ["entity"]), "date") == [("a", month(9), 9.0)]
    assert column(ts.background(df, ["entity"], n=3), "x") == [6.0, 7.0, 8.0]
    assert column(ts.preview(df, ["date"], 2, tail=True, need=["x"]), "x") == [8.0, 9.0]


def _customer_orders(spark):
    from pyspark.sql import functions as F
    return {"orders": spark.range(4000).select(
        "id", (F.col("id") % 100).alias("o_custkey"), F.expr("timestamp'1995-01-01' + make_interval(0, CAST(id % 61 AS INT))").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit("F").alias("o_orderstatus"), F.lit(10.0).alias("o_totalprice"))}


def test_customers_get_tasks_by_their_orders(spark, monkeypatch):
    """Small shuffles of orders must not be joined into one task that then holds all months."""
    from pyspark.sql import functions as F
    from stormglass.plans import chain, macro
    from stormglass.sources import tables
    monkeypatch.setattr(tables, "ORDERS_PER_TASK", 500, raising=False)
    t = _customer_orders(spark)
    for df in (chain.targets(spark, t, "o_custkey", 6), macro.aged_fill(spark, t), chain.wide(t, "o_custkey")):
        used = df.select("entity", F.spark_partition_id().alias("p")).distinct()
        assert used.groupBy("entity").count().filter("count > 1").count() == 0
        assert used.select("p").distinct().count() >= 6
