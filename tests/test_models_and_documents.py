import json
import math
import random

import pytest
from helpers import day, month, rows
from pyspark.sql import functions as F

from stormglass import fixed
from stormglass.operators import documents, explain, models, validation
from stormglass.operators.timeseries import latest_rows
from stormglass.sources import load_model, save_model

T = fixed.TARGET


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    out = []
    for i in range(40):
        for e in ("a", "b", "c", "d", "e"):
            x, z = r.gauss(0, 1), r.gauss(5, 2)
            noise = r.gauss(0, 1)
            y = None if i >= 37 else int(1.5 * x - 0.5 * (z - 5) + noise > 0.8)
            out.append((e, month(i), x, None if i % 9 == 0 else z, r.random(), 4.0, None, 50 + 5 * x, y,
                        None if y is None else 50 + 5 * x + noise))
    df = spark.createDataFrame(out, f"entity string, date date, x double, z double, n double, flat double, "
                                    f"empty double, ECON_STRESS double, {T} int, TARGET_STRESS_3M double")
    return df.cache()


COLS = ["x", "z", "n", "flat", "empty"]


def labelled(data):
    return data.where(F.col(T).isNotNull())


def test_scaler_imputes_then_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (4.0, None), (None, 2.0)],
                               "a double, b double")
    s = models.fit_scaler(df, ["a", "b"])
    assert s.median == {"a": 2.5, "b": 2.0} and s.mean == {"a": 2.5, "b": 2.0}
    assert s.scale["a"] == pytest.approx(1.0) and s.scale["b"] == 1.0
    got = [r[0] for r in df.select(s.scaled("a")).collect()]
    assert got == pytest.approx([-1.5, -0.5, 0.5, 1.5, 0.0])


def test_inputs_leave_out_targets_labels_and_keys(data):
    rows_, cols = models.model_inputs(data, ["entity"])
    assert cols == ["x", "z", "n", "flat", "empty", "ECON_STRESS"] and rows_.count() == 185


@pytest.mark.parametrize("C", [1.0, 0.1])
def test_logistic_fit_is_at_the_optimum(data, C):
    df = labelled(data)
    model = models.fit_logistic(df, COLS, C=C, tol=1e-10)
    assert "empty" not in model.beta and model.beta["flat"] == pytest.approx(0, abs=1e-9)
    assert models.log_loss_gradient(df, model, T, C) < 1e-5


def test_strong_l1_drops_features(data):
    df = labelled(data)
    weak, strong = (models.fit_logistic(df, COLS, C=c, penalty="l1") for c in (1.0, 0.02))
    assert models.nonzero_coefficients(strong) < models.nonzero_coefficients(weak) <= 3
    mixed = models.fit_logistic(df, COLS, C=0.1, penalty="elasticnet", l1_ratio=0.5)
    assert abs(mixed.beta["x"]) < abs(weak.beta["x"])


def test_one_class_is_refused(data):
    with pytest.raises(ValueError, match="both classes"):
        models.fit_logistic(data.where(F.col(T) == 1), COLS)


def test_saved_model_scores_alike(spark, data, tmp_path):
    model, metadata = validation.train_final(data.select("entity", "date", T, *COLS), ["entity"], 0.35)
    loaded, meta = load_model(spark, save_model(model, metadata, str(tmp_path / "m")))
    p = [rows(m.score(data).select("entity", "date", "probability"), "entity", "date")
         for m in (model, loaded)]
    assert p[0] == p[1]
    m = meta.first()
    assert (m.training_rows, m.feature_count, m.training_end) == (185, 4, str(month(36)))
    assert m.positive_training_cases + m.negative_training_cases == 185
    assert m.feature_names == ["x", "z", "n", "flat"]


def test_latest_row_without_a_feature_uses_the_median(data):
    model = models.fit_logistic(labelled(data), COLS)
    last = latest_rows(data, ["entity"])
    got = models.score_latest(last.drop("z"), model, ["entity"])
    same = models.score_latest(last.withColumn("z", F.lit(model.scaler.median["z"])), model, ["entity"])
    assert rows(got, "entity") == rows(same, "entity")
    r = got.first()
    assert r.observation_date == month(39) and r.forecast_horizon_months == 3
    assert r.warning_active == (r.risk_probability >= 0.35)


def test_trees_baseline_and_regression(spark, data):
    df = labelled(data)
    forest = models.fit_forest(df, COLS, trees=20)
    boosted = models.fit_boosted(df, COLS, rounds=5)
    for m in (forest, boosted):
        p = [r.probability for r in m.score(df).select("probability").collect()]
        assert 0 <= min(p) < max(p) <= 1
    assert forest.importance(spark, 2).first().feature == "x"
    assert models.fit_majority(df).label in (0, 1)
    even = spark.createDataFrame([(0,), (1,)], f"{T} int")
    assert models.fit_majority(even).label == 0
    line = models.fit_linear(df, ["x", "z"])
    errors = line.score(df).select(F.avg(F.col("prediction") - F.col("TARGET_STRESS_3M"))).first()[0]
    assert errors == pytest.approx(0, abs=1e-6)
    tree = models.fit_forest_regressor(df, ["x", "z"], trees=10).score(df, "prediction")
    assert tree.agg(F.corr("prediction", "TARGET_STRESS_3M")).first()[0] > 0.9


FAST = {"Logistic Regression": models.fit_logistic,
        "Random Forest": lambda df, cols, **kw: models.fit_forest(df, cols, trees=5, **kw),
        "Boosted Trees": lambda df, cols, **kw: models.fit_boosted(df, cols, rounds=3, **kw)}


def test_walk_forward(data):
    per_fold, summary = validation.walk_forward(data.drop("empty", "TARGET_STRESS_3M"), ["entity"], FAST)
    got = per_fold.collect()
    assert len(got) == 15 and {r.test_rows for r in got} == {30}
    for r in got:
        assert r.true_positives + r.false_positives + r.false_negatives + r.true_negatives == 30
        assert r.true_positives + r.false_negatives == r.positive_cases
    assert {r.model for r in summary.collect()} == set(FAST)


def test_folds_with_one_class_are_skipped(spark):
    df = spark.createDataFrame([("a", month(i), float(i), float(i), int(i > 20 and i % 2)) for i in range(36)],
                               f"entity string, date date, x double, ECON_STRESS double, {T} int")
    data = validation.prepare_folds(df, ["entity"])
    assert [f.fold for f in data.folds] == [4, 5]


def test_threshold_tuning_and_comparisons(data):
    df = data.drop("empty", "TARGET_STRESS_3M")
    sweep, best, scored = validation.tune_threshold(df, ["entity"])
    assert best in fixed.THRESHOLDS and sweep.count() == 11 and scored.count() == 150
    assert sweep.first().threshold == best
    _, sets = validation.compare_feature_sets(df, ["entity"], {"all": ["x", "z", "n"], "few": ["n"]})
    assert sets.first().model == "all"
    with pytest.raises(ValueError, match="missing"):
        validation.compare_feature_sets(df, ["entity"], {"bad": ["nope"]})
    grid = [g for g in validation.REGULARISATION_GRID if g[2] == 1.0]
    folds_, summary = validation.compare_regularisation(df, ["entity"], grid)
    assert folds_.count() == 15
    r = summary.first()
    years = (month(36) - month(37 // 6)).days / 365.25
    assert r.false_alarms_per_year == pytest.approx(r.total_false_positives / years)
    assert len(validation.REGULARISATION_GRID) == 9


def test_benchmarks(data):
    fits = {validation.BASELINE: models.fit_majority, "Logistic Regression": models.fit_logistic}
    table, best, model = validation.benchmark(data.drop("empty", "TARGET_STRESS_3M"), ["entity"], fits=fits)
    assert best == "Logistic Regression" and table.count() == 2 and model.beta
    df = data.drop("empty", T)
    table, best = validation.benchmark_regression(df, ["entity"], trees=5)
    assert table.count() == 4 and best != "Persistence Baseline"
    folds_, summary = validation.walk_forward_regression(df, ["entity"], trees=5)
    assert folds_.count() == 5 and summary.first().folds == 5


def test_attribution_adds_up_to_the_difference_in_log_odds(spark, data):
    model = models.fit_logistic(labelled(data), COLS)
    feats = model.scaler.features
    attr = explain.attribution(data, model.coefficients(spark), feats, ["entity"], n=20)
    total = {r.entity: r.t for r in attr.groupBy("entity").agg(F.sum("shap_value").alias("t")).collect()}
    odds = data.withColumn("odds", model.log_odds())
    for e, t in total.items():
        o = [r.odds for r in odds.where(F.col("entity") == e).orderBy("date").collect()]
        assert t == pytest.approx(o[-1] - sum(o[-21:-1]) / 20)


def test_driver_tables_and_nested_lists_agree(spark, data):
    model = models.fit_logistic(labelled(data), COLS)
    attr = explain.attribution(data, model.coefficients(spark), model.scaler.features, ["entity"])
    attr = explain.with_groups(attr, explain.groups_table(spark, {"G": ["x", "z"]}))
    assert {r.group for r in attr.collect()} == {"G", fixed.OTHER_GROUP}
    flat = explain.driver_tables(attr, ["entity"], top=2)
    nested = explain.explanation_arrays(attr, ["entity"], top=2).collect()
    for name, table in flat.items():
        key = "group" if name.startswith("grouped") else "feature"
        for doc in nested:
            listed = [r[key] for r in table.where(F.col("entity") == doc.entity).orderBy("rank").collect()]
            assert [r[key] for r in doc[name]] == listed


def test_risk_document(spark, data):
    df = data.drop("empty", "TARGET_STRESS_3M")
    model = models.fit_logistic(labelled(df), ["x", "z", "n", "flat"])
    per_fold, _ = validation.walk_forward(df, ["entity"], {"L": models.fit_logistic}, 0.35)
    assessment = models.score_latest(latest_rows(df, ["entity"]), model, ["entity"])
    attr = explain.with_groups(explain.attribution(
        df, model.coefficients(spark), model.scaler.features, ["entity"]), explain.groups_table(spark))
    lists = explain.explanation_arrays(attr, ["entity"])
    when = F.when(F.col("entity") == "b", F.lit(day("2000-01-01"))).otherwise(F.lit(month(39)))
    lists = lists.withColumn("observation_date", when).where("entity <> 'c'")
    docs, rejected = documents.risk_document(assessment, lists, per_fold, ["entity"], 4)
    assert dict(rows(rejected, "entity")) == {
        "b": f"dates do not match: {month(39)} versus 2000-01-01",
        "c": "explanation has no observation date"}
    doc = json.loads(docs.orderBy("entity").select(F.to_json(F.struct("*"))).first()[0])
    assert doc["assessment"]["observation_date"] == str(month(39))
    assert doc["assessment"]["risk_probability_percent"] == pytest.approx(
        doc["assessment"]["risk_probability"] * 100, abs=0.051)
    assert len(doc["limitations"]) == 4 and doc["model"]["feature_count"] == 4
    means = per_fold.agg(F.avg("recall")).first()[0]
    assert doc["model"]["validation"]["average_recall"] == pytest.approx(means)
    views = documents.result_views(["entity"], risk=docs, prefix="t_")
    assert spark.table("t_explanation").count() == 3 and set(views) >= {"health", "model", "assessment"}


def test_history_document(spark):
    df = spark.createDataFrame(
        [("a", month(0), 1.0, 1, "x"), ("a", month(1), 9.0, 1, "x"), ("a", month(2), None, 0, "None"),
         ("a", month(3), 9.0, 0, "None"), ("b", month(0), 2.0, 0, "None")],
        "entity string, date date, ECON_STRESS double, CRISIS int, CRISIS_NAME string")
    a, b = documents.history_document(df, ["entity"]).orderBy("entity").collect()
    assert (a.summary.latest_stress, a.summary.peak_stress_date) == (9.0, str(month(1)))
    assert a.metadata.observation_count == 3 and len(a.series) == 3
    assert [tuple(p) for p in a.crisis_periods] == [("x", str(month(0)), str(month(1)))]
    assert b.crisis_periods == [] and b.series[0].crisis_name == "None"
    clear = documents.history_document(df, ["entity"], null_name=True).where("entity = 'b'").first()
    assert clear.series[0].crisis_name is None and clear.series[0].vix is None
    with pytest.raises(ValueError):
        documents.history_document(df.drop("ECON_STRESS"), ["entity"])
    assert math.isclose(a.summary.average_stress, 19 / 3)
