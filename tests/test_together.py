"""Fits that share scans, against plain computations on collected rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.operators import models, together, validation

COLS = ["a", "b", "c", "flat", "late"]


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(8)
    out = []
    for i in range(600):
        a, b = r.gauss(1e6, 3), r.gauss(0, 1)
        y = int(0.4 * (a - 1e6) - b + r.gauss(0, 1) > 0.5)
        out.append((i // 100, a, None if i % 7 == 0 else b, float(r.randrange(4)), 5.0, None if i < 250 else r.random(), y))
    rows = spark.createDataFrame(out, "block int, a double, b double, c double, flat double, late double, y int").repartition(5).cache()
    enters = F.when(F.col("block") < 5, F.col("block"))  # block 5 is in no training set
    return together.training_sets(rows, COLS, "y", enters, 5), rows.toPandas()


def imputed(part, f, cols):
    x = part[part.block <= f][cols]
    return x.fillna(x.median()), part[part.block <= f]["y"]


def test_scalers_of_all_sets_in_shared_scans(frame):
    sets, part = frame
    for f, (median, mean, dev) in enumerate(together.scalers(sets)):
        x = part[part.block <= f][COLS]
        assert ("late" in median) == x.late.notna().any()
        for c in median:
            full = x[c].fillna(x[c].median())
            assert median[c] == x[c].median() and mean[c] == pytest.approx(full.mean(), rel=1e-12)
            assert dev[c] == pytest.approx(full.std(ddof=0) or 1.0, rel=1e-9)


def test_medians_where_cut_points_are_useless(spark):
    rows = spark.createDataFrame([(0, v, 0) for v in [0.0] * 900 + [1e-9 * i for i in range(1, 1_001)]], "e int, a double, y int")
    sets = together.training_sets(rows, ["a"], "y", F.col("e"), 1)
    assert together.medians(sets)[0]["a"] == pytest.approx(50.5e-9)
    none = together.training_sets(rows.withColumn("a", F.lit(None).cast("double")), ["a"], "y")
    assert together.medians(none) == [{}]


def test_co_moments_add_up_under_any_imputation(frame):
    sets, part = frame
    scaled = together.scalers(sets)
    for f, moments in enumerate(together.co_moments(sets, scaled[-1][0])):
        median = scaled[f][0]
        x, y = imputed(part, f, list(median))
        both = np.concatenate([x.to_numpy(), y.to_numpy()[:, None]], axis=1)
        n, mean, cov = moments.imputed(median)
        assert n == len(x) and np.allclose(mean, both.mean(axis=0)) and np.allclose(cov, np.cov(both.T, ddof=0), atol=1e-6)
        beta, intercept = together.least_squares(moments, median, scaled[f][2])
        z = (x - x.mean()) / [scaled[f][2][c] for c in x]
        want = np.linalg.lstsq(np.c_[z, np.ones(len(z))], y, rcond=1e-9)[0]
        assert intercept == pytest.approx(want[-1]) and np.allclose([beta[c] for c in x], want[:-1], atol=1e-6)


def test_45_fits_are_at_their_optima_in_a_few_scans(frame):
    sets, part = frame
    scaled = together.scalers(sets)
    settings = [together.Setting(name, f, c, {"l2": 0.0, "l1": 1.0}.get(p, r))
                for name, p, c, r in validation.REGULARISATION_GRID for f in range(5)]
    fitted = together.fit_logistic_all(sets, settings, scaled)
    assert len(fitted) == 45 and max(scans for *_, scans in fitted) <= 15
    for s, (beta, intercept, residual, _) in zip(settings, fitted):
        x, y = imputed(part, s.set, list(beta))
        z, y = ((x - x.mean()) / [scaled[s.set][2][c] for c in x]).to_numpy(), y.to_numpy()
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        b = np.array(list(beta.values()))
        pull = weight * (1 / (1 + np.exp(-(z @ b + intercept))) - y)
        gradient = np.append(pull @ z, pull.sum()) / len(y)
        n = s.C * len(y)
        assert residual < 1e-6
        assert together.optimality_residual(np.append(b, intercept), gradient, s.ratio / n, (1 - s.ratio) / n) < 1e-6


def test_penalties_act(frame):
    sets, _ = frame
    scaled = together.scalers(sets)
    strong, weak = (together.fit_logistic_all(sets, [together.Setting("x", 4, c, 1.0)], scaled)[0][0] for c in (0.005, 1.0))
    assert sum(map(abs, strong.values())) < sum(map(abs, weak.values())) and 0.0 in strong.values()
    (short,) = together.fit_logistic_all(sets, [together.Setting("x", 4, cols=("a", "flat"))], scaled)
    assert set(short[0]) == {"a", "flat"} and short[0]["flat"] == 0
    with pytest.raises(RuntimeError, match="no optimum"):
        together.fit_logistic_all(sets, [together.Setting("x", 4)], scaled, max_scans=1)


def test_out_of_fold_models_equal_single_fits(spark):
    r = random.Random(5)
    rows = [(f"e{j}", i, r.gauss(0, 1), None if i % 5 == 0 else r.random(), int(r.random() < 0.4)) for i in range(60) for j in range(4)]
    df = spark.createDataFrame(rows, "entity string, i int, x double, z double, TARGET_RISK_RISING_3M int").selectExpr(
        "entity", "add_months(date'2000-01-01', i) AS date", "x", "z", "x AS ECON_STRESS", "TARGET_RISK_RISING_3M")
    data = validation.prepare_folds(df, ["entity"], cols=["x", "z"])
    _, fitted = validation.out_of_fold(data, {"L": models.fit_logistic, "S": models.fit_scorecard}, {"S": ["z"]})
    for f in data.folds[::4]:
        alone = models.fit_logistic(data.train(f), ["x", "z"])
        both = fitted["L", f.fold]
        assert alone.scaler == both.scaler and math.isclose(alone.intercept, both.intercept, abs_tol=1e-6)
        assert all(math.isclose(alone.beta[c], both.beta[c], abs_tol=1e-6) for c in alone.beta)
        assert list(fitted["S", f.fold].beta) == ["z"]
