"""Boosted trees with leaf penalties, against sums done by hand and a plain fit on collected rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.operators import boosting, models, together
from stormglass.operators.boosting import Boosting


def test_one_split_by_hand(spark):
    # x <= 2: two of eight positive, x > 2: six of eight. Classes are even, so p = 0.5, g = +-0.5, h = 0.25.
    rows = spark.createDataFrame([(float(x), int(i < k)) for x, k in ((1, 1), (2, 1), (3, 3), (4, 3)) for i in range(4)], "x double, y int")
    one = dict(rounds=1, rate=0.5, depth=1, least=1.0, share=1.0)

    def weights(**kw):
        tree = models.fit_boosted(rows, ["x"], "y", **one, **kw).trees.trees[0]
        return tree.value.tolist()
    # Left side: G = 6 * 0.5 - 2 * 0.5 = 2, H = 8 * 0.25 = 2.
    assert weights(l1=0.0, l2=0.0) == pytest.approx([-0.5 * 2 / 2, 0.5 * 2 / 2])
    assert weights(l1=0.0, l2=2.0) == pytest.approx([-0.5 * 2 / 4, 0.5 * 2 / 4])
    assert weights(l1=0.5, l2=2.0) == pytest.approx([-0.5 * 1.5 / 4, 0.5 * 1.5 / 4])
    assert weights(l1=3.0, l2=2.0) == [0, 0]
    assert models.fit_boosted(rows, ["x"], "y", **one | {"least": 2.5}).trees.trees[0].upto[0] == boosting.RANGES
    model = models.fit_boosted(rows, ["x"], "y", **one, l1=0.5, l2=2.0)
    got = {r.x: r.probability for r in model.score(rows).collect()}
    assert got[1.0] == got[2.0] == pytest.approx(1 / (1 + math.exp(0.1875))) and got[3.0] == got[4.0] == pytest.approx(1 - got[1.0])


def plain(part, cols, cuts, s):
    """The same rounds without sharing of rows or columns, by recursion over nodes."""
    x, y = part[cols].fillna(part[cols].median()).to_numpy(), part.y.to_numpy(float)
    w, margin = np.where(y > 0, (y == 0).sum() / y.sum(), 1.0), np.zeros(len(y))

    def worth(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    def grow(rows, depth, g, h):
        G, H, best = g[rows].sum(), h[rows].sum(), (1e-12, None)
        if depth:
            for j in range(len(cols)):
                for c in cuts[j]:
                    side = rows[x[rows, j] <= c]
                    gl, hl = g[side].sum(), h[side].sum()
                    gain = worth(gl, hl) + worth(G - gl, H - hl) - worth(G, H)
                    if hl >= s.least and H - hl >= s.least and gain > best[0] + 1e-9:
                        best = gain, (j, c)
        if best[1] is None:
            margin[rows] -= s.rate * np.sign(G) * max(abs(G) - s.l1, 0) / (H + s.l2)
            return
        j, c = best[1]
        grow(rows[x[rows, j] <= c], depth - 1, g, h)
        grow(rows[x[rows, j] > c], depth - 1, g, h)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), s.depth, w * (p - y), w * p * (1 - p))
    return 1 / (1 + np.exp(-margin))


def test_all_sets_equal_plain_fits(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    r, data = random.Random(4), []
    for i in range(300):
        a, b = r.gauss(0, 1), r.gauss(5, 2)
        data.append((i, i // 100, a, None if i % 9 == 0 else b, float(i % 3), 7.0, int(a * b > r.gauss(1, 2))))
    rows = spark.createDataFrame(data, "i int, block int, a double, b double, c double, flat double, y int").repartition(4).cache()
    cols, s = ["a", "b", "c", "flat"], Boosting(rounds=5, rate=0.3, share=1.0)
    sets = together.training_sets(rows, cols, "y", F.when(F.col("block") < 2, F.col("block")), 2)
    scalers = [models.Scaler(*found) for found in together.scalers(sets)]
    ((first,), (second,)) = zip(*models._all_boosted(sets, scalers, [vars(s)], [cols]))
    part = rows.toPandas().sort_values("i")
    for k, model in enumerate((first, second)):
        mine = part[part.block <= k]
        got = {row.i: row.probability for row in model.score(rows.where(F.col("block") <= k)).collect()}
        assert [got[i] for i in mine.i] == pytest.approx(plain(mine, cols, model.trees.cuts, s).tolist(), abs=1e-9)


def test_shares_one_class_and_no_rows(spark):
    rows = spark.range(200).select((F.col("id") % 50).cast("double").alias("x"), F.lit(None).cast("double").alias("none"),
                                   (F.col("id") % 2).cast("int").alias("y"))
    half = [boosting._drawn(np.arange(4000, dtype=np.uint64), t, 0.8) for t in (0, 1)]
    assert 3050 < half[0].sum() < 3350 and (half[0] != half[1]).any()
    for df in (rows.where("y = 1"), rows.where("y = 5")):
        model = models.fit_boosted(df, ["x", "none"], "y", rounds=2, scaler=models.Scaler({"x": 1.0}, {"x": 0.0}, {"x": 1.0}))
        assert {row.probability for row in model.score(rows).collect()} == {0.5}
