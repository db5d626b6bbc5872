import random
import statistics

import pytest
from helpers import month, rows
from pyspark.sql import functions as F

from stormglass.operators import evaluate, folds, ranking


def brute(pairs):
    pos = [p for a, p in pairs if a]
    neg = [p for a, p in pairs if not a]
    auc = None
    if pos and neg:
        auc = sum((x > y) + (x == y) / 2 for x in pos for y in neg) / (len(pos) * len(neg))
    ap = seen = hits = 0
    for s in sorted({p for _, p in pairs}, reverse=True):
        here = [a for a, p in pairs if p == s]
        seen, hits = seen + len(here), hits + sum(here)
        ap += sum(here) / len(pos) * hits / seen if pos else 0
    return auc, ap


def scored(spark, pairs, name="m"):
    return spark.createDataFrame([(name, int(a), float(p)) for a, p in pairs],
                                 "model string, actual int, probability double")


@pytest.mark.parametrize("bounds", [None, [0.3], [0.1, 0.11, 0.5, 0.9]])
def test_ranking_metrics_match_brute_force(spark, bounds):
    r = random.Random(1)
    sets = {"ties": [(r.random() < 0.3, round(r.random(), 1)) for _ in range(200)],
            "fine": [(r.random() < 0.3, r.random()) for _ in range(200)],
            "hot": [(r.random() < 0.5, 0.3) for _ in range(150)] + [(1, 0.9), (0, 0.1)],
            "no positives": [(0, 0.1), (0, 0.5)], "no negatives": [(1, 0.1), (1, 0.5)]}
    df = None
    for name, pairs in sets.items():
        part = scored(spark, pairs, name)
        df = part if df is None else df.unionByName(part)
    got = {x.model: (x.roc_auc, x.pr_auc)
           for x in ranking.ranking_metrics(df, ["model"], bounds=bounds).collect()}
    for name, pairs in sets.items():
        auc, ap = brute(pairs)
        assert got[name][1] == pytest.approx(ap)
        assert got[name][0] is None if auc is None else got[name][0] == pytest.approx(auc)


def test_step_sum_is_not_the_interpolated_area(spark):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.4)]
    assert ranking.average_precision(scored(spark, pairs)).first()[0] == pytest.approx(brute(pairs)[1])


def test_bounds_split_large_inputs_only(spark):
    df = spark.range(10_000).select((F.col("id") / 10_000).alias("s"))
    assert len(ranking.score_bounds(df, "s")) == 1
    found = ranking.score_bounds(df, "s", rows_per_bucket=1_000)
    assert len(found) == 9 and found == sorted(found)


def test_prefix_sum_is_the_same_in_any_ranges(spark):
    df = spark.range(2_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500 / 1.0).alias("s"),
                                   F.lit(1).alias("n"))
    whole = rows(ranking.prefix_sum(df, ["g"], "s", ["n"], bounds=[]), "g", "s")
    cut = ranking.prefix_sum(df, ["g"], "s", ["n"], bounds=[10.0, 11.0, 250.0]).select("g", "s", "n", "cum_n")
    assert rows(cut, "g", "s") == whole


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_medians_by_ranking_are_exact(spark, n):
    r = random.Random(n)
    data = [(r.gauss(0, 1), float(r.randint(0, 3)), None if i % 2 else r.random(), None, 7.0)
            for i in range(n)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    got = ranking.exact_medians(df, list("abcde"))
    assert got == df.agg(*[F.median(c).alias(c) for c in "abcde"]).first().asDict()
    for i, c in enumerate("abcde"):
        known = [x[i] for x in data if x[i] is not None]
        assert got[c] == (pytest.approx(statistics.median(known)) if known else None)


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"))
    monkeypatch.setattr(ranking, "_brackets", lambda d, cols: {"a": (95.0, 96.0)})
    assert ranking.exact_medians(df, ["a"]) == {"a": 50.0}


def test_counts_and_rates(spark):
    df = scored(spark, [(1, 0.35), (1, 0.3), (0, 0.9), (0, 0.1), (0, 0.2)])
    r = evaluate.classification_metrics(df).first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.true_negatives) == (1, 1, 1, 2)
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((0.6, 0.5, 0.5, 0.5))
    none = evaluate.classification_metrics(df, threshold=2.0, ranking=False).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_sweep_equals_single_thresholds_and_ties_take_the_lowest(spark):
    r = random.Random(5)
    df = scored(spark, [(r.random() < 0.4, round(r.random(), 2)) for _ in range(300)])
    for s in evaluate.threshold_sweep(df).collect():
        one = evaluate.confusion(df, threshold=s.threshold).first()
        assert [s[c] for c in evaluate.COUNTS] == list(one)
        assert sum(one) == 300
    tied = scored(spark, [(1, 0.9), (0, 0.1)])
    assert evaluate.best_threshold(evaluate.threshold_sweep(tied)).first().threshold == 0.2


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (9.0, None)],
                               "actual double, prediction double")
    r = evaluate.regression_metrics(df).first()
    assert (r.rows, r.mae, r.rmse, r.r2) == pytest.approx((3, 2 / 3, (2 / 3) ** 0.5, 1 - 2 / 8))


def test_fold_means_skip_a_missing_auc(spark):
    df = spark.createDataFrame(
        [("m", 0.5, 0.5, 0.5, 0.5, None, 1, 2, 3), ("m", 1.0, 1.0, 1.0, 1.0, 0.8, 1, 2, 3)],
        "model string, precision double, recall double, f1 double, pr_auc double, roc_auc double, "
        "true_positives int, false_positives int, false_negatives int")
    r = evaluate.summarise_folds(df, ["model"]).first()
    assert (r.average_precision, r.average_roc_auc, r.total_false_positives) == (0.75, 0.8, 4)


def test_fold_bounds():
    found = folds.fold_bounds(401)
    assert [f.test_start - 1 for f in found] == [71, 137, 203, 269, 335]
    assert {f.test_end - f.test_start + 1 for f in found} == {66} and found[-1].test_end == 401
    assert [f.train_end for f in found] == [71, 137, 203, 269, 335]
    assert [f.train_end for f in folds.fold_bounds(401, gap=3)] == [68, 134, 200, 266, 332]
    with pytest.raises(ValueError):
        folds.fold_bounds(5)


def panel(spark, entities=7, months=12):
    return spark.createDataFrame([(f"e{e}", month(m), (e + m) % 2)
                                  for e in range(entities) for m in range(months)],
                                 "entity string, date date, y int")


def test_row_positions_are_a_permutation_in_date_order(spark):
    got = folds.ordinal(panel(spark), "date", ["entity"]).collect()
    assert sorted(r.pos for r in got) == list(range(1, 85))
    dates = [r.date for r in sorted(got, key=lambda r: r.pos)]
    assert dates == sorted(dates)
    mixed = folds.ordinal(panel(spark).orderBy(F.rand(1)).repartition(6), "date", ["entity"], digits=1)
    assert {(r.entity, r.date, r.pos) for r in mixed.collect()} == {(r.entity, r.date, r.pos) for r in got}


def test_date_positions_keep_a_date_together(spark):
    got = folds.ordinal(panel(spark), "date", unit="date")
    assert got.groupBy("date").agg(F.count_distinct("pos").alias("n")).where("n > 1").count() == 0
    placed, bounds = folds.walk_forward_folds(panel(spark), unit="date")
    test = folds.assign_test_folds(placed, bounds)
    assert test.count() == 5 * 2 * 7
    facts = folds.fold_summary(placed, bounds, target="y").orderBy("fold").collect()
    assert [f.train_rows for f in facts] == [14, 28, 42, 56, 70]
    assert [f.test_start for f in facts] == [month(i) for i in (2, 4, 6, 8, 10)]


def test_split_takes_the_floor(spark):
    got = folds.chronological_split(panel(spark, 1, 11), tie=["entity"])
    assert got.where("is_train").count() == 8
    last = got.where("is_train").agg(F.max("date")).first()[0]
    assert last < got.where("not is_train").agg(F.min("date")).first()[0]


def test_ranking_metrics_hold_billions_of_rows(spark):
    df = spark.createDataFrame([(1, 0.9, 4_000_000_000), (0, 0.9, 1_000_000_000), (1, 0.2, 1_000_000_000),
                                (0, 0.2, 4_000_000_000), (1, None, 7)], "actual int, probability double, n long")
    r = ranking.ranking_metrics(df, times="n").first()
    assert r.roc_auc == pytest.approx(0.8) and r.pr_auc == pytest.approx(0.8 * 0.8 + 0.2 * 0.5)


def test_rows_without_score_or_date_count_nowhere(spark):
    from stormglass.operators import evaluate

    df = spark.createDataFrame([(1, None), (0, None), (0, .4), (1, .6)], "actual int, probability double")
    swept = evaluate.threshold_sweep(df, [0.5]).first()
    plain = evaluate.confusion(df, threshold=0.5).first()
    assert [swept[c] for c in evaluate.COUNTS] == [plain[c] for c in evaluate.COUNTS] == [1, 0, 0, 1]
    dated = spark.createDataFrame([(i, None if i < 4 else f"2020-01-{i + 1:02d}") for i in range(20)],
                                  "k int, date string").withColumn("date", F.to_date("date"))
    placed = folds.ordinal(dated, "date", ["k"])
    assert sorted(r.pos for r in placed.collect()) == list(range(1, 17))
    assert folds.count_positions(dated, "date") == 16
