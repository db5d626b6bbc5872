"""Benchmarks, walk-forward validation, comparisons and the final fit.

Folds are partition filters on one materialised table of model inputs. Imputation and
scaling depend on the fold only; those of all folds come from shared scans, as do all linear
and logistic fits (see `together`). The test rows of a fold are scanned once for all models.
Fits on small data run side by side from a few driver threads; on large data every fit
fills the cluster by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..storage import literal_table, materialise
from . import evaluate, models, together
from .folds import Fold, assign_test_folds, chronological_split, fold_summary, walk_forward_folds
from .reshape import union_all
from .timeseries import persistence_forecast

BASELINE = "Majority-Class Baseline"

REGULARISATION_GRID = tuple(
    (f"{label} C={c:.2f}", penalty, c, ratio)
    for label, penalty, ratio in (("L2", "l2", None), ("L1", "l1", None),
                                  ("Elastic Net", "elasticnet", 0.5))
    for c in (1.0, 0.3, 0.1))

CLASSIFIERS = {
    "Logistic Regression": models.fit_logistic,
    "Random Forest": models.fit_forest,
}
BOOSTED = {**CLASSIFIERS, "Boosted Trees": models.fit_boosted}


def side_by_side(spark, work: Callable, items: Sequence, threads: int = 8) -> list:
    """Run independent driver calls concurrently, keeping their order."""
    if threads == 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(min(threads, max(1, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


@dataclass(frozen=True)
class FoldedData:
    """Model inputs with `pos` and their test `fold` (0: never tested), and a scaler per fold."""

    rows: DataFrame
    cols: list[str]
    keys: list[str]
    order: str
    target: str
    folds: list[Fold]
    scalers: dict[int, models.Scaler]
    threads: int

    def train(self, f: Fold) -> DataFrame:
        return train_rows(self.rows, f)

    def test(self, f: Fold) -> DataFrame:
        return self.rows.where(F.col("fold") == f.fold)

    def tested(self) -> DataFrame:
        return self.rows.where(F.col("fold").isin([f.fold for f in self.folds]))


def train_rows(rows: DataFrame, f: Fold) -> DataFrame:
    """Everything before the test block, less a gap. The fold prunes whole partitions."""
    return rows.where((F.col("fold") < f.fold) & (F.col("pos") <= f.train_end))


def prepare_folds(df: DataFrame, keys: Sequence[str], order: str = "date", k: int = 5,
                  unit: str = "date", gap: int = 0, target: str = fixed.TARGET,
                  cols: Sequence[str] | None = None, threads: int = 8) -> FoldedData:
    """Write the labelled inputs once, number them, and drop folds that hold one class.

    threads: fits that are submitted side by side; each is a distributed job.
    """
    labelled, found = models.model_inputs(df, keys, target)
    cols = list(cols or found)
    need = list(dict.fromkeys([*keys, order, target, *cols, "ECON_STRESS"]))
    placed, folds = walk_forward_folds(labelled.select(*need), order, k, unit, list(keys), gap)
    rows = materialise(assign_test_folds(placed, folds, keep_rest=True), "folds", ["fold"])
    if target == fixed.TARGET:
        counts = rows.agg(*[
            F.count_distinct(F.when(F.col("pos") <= f.train_end, F.col(target)))
            for f in folds]).first()
        folds = [f for f, classes in zip(folds, counts) if classes == 2]
    if not folds:
        raise ValueError("no fold has both classes in its training rows")
    scalers = [models.Scaler(*found) for found in together.scalers(_training_sets(rows, folds, cols, target))]
    return FoldedData(rows, cols, list(keys), order, target, folds,
                      {f.fold: s for f, s in zip(folds, scalers)}, threads)


def _training_sets(rows: DataFrame, folds: Sequence[Fold], cols: Sequence[str], target: str) -> together.TrainingSets:
    """The nested training sets of the folds; a row enters with the first fold that trains on it."""
    enters = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(folds))):
        enters = F.when(F.col("pos") <= f.train_end, i).otherwise(enters)
    return together.training_sets(rows, cols, target, enters, len(folds))


def fold_training_sets(data: FoldedData) -> together.TrainingSets:
    return _training_sets(data.rows, data.folds, data.cols, data.target)


def out_of_fold(data: FoldedData, fits: Mapping[str, Callable],
                cols: Mapping[str, Sequence[str]] | None = None,
                score: str = "probability") -> tuple[DataFrame, dict]:
    """Fit every model on every fold; (model, fold, keys, date, actual, score) of test rows.

    Also returns the fitted models by (model, fold).
    """
    use = {name: (cols or {}).get(name, data.cols) for name in fits}
    fitted, alone = {}, dict(fits)
    for kind, solve in models.TOGETHER.items():
        parts = {n: fit.keywords if isinstance(fit, partial) else {} for n, fit in fits.items()
                 if (fit.func if isinstance(fit, partial) else fit) is kind}
        if parts:
            found = solve(fold_training_sets(data), [data.scalers[f.fold] for f in data.folds], list(parts.values()), [use[n] for n in parts])
            fitted |= {(n, f.fold): m for n, row in zip(parts, found) for f, m in zip(data.folds, row)}
            alone = {n: fit for n, fit in alone.items() if n not in parts}
    jobs = [(name, f) for f in data.folds for name in alone]

    def run(job):
        name, f = job
        return alone[name](data.train(f), use[name], target=data.target,
                           scaler=data.scalers[f.fold].narrow(use[name]))
    spark = data.rows.sparkSession
    fitted |= dict(zip([(n, f.fold) for n, f in jobs],
                       side_by_side(spark, run, jobs, data.threads)))
    parts = [score_all(data.test(f), {n: fitted[n, f.fold] for n in fits}, score).select(
        "model", "fold", *data.keys, data.order, F.col(data.target).alias("actual"), score)
        for f in data.folds]
    return materialise(union_all(parts), "scored"), fitted


def score_all(rows: DataFrame, fitted: Mapping[str, object], score: str) -> DataFrame:
    """One row per row and model, with the scores of all models taken in one scan."""
    names = list(fitted)
    for i, name in enumerate(names):
        rows = fitted[name].score(rows, f"_score{i}")
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_score{i}").alias(score))
                              for i, n in enumerate(names)]))
    return rows.select("*", each).drop(*[f"_score{i}" for i in range(len(names))])


def fold_metrics(scored: DataFrame, data: FoldedData, threshold: float) -> DataFrame:
    """Metrics per model and fold with the dates and positives of the fold."""
    metrics = evaluate.classification_metrics(scored, ["model", "fold"], threshold)
    facts = fold_summary(data.rows, data.folds, data.order, data.target)
    return metrics.join(facts, "fold")


def walk_forward(df: DataFrame, keys: Sequence[str], fits: Mapping[str, Callable] = CLASSIFIERS,
                 threshold: float = 0.5, order: str = "date", k: int = 5, unit: str = "date",
                 gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """(per-fold metrics, mean over folds per model, best average precision first)."""
    data = prepare_folds(df, keys, order, k, unit, gap)
    scored, _ = out_of_fold(data, fits)
    folds = fold_metrics(scored, data, threshold)
    summary = evaluate.summarise_folds(folds, ["model"])
    return folds, summary.orderBy(F.desc("average_pr_auc"), F.desc("average_f1"), "model")


def tune_threshold(df: DataFrame, keys: Sequence[str], order: str = "date", k: int = 5,
                   unit: str = "date", thresholds: Sequence[float] = fixed.THRESHOLDS,
                   fit: Callable = models.fit_logistic) -> tuple[DataFrame, float, DataFrame]:
    """(sweep, best threshold, pooled out-of-fold scores) of the logistic model, or of another fit."""
    data = prepare_folds(df, keys, order, k, unit)
    scored, _ = out_of_fold(data, {"Logistic Regression": fit})
    sweep = evaluate.threshold_sweep(scored, thresholds)
    best = evaluate.best_threshold(sweep).first()["threshold"]
    return sweep.orderBy(F.desc("f1"), "threshold"), best, scored


def compare_feature_sets(df: DataFrame, keys: Sequence[str],
                         sets: Mapping[str, Sequence[str]] | None = None,
                         threshold: float = fixed.ALERT_THRESHOLD, order: str = "date",
                         k: int = 5, unit: str = "date",
                         fit: Callable = models.fit_logistic) -> tuple[DataFrame, DataFrame]:
    """Logistic model (or another fit) on the full and the curated feature set over identical folds."""
    if sets is None:
        _, full = models.model_inputs(df, keys)
        sets = {f"Full {len(full)}-Feature Model": full,
                "Curated Feature Model": list(fixed.CURATED_FEATURES)}
    missing = {c for cols in sets.values() for c in cols} - set(df.columns)
    if missing:
        raise ValueError(f"The following features are missing: {', '.join(sorted(missing))}")
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    data = prepare_folds(df, keys, order, k, unit, cols=every)
    scored, _ = out_of_fold(data, dict.fromkeys(sets, fit), sets)
    folds = fold_metrics(scored, data, threshold)
    summary = evaluate.summarise_folds(folds, ["model"])
    return folds, summary.orderBy(F.desc("average_pr_auc"), F.desc("average_f1"), "model")


def fold_period(data: FoldedData, k: int, start: str = "position") -> tuple:
    """First and last date over which false alarms are counted.

    'position' starts at position n // (k + 1), counted from 0, which need not be the first
    test row; 'first_test' starts at the first test row.
    """
    n = data.rows.agg(F.max("pos")).first()[0]
    first = n // (k + 1) + 1 if start == "position" else data.folds[0].test_start
    return data.rows.agg(F.min(F.when(F.col("pos") == first, F.col(data.order))),
                         F.max(data.order)).first()[:]


def compare_regularisation(df: DataFrame, keys: Sequence[str], grid=REGULARISATION_GRID,
                           threshold: float = fixed.ALERT_THRESHOLD, order: str = "date",
                           k: int = 5, unit: str = "date",
                           alarm_start: str = "position") -> tuple[DataFrame, DataFrame]:
    """Nine penalties over identical folds, with retained features and false alarms a year."""
    data = prepare_folds(df, keys, order, k, unit)
    fits = {name: partial(models.fit_logistic, penalty=p, C=c, l1_ratio=r)
            for name, p, c, r in grid}
    scored, fitted = out_of_fold(data, fits)
    kept = literal_table(
        df.sparkSession, [(n, f, models.nonzero_coefficients(m)) for (n, f), m in fitted.items()],
        "model string, fold int, retained_features int")
    folds = fold_metrics(scored, data, threshold).join(kept, ["model", "fold"])
    summary = evaluate.summarise_folds(
        folds, ["model"], ("precision", "recall", "f1", "pr_auc", "roc_auc", "retained_features"))
    dates = fold_period(data, k, alarm_start)
    summary = evaluate.false_alarms_per_year(summary, *[F.lit(d) for d in dates])
    return folds, summary.orderBy(F.desc("average_pr_auc"), F.desc("average_f1"),
                                  "total_false_positives", "model")


def benchmark(df: DataFrame, keys: Sequence[str], order: str = "date", frac: float = 0.8,
              unit: str = "date", threshold: float = 0.5,
              fits: Mapping[str, Callable] | None = None) -> tuple[DataFrame, str, object]:
    """(comparison by F1, best model other than the baseline, that model) on an 80/20 split."""
    fits = fits or {BASELINE: models.fit_majority,
                    "Logistic Regression": models.fit_logistic,
                    "Random Forest Classifier": models.fit_forest}
    labelled, cols = models.model_inputs(df, keys)
    rows = materialise(chronological_split(
        labelled.select(*keys, order, fixed.TARGET, *cols), order, frac, unit, list(keys)), "split")
    train, test = rows.where("is_train"), rows.where("not is_train")
    scaler = models.fit_scaler(train, cols)
    fitted = {n: fit(train, cols, target=fixed.TARGET, scaler=scaler) for n, fit in fits.items()}
    scored = score_all(test, fitted, "probability").select(
        "model", F.col(fixed.TARGET).alias("actual"), "probability")
    table = evaluate.classification_metrics(materialise(scored, "scored"), ["model"], threshold)
    best = evaluate.best_row(table.where(F.col("model") != BASELINE),
                             [F.desc("f1"), F.asc("model")]).first()["model"]
    return table.orderBy(F.desc("f1"), "model"), best, fitted[best]


def benchmark_regression(df: DataFrame, keys: Sequence[str], order: str = "date",
                         frac: float = 0.8, unit: str = "date",
                         trees: int = 500) -> tuple[DataFrame, str]:
    """(comparison by RMSE, best fitted model) for the index level at the horizon."""
    labelled, cols = models.model_inputs(df, keys, fixed.LEVEL_TARGET)
    rows = materialise(chronological_split(
        labelled.select(*keys, order, fixed.LEVEL_TARGET, *cols), order, frac, unit, list(keys)),
        "split")
    train, test = rows.where("is_train"), rows.where("not is_train")
    scaler = models.fit_scaler(train, cols)
    macro = [c for c in cols if c != "ECON_STRESS"]
    narrow = scaler.narrow(macro)
    forest = partial(models.fit_forest_regressor, trees=trees)
    fitted = {
        "Random Forest + Current Stress": forest(train, cols, scaler=scaler),
        "Random Forest - Macro Only": forest(train, macro, scaler=narrow),
        "Linear Regression": models.fit_linear(train, macro, scaler=narrow),
    }
    parts = [persistence_forecast(test).withColumn("model", F.lit("Persistence Baseline")),
             score_all(test, fitted, "prediction")]
    scored = union_all([p.select("model", F.col(fixed.LEVEL_TARGET).alias("actual"), "prediction")
                        for p in parts])
    table = evaluate.regression_metrics(materialise(scored, "scored"), ["model"])
    best = evaluate.best_row(table.where(F.col("model") != "Persistence Baseline"),
                             [F.asc("rmse"), F.asc("model")]).first()["model"]
    return table.orderBy("rmse", "model"), best


def walk_forward_regression(df: DataFrame, keys: Sequence[str], order: str = "date", k: int = 5,
                            unit: str = "date", trees: int = 500) -> tuple[DataFrame, DataFrame]:
    """(per-fold RMSE against persistence, mean improvement and folds won)."""
    data = prepare_folds(df, keys, order, k, unit, target=fixed.LEVEL_TARGET)
    scored, _ = out_of_fold(data, {"model": partial(models.fit_forest_regressor, trees=trees)},
                            score="prediction")
    rows = persistence_forecast(data.tested()).select(
        F.lit("persistence").alias("model"), "fold", F.col(data.target).alias("actual"),
        "prediction")
    both = rows.unionByName(scored.select(*rows.columns))
    table = evaluate.regression_metrics(both, ["fold", "model"])
    folds = table.groupBy("fold").agg(
        *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}")
          for m in ("model", "persistence") for c in ("mae", "rmse", "r2")])
    gain = F.try_divide(F.col("persistence_rmse") - F.col("model_rmse"),
                        F.col("persistence_rmse")) * 100
    folds = folds.withColumn("rmse_improvement_percent", gain)
    summary = folds.agg(
        F.count("*").alias("folds"), F.avg("model_rmse").alias("average_model_rmse"),
        F.avg("persistence_rmse").alias("average_persistence_rmse"),
        F.avg("rmse_improvement_percent").alias("average_improvement_percent"),
        F.count_if(F.col("model_rmse") < F.col("persistence_rmse")).alias("folds_won"))
    return folds, summary


def train_final(df: DataFrame, keys: Sequence[str], threshold: float, order: str = "date",
                name: str = "Logistic Regression", fit: Callable = models.fit_logistic
                ) -> tuple[models.LogisticModel, DataFrame]:
    """(model on all labelled rows, its one-row metadata)."""
    labelled, cols = models.model_inputs(df, keys)
    rows = materialise(labelled.select(*keys, order, fixed.TARGET, *cols), "training")
    model = fit(rows, cols)
    metadata = rows.agg(
        F.count("*").alias("training_rows"),
        F.count_if(F.col(fixed.TARGET) == 1).alias("positive_training_cases"),
        F.count_if(F.col(fixed.TARGET) == 0).alias("negative_training_cases"),
        F.min(order).alias("training_start"), F.max(order).alias("training_end"))
    return model, metadata.select(
        F.lit(name).alias("model_name"), F.lit(fixed.TARGET).alias("target"),
        F.lit(fixed.HORIZON_MONTHS).alias("forecast_horizon_months"),
        F.lit(float(threshold)).alias("warning_threshold"),
        "training_rows", "positive_training_cases", "negative_training_cases", "training_start",
        "training_end",
        F.lit(len(model.scaler.features)).alias("feature_count"),
        F.array(*[F.lit(c) for c in model.scaler.features]).alias("feature_names"),
        F.current_timestamp().alias("created_at_utc"))
