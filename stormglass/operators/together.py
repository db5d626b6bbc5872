"""Fits of many training sets and settings from shared scans.

Walk-forward training sets are nested: each adds a block of rows to the one before. `TrainingSets` says for every row
in which set it appears first, so one scan serves all sets. Tasks reduce their rows to sums of a
size that depends on columns, sets and settings alone; these are added in rounds of fixed fan-in before the driver
sees them. From such sums come

* exact medians, means and deviations of every set (`scalers`),
* co-moments of each block, added up for each set, which give correlations and least squares (`co_moments`),
* gradients and curvatures of every penalised logistic fit (`fit_logistic_all`), solved by proximal Newton steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import literal_table
from .ranking import prefix_sum

FAN_IN, ROWS_AT_ONCE, CUTS = 64, 8_192, 512


def task_sums(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of `work`, which turns rows x columns (missing: NaN) into `size` numbers."""
    names = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                total += work(np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1))
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    numbers = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(names)])
    return add_up(numbers.mapInArrow(scan, "v binary"), size)


def add_up(found: DataFrame, size: int, parts: int | None = None) -> np.ndarray:
    """The sum of rows of `size` doubles (column `v`, binary), added in rounds of fixed fan-in. parts: its partitions, if known."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    parts = parts or found.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        found = found.repartition(parts).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r.v) for r in found.collect()), np.zeros(size))


@dataclass(frozen=True)
class TrainingSets:
    """Nested training sets 0 .. count - 1 over written rows: `rows` has `_enters`, `_y` and the features."""

    rows: DataFrame
    cols: list[str]
    count: int


def _blocks(x: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that enter with each set."""
    for b in range(count):
        yield b, x[x[:, 0] == b]


def training_sets(rows: DataFrame, cols: Sequence[str], target: str, enters: Column | None = None, count: int = 1) -> TrainingSets:
    """enters: the first set that holds a row, null for rows of none; by default all rows are one set."""
    enters = F.lit(0) if enters is None else enters
    ready = rows.select(enters.cast("int").alias("_enters"), F.col(target).cast("double").alias("_y"),
                        *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    return TrainingSets(ready.where("_enters IS NOT NULL"), list(cols), count)


# --- medians, means and deviations -----------------------------------------------


def _cut_points(sets: TrainingSets) -> list[np.ndarray]:
    marks = [i / CUTS for i in range(1, CUTS)]
    at = sets.rows.agg(*[F.percentile_approx(c, marks, 4 * CUTS).alias(c) for c in sets.cols]).first()
    return [np.unique(np.array(at[c] or [], dtype=float)) for c in sets.cols]


def medians(sets: TrainingSets) -> list[dict[str, float]]:
    """The exact interpolated median of every column in every set; columns without a value are left out.

    Cut points of all rows split a column into ranges. One scan counts each block's values by range, so the
    range that holds a middle rank is known exactly, wherever the cut points lie; only the values of such ranges are
    shuffled and ranked.
    """
    cuts, width, count = _cut_points(sets), CUTS + 1, sets.count
    shape = (count, len(sets.cols), width)

    def work(x):
        out = np.zeros(shape)
        for b, part in _blocks(x, count):
            for j, at in enumerate(cuts):
                v = part[:, 2 + j]
                out[b, j] = np.bincount(np.searchsorted(at, v[~np.isnan(v)]), minlength=width)[:width]
        return out.ravel()

    upto = np.cumsum(task_sums(sets.rows, work, math.prod(shape)).reshape(shape), axis=0).astype(np.int64)
    wanted, ranges = [], set()
    for f in range(sets.count):
        for j, c in enumerate(sets.cols):
            before = np.concatenate([[0], np.cumsum(upto[f, j])])
            n = int(before[-1])
            for which, rank in enumerate(((n + 1) // 2, n // 2 + 1) if n else ()):
                bucket = int(np.searchsorted(before, rank)) - 1
                ranges.add((c, bucket, float(cuts[j][bucket - 1]) if bucket else -math.inf,
                            float(cuts[j][bucket]) if bucket < len(cuts[j]) else math.inf))
                wanted.append((c, bucket, f, which, rank - int(before[bucket])))
    if not wanted:
        return [{} for _ in range(sets.count)]
    spark = sets.rows.sparkSession
    places = literal_table(spark, sorted(ranges), "name string, bucket int, lo double, hi double")
    live = sorted({c for c, *_ in ranges})
    values = (sets.rows.select("_enters", *live).unpivot(["_enters"], live, "feature", "value").where("value IS NOT NULL")
              .join(places, (F.col("feature") == F.col("name")) & (F.col("value") > F.col("lo")) & (F.col("value") <= F.col("hi"))))
    blocks = [f"n{b}" for b in range(sets.count)]
    counted = values.select("feature", "bucket", "value", *[(F.col("_enters") == b).cast("int").alias(n) for b, n in enumerate(blocks)])
    ranks = prefix_sum(counted, ["feature", "bucket"], "value", blocks, descending=False, bounds=[])

    def of_set(prefix):
        sums = [sum((F.col(f"{prefix}{n}") for n in blocks[:f + 1]), F.lit(0)) for f in range(sets.count)]
        return F.array(*sums)[F.col("set")]
    asked = literal_table(spark, wanted, "feature string, bucket int, set int, which int, rank bigint")
    found = (ranks.join(asked, ["feature", "bucket"])
             .where((of_set("cum_") >= F.col("rank")) & (of_set("cum_") - of_set("") < F.col("rank")))
             .select("feature", "set", "which", "value").collect())  # two rows for each column and set
    pairs: dict[tuple, list[float]] = {}
    for r in found:
        pairs.setdefault((r["set"], r["feature"]), []).append(r["value"])
    return [{c: sum(pairs[f, c]) / 2 for c in sets.cols if (f, c) in pairs} for f in range(sets.count)]


def scalers(sets: TrainingSets) -> list[tuple[dict[str, float], dict[str, float], dict[str, float]]]:
    """(medians, means, deviations) of the imputed columns of every set; a constant column has deviation 1."""
    middle = medians(sets)
    shift = np.array([[m.get(c, 0.0) for c in sets.cols] for m in middle])
    shape = (sets.count, 2 * len(sets.cols) + 1)

    def work(x):  # deviations from the set's own median: a constant column gives exact zeros
        out = np.zeros(shape)
        for f in range(len(shift)):
            z = np.nan_to_num(x[x[:, 0] <= f][:, 2:] - shift[f])
            out[f] = np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])
        return out.ravel()

    sums = task_sums(sets.rows, work, math.prod(shape)).reshape(shape)
    out = []
    for f, m in enumerate(middle):
        n, d = max(sums[f, 0], 1), len(sets.cols)
        first, second = sums[f, 1:1 + d] / n, sums[f, 1 + d:] / n
        mean, dev = shift[f] + first, np.sqrt(np.maximum(second - first ** 2, 0))
        at = {c: j for j, c in enumerate(sets.cols)}
        out.append((m, {c: float(mean[at[c]]) for c in m},
                    {c: float(dev[at[c]]) if dev[at[c]] > 1e-12 * abs(mean[at[c]]) else 1.0 for c in m}))
    return out


# --- co-moments ------------------------------------------------------------------


@dataclass(frozen=True)
class CoMoments:
    """Sums of a set of rows that give the covariances under any imputation: values are shifted, missing ones 0.

    The last column is the target, which is never missing in rows that are counted.
    """

    cols: list[str]
    shift: np.ndarray
    products: np.ndarray  # of two values
    sums: np.ndarray      # of value i where j is present
    present: np.ndarray   # rows with both

    def __add__(self, other: CoMoments) -> CoMoments:
        return CoMoments(self.cols, self.shift, self.products + other.products, self.sums + other.sums, self.present + other.present)

    def imputed(self, median: dict[str, float]) -> tuple[float, np.ndarray, np.ndarray]:
        """(rows, means, population covariances) of the columns of `median` and the target, after imputation."""
        keep = [j for j, c in enumerate(self.cols) if c in median]
        m = np.array([median[self.cols[j]] - self.shift[j] for j in keep] + [0.0])
        keep.append(len(self.cols))
        p, s, both = (a[np.ix_(keep, keep)] for a in (self.products, self.sums, self.present))
        n, own, has = self.present[-1, -1], np.diag(s), np.diag(both)
        lone = own[:, None] - s          # sums of value i where j is missing
        neither = n - has[:, None] - has[None, :] + both
        raw = p + lone * m[None, :] + lone.T * m[:, None] + neither * np.outer(m, m)
        mean = (own + (n - has) * m) / n
        cov = raw / n - np.outer(mean, mean)
        # What remains of a constant column after cancellation is rounding.
        flat = np.diag(cov) <= 1e-14 * np.maximum(np.diag(raw) / n, 1e-300)
        cov[flat, :] = cov[:, flat] = 0.0
        return n, mean + self.shift[keep], cov


def co_moments(sets: TrainingSets, shift: dict[str, float]) -> list[CoMoments]:
    """The co-moments of every set, from one scan: those of the blocks, added up."""
    d, count = len(sets.cols) + 1, sets.count
    base = np.array([shift.get(c, 0.0) for c in sets.cols] + [0.0])
    shape = (count, 3, d, d)

    def work(x):
        out = np.zeros(shape)
        for b, part in _blocks(x[~np.isnan(x[:, 1])], count):
            v = np.concatenate([part[:, 2:], part[:, 1:2]], axis=1) - base
            has = (~np.isnan(v)).astype(float)
            v = np.nan_to_num(v)
            out[b] = v.T @ v, v.T @ has, has.T @ has
        return out.ravel()

    upto = np.cumsum(task_sums(sets.rows, work, math.prod(shape)).reshape(shape), axis=0)
    return [CoMoments(sets.cols, base, *upto[f]) for f in range(sets.count)]


def correlations_with_target(moments: CoMoments, median: dict[str, float]) -> dict[str, float]:
    """Pearson r of every imputed column with the target; 0 where one of them is constant."""
    _, _, cov = moments.imputed(median)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((dev[:-1] > 0) & (dev[-1] > 0), cov[:-1, -1] / (dev[:-1] * dev[-1]), 0.0)
    return {c: float(r[j]) for j, c in enumerate(c for c in moments.cols if c in median)}


def least_squares(moments: CoMoments, median: dict[str, float], scale: dict[str, float]) -> tuple[dict[str, float], float]:
    """(weights of the scaled columns, intercept) by the normal equations; of dependent columns the shortest solution."""
    _, mean, cov = moments.imputed(median)
    names = [c for c in moments.cols if c in median]
    s = np.array([scale[c] for c in names])
    beta = np.linalg.lstsq(cov[:-1, :-1] / np.outer(s, s), cov[:-1, -1] / s, rcond=1e-11)[0] if names else np.zeros(0)
    return dict(zip(names, map(float, beta))), float(mean[-1])


# --- penalised logistic regression -----------------------------------------------


@dataclass(frozen=True)
class Setting:
    """A penalised fit on one training set: C * sum(weight * loss) + penalty, the intercept free.

    penalty = C-free sum of ratio * |b| + (1 - ratio) / 2 * b^2 over the named columns.
    """

    name: str
    set: int
    C: float = 1.0
    ratio: float = 0.0
    cols: tuple[str, ...] | None = None


@dataclass
class _Fit:
    use: list[int]
    l1: float
    l2: float
    beta: np.ndarray            # the trial point, intercept last
    last: np.ndarray | None = None
    value: float = math.inf
    residual: float = math.inf
    scans: int = 0
    done: bool = False

    def penalty(self, b: np.ndarray) -> float:
        return float(self.l1 * np.abs(b[:-1]).sum() + 0.5 * self.l2 * (b[:-1] ** 2).sum())


def optimality_residual(beta: np.ndarray, gradient: np.ndarray, l1: float, l2: float) -> float:
    """Distance from zero of the subgradient of smallest size; the last entry is the free intercept."""
    pull = gradient[:-1] + l2 * beta[:-1]
    rest = np.where(beta[:-1] != 0, np.abs(pull + l1 * np.sign(beta[:-1])), np.maximum(np.abs(pull) - l1, 0))
    return float(max([abs(gradient[-1]), *rest]))


def newton_point(beta: np.ndarray, gradient: np.ndarray, curve: np.ndarray, l1: float, l2: float,
                 sweeps: int = 2_000) -> np.ndarray:
    """The minimum of the quadratic model at beta plus the penalty."""
    d = len(beta)
    shrink = np.append(np.full(d - 1, l2), 0.0)
    if not l1:
        return beta - np.linalg.solve(curve + np.diag(shrink + 1e-14), gradient + shrink * beta)
    u, slack = beta.copy(), curve @ np.zeros(d)  # slack = curve @ (u - beta)
    for _ in range(sweeps):
        most = 0.0
        for j in range(d):
            h = curve[j, j] + shrink[j]
            if h <= 1e-14:
                continue
            at = curve[j, j] * u[j] - gradient[j] - slack[j]
            new = (math.copysign(max(abs(at) - l1, 0.0), at) if j < d - 1 else at) / h
            if new != u[j]:
                slack += curve[:, j] * (new - u[j])
                most = max(most, abs(new - u[j]))
                u[j] = new
        if most < 1e-13:
            break
    return u


def fit_logistic_all(sets: TrainingSets, settings: Sequence[Setting], scaled: Sequence[tuple], tol: float = 1e-8,
                     max_scans: int = 60) -> list[tuple[dict[str, float], float, float, int]]:
    """(weights, intercept, residual, scans) of every setting, all fitted side by side, one scan for each step.

    scaled: (medians, means, deviations) of each set. Classes weigh alike. A scan gives every open fit
    its loss, gradient and curvature; a fit whose loss grew goes back half-way, the others take a proximal Newton step. A fit
    is done when its residual, per unit of weight, is at most tol. Raises if one is not after max_scans.
    """
    d, count = len(sets.cols), sets.count

    def balance(x):
        return np.concatenate([[np.sum(part[:, 1] == 0), np.sum(part[:, 1] == 1)] for _, part in _blocks(x, count)])
    counts = np.cumsum(task_sums(sets.rows.select("_enters", "_y"), balance, 2 * sets.count).reshape(-1, 2), axis=0)
    used = sorted({s.set for s in settings})
    if any(counts[f].min() == 0 for f in used):
        raise ValueError("training needs both classes")
    at = {c: j for j, c in enumerate(sets.cols)}
    fits = []
    for s in settings:
        use = [at[c] for c in (s.cols or sets.cols) if c in scaled[s.set][0]]
        n = counts[s.set].sum()
        fits.append(_Fit(use, s.ratio / (s.C * n), (1 - s.ratio) / (s.C * n), np.zeros(len(use) + 1)))
    parts = {f: [np.array([scaled[f][k].get(c, v) for c in sets.cols]) for k, v in ((0, 0.0), (1, 0.0), (2, 1.0))] for f in used}
    weight = {f: counts[f].sum() / (2 * counts[f]) for f in used}

    for _ in range(max_scans):
        live = [i for i, fit in enumerate(fits) if not fit.done]
        if not live:
            break
        points = [(settings[i].set, np.array([*fits[i].use, d]), fits[i].beta) for i in live]
        sizes = [1 + len(use) + len(use) ** 2 for _, use, _ in points]

        def work(x, points=points):
            out, x = [], x[~np.isnan(x[:, 1])]
            ready = {}
            for f in {p[0] for p in points}:
                mine = x[x[:, 0] <= f]
                raw, (median, mean, dev) = mine[:, 2:], parts[f]
                z = (np.where(np.isnan(raw), median, raw) - mean) / dev
                ready[f] = np.concatenate([z, np.ones((len(z), 1))], axis=1), mine[:, 1], weight[f][mine[:, 1].astype(int)]
            for f, use, beta in points:
                z, y, w = ready[f]
                z = z[:, use]
                eta = z @ beta
                p = 0.5 * (1 + np.tanh(0.5 * eta))
                loss = np.sum(w * (np.logaddexp(0, eta) - y * eta))
                out += [[loss], (w * (p - y)) @ z, ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        sums, start = task_sums(sets.rows, work, sum(sizes)), 0
        for i, (f, use, _), size in zip(live, points, sizes):
            mine, fit, n, k = sums[start:start + size] / counts[f].sum(), fits[i], counts[f].sum(), len(use)
            start, fit.scans = start + size, fit.scans + 1
            value = mine[0] + fit.penalty(fit.beta)
            if fit.last is not None and value > fit.value + 1e-12 * abs(fit.value) + 1e-15:
                fit.beta = (fit.beta + fit.last) / 2
                continue
            gradient, curve = mine[1:1 + k], mine[1 + k:].reshape(k, k)
            fit.residual = optimality_residual(fit.beta, gradient, fit.l1, fit.l2)
            fit.done = fit.residual <= tol
            if not fit.done:
                fit.last, fit.value = fit.beta, value
                fit.beta = newton_point(fit.beta, gradient, curve, fit.l1, fit.l2)
    still = [s.name for s, fit in zip(settings, fits) if not fit.done]
    if still:
        raise RuntimeError(f"no optimum within {max_scans} scans: {', '.join(sorted(set(still)))}")
    return [({sets.cols[j]: float(b) for j, b in zip(fit.use, fit.beta)}, float(fit.beta[-1]), fit.residual, fit.scans) for fit in fits]


def residual_table(spark: SparkSession, settings: Sequence[Setting], fitted: Sequence[tuple]) -> DataFrame:
    """One row for each fit: model, set, weights that are not zero, residual and scans."""
    rows = [(s.name, s.set, sum(abs(b) > 1e-8 for b in beta.values()), residual, scans)
            for s, (beta, _, residual, scans) in zip(settings, fitted)]
    return literal_table(spark, rows, "model string, training_set int, retained_features int, residual double, scans int")
