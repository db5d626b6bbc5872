"""Quality scores by positive-unlabelled learning with a non-negative risk estimate.

Trusted positives (labelled good) and unlabelled text (all training documents, whatever their labels) are
enough: with class prior p, log loss l and a linear function f, the risk of f is estimated as

    R = p * mean_P l(f) + max(0, r),   r = mean_U l(-f) - p * mean_P l(-f),

since r estimates the part of the risk that unseen negatives cause and can't truly be below zero. Where r >= 0, R is
convex and a Newton step needs sums over P and U only. A flexible f can fit the sample until r falls below zero, which is
overfitting; so steps are only taken as far as r stays at least zero.

1. *Features.* Every whole text is scanned once in blocks of at most a megabyte; what is counted is additive, so very
   long texts need no more memory. Shares and averages of the counts, no words and no ids, make one row of floats.
2. *Prior.* A plain classifier of P against U is fitted on one half of the training rows. On the other half, the
   share of U above a score, divided by that of P, bounds p from above for every score; the bound that is
   best with its sampling error is the estimate.
3. *Fit* as above, and *score* = 1 / (1 + exp(-f)).

Each step is one scan of the written features: tasks return sums of fixed size, which are added in rounds of
fixed fan-in, so what reaches the driver does not grow with the input. Nothing is sampled.

Defined cases: null and empty texts have all counts zero and a score like any other. A null id is never labelled and
is learned from (as no remainder is 1). Several labels of an id: positive only if all say so. Repeated rows count
each. Without a positive or without training rows every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T

FOLDS, HELD_OUT = 3, 1
PENALTY, STEPS, PRIOR_STEPS, TOLERANCE = 1e-3, 12, 6, 1e-5
REACHES = tuple(2.0 ** -k for k in range(12))
BINS, RANGE, CONFIDENCE = 2_000, 30.0, 0.1
FAN_IN, CLIP, WORD_BLOCK = 64, 6.0, 64

_KINDS = np.zeros(256, dtype=np.int64)  # groups of bytes that are counted
for _i, (_lo, _hi) in enumerate([(0x09, 0x0D), (0x20, 0x20), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC0, 0xFF)]):
    _KINDS[_lo:_hi + 1] = _i + 1
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
for _i, _c in enumerate(_MARKS):
    _KINDS[_c] = 8 + _i
N_KINDS = 8 + len(_MARKS)
_LETTER = (_KINDS == 4) | (_KINDS == 5) | (_KINDS >= 6) & (_KINDS <= 7)
_WORD_SUMS = ("words", "letters", "square", "capital", "shouted", "no_letter", "marked", "joined", "distinct", "again", "blocked",
              "blocks", "long", "lines", "line_words", "open_lines")
FEATURES = 2 + N_KINDS + 16


def _blocks(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of a slice, of at most `limit` bytes each; a longer text is cut, at white space if
    there is some in the last part."""
    if len(data) <= limit:
        yield 0, data, offsets
        return
    for row in range(len(offsets) - 1):  # one long text
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            stop = min(end, at + limit)
            if stop < end:
                blanks = np.flatnonzero(T.SPACE[data[stop - limit // 16:stop]])
                stop = stop - limit // 16 + int(blanks[-1]) + 1 if len(blanks) else stop
            yield row, data[at:stop], np.array([0, stop - at])
            at = stop


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Additive counts of each text: byte groups, and words."""
    n = len(offsets) - 1
    row = T.row_of(offsets)
    kinds = np.bincount(row * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(np.float64)
    out = np.zeros((n, len(_WORD_SUMS)))
    starts, ends, bounds = T.word_spans(data, offsets)
    if not len(starts):
        return kinds, out
    of = T.row_of(bounds)

    def add(name: str, values) -> None:
        out[:, _WORD_SUMS.index(name)] += np.bincount(of, weights=values, minlength=n)

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[starts]

    size = (ends - starts).astype(np.float64)
    kind = _KINDS[data]
    letters, upper, mark = inside(_LETTER[data]), inside(kind == 4), inside(kind >= 8)
    add("words", np.ones(len(starts)))
    add("letters", size)
    add("square", np.minimum(size, 64) ** 2)
    add("capital", kind[starts] == 4)
    add("shouted", (upper > 1) & (upper == letters))
    add("no_letter", letters == 0)
    add("marked", kind[ends - 1] >= 8)
    add("joined", mark > 1)
    add("long", size > 24)
    # Distinct words in blocks of words, so that the share does not fall with the length of a text.
    key = T.byte_spans(T.LOWER[data], starts, ends)
    place = np.arange(len(starts)) - bounds[of]
    block = of * (len(starts) + 1) + place // WORD_BLOCK
    order = np.lexsort((key, block))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (block[order][1:] != block[order][:-1])
    first = np.zeros(len(starts), dtype=bool)
    first[order] = new
    full = (place // WORD_BLOCK + 1) * WORD_BLOCK <= np.diff(bounds)[of]  # whole blocks, or a text of one
    full |= (np.diff(bounds)[of] < WORD_BLOCK)
    add("distinct", first & full)
    add("blocked", full)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    add("again", same)
    # Windows of four words that occurred before in the same part of a text.
    h, at = T.windows(key, bounds, 4)
    if len(h):
        order = np.lexsort((h, of[at]))
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] = (h[order][1:] == h[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
        out[:, _WORD_SUMS.index("blocks")] += np.bincount(of[at][order], weights=twice, minlength=n)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts]
    starts_line = np.ones(len(starts), dtype=bool)
    starts_line[1:] = (breaks[1:] != breaks[:-1]) | (of[1:] != of[:-1])
    add("lines", starts_line)
    ends_line = np.append(starts_line[1:], True)
    add("open_lines", ends_line & ~np.isin(data[ends - 1], np.frombuffer(b".!?:;\"'", dtype=np.uint8)))
    return kinds, out


def _features(kinds: np.ndarray, sums: np.ndarray) -> np.ndarray:
    c = dict(zip(_WORD_SUMS, sums.T))
    size, words = np.maximum(kinds.sum(axis=1), 1), np.maximum(c["words"], 1)
    blocked, lines = np.maximum(c["blocked"], 1), np.maximum(c["lines"], 1)
    root = np.sqrt  # small shares matter most
    mean = c["letters"] / words
    cols = [np.log1p(size), np.log1p(c["words"]), *root(kinds / size[:, None]).T, mean,
            root(np.maximum(c["square"] / words - mean ** 2, 0)), root(c["capital"] / words), root(c["shouted"] / words),
            root(c["no_letter"] / words), root(c["marked"] / words), root(c["joined"] / words), c["distinct"] / blocked,
            (c["distinct"] / blocked) ** 2, root(c["again"] / words), root(c["blocks"] / words), root(c["long"] / words),
            np.log1p(words / lines), root(c["open_lines"] / lines), np.log1p(c["words"]) ** 2, (c["words"] == 0).astype(float)]
    return np.stack(cols, axis=1).astype(np.float32)


def text_features(column: pa.Array, limit: int = T.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of slices of a column of texts."""
    for lo, hi, data, offsets in T.text_slices(column, limit):
        kinds, sums = np.zeros((hi - lo, N_KINDS)), np.zeros((hi - lo, len(_WORD_SUMS)))
        for row, part, at in _blocks(data, offsets, limit):
            k, s = _sums(part, at)
            kinds[row:row + len(k)] += k
            sums[row:row + len(s)] += s
        yield lo, hi, _features(kinds, sums)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, x in text_features(batch.column(1)):
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows.cast(pa.binary())], names=["doc_id", "x"])


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, x): the features of each text, as bytes of 32-bit floats."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, x binary")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id; a null id has 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


# --- sums over tasks -------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, FEATURES), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(len(column), FEATURES)


def _total(rows: DataFrame, task, size: int) -> np.ndarray:
    """The sum of task(columns) over all batches: vectors of `size`, added in rounds of FAN_IN.

    rows: x, positive and half; `task` gets a matrix and two masks.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                masks = [part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
                total += task(_matrix(part.column(0)), *masks)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    found = rows.select("x", "positive", "half").mapInArrow(scan, "v binary")
    parts = found.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        found = found.repartition(parts).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r.v) for r in found.collect()), np.zeros(size))


@dataclass(frozen=True)
class Scaling:
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features within a bound, and a one."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _scaling(rows: DataFrame) -> tuple[Scaling, np.ndarray]:
    """Mean and deviation of the features, and the numbers of rows: U, P, and both of half 1."""
    def task(x, positive, half):
        x = x.astype(np.float64)
        counts = [len(x), positive.sum(), half.sum(), (positive & half).sum()]
        return np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), counts])
    v = _total(rows, task, 2 * FEATURES + 4)
    n = max(v[2 * FEATURES], 1)
    mean = v[:FEATURES] / n
    dev = np.sqrt(np.maximum(v[FEATURES:2 * FEATURES] / n - mean ** 2, 0))
    return Scaling(mean, np.where(dev > 1e-9 * (1 + abs(mean)), dev, 1.0)), v[2 * FEATURES:]


def _log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _moments(rows: DataFrame, scaling: Scaling, w: np.ndarray, half: bool | None) -> dict[str, np.ndarray]:
    """Sums over U and P at w: numbers, gradient of l(-f) over U, inputs of P, and the curvature over U."""
    d = FEATURES + 1

    def task(x, positive, in_half):
        keep = np.ones(len(x), bool) if half is None else in_half == half
        z, p = scaling.inputs(x[keep]), positive[keep]
        s = _sigmoid(z @ w)
        curve = (z * (s * (1 - s))[:, None]).T @ z
        return np.concatenate([[len(z), p.sum()], s @ z, z[p].sum(axis=0), curve.ravel()])

    v = _total(rows, task, 2 + 2 * d + d * d)
    return {"n_u": v[0], "n_p": v[1], "push_u": v[2:2 + d], "sum_p": v[2 + d:2 + 2 * d], "curve_u": v[2 + 2 * d:].reshape(d, d)}


def risk(m: dict, prior: float) -> tuple[float, float]:
    """(risk of the positive part, r) from the sums of `_moments`."""
    return prior * m["p_plus"] / m["n_p"], m["u_minus"] / m["n_u"] - prior * m["p_minus"] / m["n_p"]


def _ahead(rows: DataFrame, scaling: Scaling, w: np.ndarray, step: np.ndarray, half: bool | None) -> list[dict]:
    """The losses at w + t * step for every t of REACHES, in one scan."""
    ends = np.stack([w + t * step for t in REACHES], axis=1)

    def task(x, positive, in_half):
        keep = np.ones(len(x), bool) if half is None else in_half == half
        f, p = scaling.inputs(x[keep]) @ ends, positive[keep]
        minus = _log_loss(-f)
        counts = np.tile([[len(f)], [p.sum()]], len(REACHES))
        return np.concatenate([counts, [minus.sum(axis=0), _log_loss(f[p]).sum(axis=0), minus[p].sum(axis=0)]]).ravel()

    v = _total(rows, task, 5 * len(REACHES)).reshape(5, len(REACHES))
    return [dict(zip(("n_u", "n_p", "u_minus", "p_plus", "p_minus"), c)) for c in v.T]


def fit(rows: DataFrame, scaling: Scaling, prior: float, steps: int = STEPS, half: bool | None = None
        ) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Weights of least risk with r >= 0, and (risk, r) of each step.

    A Newton step of the convex estimate gives the direction, a second scan the risk at several lengths of it. Of the
    lengths that keep r from falling below zero the one of least risk is taken, until the risk falls no further.
    half: only training rows of that half are used.
    """
    d = FEATURES + 1
    w, shrink, course, least = np.zeros(d), np.full(d, PENALTY), [], math.inf
    shrink[-1] = 0
    for _ in range(steps):
        m = _moments(rows, scaling, w, half)
        if not m["n_u"] or not m["n_p"]:
            return w, course
        push = m["push_u"] / m["n_u"] - prior * m["sum_p"] / m["n_p"] + shrink * w
        step = -np.linalg.solve(m["curve_u"] / m["n_u"] + np.diag(shrink + 1e-9), push)
        tried = []
        for t, at in zip(REACHES, _ahead(rows, scaling, w, step, half)):
            plus, r = risk(at, prior)
            end = w + t * step
            if r >= 0:
                tried.append((plus + r + 0.5 * (shrink * end * end).sum(), plus + r, r, t))
        if not tried or min(tried)[0] >= least - TOLERANCE:
            break
        least, value, r, t = min(tried)
        w = w + t * step
        course.append((float(value), float(r)))
    return w, course


def estimate_prior(rows: DataFrame, scaling: Scaling) -> float:
    """The class prior: the least bound of the share of U over the share of P above a score.

    The classifier is fitted on half 0 with P against U weighed alike; both shares are taken on half 1.
    """
    w, _ = fit(rows, scaling, 0.5, PRIOR_STEPS, half=False)

    def task(x, positive, half):
        f = scaling.inputs(x[half]) @ w
        bins = np.clip(((f + RANGE) * (BINS / (2 * RANGE))).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(bins, minlength=BINS), np.bincount(bins[positive[half]], minlength=BINS)])

    v = _total(rows, task, 2 * BINS)
    return best_bound(v[:BINS], v[BINS:])


def best_bound(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The prior from two histograms over the same bins of scores."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    if not n_u or not n_p:
        return 0.5
    above_u, above_p = (np.cumsum(h[::-1]) / h.sum() for h in (unlabelled, positive))
    error = sum(math.sqrt(math.log(4 / CONFIDENCE) / (2 * n)) for n in (n_u, n_p))
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(above_p > 0, (above_u + error) / above_p, np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(above_u[at] / above_p[at], 1 / n_u, 1 - 1e-3))


@dataclass(frozen=True)
class Model:
    """A fitted scorer, with the estimated prior and the course of its risk."""

    scaling: Scaling
    weights: np.ndarray
    prior: float
    course: list[tuple[float, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scaling.inputs(x) @ self.weights)


def learn(rows: DataFrame, prior: float | None = None) -> Model:
    """rows: x, positive and half of all training documents; the prior is estimated unless given."""
    scaling, (n_u, n_p, n_half, p_half) = _scaling(rows)
    if not n_u or not n_p:
        return Model(scaling, np.zeros(FEATURES + 1), prior or 0.5, [])
    if prior is None:
        halves = p_half and p_half < n_p and n_half < n_u
        prior = estimate_prior(rows, scaling) if halves else 0.5
    weights, course = fit(rows, scaling, prior)
    return Model(scaling, weights, prior, course)


def prepared(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One written row for each document: doc_id, held_out, positive, half and x."""
    good = (labels.select(F.col(doc_id).cast("long").alias("label_id"), F.col(label).alias("value"))
            .filter("label_id IS NOT NULL").groupBy("label_id").agg(F.min("value").alias("value"))
            .filter((F.col("value") == 1) & (remainder(F.col("label_id"), FOLDS) != HELD_OUT)))
    x = features(docs, text, doc_id)
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    half = remainder(F.concat(F.lit("half "), F.coalesce(F.col("doc_id").cast("string"), F.base64(F.substring("x", 1, 8)))), 2) == 1
    return materialise(x.join(good, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", held.alias("held_out"), F.col("label_id").isNotNull().alias("positive"), half.alias("half"), "x"), "quality-features")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of prepared rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return rows.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
          prior: float | None = None) -> DataFrame:
    """Learn from the training rows and score all: doc_id, held_out, score, predicted."""
    rows = prepared(docs, labels, text, doc_id, label)
    model = learn(rows.filter("NOT held_out"), prior)
    return scored(rows, model).withColumnRenamed("doc_id", doc_id)
