"""Boosted trees with penalties on the leaf weights, for all training sets at once.

Every feature is cut into ranges. A tree grows level by level: tasks add up first and second derivatives of the
logistic loss by node, feature and range (`together.add_up`), for every training set in the same scan, and the driver picks the
splits from these sums, whose size depends on sets, columns and ranges alone. With G and H the sums of a node,

    weight = -soft(G) / (H + l2),    worth = soft(G)^2 / (H + l2),    soft(G) = sign(G) * max(|G| - l1, 0),

and the split of largest worth(left) + worth(right) - worth(node) > 0 is taken whose sides both hold H >= `least`.

Defined cases: missing values take the median of the set, a column without a value is never split, a set of one class
or without rows has trees of weight 0 and positives and negatives weigh the same. Rows equal in every column are
left out of a round together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .together import TrainingSets, add_up

RANGES = 64      # of a feature; one byte holds the number of a range
KEEP_EVERY = 50  # rounds after which the rows are written again with their margins
SEED = 42


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; `share` of the rows and of the features take part in a round."""

    rounds: int = 350
    rate: float = 0.03
    depth: int = 3
    least: float = 3.0
    share: float = 0.8
    l1: float = 0.1
    l2: float = 1.5


@dataclass
class Tree:
    """A full binary tree; node i has the children 2i + 1 and 2i + 2. Values of a range up to `upto` go left."""

    feature: np.ndarray
    upto: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches in so many levels, counted from 0 within the level."""
        at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[row, self.feature[at]] > self.upto[at])
        return at - (2 ** levels - 1)


@dataclass
class Boosted:
    """The trees of one training set."""

    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def margin(self, features: Sequence[Column]) -> Column:
        """The sum of the leaf weights; `features` without nulls, in the order of the set."""
        table = []
        for t in self.trees:
            limit = [float(self.cuts[f][u]) if u < len(self.cuts[f]) else float(np.finfo(float).max)
                     for f, u in zip(t.feature.tolist(), t.upto.tolist())]
            table.append({"f": t.feature.tolist(), "t": limit, "v": t.value.tolist()})
        depth = int(math.log2(len(self.trees[0].value))) if self.trees else 0
        trees = F.from_json(F.lit(json.dumps(table)), "array<struct<f:array<int>,t:array<double>,v:array<double>>>")
        levels = F.array(*[F.lit(i) for i in range(depth)]).cast("array<int>")

        def weight(x, tree):
            at = F.aggregate(levels, F.lit(0), lambda at, _: 2 * at + 1 + (
                F.get(x, F.get(tree["f"], at)) > F.get(tree["t"], at)).cast("int"))
            return F.get(tree["v"], at - (2 ** depth - 1))
        # A variable for the inputs of a row, which are so computed once and not for every tree.
        return F.get(F.transform(F.array(F.array(*features)), lambda x: F.aggregate(
            trees, F.lit(0.0), lambda total, tree: total + weight(x, tree))), 0)


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_weight(g, h, l1: float, l2: float):
    return np.divide(-soft(g, l1), h + l2, out=np.zeros_like(g), where=h + l2 > 0)


def _worth(g, h, l1, l2):
    return np.divide(soft(g, l1) ** 2, h + l2, out=np.zeros_like(g), where=h + l2 > 0)


def best_splits(sums: np.ndarray, allowed: np.ndarray, s: Boosting) -> tuple[np.ndarray, ...]:
    """(feature, upto, left g and h, right g and h) of each node from sums (node, feature, range, 2).

    A node without a worthy split sends all rows left. Ties go to the first feature and range.
    """
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    g, h = left[..., 0], left[..., 1]
    G, H = whole[..., 0], whole[..., 1]
    gain = _worth(g, h, s.l1, s.l2) + _worth(G - g, H - h, s.l1, s.l2) - _worth(G, H, s.l1, s.l2)
    gain = np.where((h >= s.least) & (H - h >= s.least) & allowed[None, :, None], gain, 0)
    flat = gain.reshape(len(gain), -1)
    best, nodes = flat.argmax(axis=1), np.arange(len(flat))
    feature, upto = np.unravel_index(best, gain.shape[1:])
    taken = flat[nodes, best] > 1e-12
    feature, upto = np.where(taken, feature, 0), np.where(taken, upto, RANGES)
    total = whole[nodes, 0, 0]
    side = np.where(taken[:, None], left[nodes, feature, np.minimum(upto, RANGES - 1)], total)
    return feature, upto, side, total - side


def _drawn(mix: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round: the same after a task is run again."""
    z = mix + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) < share * 2.0 ** 53


def _cuts(sets: TrainingSets) -> list[list[np.ndarray]]:
    """Cut points of every feature in every set, from the rows of that set alone."""
    marks = [i / RANGES for i in range(1, RANGES)]
    found = sets.rows.agg(*[F.percentile_approx(F.when(F.col("_enters") <= s, F.col(c)), marks, 16 * RANGES).alias(f"p{s}_{j}")
                            for s in range(sets.count) for j, c in enumerate(sets.cols)]).first()
    return [[np.unique(np.array(found[f"p{s}_{j}"] or [], dtype=float)) for j in range(len(sets.cols))]
            for s in range(sets.count)]


def _ranges(sets: TrainingSets, cuts, medians) -> DataFrame:
    """Written rows: label, first set, hash, ranges of every set (bytes) and margins of every set (doubles)."""
    cols, count = sets.cols, sets.count

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, count, len(cols)), dtype=np.uint8)
            for j, c in enumerate(cols):
                v = batch.column(3 + j).to_numpy(zero_copy_only=False).astype(float)
                for s in range(count):
                    if c in medians[s]:
                        out[:, s, j] = np.searchsorted(cuts[s][j], np.where(np.isnan(v), medians[s][c], v))
            yield pa.RecordBatch.from_pydict({
                "y": batch.column(0).cast(pa.float64()), "enters": batch.column(1).cast(pa.int32()), "mix": batch.column(2),
                "bins": [r.tobytes() for r in out], "margins": [bytes(8 * count)] * batch.num_rows})

    rows = sets.rows.select("_y", "_enters", F.xxhash64("_enters", "_y", *cols).alias("mix"), *cols)
    return materialise(rows.mapInArrow(work, "y double, enters int, mix long, bins binary, margins binary"), "ranges")


@dataclass
class _Part:
    """A batch of written rows as arrays."""

    y: np.ndarray
    enters: np.ndarray
    mix: np.ndarray
    bins: np.ndarray
    margins: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, count: int) -> _Part:
        y, enters, mix = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        bins, margins = (b"".join(batch.column(i).to_pylist()) for i in (3, 4))
        return cls(y, enters, mix.view(np.uint64), np.frombuffer(bins, np.uint8).reshape(len(y), count, -1),
                   np.frombuffer(margins).reshape(len(y), count))

    def margin(self, s: int, trees: Sequence[Tree], depth: int) -> np.ndarray:
        """The margin of set s with the trees that came after the rows were written."""
        out = self.margins[:, s].copy()
        for t in trees:
            out += t.value[t.leaf(self.bins[:, s], depth)]
        return out


def _level_sums(rows: DataFrame, shape: tuple, pending, partial, level: int, turn: int, heavier, s: Boosting,
                parts: int) -> np.ndarray:
    """Derivatives by set, node, feature and range."""
    count, nodes, width = shape[:3]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            part = _Part.of(batch, count)
            drawn = _drawn(part.mix, turn, s.share)
            for k in range(count):
                use = drawn & (part.enters <= k)
                bins, y = part.bins[use, k], part.y[use]
                p = 1 / (1 + np.exp(-np.clip(part.margin(k, pending[k], s.depth)[use], -500, 500)))
                w = np.where(y > 0, heavier[k], 1.0)
                node = partial[k].leaf(bins, level)
                at = ((node[:, None] * width + np.arange(width)) * RANGES + bins).ravel()
                for d, v in enumerate((w * (p - y), w * p * (1 - p))):
                    total[k, ..., d] += np.bincount(at, np.repeat(v, width), nodes * width * RANGES).reshape(shape[1:4])
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})
    return add_up(rows.mapInArrow(work, "v binary"), math.prod(shape), parts).reshape(shape)


def _with_margins(rows: DataFrame, count: int, pending, depth: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _Part.of(batch, count)
            now = np.stack([part.margin(k, pending[k], depth) for k in range(count)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in now], pa.binary())],
                                             names=batch.schema.names)
    return materialise(rows.mapInArrow(work, rows.schema), "ranges")


def fit_all(sets: TrainingSets, medians: Sequence[dict[str, float]], s: Boosting = Boosting(),
            use: Sequence[str] | None = None) -> list[Boosted]:
    """The trees of every training set: one scan for each level of a round."""
    width, count = len(sets.cols), sets.count
    cuts = _cuts(sets)
    rows = _ranges(sets, cuts, medians)
    classes = {(r.enters, r.y): r["count"] for r in rows.groupBy("enters", "y").count().collect()}  # a row for each set and class
    n = [[sum(v for (e, y), v in classes.items() if e <= k and (y > 0) == positive) for positive in (False, True)] for k in range(count)]
    heavier = [neg / pos if pos and neg else 1.0 for neg, pos in n]
    open_to = [np.array([c in medians[k] and (use is None or c in use) for c in sets.cols], dtype=bool) & all(n[k]) for k in range(count)]
    out, draw, pending = [Boosted(cuts[k]) for k in range(count)], np.random.default_rng(SEED), [[] for _ in range(count)]
    parts = rows.rdd.getNumPartitions()
    for turn in range(s.rounds):
        if turn and turn % KEEP_EVERY == 0:
            rows, pending = _with_margins(rows, count, pending, s.depth), [[] for _ in range(count)]
            parts = rows.rdd.getNumPartitions()
        partial = [Tree(np.zeros(2 ** s.depth - 1, np.int64), np.full(2 ** s.depth - 1, RANGES), np.zeros(2 ** s.depth)) for _ in range(count)]
        order = draw.permutation(width)
        for level in range(s.depth):
            sums = _level_sums(rows, (count, 2 ** level, width, RANGES, 2), pending, partial, level, turn, heavier, s, parts)
            for k, tree in enumerate(partial):
                mine = order[open_to[k][order]]
                allowed = np.zeros(width, dtype=bool)
                allowed[mine[:max(1, int(s.share * len(mine)))]] = True
                feature, upto, left, right = best_splits(sums[k], allowed, s)
                first = 2 ** level - 1
                tree.feature[first:2 * first + 1], tree.upto[first:2 * first + 1] = feature, upto
                if level == s.depth - 1 and open_to[k].any():
                    sides = np.stack([left, right], axis=1).reshape(-1, 2)
                    tree.value[:] = s.rate * leaf_weight(sides[:, 0], sides[:, 1], s.l1, s.l2)
        for k, tree in enumerate(partial):
            pending[k].append(tree)
            out[k].trees.append(tree)
    return out
