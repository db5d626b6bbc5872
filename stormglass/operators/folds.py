"""Chronological positions, splits and walk-forward folds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SLICE = 500_000


def date_positions(df: DataFrame, order: str = "date") -> DataFrame:
    """One row per date: its number `date_pos` from 1, its rows, and the rows before it.

    Rows without a date have no position and are not counted.

    The window runs over distinct dates, which the calendar bounds, never over data rows.
    """
    w = Window.orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("date_rows"))
    return counted.select(
        order, "date_rows", F.row_number().over(w).cast("bigint").alias("date_pos"),
        F.coalesce(F.sum("date_rows").over(before), F.lit(0)).alias("rows_before"))


def ordinal(df: DataFrame, order: str = "date", tie: Sequence[str] = (), unit: str = "row",
            digits: int | None = None) -> DataFrame:
    """Add `pos`, the chronological position from 1.

    unit='date': all rows of a date share the number of that date.
    unit='row': every row has its own; rows of one date are ordered by the md5 of their
    tie columns. The leading hex digits of it cut a date into even slices that are
    numbered in separate tasks, so a date with most of the rows is no bottleneck. Their
    number follows from the largest date unless `digits` is given.
    Rows without a date have no position and are left out.
    """
    if unit == "date":
        dates = date_positions(df, order)
        return (df.join(dates.select(order, F.col("date_pos").alias("pos")), order))
    if unit != "row":
        raise ValueError(f"unknown unit {unit!r}")
    if not tie:
        raise ValueError("unit='row' needs tie columns that identify a row of a date")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie]
    df = df.where(F.col(order).isNotNull())
    if digits is None:
        most = df.groupBy(order).count().agg(F.max("count")).first()[0] or 1
        digits = max(1, math.ceil(math.log(most / ROWS_PER_SLICE, 16))) if most > ROWS_PER_SLICE else 1
    rows = (df.withColumn("_mix", F.md5(F.concat_ws("|", *text)))
            .withColumn("_slice", F.substring("_mix", 1, digits)))
    slices = rows.groupBy(order, "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(order).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .join(date_positions(df, order).select(order, "rows_before"), order)
               .select(order, "_slice", (F.col("_before") + F.col("rows_before")).alias("_before")))
    inner = Window.partitionBy(order, "_slice").orderBy("_mix", *tie)
    return (rows.join(offsets, [order, "_slice"])
            .withColumn("pos", F.row_number().over(inner) + F.col("_before"))
            .drop("_mix", "_slice", "_before"))


def count_positions(df: DataFrame, order: str = "date", unit: str = "row") -> int:
    """Number of rows, or of distinct dates."""
    return df.agg(F.count_distinct(order) if unit == "date" else F.count(order)).first()[0]


def chronological_split(df: DataFrame, order: str = "date", frac: float = 0.8,
                        unit: str = "row", tie: Sequence[str] = ()) -> DataFrame:
    """Add `is_train`: true for the first floor(frac * n) positions."""
    n = count_positions(df, order, unit)
    return ordinal(df, order, tie, unit).withColumn("is_train", F.col("pos") <= int(n * frac))


@dataclass(frozen=True)
class Fold:
    """Positions counted from 1: train is 1..train_end, test is test_start..test_end."""

    fold: int
    train_end: int
    test_start: int
    test_end: int


def fold_bounds(n: int, k: int = 5, gap: int = 0) -> list[Fold]:
    """k equal test blocks at the end of n positions, each after all of its training."""
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"{n} positions are too few for {k} folds")
    starts = [n - (k - i) * size + 1 for i in range(k)]
    return [Fold(i + 1, s - 1 - gap, s, s + size - 1) for i, s in enumerate(starts)]


def walk_forward_folds(df: DataFrame, order: str = "date", k: int = 5, unit: str = "row",
                       tie: Sequence[str] = (), gap: int = 0) -> tuple[DataFrame, list[Fold]]:
    """The frame with `pos`, and the fold bounds. One number is read by the driver."""
    return ordinal(df, order, tie, unit), fold_bounds(count_positions(df, order, unit), k, gap)


def assign_test_folds(placed: DataFrame, folds: Sequence[Fold],
                      keep_rest: bool = False) -> DataFrame:
    """Test rows with the number of their fold; the other rows, if kept, have fold 0."""
    pos, fold = F.col("pos"), F.lit(0)
    for f in folds:  # test blocks do not overlap
        fold = F.when(pos.between(f.test_start, f.test_end), f.fold).otherwise(fold)
    rows = placed.withColumn("fold", fold)
    return rows if keep_rest else rows.where("fold > 0")


def fold_summary(placed: DataFrame, folds: Sequence[Fold], order: str = "date",
                 target: str | None = None) -> DataFrame:
    """Training rows, test rows and test dates of each fold, in one aggregate."""
    pos = F.col("pos")

    def stats(f):
        test, train = pos.between(f.test_start, f.test_end), pos <= f.train_end
        parts = [F.lit(f.fold).alias("fold"),
                 F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
                 F.min(F.when(test, F.col(order))).alias("test_start"),
                 F.max(F.when(test, F.col(order))).alias("test_end")]
        if target:
            parts.append(F.count_if(test & (F.col(target) == 1)).alias("positive_cases"))
        return F.struct(*parts)
    one = placed.agg(F.array(*[stats(f) for f in folds]).alias("_folds"))
    return one.select(F.explode("_folds").alias("f")).select("f.*")
