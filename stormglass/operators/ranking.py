"""Prefix sums, exact ranking metrics and exact medians without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def score_bounds(df: DataFrame, score: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Cut points that split the rows about evenly by score, one range for each `rows_per_bucket`.

    Only these few numbers reach the driver. They are literals afterwards, so that a task
    that is run again puts every row into the same range.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    marks = [i / buckets for i in range(1, buckets)] or [1.0]
    at = df.agg(F.percentile_approx(score, marks, 4 * buckets)).first()[0]
    return sorted({float(x) for x in at or []})


def _with_bucket(df: DataFrame, score: str, bounds: Sequence[float]) -> DataFrame:
    if not bounds:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol="_bucket").transform(df)


def prefix_sum(df: DataFrame, by: Sequence[str], score: str, cols: Sequence[str],
               descending: bool = True, bounds: Sequence[float] | None = None) -> DataFrame:
    """Per distinct score of each group: the sums of `cols`, and `cum_<col>` up to there.

    Rows with one score are merged first, so a frequent score is one row. Groups are cut
    into score ranges that are sorted in separate tasks; the totals of the earlier
    ranges, one row for each range of a group, are added afterwards.
    """
    if bounds is None:
        bounds = score_bounds(df, score)
    rows = _with_bucket(df.where(F.col(score).isNotNull()), score, bounds)
    if descending:
        rows = rows.withColumn("_bucket", -F.col("_bucket"))
    sums = [F.sum(c).alias(c) for c in cols]
    scored = rows.groupBy(*by, "_bucket", score).agg(*sums)
    direction = F.col(score).desc() if descending else F.col(score).asc()
    within = (Window.partitionBy(*by, "_bucket").orderBy(direction)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cumulated = scored.withColumns({f"cum_{c}": F.sum(c).over(within) for c in cols})
    earlier = (Window.partitionBy(*by).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1)) if by else \
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: small whatever the number of data rows.
    totals = rows.groupBy(*by, "_bucket").agg(*sums)
    offsets = totals.select(*by, "_bucket",
                            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}")
                              for c in cols])
    return (cumulated.join(offsets, [*by, "_bucket"])
            .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in cols})
            .drop("_bucket", *[f"_before_{c}" for c in cols]))


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                    probability: str = "probability",
                    bounds: Sequence[float] | None = None,
                    times: str | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision (step sum) per group.

    Rows without a score are left out. `times`: a column that says how many rows a row stands for.

    ROC-AUC is NULL when a group has one class; average precision is 0 without positives.
    """
    hit = F.col(actual).cast("bigint")
    n = F.lit(1).cast("bigint") if times is None else F.col(times).cast("bigint")
    rows = df.select(*by, F.col(probability).alias("_score"), (n * hit).alias("pos"),
                     (n * (1 - hit)).alias("neg"))
    steps = prefix_sum(rows, by, "_score", ["pos", "neg"], bounds=bounds)
    pos, tp, fp = F.col("pos"), F.col("cum_pos"), F.col("cum_neg")

    def wide(c):  # products of counts leave the range of bigint at a few billion rows
        return c.cast("decimal(19,0)")
    # Twice the number of (positive, negative) pairs in the right order: a whole number.
    pairs = F.sum(wide(F.col("neg")) * wide(2 * tp - pos)).cast("double").alias("_pairs")
    precision = F.sum(F.try_divide(pos.cast("double") * tp.cast("double"), tp + fp)).alias("_precision")
    return (steps.groupBy(*by)
            .agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                 pairs, precision)
            .select(*by, "positives", "negatives",
                    F.try_divide(F.col("_pairs"), 2 * F.col("positives").cast("double")
                                 * F.col("negatives").cast("double"))
                    .alias("roc_auc"),
                    F.coalesce(F.try_divide(F.col("_precision"), F.col("positives")), F.lit(0.0))
                    .alias("pr_auc")))


def roc_auc(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(df, by, **kw).select(*by, "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    return ranking_metrics(df, by, **kw).select(*by, "pr_auc")


def _brackets(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    guess = df.agg(*[F.percentile_approx(c, [0.4975, 0.5025], 2_000).alias(c) for c in cols]).first()
    return {c: tuple(guess[c]) if guess[c] else (0.0, 0.0) for c in cols}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact interpolated median of every column, ignoring nulls.

    Approximate percentiles give a guess of a narrow bracket around the middle, one scan
    counts the values below and up to each bracket, and only the values inside are
    shuffled and ranked. A bracket that turns out not to hold the middle is widened to the
    whole column, so the guess never affects the result.
    """
    cols = list(cols)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    bracket = _brackets(doubles, cols)
    facts = doubles.agg(*[
        F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
                 F.count_if(F.col(c) < bracket[c][0]).alias("under"),
                 F.count_if(F.col(c) <= bracket[c][1]).alias("upto")).alias(c)
        for c in cols]).first()
    live = [c for c in cols if facts[c]["n"] > 0]
    if not live:
        return dict.fromkeys(cols)
    under = {}
    for c in live:
        f = facts[c]
        under[c] = f["under"]
        if not (f["under"] < (f["n"] + 1) // 2 and f["n"] // 2 + 1 <= f["upto"]):
            under[c], bracket[c] = 0, (f["lo"], f["hi"])

    inside = doubles.select(*[
        F.when(F.col(c).between(*bracket[c]), F.col(c)).alias(c) for c in live])
    values = (inside.unpivot([], live, "feature", "value").where(F.col("value").isNotNull())
              .withColumn("times", F.lit(1)))
    ranks = prefix_sum(values, ["feature"], "value", ["times"], descending=False)

    def per_feature(numbers):
        return F.create_map(*[F.lit(x) for c in live for x in (c, numbers[c])])[F.col("feature")]
    size = per_feature({c: facts[c]["n"] for c in live})
    upto = F.col("cum_times") + per_feature(under)

    def at_rank(rank):
        here = (upto - F.col("times") < rank) & (rank <= upto)
        return F.max(F.when(here, F.col("value")))
    middle = ranks.groupBy("feature").agg(
        ((at_rank(F.floor((size + 1) / 2)) + at_rank(F.floor(size / 2) + 1)) / 2).alias("median"))
    got = {r["feature"]: r["median"] for r in middle.collect()}  # one row per column
    return {c: got.get(c) for c in cols}
