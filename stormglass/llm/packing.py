"""Best-fit packing of documents into fixed-size bins with conflicts.

A bin holds at most `capacity` bytes, at most one document of a duplicate cluster and at most
`max_per_source` documents of a source. Pieces are dealt by row and piece number into shards of about
`shard_rows`, so that repeated rows spread too, each packed by one task: pieces go from long to short (ties by id, piece,
cluster and row) into the fullest bin they fit in without a conflict. Bins are kept in order of
residual space; the search starts at the smallest residual that suffices and moves on to the
next until a bin is compatible, or a new one is opened. A bin carries a bitmap of its clusters and one bitmap
of its sources for each count up to the limit.

A text longer than the capacity is cut into pieces of the capacity and a rest; the pieces belong
to one cluster. Nothing is dropped.

With `contents` every row carries the bytes of its piece, so that bins can be built from the result alone (a piece may
begin or end inside a character; the pieces of a text in order are its bytes).

Defined cases: a null or empty text gives one row of length 0 without a bin. A null source is a
source of its own. Repeated rows are packed each (they are one cluster, so they go to different bins).
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, MAX_PER_SOURCE, SHARD_ROWS = 16_384, 4, 4_096


def best_fit(lengths, sources, clusters, capacity: int, max_per_source: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, for items in packing order."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(
        c for c, n in zip(*np.unique(clusters, return_counts=True)) if n > 1))}
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    in_clusters: list[int] = []
    in_sources: list[list[int]] = []   # bitmap of the sources with at least 1, 2, .. documents
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for item, (length, source, cluster) in enumerate(zip(lengths, sources, clusters)):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (in_clusters[b] & c or in_sources[b][-1] & s):
                residual = order.pop(at)[0]
                break
            at += 1
        else:
            b, residual = len(in_clusters), capacity
            in_clusters.append(0)
            in_sources.append([0] * max_per_source)
        in_clusters[b] |= c
        levels = in_sources[b]
        levels[next(k for k in range(max_per_source) if not levels[k] & s)] |= s
        bins[item], offsets[item] = b, capacity - residual
        insort(order, (residual - length, b))
    return bins, offsets


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
         cluster: Column | None = None, capacity: int = CAPACITY,
         max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS,
         contents: bool = False) -> DataFrame:
    """One row for each piece: its place in the text (bytes), its bin, and its offset there.

    cluster: names the duplicate cluster; by default equal texts are a cluster.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
        (F.xxhash64(text) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
        size.alias("size"), F.monotonically_increasing_id().alias("row"),
        *([F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("whole")] if contents else []))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / capacity)).cast("int")
    pieces = (rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
              .withColumn("start", F.col("piece").cast("long") * capacity)
              .withColumn("length", F.least(F.lit(capacity), F.col("size") - F.col("start"))))
    total = rows.agg(F.sum(last + 1)).first()[0] or 1
    shards = max(1, math.ceil(total / shard_rows))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    held = ["content"] if contents else []
    if contents:
        cut = F.substring(F.col("whole"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
        pieces = pieces.withColumn("content", cut).drop("whole")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "cluster", "row"],
                                  ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = best_fit(group["length"].tolist(), group["source"].tolist(),
                                 group["cluster"].tolist(), capacity, max_per_source)
        group["bin"], group["offset"] = bins, offsets
        return group[["doc_id", "piece", "start", "length", "shard", "bin", "offset", *held]]

    schema = "doc_id long, piece int, start long, length long, shard long, bin long, offset long" + (", content binary" if contents else "")
    packed = pieces.filter("length > 0").drop("size").groupBy("shard").applyInPandas(place, schema)
    empty = pieces.filter("length <= 0").select(
        "doc_id", "piece", "start", F.lit(0).cast("long").alias("length"), "shard",
        F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"), *held)
    return packed.unionByName(empty).withColumnRenamed("doc_id", doc_id)
