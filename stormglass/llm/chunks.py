"""Substring deduplication by content-defined chunks with a gear rolling hash.

The gear hash of a position adds a table value for each of the last 16 bytes, each shifted by its age.
A position whose hash lies under a limit is a cut (one in `rate` bytes); so are the ends of
a text. Cuts depend on the 16 bytes before them only, so inserted bytes move no other cut.
A chunk begins at every cut and ends at the first cut at least `min_bytes` later; chunks may
overlap, so that a repeated passage is found wherever it begins. Chunks are compared by a 64-bit
digest and their length: a first shuffle counts digests (with partial sums), a second one brings
back only the chunks whose digest occurs again. The first occurrence (smallest id, row and
start) stays, later ones are repeats. Overlapping or touching repeated chunks form a region; a
region of at least `min_region` bytes counts.

Defined cases: null and empty texts have no chunks. Repeated rows are repeats of each other. A null id sorts first.
Other columns are ignored by `regions` and pass through `apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T
from .columns import keeps_columns

RATE, MIN_BYTES, MIN_REGION, WINDOW_BYTES = 20, 64, 120, 16
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each position, over the last 16 bytes, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
    return h


def chunk_spans(data: np.ndarray, offsets: np.ndarray, rate: int, min_bytes: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all chunks of a slice of texts."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:] = (gear(data) >> np.uint32(8)) < (1 << 24) // rate
    for k in range(WINDOW_BYTES):  # a hash that reaches into the text before is no cut
        at = offsets[:-1] + k
        cut[at[at < offsets[1:]]] = False
    cut[offsets] = True
    cuts = np.flatnonzero(cut)
    row = np.searchsorted(offsets, cuts, side="right") - 1
    ends = np.searchsorted(cuts, cuts + min_bytes)
    ok = ends < len(cuts)
    starts, row, ends = cuts[ok], row[ok], cuts[ends[ok]]
    inside = ends <= offsets[np.minimum(row + 1, len(offsets) - 1)]
    return starts[inside], ends[inside], row[inside]


def _chunks(batches: Iterator[pa.RecordBatch], rate: int, min_bytes: int, places: bool
            ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.text_slices(batch.column("text")):
            starts, ends, row = chunk_spans(data, offsets, rate, min_bytes)
            digest = T.signed(T.byte_spans(data, starts, ends))
            if not places:
                digest, n = np.unique(digest, return_counts=True)
                yield pa.RecordBatch.from_pydict({"digest": digest, "n": n.astype(np.int64)})
                continue
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_pydict({
                "digest": digest, "row": batch.column("row").take(take), "id": batch.column("id").take(take),
                "start": (starts - offsets[row]).astype(np.int32), "size": (ends - starts).astype(np.int32)})


def repeats(docs: DataFrame, text: str, doc_id: str, rate: int, min_bytes: int) -> DataFrame:
    """(row, id, start, end, first_id, later): chunks that occur again; later ones are not the first."""
    rows = docs.select(F.col("_row").alias("row"), F.col(doc_id).cast("long").alias("id"),
                       F.col(text).alias("text"))
    counts = rows.select("text").mapInArrow(
        lambda it: _chunks(it, rate, min_bytes, False), "digest long, n long")
    again = counts.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest")
    places = rows.mapInArrow(lambda it: _chunks(it, rate, min_bytes, True),
                             "digest long, row long, id long, start int, size int")
    found = materialise(places.join(again, "digest"), "repeats")
    first = found.groupBy("digest", "size").agg(F.min(F.struct("id", "row", "start")).alias("first"),
                                                F.count("*").alias("n")).filter("n > 1").drop("n")
    return found.join(first, ["digest", "size"]).select(
        "row", "id", "start", (F.col("start") + F.col("size")).alias("end"), F.col("first.id").alias("first_id"),
        ((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).alias("later"))


def _islands(spans: DataFrame, min_region: int) -> DataFrame:
    """Spans of a row merged to regions of at least min_region bytes."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return (spans.withColumn("reach", F.max("end").over(before))
            .withColumn("island", F.sum(F.when(F.col("start") > F.col("reach"), 1).otherwise(0)).over(upto))
            .groupBy("row", "island").agg(
                F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"),
                F.min("first_id").alias("first_id"), F.max("later").alias("later"),
                F.collect_list(F.when(F.col("later"), F.struct("start", "end"))).alias("cuts"))
            .filter(F.col("end") - F.col("start") >= min_region))


def regions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE,
            min_bytes: int = MIN_BYTES, min_region: int = MIN_REGION) -> DataFrame:
    """One row for each region that occurs again: its document, place, the smallest id that holds
    a part of it, and whether any of it repeats an earlier place."""
    rows = docs.select(doc_id, text, F.monotonically_increasing_id().alias("_row"))
    found = _islands(repeats(rows, text, doc_id, rate, min_bytes), min_region)
    return found.select(F.col("id").alias(doc_id), F.col("start").cast("long").alias("start"),
                        (F.col("end") - F.col("start")).cast("long").alias("n_bytes"),
                        F.col("first_id").alias(f"first_{doc_id}"), F.col("later").alias("repeats_earlier"))


def _cut_out(batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = batch.column(text).to_pylist(), batch.column("_cuts").to_pylist()
        for i, spans in enumerate(cuts):
            if not spans:
                continue
            raw = texts[i].encode()
            keep = np.ones(len(raw), dtype=bool)
            for s in spans:
                keep[s["start"]:s["end"]] = False
            data = np.frombuffer(raw, dtype=np.uint8)
            # A character goes or stays as a whole, as its first byte does.
            lead = np.maximum.accumulate(np.where(T.NOT_LEADING[data], 0, np.arange(len(raw))))
            texts[i] = data[keep[lead]].tobytes().decode()
        yield pa.RecordBatch.from_arrays([
            pa.array(texts, batch.schema.field(n).type) if n == text else batch.column(n) for n in names], names=names)


@keeps_columns("_row", "_cuts")
def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE,
          min_bytes: int = MIN_BYTES, min_region: int = MIN_REGION) -> DataFrame:
    """The documents without the chunks that repeat an earlier place."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = _islands(repeats(rows, text, doc_id, rate, min_bytes), min_region)
    cuts = found.groupBy("row").agg(F.flatten(F.collect_list("cuts")).alias("_cuts")).withColumnRenamed("row", "_row")
    names = docs.columns
    return rows.join(cuts, "_row", "left").drop("_row").mapInArrow(
        lambda it: _cut_out(it, text, names), docs.schema)
