"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are all runs of `size` consecutive words of a benchmark item; an item of fewer
words is one pattern. Texts and items are brought to one form first: lower-case A-Z, words of
letters, digits and bytes above 0x7F, single blanks between them. Then, per length class of
patterns with least length m:

* a shift table over blocks of B bytes says how far the search may move: a block that occurs
  in the first m bytes of no pattern lets it skip m - B + 1 positions;
* where the shift is 0 the block's hash selects a bucket of patterns, a check of the first
  bytes thins the bucket, and a direct comparison with word boundaries on both sides confirms.

The search moves many positions of a slice of text in step (one array operation for all), each
over its own stretch, so it skips like the sequential search. The benchmark is a query set: it
is cut into blocks of at most `block_bytes` expected bytes of text, each block is sent to the
tasks, and the texts pass the blocks in turn.

Defined cases: null and empty texts and items have no words. Repeated items and windows count
for every item that holds them. A null item id hits words and counts as one item written
`null`. Repeated documents are judged row by row; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T
from .columns import keeps_columns

WINDOW = 13
BLOCK_BYTES = 4 << 20
HIT_PERCENT_INVERSE = 20  # contaminated: 20 * hit words >= words
LENGTH_CLASSES = (1, 4, 8, 16, 32)
_LANES = 4096
_TABLE_BITS = 21

_NOT_WORD = T._table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_FORM = T.LOWER.copy()
_FORM[_NOT_WORD] = 0x20


def canonical(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts as words with single blanks; a zero byte closes each text.

    Yields (first row, end row, bytes, row offsets).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    closed = pc.binary_join_element_wise(column, pa.scalar("\n", pa.large_string()),
                                         pa.scalar("", pa.large_string()))
    for lo, hi, data, offsets in T.text_slices(closed):
        data = _FORM[data]
        word = data != 0x20
        keep = word.copy()
        keep[1:] |= word[:-1]
        at = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=at[1:])
        out, bounds = data[keep], at[offsets]
        filled = bounds[1:] > bounds[:-1]
        out[bounds[1:][filled] - 1] = 0
        yield lo, hi, out, bounds


def _gather(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` (at most 8) bytes from each position as one number."""
    v = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        v = (v << np.uint64(8)) | data[at + k]
    return v


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (T.mix(blocks) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class _Class:
    """Shift table and buckets of the patterns of one length class."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.m = min(len(p) for _, p in patterns)
        self.block = 8 if self.m >= 16 else max(1, self.m // 2)
        self.head = min(8, self.m)
        self.bucket = defaultdict(list)
        heads = np.frombuffer(b"".join(p[:self.m] for _, p in patterns), dtype=np.uint8)
        base = np.arange(len(patterns)) * self.m
        most = self.m - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, most, dtype=np.int32)
        for j in range(most):  # from left to right, so later blocks leave smaller shifts
            self.shift[_slot(_gather(heads, base + j, self.block))] = most - 1 - j
        last = _gather(heads, base + most - 1, self.block)
        first = _gather(heads, base, self.head)
        for (number, p), key in zip(patterns, self._key(last, first).tolist()):
            self.bucket[key].append((number, p))
        self.keys = np.unique(self._key(last, first))

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return T.mix(T.mix(last) + first)

    def search(self, data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        """(position, pattern number) of every occurrence between word boundaries."""
        n = len(data)
        total = n - self.m + 1  # possible starts
        if total <= 0:
            return
        step = max(64, -(-total // _LANES))
        at = np.arange(0, total, step)
        stop = np.minimum(at + step, total)
        found = []
        tail = self.m - self.block
        while len(at):
            shift = self.shift[_slot(_gather(data, at + tail, self.block))]
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(shift, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return
        at = np.concatenate(found)
        at = at[(at == 0) | (data[at - 1] <= 0x20)]
        key = self._key(_gather(data, at + tail, self.block), _gather(data, at, self.head))
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        for p, k in zip(at[same].tolist(), key[same].tolist()):
            for number, pattern in self.bucket[k]:
                end = p + len(pattern)
                if end < n and data[end] <= 0x20 and raw[p:end] == pattern:
                    yield p, number


class Patterns:
    """Windows of a block of benchmark items, ready for the search."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        holders: dict[bytes, set[str]] = defaultdict(set)
        for _, _, data, bounds in canonical(pa.array([t for _, t in items], pa.string())):
            lo = 0
            for i in range(len(bounds) - 1):
                words = data[bounds[i]:bounds[i + 1]].tobytes().rstrip(b"\0").split(b" ")
                name = items[lo + i][0]
                if words == [b""]:
                    continue
                for j in range(max(1, len(words) - size + 1)):
                    holders[b" ".join(words[j:j + size])].add(name)
            items = items[len(bounds) - 1:]
        self.texts = sorted(holders)
        self.items = [sorted(holders[p]) for p in self.texts]
        self.words = [p.count(b" ") + 1 for p in self.texts]
        classes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for number, p in enumerate(self.texts):
            classes[max(c for c in LENGTH_CLASSES if c <= len(p))].append((number, p))
        self.classes = [_Class(v) for v in classes.values()]

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By row: (first word, words, pattern number) of each occurrence."""
        raw, out = data.tobytes(), defaultdict(list)
        found = [x for c in self.classes for x in c.search(data, raw)]
        if found:
            gaps = np.flatnonzero(data <= 0x20)
            at = np.array([p for p, _ in found])
            row = np.searchsorted(bounds, at, side="right") - 1
            word = np.searchsorted(gaps, at) - np.searchsorted(gaps, bounds[row])
            for r, w, (_, number) in zip(row.tolist(), word.tolist(), found):
                out[r].append((w, self.words[number], number))
        return out


_HIT = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string())])
HITS = "array<struct<first_word: long, n_words: long, item_id: string>>"


def _search(batches: Iterator[pa.RecordBatch], patterns: Patterns, text: str
            ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, sizes = batch.column("_hits").to_pylist(), np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, bounds in canonical(batch.column(text)):
            sizes[lo:hi] = T.per_row(data <= 0x20, bounds)
            for row, found in patterns.hits(data, bounds).items():
                hits[lo + row] = [*(hits[lo + row] or []), *(
                    {"first_word": w, "n_words": k, "item_id": item}
                    for w, k, number in found for item in patterns.items[number])]
        cols = {n: batch.column(n) for n in batch.schema.names}
        cols |= {"_hits": pa.array(hits, pa.list_(_HIT)), "_n_words": pa.array(sizes)}
        yield pa.RecordBatch.from_pydict(cols)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with `_n_words` and `_hits`: (first word, words, item) of every occurrence."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"),
                             F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    df = docs.select("*", F.lit(None).cast(HITS).alias("_hits"),
                     F.lit(0).cast("long").alias("_n_words"))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in rows], size))
        if b:  # one block's tables at a time in a worker
            df = materialise(df, "searched")
        df = df.mapInArrow(lambda it, s=shared: _search(it, s.value, text), df.schema)
    return df


def _summary(hits: list[dict] | None) -> tuple[int, int, str]:
    words: set[int] = set()
    for h in hits or ():
        words.update(range(h["first_word"], h["first_word"] + h["n_words"]))
    items = sorted({h["item_id"] for h in hits or ()})
    return len(words), len(items), hashlib.sha256(",".join(items).encode()).hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch], doc_id: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_summary(h) for h in batch.column("_hits").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            doc_id: batch.column(doc_id), "n_words": batch.column("_n_words"),
            "n_hit": pa.array([r[0] for r in rows], pa.int64()),
            "n_items": pa.array([r[1] for r in rows], pa.int64()),
            "items_sha256": pa.array([r[2] for r in rows], pa.string())})


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (HIT_PERCENT_INVERSE * n_hit >= n_words)


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
          item_id: str = "item_id") -> DataFrame:
    """One row for each document: words, hit words, items, and the verdict."""
    found = find(docs.select(doc_id, text), benchmark, text, item_id).select(
        doc_id, "_n_words", "_hits")
    kind = docs.schema[doc_id].dataType.simpleString()
    return found.mapInArrow(
        lambda it: _summaries(it, doc_id),
        f"{doc_id} {kind}, n_words long, n_hit long, n_items long, items_sha256 string",
    ).withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


@keeps_columns("_hits", "_n_words")
def apply(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = find(docs, benchmark, text)
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.coalesce("_hits", F.array().cast(HITS)),
        lambda h: F.sequence(h["first_word"], h["first_word"] + h["n_words"] - 1)))))
    return found.filter(~_contaminated(covered, F.col("_n_words"))).select(*docs.columns)
