"""Quality rules with cross-document line frequency.

Each text is scanned once, in tasks, for its own figures and for the hashes of its
normalised lines. Lines are then counted over all documents of a host; lines above the
limit are removed, and documents that lose too much are rejected.

A line is above the limit when more than `limit` documents of the host hold it, where `limit` is the larger of
`min_docs` and `share` of the host's documents. Documents of a host with equal texts count once, in both
numbers: a text that was merely copied many times is the work of the duplicate stage. Normalised: lower-case A-Z, digits
as 0, white space as one blank. Lines without a word are never counted or removed.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. A
null host is a host of its own. Ids play no part in the counts; each row gets its own result. Other columns are ignored by
`judge` and passed through by `apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T
from .columns import keeps_columns

MIN_DOCS, SHARE = 20, 0.001
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT, MIN_LEFT_PERCENT = 20, 8, 30, 50

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PLAIN = T.LOWER.copy()
_PLAIN[0x30:0x3A] = 0x30


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the \\n-split lines, and where the lines of each row begin."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    counts = 1 + T.per_row(data == 0x0A, offsets)
    return starts, ends, np.concatenate([[0], np.cumsum(counts)])


def _first_of_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Marks the first occurrence of each value inside its row."""
    order = np.lexsort((np.arange(len(values)), values, row))
    v, r = values[order], row[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    out = np.zeros(len(values), dtype=bool)
    out[order] = first
    return out


def line_keys(data: np.ndarray, offsets: np.ndarray):
    """Normalised hash, words, start, end and row of every line that holds a word."""
    starts, ends, bounds = _lines(data, offsets)
    plain = _PLAIN[data]
    w_start, w_end, _ = T.word_spans(data, offsets)
    hashes = T.byte_spans(plain, w_start, w_end)
    lo, hi = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    full = hi > lo
    row = T.row_of(bounds)
    keys = T.span_hashes(hashes, lo, hi)
    return keys[full], (hi - lo)[full], starts[full], ends[full], row[full]


def _figures(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], dict]:
    n = len(offsets) - 1
    starts, ends, bounds = T.word_spans(data, offsets)
    letters = T.per_row(~T.NOT_LEADING[data] & ~T.SPACE[data], offsets)
    words = T.byte_spans(data, starts, ends)
    h, first = T.windows(words, bounds, REPEAT_WINDOW)
    row = T.row_of(bounds)
    twice = np.zeros(len(words) + 1, dtype=np.int64)
    if len(h):
        key = h ^ T.mix(row[first].astype(np.uint64) + np.uint64(1))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = first[count[inverse] > 1]
        np.add.at(twice, hit, 1)
        np.add.at(twice, hit + REPEAT_WINDOW, -1)
    repeated = np.cumsum(twice)[:len(words)] > 0

    key, size, l_start, l_end, l_row = line_keys(data, offsets)
    raw = T.byte_spans(data, l_start, l_end)
    distinct = np.bincount(l_row[_first_of_row(raw, l_row)], minlength=n)
    figures = {"n_words": np.diff(bounds), "word_chars": letters,
               "n_symbols": T.per_row(_SYMBOLS[data], offsets),
               "n_dup_lines": np.bincount(l_row, minlength=n) - distinct,
               "n_repeat_words": T.per_row(repeated, bounds)}
    lines = {"line": T.signed(key), "words": size.astype(np.int64)}
    return figures, lines | {"bounds": np.concatenate([[0], np.cumsum(np.bincount(l_row, minlength=n))])}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, size = [], 0
        for lo, hi, data, offsets in T.text_slices(batch.column("_text"), T.CACHE_BYTES):
            figures, lines = _figures(data, offsets)
            bounds = lines.pop("bounds")
            items = pa.StructArray.from_arrays([pa.array(v) for v in lines.values()], list(lines))
            cols = {c: batch.column(c).slice(lo, hi - lo) for c in ("_row", "_id", "_host")}
            cols["_body"] = pa.array(T.signed(T.byte_spans(data, offsets[:-1], offsets[1:])))
            cols |= {k: pa.array(v.astype(np.int64)) for k, v in figures.items()}
            cols["_lines"] = T.list_array(items, bounds)
            found, size = [*found, pa.RecordBatch.from_pydict(cols)], size + len(data)
            if size >= T.SLICE_BYTES or hi == batch.num_rows:
                yield pa.concat_batches(found)
                found, size = [], 0


_SCHEMA = ("_row long, _id long, _host string, _body long, " + ", ".join(f"{c} long" for c in FIGURES)
           + ", _lines array<struct<line: long, words: long>>")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.monotonically_increasing_id())


def _scanned(rows: DataFrame, text: str, doc_id: str, host: str) -> DataFrame:
    """Figures and line hashes of each numbered row, written once."""
    scanned = rows.select("_row", F.col(doc_id).cast("long").alias("_id"),
                          F.col(host).cast("string").alias("_host"),
                          F.col(text).alias("_text")).mapInArrow(_scan, _SCHEMA)
    return materialise(scanned, "lines")


def _over_limit(scanned: DataFrame, min_docs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """All lines (row, host, line, words), and the (host, line) pairs above the limit."""
    host = F.coalesce(F.concat(F.lit("="), "_host"), F.lit("")).alias("_host")
    lines = scanned.select("_row", "_body", host, F.explode("_lines").alias("_l")).select("_row", "_body", "_host", "_l.*")
    hosts = scanned.groupBy(host).agg(F.count_distinct("_body").alias("_docs"))
    counts = (lines.groupBy("_host", "line").agg(F.count_distinct("_body").alias("n_docs"))
              .filter(F.col("n_docs") > min_docs))
    over = counts.join(hosts, "_host").filter(F.col("n_docs") > F.col("_docs") * share).select("_host", "line")
    return lines, over


def _verdicts(scanned: DataFrame, hits: DataFrame) -> DataFrame:
    lost = hits.groupBy("_row").agg(F.sum("words").alias("n_removed_words"),
                                    F.count("*").alias("n_removed_lines"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & (
        (left < MIN_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (scanned.drop("_lines", "_body").join(lost, "_row", "left")
            .fillna(0, ["n_removed_words", "n_removed_lines"])
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ~depleted))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source",
          min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """One row for each document: its figures, removed lines and words, and the verdict."""
    scanned = _scanned(_numbered(docs.select(text, doc_id, host)), text, doc_id, host)
    lines, over = _over_limit(scanned, min_docs, share)
    hits = lines.join(over, ["_host", "line"], "left_semi")
    return _verdicts(scanned, hits).select(
        F.col("_id").alias(doc_id), *FIGURES, "n_removed_lines", "n_removed_words",
        "base_failed", "kept")


def _strip(batches: Iterator[pa.RecordBatch], text: str, n_chars: str | None,
           names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("_gone")
        touched = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist()
        cols = {n: batch.column(n) for n in names}
        if touched:
            texts = cols[text].to_pylist()
            for i in touched:
                raw = texts[i].encode()
                data = np.frombuffer(raw, dtype=np.uint8)
                key, _, start, end, _ = line_keys(data, np.array([0, len(data)]))
                drop = np.isin(T.signed(key), np.array(gone[i].as_py(), dtype=np.int64))
                kept, at = [], 0
                for s, e in zip(start[drop].tolist(), end[drop].tolist()):
                    kept.append(raw[at:s])
                    at = min(e + 1, len(raw))
                texts[i] = b"".join([*kept, raw[at:]]).decode()
            cols[text] = pa.array(texts, batch.schema.field(text).type)
            if n_chars:
                sizes = cols[n_chars].to_pylist()
                for i in touched:
                    sizes[i] = len(texts[i])
                cols[n_chars] = pa.array(sizes, batch.schema.field(n_chars).type)
        yield pa.RecordBatch.from_pydict(cols)


@keeps_columns("_row", "_gone")
def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source",
          n_chars: str | None = "n_chars", min_docs: int = MIN_DOCS,
          share: float = SHARE) -> DataFrame:
    """The kept documents with all their columns, without the lines above the limits."""
    rows = materialise(_numbered(docs), "numbered")
    scanned = _scanned(rows, text, doc_id, host)
    lines, over = _over_limit(scanned, min_docs, share)
    hits = materialise(lines.join(over, ["_host", "line"], "left_semi"), "line-hits")
    kept = _verdicts(scanned, hits).filter("kept").select("_row")
    gone = hits.groupBy("_row").agg(F.collect_set("line").alias("_gone"))
    joined = rows.join(kept.join(gone, "_row", "left"), "_row").drop("_row")
    names, sizes = docs.columns, n_chars if n_chars in docs.columns else None
    return joined.mapInArrow(lambda it: _strip(it, text, sizes, names), docs.schema)
