"""Fill-in-the-middle transformation over texts in seekable compressed frames.

Three passes, each a job whose tasks write files of frames (see `frames`) and a table of places:

1. `store` compresses every text once, in frames, with its units and whether it holds a mark.
2. `transform` draws two cuts for each text from a digest of its id, decompresses the frames that hold the cuts to find their bytes, and streams
   the frames of prefix, middle and suffix in the order of the form into a new file.
3. `restore` streams the frames of the output for its digest, finds the marks in it, and streams the parts
   in the order of the text for the digest of the restored text. `texts` returns outputs as a column.

No pass holds more than a few frames of a text beside what Spark hands over. Files are named in the tables, so
a repeated task leaves unused files and disturbs nothing.

Units are code points. The digest of `seed` and the decimal id gives four numbers h1 .. h4; the prefix
ends after the smaller and the middle after the larger of h1 % (n + 1) and h2 % (n + 1) units. A text is left plain if it is empty, holds a
mark, or h3 % 100 reaches `rate`; else the suffix comes first (spm) if h4 % 100 is under `spm_rate`.

Defined cases: a null text is empty. A null id counts as an empty one in the digest. Repeated rows are
transformed each, alike. No documents give no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T
from .files import new_folder
from .frames import FILE_BYTES, FRAME_BYTES, FrameReader, FrameWriter

RATE, SPM_RATE, SEED = 90, 20, "1:"
# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_ANY_MARK = "<[PSM]>"
_PLACE = "path string, first_unit long, first_byte long, n_units long, n_bytes long"
_OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, path string, first_byte long, n_bytes long"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    named = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(named)})


def _store(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    out, n_units = None, 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        marked = pc.match_substring_regex(texts, _ANY_MARK)
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy()
        for lo, hi, data, offsets in T.text_slices(texts):
            if out is None or out.written >= file_bytes:
                if out:
                    out.close()
                out, n_units = FrameWriter(folder, frame_bytes), 0
            n = sizes[lo:hi]
            ends = n_units + n.cumsum()
            k = hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, k), marked.slice(lo, k), pa.array([out.path] * k), pa.array(ends - n, pa.int64()),
                 pa.array(out.n_bytes + offsets[:-1], pa.int64()), pa.array(n, pa.int64()),
                 pa.array(offsets[1:] - offsets[:-1], pa.int64())],
                names=["doc_id", "marked", "path", "first_unit", "first_byte", "n_units", "n_bytes"])
            out.add(data.data)
            n_units = int(ends[-1])
    if out:
        out.close()


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", frame_bytes: int = FRAME_BYTES,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all texts to frames; returns doc_id, marked and the place of each text."""
    folder = new_folder(docs.sparkSession, "frames")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(lambda it: _store(it, folder, frame_bytes, file_bytes),
                                       f"doc_id long, marked boolean, {_PLACE}"), "frame-places")


def _number(seed: str, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def plan(stored: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """The places with the cuts (in units of the text) and the form."""
    h = [_number(seed, g) for g in range(4)]
    one, two = h[0] % (F.col("n_units") + 1), h[1] % (F.col("n_units") + 1)
    plain = (F.col("n_units") == 0) | F.col("marked") | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    return stored.select("*", F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi"), form.alias("form"))


def _by_path(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[tuple]:
    """work(reader, row) for each row, with one open file at a time."""
    reader, path = None, None
    try:
        for batch in batches:
            names = batch.schema.names
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                row = dict(zip(names, values))
                if row["path"] != path:
                    if reader:
                        reader.close()
                    reader, path = FrameReader(row["path"]), row["path"]
                yield work(reader, row)
    finally:
        if reader:
            reader.close()


def _transform(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    out: FrameWriter | None = None

    def work(source: FrameReader, row: dict) -> tuple:
        nonlocal out
        if out is None or out.written >= file_bytes:
            if out:
                out.close()
            out = FrameWriter(folder, frame_bytes)
        start, first = out.n_bytes, row["first_byte"]
        end, form = first + row["n_bytes"], row["form"]
        if form == "plain":
            parts, lengths = [(first, end)], (None, None)
        else:
            a, b = (source.byte_of(row["first_unit"] + row[c]) if row[c] < row["n_units"] else end for c in ("lo", "hi"))
            prefix, middle, suffix = (PREFIX, first, a), (MIDDLE, a, b), (SUFFIX, b, end)
            parts = [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle]
            lengths = row["lo"], row["hi"] - row["lo"]
        for *mark, lo, hi in parts:
            for m in mark:
                out.add(m)
            for chunk in source.chunks(lo, hi):
                out.add(chunk)
        return (row["doc_id"], row["n_units"], form, *lengths, out.path, start, out.n_bytes - start)

    rows = []
    for row in _by_path(batches, work):
        rows.append(row)
        if len(rows) >= 10_000:
            yield _batch(_OUTPUT, rows)
            rows = []
    if out:
        out.close()
    yield _batch(_OUTPUT, rows)


def transform(planned: DataFrame, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the outputs to frames; returns doc_id, n, form, prefix_chars, middle_chars and the place of each output."""
    folder = new_folder(planned.sparkSession, "infill")
    return materialise(planned.mapInArrow(lambda it: _transform(it, folder, frame_bytes, file_bytes), _OUTPUT), "infill-places")


def parts_of(reader: FrameReader, start: int, end: int, form: str) -> list[tuple[int, int]]:
    """The places of prefix, middle and suffix in an output, as its marks tell."""
    if form == "plain":
        return [(start, end)]
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places, at = {}, start
    for mark in order:
        found = reader.find(mark, at, end)
        if found < 0:
            raise ValueError(f"an output of form {form} lacks {mark.decode()}")
        places[mark] = found
        at = found + len(mark)
    ends = dict(zip(order, [places[order[1]], places[order[2]], end]))
    return [(places[m] + len(m), ends[m]) for m in (PREFIX, MIDDLE, SUFFIX)]


def _digest(reader: FrameReader, parts: list[tuple[int, int]]) -> str:
    sha = hashlib.sha256()
    for lo, hi in parts:
        for chunk in reader.chunks(lo, hi):
            sha.update(chunk)
    return sha.hexdigest()


_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(reader: FrameReader, row: dict) -> tuple:
        start, end = row["first_byte"], row["first_byte"] + row["n_bytes"]
        whole = _digest(reader, [(start, end)])
        restored = whole if row["form"] == "plain" else _digest(reader, parts_of(reader, start, end, row["form"]))
        return (*(row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")), whole, restored)

    rows = []
    for row in _by_path(batches, work):
        rows.append(row)
        if len(rows) >= 10_000:
            yield _batch(_DIGESTS, rows)
            rows = []
    yield _batch(_DIGESTS, rows)


def restore(outputs: DataFrame) -> DataFrame:
    """Digests of every output and of the text rebuilt from it: doc_id, n, form, lengths, output_sha256, restored_sha256."""
    return outputs.mapInArrow(_restore, _DIGESTS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(reader: FrameReader, row: dict) -> tuple:
        chunks = reader.chunks(row["first_byte"], row["first_byte"] + row["n_bytes"])
        return row["doc_id"], row["form"], b"".join(chunks).decode()

    for row in _by_path(batches, work):
        yield _batch("doc_id long, form string, output string", [row])


def texts(outputs: DataFrame) -> DataFrame:
    """(doc_id, form, output): the transformed texts themselves."""
    return outputs.mapInArrow(_texts, "doc_id long, form string, output string")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE,
            seed: str = SEED, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Store, transform and restore all texts; one row of digests for each."""
    placed = plan(store(docs, text, doc_id, frame_bytes), rate, spm_rate, seed)
    return restore(transform(placed, frame_bytes)).withColumnRenamed("doc_id", doc_id)
