"""Token ids in Arrow stream files with equal-length sequences and masks.

A file is one Arrow IPC stream. Each batch holds `rows` sequences (the last one fewer) in two
fixed-size-list columns of `length`: `ids` (uint16, or uint32 for vocabularies over 65,536) and
`mask` (one bit: token or padding). All batches but the last have equal byte sizes, so sequence i lies in batch
i // rows, at an offset that follows from the sizes of schema and batch: a reader maps the file
and takes any sequence without parsing or copying (`open_sequences`). A second stream file next to it
lists the documents of the file: doc_id, their first token in the file and their number of tokens.

Documents are sorted by id over all tasks; each task tokenizes its range and writes one pair of
files under names of their own for each attempt. A written table of the files (the manifest) decides which
belong to the output; offsets over all files are the running sum of its token counts.

Tokenizing: texts are cut before white space that follows another character, where this pre-tokenizer never joins
pieces, and equal pieces of a slice of text are encoded once. Texts with other Unicode white space or with a
special token's string are encoded as a whole.

Defined cases: a null or empty text has only the end id. Documents without an id come first.
Repeated rows are written each. No documents give no files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as T
from .files import file_system, new_folder, new_name

LENGTH, ROWS, END_ID = 2_048, 256, 0
CACHE_PIECES, SLICE_BYTES = 1_000_000, 4 << 20
TEXT_PIECES, TEXTS, HASH_PIECES = 512, 100, 8_192  # pieces encoded as one text, such texts in a call, pieces hashed at a time
# Unicode white space beyond ASCII blanks and line ends.
_OTHER_SPACE = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                0x205F, 0x3000)
_WHOLE = re.compile("[" + "".join(map(chr, _OTHER_SPACE)) + "]|<[|]")
# The first bytes of what the expression finds: without any of them, there is nothing to search for.
_MAYBE_WHOLE = np.zeros(256, dtype=bool)
_MAYBE_WHOLE[[chr(c).encode()[0] for c in _OTHER_SPACE] + [ord("<")]] = True
_BLANKS = frozenset(np.flatnonzero(T.SPACE).tolist())


class Encoder:
    """Encodes slices of texts with a byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = id_type(size)
        # A token of a byte-level vocabulary is written with one character for each of its bytes.
        self.byte_size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = pieces
        # Pieces that begin with white space can stand side by side without changing each other.
        side, alone = [], []
        for p in new:
            (side if p[0] in _BLANKS and p[-1] not in _BLANKS else alone).append(p)
        for p, ids in zip(alone, self._encode([p.decode() for p in alone])):
            cache[p] = ids.tobytes()
        for a in range(0, len(side), TEXT_PIECES * TEXTS):
            part = side[a:a + TEXT_PIECES * TEXTS]
            ids = np.concatenate(self._encode([b"".join(part[b:b + TEXT_PIECES]).decode()
                                               for b in range(0, len(part), TEXT_PIECES)]))
            ends = np.cumsum(self.byte_size[ids])
            at = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(p) for p in part])) + 1])
            raw, at = ids.tobytes(), (at * ids.itemsize).tolist()
            for p, lo, hi in zip(part, at, at[1:]):
                cache[p] = raw[lo:hi]
        return [cache[p] for p in pieces]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts of a slice."""
        n = len(data)
        space = T.SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[1:n] = space[1:] & ~space[:-1]
        first[offsets] = True
        starts = np.flatnonzero(first)
        starts = starts[starts < n]
        ends = np.append(starts[1:], n)
        keys = np.zeros(len(starts), dtype=np.uint64)
        for a in range(0, len(starts), HASH_PIECES):  # the arrays of a part stay small
            lo, hi = starts[a:a + HASH_PIECES], ends[a:a + HASH_PIECES]
            keys[a:a + HASH_PIECES] = T.byte_spans(data[lo[0]:hi[-1]], lo - lo[0], hi - lo[0])
        inverse, _ = pd.factorize(keys)  # numbered in the order of their first occurrences
        upto = np.maximum.accumulate(np.append(-1, inverse))
        at = np.flatnonzero(upto[1:] > upto[:-1])
        raw = data.tobytes()
        found = self._pieces([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
        pool = np.frombuffer(b"".join(found), dtype=self.kind)
        sizes = np.array([len(f) for f in found], dtype=np.int64) // pool.itemsize
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        lengths = sizes[inverse]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(begin[inverse] - before[:-1], lengths) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds) of slices of a column."""
        for lo, hi, data, offsets in T.text_slices(column, SLICE_BYTES):
            ids, bounds = self.encode(data, offsets)
            raw = data.tobytes()
            odd = {}
            if _MAYBE_WHOLE[data].any() and _WHOLE.search(raw.decode()):
                for i in range(hi - lo):
                    text = raw[offsets[i]:offsets[i + 1]].decode()
                    if _WHOLE.search(text):
                        odd[i] = text
            if odd:
                parts = [ids[bounds[i]:bounds[i + 1]] for i in range(hi - lo)]
                for i, whole in zip(odd, self._encode(list(odd.values()))):
                    parts[i] = whole
                ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield lo, hi, ids, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _schema(length: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Fills batches of sequences from documents that come in order."""

    def __init__(self, folder: str, length: int, rows: int, kind: type):
        self.path, self.length, self.size, self.kind = new_name(folder, ".arrow"), length, length * rows, kind
        system, inner = file_system(self.path)
        self.streams = [system.open_output_stream(inner), system.open_output_stream(f"{inner}.docs")]
        self.tokens = pa.ipc.new_stream(self.streams[0], _schema(length, kind))
        self.docs = pa.ipc.new_stream(self.streams[1], _INDEX)
        self.ids = np.zeros(0, kind)
        self.total = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents with their ids; the end id is already in."""
        self.docs.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(self.total + bounds[:-1]), pa.array(np.diff(bounds))], schema=_INDEX))
        self.total, self.n_docs = self.total + len(ids), self.n_docs + len(doc_ids)
        self.ids = np.concatenate([self.ids, ids])
        whole = len(self.ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self._batch(self.ids[at:at + self.size])
        self.ids = self.ids[whole:]

    def _batch(self, ids: np.ndarray) -> None:
        mask = np.arange(-(-len(ids) // self.length) * self.length) < len(ids)
        ids = np.pad(ids, (0, len(mask) - len(ids)))
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(arrays, schema=_schema(self.length, self.kind)))

    def close(self) -> None:
        if len(self.ids):
            self._batch(self.ids)
        for x in (self.tokens, self.docs, *self.streams):
            x.close()


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, length: int, rows: int,
           end_id: int) -> Iterator[pa.RecordBatch]:
    coder, out, first = encoder(tokenizer), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out, first = _Writer(folder, length, rows, coder.kind), batch.column(0)[0].as_py()
        for lo, hi, ids, bounds in coder.encode_column(batch.column(1)):
            ids = np.insert(ids, bounds[1:], coder.kind(end_id))
            out.add(batch.column(0).slice(lo, hi - lo), ids, bounds + np.arange(len(bounds)))
    done = []
    if out is not None:
        out.close()
        done = [(out.path, first, out.n_docs, out.total)]
    kinds = (("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()))
    yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], k) for i, (n, k) in enumerate(kinds)})


def write(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
          length: int = LENGTH, rows: int = ROWS, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the manifest: path, first_id, n_docs, n_tokens, start."""
    folder = new_folder(docs.sparkSession, "tokens")
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    files = materialise(ordered.mapInArrow(
        lambda it: _write(it, tokenizer, folder, length, rows, end_id),
        "path string, first_id long, n_docs long, n_tokens long"), "token-files")
    # One row for each file; equal ids share a file, so the first ids order the files.
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Sequences:
    """Random access to the sequences of one file, without copying."""

    def __init__(self, buffer: pa.Buffer):
        self.buffer = buffer
        reader = pa.ipc.MessageReader.open_stream(pa.BufferReader(buffer))
        self.schema = pa.ipc.read_schema(reader.read_next_message())
        self.length = self.schema.field("ids").type.list_size
        source = pa.BufferReader(buffer)
        pa.ipc.read_message(source)
        self.head = source.tell()
        message = pa.ipc.read_message(source)
        self.step = source.tell() - self.head
        self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows
        self._last: tuple[int, list[pa.Array]] = (-1, [])

    def batch(self, b: int) -> pa.RecordBatch:
        at = self.head + b * self.step
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.buffer.slice(at)), self.schema)

    def _flat(self, b: int) -> list[pa.Array]:
        """Ids and mask of a batch as flat views; the last one stays open, since documents come in order."""
        if self._last[0] != b:
            batch = self.batch(b)
            self._last = b, [batch.column(c).flatten() for c in range(2)]
        return self._last[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i, as views of the file."""
        b, r = divmod(i, self.rows)
        ids, mask = (v.slice(r * self.length, self.length) for v in self._flat(b))
        return ids.to_numpy(), mask

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n ids from position `first`; copies only across batches."""
        size = self.rows * self.length
        parts = []
        while n:
            b, at = divmod(first, size)
            k = min(n, size - at)
            ids, mask = (v.slice(at, k) for v in self._flat(b))
            if mask.true_count != k:
                raise ValueError("padding inside a document")
            parts.append(ids.to_numpy())
            first, n = first + k, n - k
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def open_sequences(path: str) -> Sequences:
    """Maps a local file; a file elsewhere is read into one buffer."""
    system, inner = file_system(path)
    if system.type_name == "local":
        return Sequences(pa.memory_map(inner).read_buffer())
    with system.open_input_file(inner) as f:
        return Sequences(f.read_buffer())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            sequences = open_sequences(path)
            system, inner = file_system(f"{path}.docs")
            with system.open_input_file(inner) as f:
                for docs in pa.ipc.open_stream(f):
                    sums = [zlib.crc32(np.ascontiguousarray(sequences.tokens(first, n), dtype="<u4"))
                            for first, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": docs.column(0), "start": pa.array(docs.column(1).to_numpy() + start),
                        "n_tokens": docs.column(2), "ids_crc32": pa.array(sums, pa.int64())})


def read(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    tasks = max(1, manifest.count())
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
