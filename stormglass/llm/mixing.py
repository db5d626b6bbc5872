"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is the sequence of its lower-cased words and an end, and the model predicts the bits of that whole token
sequence. A token is coded by a bit that tells whether it is known (stands in a training text) and then

* *known:* 16 bits (the class it is most used in, and 12 bits of its hash), and last the word among the training words
  with the same bits by its count;
* *unknown:* the bits of its bytes and a closing blank.

Each of the 17 bits is predicted in four contexts that reach over word borders: none, the likeliest class of the text
by the words before, the last word, the last two words (the latter two hashed to tables of fixed size). If the last
two words stood in the text before, the word that followed them gives a fifth prediction, of each bit
as long as the bits agree with it. Stretched predictions are mixed by weights that a gate selects (place of the bit,
longest context seen, state of the copy), and an adaptive probability map refines the mixed prediction. The bytes
of unknown words are predicted in contexts of the last 0 to 4 bytes in the same way. The word bits with no context are
the counts of all training words, so nothing of the vocabulary is lost to collisions.

Learning takes two scans of the training texts. The first counts the bits in all contexts. The second learns the
weights online, one small batch after the other through all texts of a task; tasks are averaged by their tokens. A
bit is predicted there without its own count, and a word is known if it stands in another training text.

The classes are a hash of the language column of training texts; the column is never an input of a score.
The vocabulary grows with the corpus and is never sent to the driver or broadcast: texts are written in chunks (the
partitions of the scan), the counts of each chunk's distinct words are summed by word and sent back to the chunk, whose
task reads its own part. What goes to all tasks and to the driver has a fixed size: 2.2 million counts of word
bits, 1.4 million of bytes, weights and maps. Tables of tasks are added by Spark, in segments.

Defined cases: a null or empty text is the end alone. A null id is in the training part. Repeated
rows count and are scored each. Without training words the base score is that of an empty model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch_path
from . import text as T
from .files import file_system

CLASSES = 16
CODE, CLASS_BITS = 16, 4   # bits of a known token; of them for its class
LINE_BITS = 15            # a hashed context has 2 ** 15 lines of 16 slots, one line for four bits
ORDERS = ((0, 8), (1, 16), (2, 18), (3, 19), (4, 19))  # bytes of context, bits of the table
SEGMENTS = 64
BATCH, RATE, SHARE_OTHER = 2_048, 0.02, 0.05
GATES, BUCKETS = 40, 33
HISTORY = 16
HELD_WORDS = 800_000      # distinct words of slices kept before a chunk's part is written
PIECE_BYTES, SLICE_BYTES = 4_096, 1 << 16  # spelling: longest piece of a word, bytes at a time
END = b"\n"
_END_HASH = int(T.byte_spans(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))[0])
_START = np.cumsum([0, *(1 << b for _, b in ORDERS)])
SLOTS = int(_START[-1])


# Words and copies of a slice of texts

def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the tokens; each text ends with the end token."""
    low = T.LOWER[data]
    starts, ends, bounds = T.word_spans(low, offsets)
    h = np.insert(T.byte_spans(low, starts, ends), bounds[1:], np.uint64(_END_HASH))
    return h, starts, ends, bounds + np.arange(len(bounds))


def guesses(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gate, then) of each token: the place of the guessed token, gate 0 where nothing is guessed.

    The gate holds the last results of guessing in the text as a binary number with a leading 1.
    """
    n = len(h)
    gate, guess = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    row = T.row_of(bounds)
    at = np.flatnonzero(row[2:] == row[:-2]) + 2 if n > 2 else np.zeros(0, np.int64)
    if not len(at):
        return gate, guess
    key = T.mix(h[at - 2] * np.uint64(3) + h[at - 1]) ^ T.mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.lexsort((at, key))
    k, p = key[order], at[order]
    same = k[1:] == k[:-1]
    now, then = p[1:][same], p[:-1][same]
    sort = np.argsort(now)
    now, then = now[sort], then[sort]
    guess[now] = then
    state = np.ones(len(now), dtype=np.int64)  # results of the last three guesses of the text
    r, ok = row[now], (h[now] == h[then]).astype(np.int64)
    for back in (3, 2, 1):
        have = np.zeros(len(now), dtype=bool)
        have[back:] = r[back:] == r[:-back]
        last = np.zeros(len(now), dtype=np.int64)
        last[back:] = ok[:-back]
        state = np.where(have, state * 2 + last, state)
    gate[now] = np.minimum(state, HISTORY - 1)
    return gate, guess


def _code(h: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
    """The first bits of the hash, after those of the class if given."""
    if cls is None:
        return (h >> np.uint64(64 - CODE)).astype(np.int64)
    return (h >> np.uint64(64 - CODE + CLASS_BITS)).astype(np.int64) | cls.astype(np.int64) << (CODE - CLASS_BITS)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a chunk with their training counts and main class; and training tokens by hash and class.

    Rows: chunk, h, n, cls. A row without chunk has a segment of the second table.
    """
    parts: list[tuple] = []
    classes = np.zeros((1 << CODE, CLASSES), dtype=np.int32)
    chunk = None

    def close() -> Iterator[pa.RecordBatch]:
        if parts:
            h, n, cls = _merged(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            parts.clear()
            for a in range(0, len(h), 100_000):
                part = T.signed(h[a:a + 100_000])
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([chunk] * len(part), pa.int64()), "h": pa.array(part, pa.int64()),
                    "n": pa.array(n[a:a + 100_000], pa.int64()), "cls": pa.array(cls[a:a + 100_000], pa.int32()),
                    "counts": pa.nulls(len(part), pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = batch.column("chunk").to_numpy()
        for lo, hi, data, offsets in T.text_slices(batch.column("text")):
            for a, b in _runs(chunks[lo:hi]):
                if chunks[lo + a] != chunk:
                    yield from close()
                    chunk = int(chunks[lo + a])
                h, _, _, bounds = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                row = T.row_of(bounds)
                train = ~batch.column("held_out").slice(lo + a, b - a).to_numpy(zero_copy_only=False)[row]
                cls = batch.column("cls").slice(lo + a, b - a).to_numpy()[row]
                np.add.at(classes, (_code(h[train]), cls[train]), 1)
                parts.append(_merged(h, train.astype(np.int64), cls))
                if sum(len(p[0]) for p in parts) > HELD_WORDS:
                    yield from close()
    yield from close()
    for i, counts in _segments(classes):
        yield pa.RecordBatch.from_pydict({"chunk": pa.nulls(1, pa.int64()), "h": pa.array([i], pa.int64()),
                                          "n": pa.nulls(1, pa.int64()), "cls": pa.nulls(1, pa.int32()), "counts": [counts]})


def _merged(h: np.ndarray, n: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, with the sum of n and the class that has most of it."""
    _, first, inverse = np.unique(T.mix(h + cls.astype(np.uint64)), return_index=True, return_inverse=True)
    h, cls = h[first], cls[first]
    n = np.bincount(inverse, weights=n, minlength=len(first)).astype(np.int64)
    order = np.lexsort((cls, n, h))
    h, n, cls = h[order], n[order], cls[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[start], np.add.reduceat(n, start), cls[np.append(start[1:], len(h)) - 1]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.diff(values)) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(values)]))


# Tables of tasks, added in segments

def _segments(values: np.ndarray) -> list[tuple[int, bytes]]:
    return [(i, part.tobytes()) for i, part in enumerate(np.array_split(values.ravel(), SEGMENTS))]


def _segment_rows(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for i, part in _segments(values):
        yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int64()), "task": pa.array([task], pa.int64()),
                                          "counts": [part]})


def _added(parts: DataFrame, size: int, kind: type) -> np.ndarray:
    """The sum of the tables in rows (segment, task, counts)."""
    sums = np.float64 if np.issubdtype(kind, np.floating) else np.int64
    narrow = np.float64 if np.issubdtype(kind, np.floating) else np.float32

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for part in table.sort_by("task").column("counts"):
            total = total + np.frombuffer(part.as_buffer(), dtype=kind).astype(sums)
        return pa.table({"segment": table.column("segment").slice(0, 1), "counts": [total.astype(narrow).tobytes()]})

    out, places = np.zeros(size, dtype=narrow), np.array_split(np.arange(size), SEGMENTS)
    for r in parts.groupBy("segment").applyInArrow(add, "segment long, counts binary").toLocalIterator():
        out[places[r[0]]] = np.frombuffer(r[1], dtype=narrow)
    return out


# Spelling

def _groups(words: list[bytes], most: int = BATCH) -> Iterator[list[bytes]]:
    """The words in order, in lists of at most `most` words and about SLICE_BYTES bytes."""
    group, size = [], 0
    for w in words:
        group.append(w)
        size += len(w)
        if len(group) >= most or size >= SLICE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _pieces(words: list[bytes]) -> list[bytes]:
    """The words, very long ones in pieces that repeat the last four bytes of the piece before."""
    return [w if len(w) <= PIECE_BYTES else piece for w in words for piece in (
        [w] if len(w) <= PIECE_BYTES else
        [w[max(0, a - 4):a + PIECE_BYTES] for a in range(0, len(w), PIECE_BYTES)])]


def _bits(words: list[bytes]):
    """Table slots (orders x bits), bits, and bounds of the bits of each word."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(len(data)) - np.repeat(bounds[:-1], lengths)
    shift = np.arange(8)
    node = (data[:, None] | 256) >> (8 - shift)[None, :]  # the bits before, with a leading 1
    bit = (data[:, None] >> (7 - shift)[None, :]) & 1
    slots, context = [], np.zeros(len(data), dtype=np.uint64)
    for k, (order, width) in enumerate(ORDERS):
        if order:
            past = np.zeros(len(data), dtype=np.uint64)
            past[order:] = data[:-order]
            past[place == order - 1] = 32
            past[place < order - 1] = 0
            context = context * np.uint64(256) + past
        if order <= 1:
            slot = context[:, None].astype(np.int64) * 256 + node
        else:
            slot = (T.mix(context[:, None] * np.uint64(512) + node.astype(np.uint64) + np.uint64(order << 56))
                    >> np.uint64(64 - width)).astype(np.int64)
        slots.append((slot + _START[k]).astype(np.int32).ravel())
    return np.stack(slots), bit.ravel(), bounds * 8, node.ravel()


def _count_bytes(words: list[bytes], counts: np.ndarray) -> None:
    """Add to `counts` (2 x slots) how often each slot saw a 0 and a 1."""
    for group in _groups(_pieces(words), 4 * BATCH):
        slots, bit, _, _ = _bits(group)
        for value in (0, 1):
            counts[value] += np.bincount(slots[:, bit == value].ravel(), minlength=SLOTS).astype(counts.dtype)


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Speller:
    """The spelling model: count tables, mixing weights, adaptive map."""

    counts: np.ndarray              # 2 x slots
    weights: np.ndarray | None = None
    map: np.ndarray | None = None   # 256 partial bytes x buckets

    def inputs(self, slots: np.ndarray, bit: np.ndarray | None = None):
        """Stretched predictions (orders + bias x bits) and the gate of each bit.

        With `bit`, the word's own counts are left out.
        """
        zero, one = self.counts[0][slots].astype(np.float64), self.counts[1][slots].astype(np.float64)
        if bit is not None:
            zero, one = np.maximum(zero - (1 - bit), 0), np.maximum(one - bit, 0)
        seen = zero + one
        x = np.empty((len(ORDERS) + 1, slots.shape[1]))
        x[:-1] = _stretch((one + 0.2) / (seen + 0.4))
        x[-1] = 0.3
        known = (seen[1:] > 0).sum(axis=0)
        return x, known * 8 + np.arange(slots.shape[1]) % 8

    @staticmethod
    def bucket(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(x, -7.999, 7.999) + 8) * (BUCKETS - 1) / 16
        low = at.astype(np.int64)
        return low, at - low

    def learn(self, words: list[bytes], w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Online pass: mixing weights (given ones go on), and counts (ones, all) of the map's buckets."""
        w = np.full((GATES, len(ORDERS) + 1), 0.3) if w is None else w
        seen = np.zeros((2, 256 * BUCKETS))
        for group in _groups(_pieces(words)):
            slots, bit, _, node = _bits(group)
            x, gate = self.inputs(slots, bit)
            mixed = (w[gate] * x.T).sum(axis=1)
            error = bit - _squash(mixed)
            n = np.maximum(1, np.bincount(gate, minlength=GATES))
            for i in range(len(w[0])):
                step = np.bincount(gate, weights=error * x[i], minlength=GATES)
                w[:, i] += RATE * step / np.sqrt(n)
            low, part = self.bucket(mixed)
            for at, share in ((low, 1 - part), (low + 1, part)):
                cell = node * BUCKETS + at
                seen[0] += np.bincount(cell, weights=share * bit, minlength=256 * BUCKETS)
                seen[1] += np.bincount(cell, weights=share, minlength=256 * BUCKETS)
        return w, seen

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The logarithm of the probability of each word with its closing blank."""
        if max(map(len, words)) > PIECE_BYTES:
            return np.array([self._long(w) if len(w) > PIECE_BYTES else self._bit_logs([w])[0].sum() for w in words])
        logs, bounds = self._bit_logs(words)
        return np.add.reduceat(logs, bounds[:-1])

    def _long(self, word: bytes) -> float:
        total, pieces = 0.0, _pieces([word])
        for i, piece in enumerate(pieces):
            logs, _ = self._bit_logs([piece])
            # The repeated bytes are context only; just the last piece closes the word.
            total += logs[32 * (i > 0):len(logs) - 8 * (i < len(pieces) - 1)].sum()
        return total

    def _bit_logs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        slots, bit, bounds, node = _bits(words)
        x, gate = self.inputs(slots)
        mixed = (self.weights[gate] * x.T).sum(axis=1)
        low, part = self.bucket(mixed)
        at = node * BUCKETS + low
        p = (_squash(mixed) + self.map[at] * (1 - part) + self.map[at + 1] * part) / 2
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log10(np.where(bit == 1, p, 1 - p)), bounds


def _map_of(seen: np.ndarray) -> np.ndarray:
    centre = _squash(np.tile(np.linspace(-8, 8, BUCKETS), len(seen[0]) // BUCKETS))
    return (seen[0] + 4 * centre) / (seen[1] + 4)


# Bits of the token sequence

DEPTH = CODE + 1
LINES = 16 << LINE_BITS
_SIZES = (1 << CODE, CLASSES << CODE, LINES, LINES)
_PLACE = np.cumsum([0, *_SIZES])
TOKEN_SLOTS = int(_PLACE[-1])
INPUTS = len(_SIZES) + 2          # contexts, copy, bias
COPY_STATES = 3                   # no guess, one after a miss or the first, one after a hit
TOKEN_GATES = DEPTH * 3 * COPY_STATES
MAP_ROWS = DEPTH * COPY_STATES
TOKENS, STEP = 2_048, 0.1         # of a learning step: tokens, part of the way


@dataclass
class Slice:
    """Token sequences of some texts, with what a prediction may know."""

    h: np.ndarray
    bounds: np.ndarray
    code: np.ndarray
    c: np.ndarray        # training count
    known: np.ndarray
    contexts: list[np.ndarray]
    gate: np.ndarray     # of the copy, 0 without a guess
    hit: np.ndarray
    guess: np.ndarray    # the place of the guessed token
    spelled: tuple[np.ndarray, np.ndarray, bytes]

    def words(self, at: np.ndarray) -> list[bytes]:
        starts, ends, raw = self.spelled
        return [END if e < 0 else raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]


def _slice(data: np.ndarray, offsets: np.ndarray, words: "_Dictionary", classes: np.ndarray, other_texts: bool) -> Slice:
    """With `other_texts`, a word is known if another text of the training part has it."""
    h, starts, ends, bounds = tokens(data, offsets)
    row = T.row_of(bounds)
    at = np.searchsorted(words.h, h)
    c = words.c[at]
    known = c > 0
    if other_texts:
        key = T.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        known = c > own[inverse]
    first = np.zeros(len(h), dtype=bool)
    first[bounds[:-1]] = True
    last = np.concatenate([[np.uint64(0)], h[:-1]])
    last[first] = 0
    before = np.concatenate([[np.uint64(0)], last[:-1]])
    before[first] = 0
    # The likeliest class by the words before, in each text.
    sums = np.zeros((len(h) + 1, classes.shape[1]))
    np.cumsum(classes[_code(h)], axis=0, out=sums[1:])
    cls = (sums[:-1] - sums[bounds[:-1]][row]).argmax(axis=1)
    gate, guess = guesses(h, bounds)
    place = np.full((2, len(h)), -1, dtype=np.int64)
    is_word = np.ones(len(h), dtype=bool)
    is_word[bounds[1:] - 1] = False
    place[0, is_word], place[1, is_word] = starts, ends
    return Slice(h, bounds, _code(h, words.cls[at]), c, known, [cls, T.mix(last + np.uint64(1)), T.mix(before * np.uint64(3) + last)], gate,
                 (gate > 0) & (h == h[guess]), guess, (place[0], place[1], T.LOWER[data].tobytes()))


def _code_bits(known: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.concatenate([known[:, None], (code[:, None] >> np.arange(CODE - 1, -1, -1)) & 1], axis=1).astype(np.int8)


def _token_bits(s: Slice, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bits) of some tokens: contexts x tokens x depth, tokens x depth."""
    code = s.code[part][:, None]
    j = np.arange(CODE)
    node = np.zeros((len(code), DEPTH), dtype=np.int64)
    node[:, 1:] = (1 << j) | (code >> (CODE - j))
    bit = _code_bits(s.known[part], s.code[part])
    slots = np.empty((len(_SIZES), *node.shape), dtype=np.int64)
    slots[0] = node
    slots[1] = node + (_PLACE[1] + (s.contexts[0][part] << CODE))[:, None]
    inner = np.zeros_like(node)
    inner[:, 1:] = (1 << (j & 3)) | ((code >> (CODE - j)) & ((1 << (j & 3)) - 1))
    stem = node[:, 1::4].astype(np.uint64)  # the bits before a line
    for k in (2, 3):
        line = T.mix(s.contexts[k - 1][part][:, None] + stem * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - LINE_BITS)
        slots[k, :, 1:] = np.repeat((line.astype(np.int64) << 4) + _PLACE[k], 4, axis=1)
        slots[k, :, 0] = slots[k, :, 1]
        slots[k] += inner
    return slots, bit


@dataclass
class Mixer:
    """The model of the token bits, and the speller of unknown words."""

    counts: np.ndarray               # by slot: zeros + ones * 1j
    classes: np.ndarray              # codes x classes: log of the share
    copied: np.ndarray               # by copy gate: share of hits; among equal codes; among unknown words
    speller: Speller
    weights: np.ndarray | None = None
    map: np.ndarray | None = None

    def inputs(self, s: Slice, part: slice, own: bool):
        """(stretched predictions, gate, map row, bits, counts of the code) of the bits of some tokens.

        With `own`, a bit's own count is left out.
        """
        slots, bit = _token_bits(s, part)
        n = self.counts[slots]
        zero, one = n.real, n.imag
        words = one[0, :, -1] * bit[:, -1] + zero[0, :, -1] * (1 - bit[:, -1])
        if own:
            zero, one = np.maximum(zero - (1 - bit), 0), np.maximum(one - bit, 0)
        x = np.zeros((INPUTS, *bit.shape), dtype=np.float32)
        x[:len(_SIZES)] = np.log((one + np.float32(0.2)) / (zero + np.float32(0.2)))
        gate, then = s.gate[part], s.guess[part]
        at = np.flatnonzero(gate)
        state = np.zeros(bit.shape, dtype=np.int64)
        if len(at):
            expected = _code_bits(s.known[then[at]], s.code[then[at]])
            agree = np.ones(expected.shape, dtype=bool)
            agree[:, 1:] = np.logical_and.accumulate(expected == bit[at], axis=1)[:, :-1]
            rate = _stretch(self.copied[0][gate[at]])[:, None]
            x[-2, at] = np.where(agree, np.where(expected == 1, rate, -rate), 0)
            state[at] = np.where(agree, 1 + ((gate[at] > 1) & (gate[at] % 2 == 1))[:, None], 0)
        x[-1] = 0.3
        seen = (zero[2] + one[2] > 0).astype(np.int64) + (zero[3] + one[3] > 0)
        row = np.arange(DEPTH) * COPY_STATES + state
        return x, row * 3 + seen, row, bit, words

    def learn(self, s: Slice, w: np.ndarray, seen: np.ndarray) -> None:
        """Online pass: changes mixing weights and counts (ones, all) of the map's buckets."""
        for a in range(0, len(s.h), TOKENS):
            part = slice(a, a + TOKENS)
            x, gate, row, bit, _ = self.inputs(s, part, True)
            used = np.ones(bit.shape, dtype=bool)
            used[:, 1:] = s.known[part][:, None]
            x, gate, row, bit = x[:, used], gate[used], row[used], bit[used]
            mixed = (w[gate].T * x).sum(axis=0)
            p = _squash(mixed)
            error, spread = bit - p, p * (1 - p)
            for i in range(INPUTS):
                step = np.bincount(gate, weights=error * x[i], minlength=TOKEN_GATES)
                w[:, i] += STEP * step / (1 + np.bincount(gate, weights=spread * x[i] * x[i], minlength=TOKEN_GATES))
            low, share = Speller.bucket(mixed)
            for at, part_of in ((low, 1 - share), (low + 1, share)):
                cell = row * BUCKETS + at
                seen[0] += np.bincount(cell, weights=part_of * bit, minlength=len(seen[0]))
                seen[1] += np.bincount(cell, weights=part_of, minlength=len(seen[1]))

    def log10(self, s: Slice) -> np.ndarray:
        """The logarithm of the probability of each token."""
        out = np.empty(len(s.h))
        for a in range(0, len(out), TOKENS):
            part = slice(a, a + TOKENS)
            x, gate, row, bit, words = self.inputs(s, part, False)
            mixed = np.einsum("tdi,itd->td", self.weights[gate], x)
            low, share = Speller.bucket(mixed)
            at = row * BUCKETS + low
            p = (_squash(mixed) + self.map[at] * (1 - share) + self.map[at + 1] * share) / 2
            p = np.clip(p, 1e-6, 1 - 1e-6)
            logs = np.log10(np.where(bit == 1, p, 1 - p))
            known = s.known[part]
            out[part] = logs[:, 0] + np.where(known, logs[:, 1:].sum(axis=1), 0)
            out[part][known] += np.log10(self._last(s, part, s.c[part] / np.maximum(words, 1), True)[known])
        new = np.flatnonzero(~s.known)
        if len(new):
            _, first, inverse = np.unique(s.h[new], return_index=True, return_inverse=True)
            spelled = np.concatenate([self.speller.log10(g) for g in _groups(s.words(new[first]))])
            left = np.zeros(len(out))
            left[new] = 10.0 ** spelled[inverse]
            out[new] += np.log10(self._last(s, slice(None), left, False)[new] + 1e-300)
        return out

    def _last(self, s: Slice, part: slice, plain: np.ndarray, known: bool) -> np.ndarray:
        """The probability of the word after its bits, where a guess may agree with all bits."""
        agreed = _agreed(s, part, known)
        rate = np.where(agreed, self.copied[1 if known else 2][s.gate[part]], 0)
        return rate * s.hit[part] + (1 - rate) * plain


def _agreed(s: Slice, part: slice, known: bool) -> np.ndarray:
    """Whether a guess is right in all bits of a known (or unknown) token."""
    then = s.guess[part]
    both = (s.gate[part] > 0) & (s.known[then] == known) & (s.known[part] == known)
    return both & (s.code[then] == s.code[part]) if known else both


def _texts(batches: Iterator[pa.RecordBatch], folder: str, classes: np.ndarray, other_texts: bool
           ) -> Iterator[tuple[pa.RecordBatch, slice, Slice, np.ndarray]]:
    words, chunk = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = batch.column("chunk").to_numpy()
        for lo, hi, data, offsets in T.text_slices(batch.column("text")):
            for a, b in _runs(chunks[lo:hi]):
                if chunks[lo + a] != chunk:
                    chunk = int(chunks[lo + a])
                    words = _Dictionary(folder, chunk)
                own = offsets[a:b + 1] - offsets[a]
                yield (batch, slice(lo + a, lo + b),
                       _slice(data[offsets[a]:offsets[b]], own, words, classes, other_texts), own)


def _new_words(s: Slice) -> list[bytes]:
    """Unknown words, once for each word, in the order of their hashes."""
    new = np.flatnonzero(~s.known)
    return s.words(new[np.unique(s.h[new], return_index=True)[1]])


_COUNTED = 2 * TOKEN_SLOTS + 2 * SLOTS + 6 * HISTORY


def _count(batches: Iterator[pa.RecordBatch], folder: str, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each slot saw a 0 and a 1, and guesses and hits by gate: of all, with equal codes, of unknown words."""
    all_ = np.zeros(_COUNTED, dtype=np.int32)
    bits, spelled, copied = np.split(all_, [2 * TOKEN_SLOTS, 2 * (TOKEN_SLOTS + SLOTS)])
    spelled, copied = spelled.reshape(2, SLOTS), copied.reshape(6, HISTORY)
    words: list[bytes] = []
    for _, _, s, _ in _texts(batches, folder, classes, True):
        for a in range(0, len(s.h), 16 * TOKENS):
            slots, bit = _token_bits(s, slice(a, a + 16 * TOKENS))
            for k, size in enumerate(_SIZES):
                lo = 2 * _PLACE[k]
                bits[lo:lo + 2 * size] += np.bincount((2 * slots[k] + bit).ravel() - lo, minlength=2 * size).astype(np.int32)
        use = s.gate > 0
        for i, among in enumerate((use, _agreed(s, slice(None), True), _agreed(s, slice(None), False))):
            copied[2 * i] += np.bincount(s.gate[among], minlength=HISTORY).astype(np.int32)
            copied[2 * i + 1] += np.bincount(s.gate[among & s.hit], minlength=HISTORY).astype(np.int32)
        words += _new_words(s)
        if len(words) > 4 * BATCH:
            _count_bytes(words, spelled)
            words.clear()
    _count_bytes(words, spelled)
    yield from _segment_rows(all_)


_LEARNED = (TOKEN_GATES * INPUTS, 2 * MAP_ROWS * BUCKETS, GATES * (len(ORDERS) + 1), 2 * 256 * BUCKETS, 2)
_START_WEIGHTS = np.array([0.4, 0.6, 0.05, 0.05, 0.5, 0.0])


def _learn(batches: Iterator[pa.RecordBatch], folder: str, mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """Weights times what they were learned on, counts of the maps, tokens and new words of a task."""
    w, spell = np.tile(_START_WEIGHTS, (TOKEN_GATES, 1)), None
    seen, spell_seen, n = np.zeros((2, MAP_ROWS * BUCKETS)), np.zeros((2, 256 * BUCKETS)), [0, 0]
    words: list[bytes] = []

    def learn_words() -> None:
        nonlocal spell, spell_seen
        spell, more = mixer.speller.learn(words, spell)
        spell_seen += more
        n[1] += len(words)
        words.clear()

    for _, _, s, _ in _texts(batches, folder, mixer.classes, True):
        mixer.learn(s, w, seen)
        n[0] += len(s.h)
        words += _new_words(s)
        if len(words) > BATCH:
            learn_words()
    learn_words()
    yield from _segment_rows(np.concatenate([(w * n[0]).ravel(), seen.ravel(), (spell * n[1]).ravel(), spell_seen.ravel(),
                                             np.array(n, dtype=np.float64)]))


# Scores

@dataclass
class Totals:
    """N, V."""

    tokens: int
    types: int


class _Dictionary:
    """The training counts of a chunk's words."""

    def __init__(self, folder: str, chunk: int):
        system, inner = file_system(f"{folder}/chunk={chunk}")
        names = [f.path for f in system.get_file_info(fs.FileSelector(inner))
                 if f.base_name.endswith(".parquet")]
        table = pa.concat_tables([pq.read_table(n, filesystem=system, partitioning=None) for n in names])
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.h, self.c, self.cls = h[order], table.column("c").to_numpy()[order], table.column("cls").to_numpy()[order]


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over row ranges, each summed by itself."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


def _score(batches: Iterator[pa.RecordBatch], folder: str, totals: Totals, mixer: Mixer) -> Iterator[pa.RecordBatch]:
    for batch, cut, s, offsets in _texts(batches, folder, mixer.classes, False):
        base = np.log10((s.c + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))
        score = _row_sums(mixer.log10(s), s.bounds)
        rows = cut.stop - cut.start
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").slice(cut.start, rows),
            "held_out": batch.column("held_out").slice(cut.start, rows),
            "n_tokens": pa.array(np.diff(s.bounds)),
            "n_known": pa.array(_row_sums((s.c > 0).astype(np.int64), s.bounds)),
            "train_tokens": pa.array(np.full(rows, totals.tokens, dtype=np.int64)),
            "base_score": pa.array(_row_sums(base, s.bounds)),
            "score": pa.array(score),
            "bits_per_byte": pa.array(-score * np.log2(10) / np.maximum(np.diff(offsets), 1))})


def held_out_fold(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", language: str | None = "lang",
          held_out: Column | None = None) -> DataFrame:
    """One row for each document: fold, token counts, base score, score, bits per byte."""
    spark = docs.sparkSession
    context = spark.sparkContext
    cls = F.lit(0) if not language or language not in docs.columns else F.pmod(
        F.xxhash64(F.col(language)), F.lit(CLASSES)).cast("int")
    chunked = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), cls.alias("cls"),
        (held_out_fold(F.col(doc_id)) if held_out is None else held_out).alias("held_out"),
        F.spark_partition_id().cast("long").alias("chunk"))

    def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    texts, _ = written(chunked, "texts")
    words, _ = written(texts.select("text", "cls", "held_out", "chunk").mapInArrow(
        _words, "chunk long, h long, n long, cls int, counts binary"), "words")
    by_class = _added(words.filter("chunk IS NULL").select(
        F.col("h").alias("segment"), F.lit(0).alias("task"), "counts"), CLASSES << CODE, np.int32).reshape(1 << CODE, CLASSES)
    by_class = by_class[:, by_class.sum(axis=0) > 0] if by_class.any() else by_class[:, :1]
    classes = np.log((by_class + 0.1) / (by_class.sum(axis=0) + 0.1 * len(by_class))).astype(np.float32)

    word = Window.partitionBy("h")
    counted = (words.filter("chunk IS NOT NULL").select(
        "chunk", "h", F.sum("n").over(word).alias("c"), F.max(F.struct("n", "cls")).over(word)["cls"].alias("cls"),
        (F.row_number().over(word.orderBy("chunk")) == 1).alias("first")).repartition("chunk"))
    own, folder = written(counted, "chunk-words", ("chunk",))
    n = own.filter("first AND c > 0").agg(F.sum("c"), F.count("*")).first()
    totals = Totals(n[0] or 0, n[1])

    train = texts.filter("NOT held_out").select("text", "chunk")
    parts = "segment long, task long, counts binary"
    found = _added(train.mapInArrow(lambda it: _count(it, folder, classes), parts), _COUNTED, np.int32)
    bits, spelled, copied = np.split(found, [2 * TOKEN_SLOTS, 2 * (TOKEN_SLOTS + SLOTS)])
    copied = copied.reshape(3, 2, HISTORY)
    mixer = Mixer(bits.view(np.complex64), classes, (copied[:, 1] + 0.5) / (copied[:, 0] + 1),
                  Speller(spelled.reshape(2, SLOTS)))
    plain = context.broadcast(mixer)
    w, seen, spell, spell_seen, sizes = np.split(
        _added(train.mapInArrow(lambda it: _learn(it, folder, plain.value), parts), sum(_LEARNED), np.float64),
        np.cumsum(_LEARNED)[:-1])
    ready = context.broadcast(Mixer(
        mixer.counts, classes, mixer.copied,
        Speller(mixer.speller.counts, spell.reshape(GATES, -1) / max(1, sizes[1]), _map_of(spell_seen.reshape(2, -1))),
        w.reshape(TOKEN_GATES, INPUTS) / max(1, sizes[0]), _map_of(seen.reshape(2, -1))))
    return texts.mapInArrow(
        lambda it: _score(it, folder, totals, ready.value),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, bits_per_byte double").withColumnRenamed("doc_id", doc_id)
