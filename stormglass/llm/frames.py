"""Texts in seekable compressed frames: independent zstandard frames with cumulative unit counts.

A file holds the UTF-8 bytes of many texts, one after the other, in frames of about `FRAME_BYTES` that end at
a code point. Each frame is compressed by itself. A skippable frame at the end lists compressed size, bytes
and units (code points) of every frame, so that the file is also a plain zstandard stream. The running sums of that list find the frame of
any byte or unit; only that frame is decompressed.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import zstandard

from . import text as T
from .files import file_system, new_name

FRAME_BYTES, LEVEL, FILE_BYTES, OPEN_FRAMES = 64 << 10, 9, 256 << 20, 4
# Fixed values of the format: a skippable frame starts with this number and its size.
_SKIPPABLE = 0x184D2A5E
_HEAD, _ROW, _TAIL = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<I")


def units(data) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(~T.NOT_LEADING[np.frombuffer(data, dtype=np.uint8)]))


class FrameWriter:
    """Appends bytes to a file of frames; `n_bytes` and `n_units` are the totals so far."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.path, self.frame_bytes = new_name(folder, ".zst"), frame_bytes
        system, inner = file_system(self.path)
        self.stream = system.open_output_stream(inner, compression=None)  # the frames are compressed already
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.n_bytes = self.written = 0

    def add(self, data) -> None:
        self.n_bytes += len(data)
        view = memoryview(data)
        for at in range(0, len(view), self.frame_bytes):  # a long text is not copied as a whole
            self.waiting += view[at:at + self.frame_bytes]
            while len(self.waiting) > self.frame_bytes:
                cut = self.frame_bytes
                while cut > self.frame_bytes - 4 and T.NOT_LEADING[self.waiting[cut]]:
                    cut -= 1
                self._frame(bytes(self.waiting[:cut]))
                del self.waiting[:cut]

    def _frame(self, data: bytes) -> None:
        packed = self.packer.compress(data)
        self.stream.write(packed)
        self.table.append((len(packed), len(data), units(data)))
        self.written += len(packed)

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        rows = b"".join(_ROW.pack(*r) for r in self.table)
        self.stream.write(_HEAD.pack(_SKIPPABLE, len(rows) + _TAIL.size) + rows + _TAIL.pack(len(self.table)))
        self.stream.close()


class FrameReader:
    """Bytes of a file of frames by place; keeps the last few frames open."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        (count,) = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        raw = self.file.read_at(count * _ROW.size, size - _TAIL.size - count * _ROW.size)
        table = np.frombuffer(raw, dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at, self.first_byte, self.first_unit = (np.concatenate([[0], np.cumsum(c)]) for c in table.T)
        self.unpacker = zstandard.ZstdDecompressor()
        self.open: OrderedDict[int, bytes] = OrderedDict()
        self.leads: dict[int, np.ndarray] = {}
        self.unpacked = 0

    def frame(self, i: int) -> bytes:
        if i not in self.open:
            packed = self.file.read_at(int(self.at[i + 1] - self.at[i]), int(self.at[i]))
            self.open[i] = self.unpacker.decompress(packed, max_output_size=int(self.first_byte[i + 1] - self.first_byte[i]))
            self.unpacked += 1
            if len(self.open) > OPEN_FRAMES:
                self.leads.pop(self.open.popitem(last=False)[0], None)
        self.open.move_to_end(i)
        return self.open[i]

    def byte_of(self, unit: int) -> int:
        """The byte at which a unit begins, by decompressing the frame that holds it."""
        i = int(np.searchsorted(self.first_unit, unit, side="right")) - 1
        if i >= len(self.first_unit) - 1:
            return int(self.first_byte[-1])
        data = self.frame(i)
        if i not in self.leads:
            self.leads[i] = np.flatnonzero(~T.NOT_LEADING[np.frombuffer(data, dtype=np.uint8)])
        return int(self.first_byte[i] + self.leads[i][unit - self.first_unit[i]])

    def chunks(self, start: int, end: int) -> Iterator[memoryview]:
        """The bytes from start to end, in the order of the frames."""
        i = int(np.searchsorted(self.first_byte, start, side="right")) - 1
        while start < end:
            base, stop = int(self.first_byte[i]), min(end, int(self.first_byte[i + 1]))
            yield memoryview(self.frame(i))[start - base:stop - base]
            start, i = stop, i + 1

    def find(self, mark: bytes, start: int, end: int) -> int:
        """The first place of `mark` in start .. end, or -1."""
        tail, at = b"", start
        for chunk in self.chunks(start, end):
            data = tail + chunk.tobytes() if tail else chunk.tobytes()
            found = data.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(chunk)
            tail = data[-(len(mark) - 1):] if len(mark) > 1 else b""
        return -1

    def close(self) -> None:
        self.file.close()
