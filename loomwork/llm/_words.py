"""Vectorised word hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a column slice at once: word borders from a byte table, word hashes by mixing
eight bytes at a time, hashes of word runs by joining runs of half their size. Nothing is kept between slices.
These hashes group and sample; where equality decides, operators compare digests of the words or the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes; a longer single text is one pass of its own.
SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the `size` bytes from each `start` on: every eight bytes pass through the mixer with what came before."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = size.astype(np.uint64) * _Q
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, rest = start[left], size[left]
    while len(left):
        chunk = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(rest, 8).astype(np.uint64)))
        out[left] = mix((out[left] ^ chunk) * _P + np.uint64(1))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _P + mix(b ^ _Q))


class Words:
    """Words of a slice of texts: `start`, `end` (byte places in `data`), `hash`, and `first` (words before each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        self.solid = ~_SEP[data]
        edge = np.empty(n, dtype=bool)
        if n:
            edge[0] = True
            np.logical_not(self.solid[:-1], out=edge[1:])
            inner = offsets[:-1]
            edge[inner[inner < n]] = True
        edge &= self.solid
        self.start = np.flatnonzero(edge)
        if n:
            edge[-1] = True
            np.logical_not(self.solid[1:], out=edge[:-1])
            ends = offsets[1:] - 1
            edge[ends[ends >= 0]] = True
        edge &= self.solid
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = byte_hashes(data, self.start, self.end - self.start)
        self._plain: tuple[memoryview, np.ndarray, np.ndarray] | None = None

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 places are missing. Runs may cross texts."""
        if len(self.hash) < k:
            return np.empty(0, dtype=np.uint64)
        size, power, out, done = 1, self.hash, None, 0
        while True:
            if k & size:
                part = power[done : done + len(self.hash) - k + 1]
                out = part.copy() if out is None else _join(out, part)
                done += size
            if size * 2 > k:
                return out
            power = _join(power[:-size], power[size:])
            size *= 2

    def digests(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(n x 2) longs: 128-bit BLAKE2b digests of the `count` words from each `first` on, joined by one space."""
        if self._plain is None:
            keep = self.solid.copy()
            keep[1:] |= self.solid[:-1]
            text = np.where(self.solid, self.data, np.uint8(0x20))[keep]
            # two words meet without a separator where texts meet; no asked run crosses texts
            place = np.cumsum(keep)
            begin = place[self.start] - 1 if len(self.start) else self.start
            self._plain = memoryview(text.tobytes()), begin, begin + (self.end - self.start)
        text, begin, end = self._plain
        digest = hashlib.blake2b
        spans = zip(begin[first].tolist(), end[first + count - 1].tolist(), strict=True)
        raw = b"".join([digest(text[a:b], digest_size=16).digest() for a, b in spans])
        return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of a string column, by slices of about SLICE_BYTES. Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
