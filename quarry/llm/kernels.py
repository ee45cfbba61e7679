"""Vectorised text kernels over Arrow string buffers.

All kernels work on slices of about half a megabyte (or one text, if it is longer), so memory per
task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def trim() -> None:
    """Gives freed memory back at the end of a task, as Python workers live on beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = {"n": 0, "pow": np.ones(1, U), "ipow": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if _SPACE["n"] < n:
        n = 1 << max(20, (n - 1).bit_length())
        for key, base in (("pow", _BASE), ("ipow", _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _SPACE[key] = x
        _SPACE["n"] = n
    return _SPACE["pow"], _SPACE["ipow"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that all output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_B = np.arange(256)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z: digits, letters and every byte of a non-ASCII character.
IS_WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
WORD_CODE = BYTE_CODE[LOWER]


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the row offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 19, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of a slice of rows. ``first[r]:first[r + 1]`` are the words of row r."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # where each row starts in buf; a zero byte ends each row

    def word(self, i: int) -> bytes:
        return LOWER[self.buf[self.starts[i] : self.ends[i]]].tobytes()

    def without(self, r: int, spans: list[tuple[int, int]]) -> bytes:
        """The bytes of row r without word spans; each goes from its first word to the end of its last."""
        out, at, base = [], int(self.rows[r]), int(self.first[r])
        for a, b in spans:
            out.append(self.buf[at : self.starts[base + a]])
            at = int(self.ends[base + b - 1])
        out.append(self.buf[at : self.rows[r + 1] - 1])
        return np.concatenate(out).tobytes()


def words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    """Words (lower-cased ASCII, see IS_WORD) of rows lo..hi with a 64-bit hash each."""
    at = offsets[lo : hi + 1]
    buf = np.insert(data[at[0] : at[-1]], at[1:] - at[0], 0)  # a zero byte ends each row
    rows = at - at[0] + np.arange(len(at))
    mask = IS_WORD[buf]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    pw, ip = powers(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(WORD_CODE[buf] * pw[: len(buf)], out=sums[1:])
    return Words(buf, starts, ends, np.searchsorted(starts, rows), mix((sums[ends] - sums[starts]) * ip[starts]), rows)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the index of the first word of each; none crosses a row."""
    m = len(w.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = w.hashes[:m].copy()
    for j in range(1, n):
        acc *= U(0x2545F4914F6CDD1D)
        acc += w.hashes[j : j + m]
    left = np.repeat(w.first[1:], np.diff(w.first))[:m] - np.arange(m)
    at = np.flatnonzero(left >= n)
    return mix(acc[at]), at
