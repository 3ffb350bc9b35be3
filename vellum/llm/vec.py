"""Vectorised kernels over UTF-8 text held in Arrow batches.

A batch of texts is one byte array and its offsets. Hashes are differences of one running polynomial sum
(mod 2**64, odd base, random byte values), finished by a bijective mixer, so a hash of any span costs O(1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
#: A-Z folded to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept and doubled on demand."""
    if len(_powers[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for k, b in enumerate((BASE, BASE_INV)):
            a = np.full(m, b, U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * BASE**i, from 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the spans [s, e) under the running sums c."""
    return mix((c[e] - c[s]) * powers(len(c))[1][s])


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def longs(col) -> np.ndarray:
    """A bigint column; null is the least integer."""
    return pc.fill_null(col.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def slices(off: np.ndarray, limit: int = 2 << 20):
    """Ranges of documents that hold up to limit bytes each, or one longer document."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def texts(batch, limit: int = 2 << 20, column: str = "text"):
    """(first, last, bytes, offsets) of each slice of a batch's texts."""
    data, off = utf8(batch.column(column))
    for lo, hi in slices(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes within documents, and the runs before each document."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1]
    e[:-1] &= ~inside[1:]
    full = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    s[full] = inside[full]
    e[last] = inside[last]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, off)


def byte_class(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


def pack(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of 64-bit integers, side by side."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width])


def unpack(b, width: int) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :width] = a
    return out.view("<u8").ravel()


def firsts(*keys: np.ndarray) -> np.ndarray:
    """For sorted parallel keys: where a new combination begins."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


#: Bytes of words: 0-9, A-Z, a-z and everything outside ASCII.
WORD = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
