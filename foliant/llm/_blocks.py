"""Vectorised text primitives shared by the corpus operators.

Texts reach Python as Arrow batches.  Every helper works on a *chunk*: the
UTF-8 bytes of some whole texts laid end to end plus their offsets.  A chunk
holds at most ``MAX_BYTES`` unless a single text is longer, so the memory of a
task does not depend on how many rows the batch has.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

MAX_BYTES = 1 << 20
U64 = np.uint64
#: Spaces of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Content hashes are polynomials over the field of integers modulo 2**31 - 1, one for each of these bases.
PRIME, BASES = (1 << 31) - 1, (0x2C9277B5, 0x5F356495)
_PRIME, _DOWN, _STRIDE = U64(PRIME), U64(31), 1 << 15
_BYTES = [mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(k)) % U64(PRIME - 1) + U64(1) for k in range(len(BASES))]


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    out = np.ones(n, U64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, PRIME)) % _PRIME
        have += step
    return out


def _forward(k: int, i: int) -> np.ndarray:
    """Powers i .. i + _STRIDE - 1 of base k; those of places under MAX_BYTES are kept, in 32 bits."""
    got = _kept.get((k, i))
    if got is None:
        got = _FIRST[k] * U64(pow(BASES[k], i, PRIME)) % _PRIME
        if i < MAX_BYTES:
            _kept[k, i] = got.astype(np.uint32)
    return got


_kept: dict[tuple[int, int], np.ndarray] = {}
_FIRST = [_powers(b, _STRIDE) for b in BASES]
_BACK = [_powers(pow(b, -1, PRIME), _STRIDE) for b in BASES]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def lean(run: Callable) -> Callable:
    """An Arrow function that gives its task's memory back to the machine when it ends: workers outlive their tasks."""

    @wraps(run)
    def with_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return with_end


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = MAX_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole rows of about max_bytes of text."""
    for batch in batches:
        buf, off = flat(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = np.empty(n + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    solid = ~gap[1:-1]
    start = np.flatnonzero(solid & (gap[:-2] | cut[:-1]))
    end = np.flatnonzero(solid & (gap[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums, a row for each base, from which span_hash() takes the hash of any span in O(1)."""
    out = np.zeros((len(BASES), len(buf) + 1), U64)
    term, over = np.empty(_STRIDE, U64), np.empty(_STRIDE, U64)
    for i in range(0, len(buf), _STRIDE):
        part = buf[i : i + _STRIDE]
        n = len(part)
        t, o = term[:n], over[:n]
        for k in range(len(BASES)):
            # a term of 62 bits is brought under 2**32, so that 2**31 of them can be summed
            np.multiply(_BYTES[k][part], _forward(k, i)[:n], out=t)
            np.right_shift(t, _DOWN, out=o)
            np.bitwise_and(t, _PRIME, out=t)
            np.add(t, o, out=t)
            t[0] += out[k, i]
            np.cumsum(t, out=out[k, i + 1 : i + 1 + n])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hash of each span, independent of where it stands: two polynomials modulo a prime, and the length."""
    h = np.zeros(len(start), U64)
    low, high = start & (_STRIDE - 1), start >> 15
    for k, base in enumerate(BASES):
        one = (sums[k][end] - sums[k][start]) % _PRIME * _BACK[k][low] % _PRIME
        if sums.shape[1] > _STRIDE:
            one = one * _powers(pow(base, -_STRIDE, PRIME), (sums.shape[1] >> 15) + 1)[high] % _PRIME
        h = h << U64(32) | one
    return mix(h ^ (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def rolled(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive values; the last k-1 places are cut off."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = values[:n].copy()
    for i in range(1, k):
        out *= U64(base)
        out += values[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have, out = 1, values
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def ids(column: pa.Array, missing: int) -> np.ndarray:
    """A long column as int64, nulls as ``missing``."""
    if column.null_count:
        column = column.fill_null(missing)
    return np.asarray(column.cast(pa.int64()).to_numpy(zero_copy_only=False), np.int64)
