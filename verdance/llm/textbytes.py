"""Words and hashes of whole Arrow batches of texts, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once, whose arrays take some 40 times as much; a longer text is a slice of its own.
SLICE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept = cache(_powers)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64; a worker keeps those of one slice, and no longer ones."""
    return _kept(SLICE + 1, base)[:n] if n <= SLICE + 1 else _powers(n, base)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) for slices of a string column; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    column = column.fill_null("")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def prefix_hash(buf: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """Sums from which the hash of every substring follows, see ``span_hash``."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_VALUE[fold][buf] * powers(len(buf), _BASE), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end)."""
    back = powers(len(sums), pow(_BASE, -1, 2**64))
    return mix((sums[end] - sums[start]) * back[start] + U64(0x632BE59BD9B4E019) * (end - start).astype(U64))


def span_sums(sums: np.ndarray, width: int) -> np.ndarray:
    """For every string of ``width`` bytes what ``span_hash`` mixes: equal strings have equal values, cheaper to make."""
    return (sums[width:] - sums[:-width]) * powers(len(sums) - width, pow(_BASE, -1, 2**64))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words don't cross rows."""
    inside = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n successive word hashes of one text (empty if there are fewer)."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.full(len(words) - n + 1, n, U64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return out
