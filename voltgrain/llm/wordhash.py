"""64-bit ids of the words of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BLOCK = 1 << 20
_multipliers = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    global _multipliers
    if len(_multipliers) < n:
        _multipliers = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _multipliers


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, counts): the UTF-8 bytes of all texts, bounds of their words, words of each text. Null: no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = texts.buffers()
    bounds = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8)[bounds[0] : bounds[-1]] if raw[2] is not None and len(bounds) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~SPACE[data]
    n = len(data)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begin[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return LOWER[data] if lower else data, starts, ends, np.diff(np.searchsorted(starts, bounds))


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit id of each word: a multilinear hash of its bytes and length, mixed. Works in blocks of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK)))
        a, e = starts[lo:hi], ends[lo:hi]
        size = e - a
        base = a[0]
        m = multipliers(int(size.max()) + 1)
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        within = np.arange(size.sum()) - np.repeat(at, size)
        value = (data[np.repeat(a - base, size) + within + base].astype(np.uint64) + np.uint64(1)) * m[within]
        out[lo:hi] = mix(np.add.reduceat(value, at) + m[size] * np.uint64(257))
        lo = hi
    return out


def pieces(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose texts hold about ``most_bytes``; a longer text stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most_bytes, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
