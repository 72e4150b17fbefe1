"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so the same as ``[^\\x20\\x09-\\x0D]+`` on the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]
_random: list[np.ndarray] = [np.empty(0, np.uint64)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            row = np.full(max(n, (1 << 20) + 64), base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes together; a longer text is a part by itself."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column (null: empty) and where each text starts; the last offset is the end."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (with the total at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; with ``lower``, A-Z count as a-z.

    The sum over a word's bytes of random numbers for the byte and its place, multiplied: no words collide by construction, as
    some do under powers of a base modulo 2**64.
    """
    sizes = ends - starts
    to = np.cumsum(sizes)
    letters = data[~_SPACE[data]]
    place = np.arange(len(letters)) - np.repeat(to - sizes, sizes)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((_LOWER_TABLE if lower else _TABLE)[letters] * _places(int(sizes.max(initial=0)))[place], out=sums[1:])
    return mix(sums[to] - sums[to - sizes] + sizes.astype(np.uint64))


def _places(n: int) -> np.ndarray:
    """A random number for each of the places 0..n-1 of a word."""
    if len(_random[0]) < n:
        _random[0] = mix(np.arange(max(n, 1024)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B))
    return _random[0]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive items; of none if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the items from each start to its end."""
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
