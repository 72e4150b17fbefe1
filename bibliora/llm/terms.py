"""Terms of Arrow text columns: maximal runs of chosen ASCII characters and of all others, with only A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import text_bytes

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(column: pa.Array, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a text column as one array, and how many terms come before each text (with all at the end).

    A term is a maximal run of bytes for which ``kept`` holds; every byte of a character beyond ASCII has to be kept.
    """
    data, offsets = text_bytes(column)
    inside = np.zeros(len(data) + 2, bool)
    np.take(kept, data, out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = _LOWER[data[inside[1:-1]]]
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return terms, np.searchsorted(starts, offsets)
