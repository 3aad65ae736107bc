"""Vectorised 64-bit hashes of words and of word runs, over Arrow string columns.

White space is ASCII, so UTF-8 bytes can be split without decoding. A word's hash is a
polynomial in its bytes (random byte values, odd base, modulo 2^64), read off prefix
sums; runs of words are polynomials in well-mixed word hashes. Everything works on
slices of half a megabyte, one document at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SLICE_BYTES = 500_000


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n at least."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        m = max(n, 2 * SLICE_BYTES)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    offsets = _offsets(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def fill(column: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    return column.fill_null("") if column.null_count else column


def word_hashes(column: pa.Array, start: int, end: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of all words of rows start..end, and where each row's words
    begin (with the end of the last). With ``lower``, A-Z count as a-z."""
    offsets = _offsets(column)[start : end + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(end - start + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    values = _VALUES
    if lower:
        values = _VALUES.copy()
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    up, down = _powers(1, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    text = ~_SPACE[data]
    cut = (offsets - offsets[0])[:-1]
    cut = cut[cut < len(data)]
    begins = text.copy()
    begins[1:] &= ~text[:-1]
    begins[cut] = text[cut]
    ends = text.copy()
    ends[:-1] &= ~text[1:]
    last = cut[cut > 0] - 1
    ends[last] = text[last]
    b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
    return hashes, np.searchsorted(b, offsets - offsets[0], "left")


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (across rows too: the caller masks)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(2, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    m = len(hashes) - n + 1
    return mix((sums[n:] - sums[:m]) * down[:m] + np.uint64(n))
