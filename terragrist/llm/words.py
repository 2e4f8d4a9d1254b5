"""Vectorised word and shingle hashing over UTF-8 bytes, shared by the Python-side operators.

A text is looked at as one numpy byte array. Word hashes come from one prefix sum of
byte * P^position (mod 2^64), so the cost is a few nanoseconds a byte whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

#: ASCII lower case of A-Z; every other byte is kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for the separators \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: True for bytes outside words of ASCII letters, digits and non-ASCII characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class _Powers:
    """Powers of P and of its inverse up to the longest text seen by this worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, p, dtype=np.uint64))]) for p in (_P, _P_INV))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of bytes that are no separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes that are hashed in one go; only a single word that is longer takes more memory.
BLOCK = 1 << 15


def word_hashes(data: np.ndarray, separator: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text."""
    return _hashes(LOWER[data], *word_spans(data, separator))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], in blocks of whole words, so that a long text needs no more memory than its words' places."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        up, down = _powers.get(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        with np.errstate(over="ignore"):
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def column_words(column: pa.Array, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of a whole string column, case kept, in order; nulls have no words."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~separator[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True  # a word ends where its text ends
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    rows = np.searchsorted(off, starts, side="right") - 1
    hashes = _hashes(data, starts, ends)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)[rows]
        rows, hashes = rows[valid], hashes[valid]
    return rows, hashes


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def utf8_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each string of an Arrow column, without copies; None for null."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[off[i] : off[i + 1]] if valid[i] else None
