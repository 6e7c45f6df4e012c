"""Word hashes of Arrow text columns.

Words are runs of anything but space and U+0009 to U+000D; A to Z are lower-cased. All work is on
the UTF-8 bytes of a block of texts at once. A block holds about a megabyte; a longer text is cut at
white space, so that only one text's hashes, not its working arrays, grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def factor(i: int) -> np.uint64:
    """Odd multiplier of the i-th word of a run."""
    return np.uint64((0x8CB92BA72F3D8DD7 * (2 * i + 1) + 0x589965CC75374CC2 * i * i) & (2**64 - 1) | 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values; one-to-one for a fixed seed."""
    x = x ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown when a longer piece comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # sent to executors empty

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def _hash_piece(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``b``; no word runs over a place in ``cuts``."""
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_is_space(b)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] |= word[cuts]
    ends = np.zeros(n + 1, bool)
    ends[1:] = word
    ends[1:-1] &= ~word[1:]
    ends[cuts] |= word[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    lower = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lower * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start


def _pieces(b: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text, cut at white space."""
    at = 0
    while at < len(b):
        to = min(at + BLOCK, len(b))
        while to < len(b):
            gap = np.flatnonzero(_is_space(b[max(at, to - BLOCK) : to]))
            if len(gap):
                to = max(at, to - BLOCK) + int(gap[-1]) + 1
                break
            to = min(to + BLOCK, len(b))
        yield b[at:to]
        at = to


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string column."""
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets, valid


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its words' hashes in order; a missing text has none."""
    data, offsets, valid = texts_of(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        begin, end = int(offsets[row]), int(offsets[stop])
        if stop == row + 1:
            parts = [_hash_piece(p, np.zeros(0, np.int64))[0] for p in _pieces(data[begin:end])]
            yield np.concatenate(parts) if parts and valid[row] else np.zeros(0, np.uint64)
        else:
            at = offsets[row : stop + 1] - begin
            hashes, start = _hash_piece(data[begin:end], at)
            first = np.searchsorted(start, at)
            for i in range(stop - row):
                yield hashes[first[i] : first[i + 1]] if valid[row + i] else hashes[:0]
        row = stop


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; fewer words make one run of all."""
    if not len(words):
        return words
    if len(words) < size:
        factors = np.array([factor(i) for i in range(len(words))], np.uint64)
        return mix((words * factors).sum(keepdims=True), seed=len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total += words[i : i + len(total)] * factor(i)
    return mix(total)
