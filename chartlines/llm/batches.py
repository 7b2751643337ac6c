"""Arrow and numpy helpers that run inside tasks: texts of a batch in slices of bounded bytes, and word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed(i: int) -> np.uint64:
    return np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    upper = np.arange(65, 91)
    letters[upper] = letters[upper + 32]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return letters, space, upper


@lru_cache(maxsize=1)
def _exact_letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, m, np.uint64))]) for m in (_MULT, inverse)]
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near limit bytes; a longer text comes alone."""
    ends = np.cumsum(byte_lengths(column))
    begin, n = 0, len(column)
    while begin < n:
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield begin, stop
        begin = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry for the end); nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _runs(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes between separators; a text's end ends a run."""
    inside = ~separators[raw]
    first = np.zeros(len(raw), bool)
    first[starts[:-1][starts[:-1] < len(raw)]] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64 (more of them may come)."""
    return _power(n)


def _sums(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    letters = _tables()[0] if lower else _exact_letters()
    power, inverse = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * power[: len(raw)], out=sums[1:])
    return sums, inverse


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lowered unless told otherwise, of all texts in a row, and each text's first word (one more entry for the end)."""
    raw, starts = joined(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    begins, ends = _runs(raw, starts, _tables()[1])
    sums, inverse = _sums(raw, lower)
    hashes = mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, starts)


def prefix_hashes(raw: np.ndarray, starts: np.ndarray, separators: np.ndarray, lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the runs between separators and of their first bytes, for each of the lengths, and the text of each run."""
    if not len(raw):
        return [np.zeros(0, np.uint64)] * (1 + len(lengths)), np.zeros(0, np.int64)
    begins, ends = _runs(raw, starts, separators)
    sums, inverse = _sums(raw)
    out = []
    for stop in (ends, *(np.minimum(begins + n, ends) for n in lengths)):
        out.append(mix((sums[stop] - sums[begins]) * inverse[begins] + (stop - begins).astype(np.uint64)))
    return out, np.searchsorted(starts, begins, "right") - 1


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and the text of each; a text with fewer words, but one, is a single shingle."""
    counts = np.diff(starts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        step = mix(hashes + seed(i + 1))
        out[: n - i] += step[i:] if i else step
    within = np.arange(n) - starts[text_of]
    full = within + k <= counts[text_of]
    short = (counts < k) & (counts > 0)
    if short.any():
        at = starts[:-1][short]
        value = np.zeros(len(at), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            value[has] += mix(hashes[at[has] + i] + seed(i + 1))
        out[at] = value + counts[short].astype(np.uint64)
        full[at] = True
    return mix(out[full]), text_of[full]
