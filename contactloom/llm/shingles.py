"""Hashes of word shingles, computed over the bytes of whole Arrow columns with numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # any odd number
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_PLACES = [U(x | 1) for x in (0xA0761D6478BD642E, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_SALTS = [U(0), U(0xD6E8FEB86659FD93)]
SLICE = 1 << 19  # bytes worked on at once; a longer word extends the slice

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, U), np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1024)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, U)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE:
            return tuple(tables)
        _powers = tuple(tables)
    return _powers


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word in the bytes, which neither start nor end inside a word."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = space
    starts = np.flatnonzero(edge[:-2] & ~edge[1:-1])
    if not len(starts):
        return np.empty(0, U)
    ends = np.flatnonzero(~edge[1:-1] & edge[2:]) + 1
    powers, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER[data].astype(U) + U(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, A-Z lowered, in order."""
    if len(data) <= SLICE:
        return _slice_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_slice_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(data: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it is shorter."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    total = np.full(n, U(width), U)
    for i in range(width):
        total += words[i : i + n] * _PLACES[i % len(_PLACES)] + U(i // len(_PLACES))
        if i + 1 < width and i % len(_PLACES) == len(_PLACES) - 1:
            total = mix(total)
    return np.unique(mix(total).view(np.int64))


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return tuple(
            int(mix(hashes.view(U) ^ salt).sum(dtype=U).astype(np.int64)) for salt in _SALTS
        )


def column_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a string column, without copies; none for a null."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if data is None:
        yield from (np.empty(0, np.uint8) for _ in range(len(column)))
        return
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[0:0] if nulls[i] else raw[ends[i] : ends[i + 1]]
