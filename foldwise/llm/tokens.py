"""64-bit hashes of words and word shingles of many texts at once, in numpy.

Words are maximal runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``);
A-Z count as a-z. A word's hash sums one random number for each (place, byte)
and is mixed with the length, so two different words agree with a chance of
about 2^-64. The numbers come from a fixed generator: every task has the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n random-looking 64-bit numbers."""
    with np.errstate(over="ignore"):
        step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(step + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = numbers(_PLACES * 256, 1).reshape(_PLACES, 256)
_TABLE[:, 65:91] = _TABLE[:, 97:123]
_TABLE = _TABLE.ravel()
_ODD = numbers(5, 2) | np.uint64(1)


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows of about ``size`` bytes; null is empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        part = offsets[first:last + 1]
        yield first, data[part[0]:part[-1]], part - part[0]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray,
               outside: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """Hash, first byte and end byte of each word; first word of each row and their number.

    ``outside`` tells for each byte whether it separates words.
    """
    inside = ~outside[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begins[heads], closes[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    kept = data[inside]
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    value = _TABLE[(place & (_PLACES - 1)) * 256 + kept]
    if lengths.max() > _PLACES:
        value = value * ((place // _PLACES * 2 + 1).astype(np.uint64))
    total = np.add.reduceat(value, at)
    return (mix(total + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
            starts, ends, bounds)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the number of all words)."""
    hashes, _, _, bounds = word_spans(data, offsets)
    return hashes, bounds


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash for each sequence of up to five hashes."""
    total = np.full(len(parts[0]), np.uint64(len(parts) * 0xA24BAED4963EE407 % 2**64))
    for odd, part in zip(_ODD, parts):
        total = total + part * odd
    return mix(total)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, sorted.

    A row of fewer words has the whole sequence as its one shingle; a row
    without words has none.
    """
    n = len(hashes)
    every = (combine(*[hashes[k:n - size + 1 + k] for k in range(size)]) if n >= size
             else np.zeros(0, np.uint64))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            yield np.unique(every[a:b - size + 1])
        elif b > a:
            yield combine(*[hashes[k:k + 1] for k in range(a, b)])
        else:
            yield np.zeros(0, np.uint64)
