"""Runs of repeated words: stretches that repeat with a period, by multi-scale minimizers.

A run is a stretch of words with smallest period q, of at least 4 * q and 6
words, that no word beside it extends. Words are compared exactly.

Periods below ``SHORT`` are scanned directly: places where a word equals the one
q later, in stretches. Longer periods are found by scale. At scale w every
window of w places marks the least hash of the 2w words from each place on. In
a run of period q, w <= q < 2w, windows a period apart mark the same place of the
period, and 2w >= q words of a run come again only after whole periods: so two
marked places with the same words, neighbours in their list, are q apart. Every
such pair is a seed, extended to both sides by comparing powers of two of words;
a stretch counts if it is long enough and its period is not a multiple of a
shorter one. The test on 2w words needs no more than 4q words, so no run is lost.

Hashes of 64 bits propose; each stretch found is compared word by word. Texts
are treated many at a time, in slices; the work is about words x log(words) ^ 2
whatever the text, as a place is a seed at most once in each scale.

Null and empty texts have no words and no runs; a very long text is one unit of
work. Every row is treated by itself, so ties and repeated rows need no rule.
Input columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.tokens import mix, numbers

SHORT = 8
LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_CHARS = 1 << 21
_ODD = numbers(64, 11) | np.uint64(1)
_LARGEST = np.uint64(2**64 - 1)
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, length, period) of all runs, sorted; text t has the words ``bounds[t]``
    to ``bounds[t + 1]``, numbered from 0 over all texts."""
    sizes = np.diff(bounds)
    longest = int(sizes.max()) if len(sizes) else 0
    if longest < LEAST_WORDS:
        return []
    found = set()
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    for q in range(1, min(SHORT - 1, longest // LEAST_PERIODS) + 1):
        found.update(_at_lag(ids, text_of, q))
    w = SHORT
    if longest >= LEAST_PERIODS * w:
        with np.errstate(over="ignore"):
            hashes = mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        # powers[j][i]: hash of the 2^j words from i on, over the bounds of texts too.
        powers = [hashes]
        while longest >= LEAST_PERIODS * w:
            while 1 << (len(powers) - 1) < 2 * w:
                powers.append(_doubled(powers[-1], len(powers) - 1))
            kept = sizes >= LEAST_PERIODS * w
            found.update(_at_scale(ids, powers, bounds, text_of, kept, w))
            w *= 2
    return sorted((s, e - s, q) for s, e, q in found if _primitive(ids[s:s + q]))


def _doubled(hashes: np.ndarray, j: int) -> np.ndarray:
    """Hashes of 2^(j + 1) words from those of 2^j; near the end they mean nothing."""
    size = 1 << j
    later = np.zeros_like(hashes)
    if size < len(hashes):
        later[:-size] = hashes[size:]
    with np.errstate(over="ignore"):
        return mix(hashes * _ODD[j] + later)


def _at_lag(ids: np.ndarray, text_of: np.ndarray, q: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of period q, long enough, by scanning the lag."""
    same = (ids[:-q] == ids[q:]) & (text_of[:-q] == text_of[q:])
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts + q >= max(LEAST_WORDS, LEAST_PERIODS * q)
    for s, e in zip(starts[long].tolist(), stops[long].tolist()):
        yield s, e + q, q


def _at_scale(ids: np.ndarray, powers: list[np.ndarray], bounds: np.ndarray, text_of: np.ndarray,
              kept: np.ndarray, w: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of periods from w to below 2w in the texts ``kept``."""
    size = 2 * w
    # Places with 2w words before the end of their text, in texts that are long enough.
    valid = np.repeat(kept, np.diff(bounds))
    valid &= np.arange(len(ids)) + size <= bounds[1:][text_of]
    grams = np.where(valid, powers[size.bit_length() - 1], _LARGEST)
    least = _windows(grams, w, np.minimum)
    # A place is marked if it is the least of any window that holds it.
    held = np.full(len(ids), np.uint64(0))
    held[w - 1:] = _windows(least, w, np.maximum)[:len(ids) - w + 1]
    head = min(w - 1, len(ids))
    held[:head] = np.maximum.accumulate(least[:head])
    marked = np.flatnonzero(valid & (held == grams))
    order = marked[np.argsort(grams[marked], kind="stable")]
    left, right = order[:-1], order[1:]
    lag = right - left
    pair = (grams[left] == grams[right]) & (text_of[left] == text_of[right]) & (lag >= w) & (lag < size)
    left, lag = left[pair], lag[pair]
    if not len(left):
        return
    # In a run seeds follow each other a lag apart: the first of such a chain is extended
    # to the left, the last to the right.
    order = np.lexsort((left, left % lag, lag))
    left, lag = left[order], lag[order]
    follows = np.append(False, (np.diff(left) == lag[1:]) & (lag[1:] == lag[:-1]))
    head, tail = left[~follows], left[np.append(~follows[1:], True)]
    lag = lag[~follows]
    stops = tail + lag + _forward(powers, tail, tail + lag, bounds[1:][text_of[tail]])
    starts = head - _backward(powers, head, head + lag, bounds[:-1][text_of[head]])
    long = stops - starts >= LEAST_PERIODS * lag
    for s, e, q in set(zip(starts[long].tolist(), stops[long].tolist(), lag[long].tolist())):
        if np.array_equal(ids[s:e - q], ids[s + q:e]):
            yield s, e, q
        else:  # Two word sequences of one hash: scan the lag itself.
            text = int(text_of[s])
            a, b = int(bounds[text]), int(bounds[text + 1])
            for x, y, _ in _at_lag(ids[a:b], np.zeros(b - a, np.int8), q):
                yield x + a, y + a, q


def _windows(values: np.ndarray, w: int, least) -> np.ndarray:
    """For each place the least (or largest) of the w values from there on, w a power of two."""
    out, size = values.copy(), 1
    while size < w:
        if size < len(out):
            out[:-size] = least(out[:-size], out[size:])
        size *= 2
    return out


def _forward(powers: list[np.ndarray], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many words from a and from b on are the same, with b before ``last``."""
    done = np.zeros(len(a), dtype=np.int64)
    top = len(powers) - 1
    moving = np.arange(len(a))
    while len(moving):  # Whole largest powers, as long as they agree.
        x, y = a[moving] + done[moving], b[moving] + done[moving]
        fits = y + (1 << top) <= last[moving]
        moving, x, y = moving[fits], x[fits], y[fits]
        moving = moving[powers[top][x] == powers[top][y]]
        done[moving] += 1 << top
    for j in range(top - 1, -1, -1):
        y = b + done
        here = np.flatnonzero(y + (1 << j) <= last)
        here = here[powers[j][a[here] + done[here]] == powers[j][y[here]]]
        done[here] += 1 << j
    return done


def _backward(powers: list[np.ndarray], a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words before a and before b are the same, from ``first`` on."""
    done = np.zeros(len(a), dtype=np.int64)
    top = len(powers) - 1
    moving = np.arange(len(a))
    while len(moving):
        x = a[moving] - done[moving] - (1 << top)
        fits = x >= first[moving]
        moving, x = moving[fits], x[fits]
        y = b[moving] - done[moving] - (1 << top)
        moving = moving[powers[top][x] == powers[top][y]]
        done[moving] += 1 << top
    for j in range(top - 1, -1, -1):
        x = a - done - (1 << j)
        here = np.flatnonzero(x >= first)
        here = here[powers[j][x[here]] == powers[j][b[here] - done[here] - (1 << j)]]
        done[here] += 1 << j
    return done


def _primitive(root: np.ndarray) -> bool:
    """Whether a sequence is no repetition of a shorter one."""
    n, left, p = len(root), len(root), 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            if np.array_equal(root[n // p:], root[:-(n // p)]):
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie beyond the first period of any run."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def found(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """For each text its number of words, its runs, and its kept words joined by a space."""
    words = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for own in words for w in own], dtype=np.int64)
    bounds = np.cumsum([0, *map(len, words)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(ids, bounds):
        text = int(np.searchsorted(bounds, start, "right")) - 1
        runs[text].append((start - int(bounds[text]), length, period))
    return ([len(own) for own in words], runs,
            [b" ".join(_kept(own, r)) for own, r in zip(words, runs)])


def with_runs(docs: DataFrame) -> DataFrame:
    """All other columns and n_words, runs (sorted by start, then period), strongest (a
    run or null) and collapsed, the text without repetitions."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
              T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())]
    new = [f.name for f in fields]
    others = [f for f in docs.schema.fields if f.name not in new]
    run_type = pa.struct([(c, pa.int64()) for c in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _slices(batch.column("text")):
                n, runs, kept = found(texts)
                best = [strongest(r) for r in runs]
                cells = [pa.array(n, pa.int64()),
                         pa.array([[dict(zip(RUN.names, r)) for r in own] for own in runs],
                                  pa.list_(run_type)),
                         pa.array([r and dict(zip(RUN.names, r)) for r in best], run_type),
                         pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(done, len(texts)) for c in batch.columns], *cells],
                    names=[*batch.schema.names, *new])
                done += len(texts)

    own = docs.select(*[F.col(f"`{f.name}`") for f in others])
    return own.mapInArrow(run, T.StructType([*others, *fields]))


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    """Runs of texts of about SLICE_CHARS bytes; null is empty."""
    run, size = [], 0
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        text = value.as_py() or b""
        run.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run
