"""Substring dedup by hashing lines and sentences.

A text is cut into units: lines, sentences in them, and sentences of more than
``LONG`` words after the word of least hash in every window of ``LONG`` words, so
that a passage is cut in the same way wherever it stands: from its first such
word, or its first stop or line break, to its last. At each end at most ``LONG``
words lie outside these, so of a passage of 50 words or more at least
``MIN_WORDS`` are found (of one cut by line breaks, if the breaks are the same).

A unit is normalised (lower case, white space to one space). What is compared
are stretches: a unit of at least ``MIN_WORDS`` words, or the fewest units beside
each other, from a unit on or up to it, that have as many. The 128-bit digest of a
stretch is grouped over all documents. The earliest occurrence, by (doc_id, place
in the text), is kept, the later ones are removed; so all that goes lies in
stretches of ``MIN_WORDS`` words or more that stood elsewhere as a whole, and
a repeated phrase of fewer words is no passage. Spans of removed text are offsets
(code points) into the original text.

Digests are counted with map-side combine, and each stretch then meets the first
place of its digest in a join, so a line that a third of all documents hold is
no single task's work. Only stretches that occur before travel on.

A null text has no units and stays null; an empty one stays empty. Rows with a
null id take no part and stay as they are. Rows with the same id and text count
as one document; different texts under one id are different documents, ranked by
a hash of their text. Columns named ``__spans`` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import stored
from foldwise.llm.tokens import mix, numbers, text_slices, word_spans

MIN_WORDS = 10
# Beyond so many words a sentence is cut, once in every window of so many words. A passage loses at
# most so many words at each end to units that it shares with its surroundings.
LONG = 20
_SALT = numbers(2, 21)
_STEP = numbers(MIN_WORDS + 1, 22)
_LOW = (1 << 32) - 1
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash, of equal ones the last, in each window of ``width`` words."""
    at, span = np.arange(len(hashes)), 1
    while span < width and len(at):
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    return at


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, place in the row, first byte, end byte (in the row), words, two digests of each unit."""
    hashes, starts, ends, bounds = word_spans(data, offsets)
    n = len(hashes)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    # A unit begins where a row or a line begins, and after a full stop.
    lines = np.cumsum(data == 0x0A)
    first = np.ones(n, dtype=bool)
    first[1:] = ((row[1:] != row[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
                 | _STOP[data[ends[:-1] - 1]])
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, n))
    # Windows that lie in one sentence; one of LONG words exactly is not cut.
    sentence = np.repeat(np.arange(len(head)), np.where(size > LONG, size, 0))
    of_long = np.flatnonzero(np.repeat(size > LONG, size))
    least = _least(mix(hashes[of_long]), LONG)
    whole = sentence[:len(least)] == sentence[len(sentence) - len(least):]
    cut = np.zeros(n + 1, dtype=bool)
    cut[of_long[least[whole]] + 1] = True
    head = np.flatnonzero(first | cut[:n])
    size = np.diff(np.append(head, n))
    place = (np.arange(n) - np.repeat(head, size)).astype(np.uint64)
    digests = [mix(np.add.reduceat(mix((hashes ^ salt) + place * np.uint64(0x9E3779B97F4A7C15)),
                                   head)).view(np.int64) for salt in _SALT]
    of = row[head]
    tail = head + size - 1
    return (of, np.arange(len(head)) - np.searchsorted(of, of, "left"),
            starts[head] - offsets[of], ends[tail] - offsets[of], size, *digests)


def _stretches(row: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of each stretch: the fewest units of a row with enough words,
    from each unit on and up to each unit."""
    n = len(row)
    until = np.cumsum(words)
    before = until - words
    unit = np.arange(n)
    last = np.searchsorted(until, before + min_words)
    onward = last < n
    onward[onward] = row[last[onward]] == row[onward]
    first = np.searchsorted(before, until - min_words, "right") - 1
    back = first >= 0
    back[back] = row[first[back]] == row[back]
    both = np.unique(np.concatenate([unit[onward] * n + last[onward], first[back] * n + unit[back]]))
    return both // max(n, 1), both % max(n, 1)


def _digest(units: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int) -> np.ndarray:
    """One number for the digests of the units of each stretch, in their order."""
    count = last - first + 1
    total = np.zeros(len(first), dtype=np.uint64)
    for k in range(min(longest, int(count.max()) if len(count) else 0)):
        own = np.flatnonzero(count > k)
        total[own] += mix(units[first[own] + k].view(np.uint64) + _STEP[k % len(_STEP)])
    return mix(total + count.astype(np.uint64)).view(np.int64)


def stretches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h (of the text), places (first and last unit), span (first and end byte) and
    digest of every stretch; pairs are packed into one number each."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, data, offsets in text_slices(batch.column("text")):
                row, place, begin, end, size, d1, d2 = _units(data, offsets)
                first, last = _stretches(row, size, min_words)
                rows = pa.array(row[first] + first_row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("h").take(rows),
                     pa.array(place[first] << 32 | place[last]), pa.array(begin[first] << 32 | end[last]),
                     *[pa.array(_digest(d, first, last, min_words)) for d in (d1, d2)]],
                    names=["doc_id", "h", "places", "span", "d1", "d2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return own.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(
        cut_up, f"doc_id {kind}, h bigint, places bigint, span bigint, d1 bigint, d2 bigint")


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h and ``spans``, sorted (first byte, end byte) pairs to remove."""
    every = stretches(docs, min_words)
    here = F.struct("doc_id", "h", "places")
    # Stored, so that the join reads plain shuffles of which Spark can split a large part.
    firsts = (every.groupBy("d1", "d2").agg(F.min(here).alias("f"), F.max(here).alias("l"))
              .where(F.col("f") != F.col("l"))
              .select("d1", "d2", F.col("f.doc_id").alias("f_doc"), F.col("f.h").alias("f_h"),
                      F.col("f.places").alias("f_places")))
    firsts = stored(firsts, "repeat-firsts")
    later = (every.join(firsts, ["d1", "d2"])
             .where((F.col("doc_id") != F.col("f_doc")) | (F.col("h") != F.col("f_h"))
                    | (F.col("places") != F.col("f_places")))
             .select("doc_id", "h", "places", "span"))
    found = later.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct("places", "span"))).alias("stretches"))
    return found.select("doc_id", "h", _joined("stretches").alias("spans"))


def _joined(name: str):
    """Stretches that overlap or lie beside each other as one (begin, end) each."""
    def high(packed):
        return F.shiftright(packed, 32).cast("int")

    def low(packed):
        return packed.bitwiseAND(F.lit(_LOW)).cast("int")

    one = F.col(name)[0]
    start = F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"),
                     low(one["places"]).alias("place"), high(one["span"]).alias("begin"),
                     low(one["span"]).alias("end"))

    def closed(run):
        return F.concat(run["done"], F.array(F.struct(run["begin"].alias("begin"),
                                                      run["end"].alias("end"))))

    def step(run, own):
        beside = high(own["places"]) <= run["place"] + 1
        return F.struct(
            F.when(beside, run["done"]).otherwise(closed(run)).alias("done"),
            F.when(beside, F.greatest(run["place"], low(own["places"])))
            .otherwise(low(own["places"])).alias("place"),
            F.when(beside, run["begin"]).otherwise(high(own["span"])).alias("begin"),
            F.when(beside, F.greatest(run["end"], low(own["span"])))
            .otherwise(low(own["span"])).alias("end"))

    return F.aggregate(F.col(name), start, step, closed)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, where = [], []
        at, of = (batch.schema.get_field_index(c) for c in ("text", "__spans"))
        for text, cuts in zip(batch.column(at), batch.column(of)):
            text, cuts = text.as_py(), cuts.as_py()
            if not cuts:
                out.append(text)
                where.append([])
                continue
            data, kept, last, chars, spans_ = text.encode(), [], 0, 0, []
            for cut in cuts:
                before = data[last:cut["begin"]].decode()
                gone = data[cut["begin"]:cut["end"]].decode()
                kept.append(before)
                chars += len(before)
                spans_.append({"first": chars, "end": chars + len(gone)})
                chars += len(gone)
                last = cut["end"]
            kept.append(data[last:].decode())
            out.append(_tidy(kept))
            where.append(spans_)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(k) for k in range(batch.num_columns)]
        columns[at], columns[of] = pa.array(out, pa.string()), pa.array(where, kind)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _tidy(kept: list[str]) -> str:
    """Join what is left; where a passage went, one break or space remains."""
    out = kept[0]
    for part in kept[1:]:
        gap = re.search(r"\s*$", out)[0] + re.match(r"\s*", part)[0]
        out, part = out.rstrip(), part.lstrip()
        out += ("\n" if "\n" in gap else " ") + part if out and part else part
    return out


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of the documents, ``text`` without repeats, and ``__spans`` that went.

    A span is (first, end) in code points of the original text.
    """
    found = stored(spans(docs, min_words), "repeat-spans")
    found = found.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"),
                         F.col("spans").alias("__spans"))
    docs = docs.drop("__spans")
    joined = docs.join(found, (docs["doc_id"] == F.col("__id"))
                       & (F.xxhash64(docs["text"]) == F.col("__h")), "left").drop("__id", "__h")
    kind = T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("__spans", kind)])
    return joined.mapInArrow(_removed, schema)
