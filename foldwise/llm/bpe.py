"""Byte-level BPE by forced boundaries, for a tokenizer file of the tokenizers library.

A byte pair that occurs inside no token of the vocabulary can never end up in
one token, whatever is merged: a text is cut there, the fragments are encoded
independently and their ids are concatenated. Cuts are made in three steps:

1. at added tokens, which are taken out first;
2. before a space between two characters that are not white space: the
   pre-tokenizer's pattern always starts a new piece there (``units``);
3. inside each piece of the pattern, at every pair that no token holds.

Distinct fragments are merged by rank, many side by side. Distinct units and
pieces are looked up in tables of two generations: a full one becomes the old
one, what is used again moves to the new one, the rest goes. That changes no
result. Decoding concatenates the tokens' bytes.

Null and empty texts have no tokens and decode to the empty text. Every row is
encoded by itself, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.units import Units, gathered, is_piece, pieces

ENTRIES = 60_000
SLICE_CHARS = 1 << 20


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Table:
    """Packed ids by bytes in two generations of about ENTRIES each."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def turn(self) -> None:
        """A full generation becomes the old one."""
        if len(self.young) > ENTRIES:
            self.old, self.young = self.young, {}

    def missing(self, wanted: Iterable[bytes]) -> list[bytes]:
        """Those in neither generation; all others are in ``young`` afterwards."""
        young, old, new = self.young, self.old, []
        for w in wanted:
            if w not in young:
                known = old.get(w)
                if known is None:
                    new.append(w)
                else:
                    young[w] = known
        return new


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and not model.get("dropout")
                 and not model.get("byte_fallback") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix")
                 and not model.get("end_of_word_suffix") and spec["normalizer"] is None
                 and before["type"] == "ByteLevel" and before["use_regex"]
                 and not before["add_prefix_space"])
        added = spec["added_tokens"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        byte_of = _byte_of_char()
        self.added = {t["content"]: t["id"] for t in added if t["content"]}
        self.added_ids = {t.encode(): i.to_bytes(4, "little") for t, i in self.added.items()}
        vocabulary = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()
                      if token not in self.added}
        rank = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rank[bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)] = r
        self.token = [b""] * (1 + max([*vocabulary.values(), *self.added.values()]))
        for token, i in vocabulary.items():
            self.token[i] = token
        for content, i in self.added.items():
            self.token[i] = content.encode()
        self.holds = np.zeros((256, 256), dtype=bool)
        for token in vocabulary:
            for a, b in zip(token, token[1:]):
                self.holds[a, b] = True
        # Merges as sorted keys of two ids, with their ranks and results.
        pairs = sorted(((vocabulary[a] << 32) | vocabulary[b], r, vocabulary[a + b])
                       for (a, b), r in rank.items())
        self.keys, self.ranks, self.results = (
            np.array(column, dtype=np.int64) for column in (zip(*pairs) if pairs else ((),) * 3))
        self._hash_keys()
        self.of_byte = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        names = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile(b"|".join(re.escape(n.encode()) for n in names)) if names else None
        self.bytes_of, self.ends_of = (np.frombuffer(b"".join(self.token), dtype=np.uint8),
                                       np.cumsum([0, *map(len, self.token)]))
        # Units and pieces: a unit that is also a piece has the same ids.
        self.known = Table()

    def _hash_keys(self) -> None:
        """Slots of merges by hash: a merge lies at most ``probes`` places beyond its slot."""
        size = 1 << max(4, (16 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        slots = np.full(size + len(self.keys) + 1, -1, dtype=np.int32)
        self.probes = 1
        for k, at in enumerate(self._slot(self.keys).tolist()):
            first = at
            while slots[at] >= 0:
                at += 1
            slots[at] = k
            self.probes = max(self.probes, at - first + 1)
        self.slots = slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of ids the number of its merge, -1 without one."""
        key = (left << 32) | right
        slot = self._slot(key)
        out = np.full(len(key), -1, dtype=np.int32)
        for k in range(self.probes):
            at = self.slots[slot + k]
            hit = (at >= 0) & (self.keys[at] == key) if len(self.keys) else at >= 0
            out[hit] = at[hit]
        return out

    def merged(self, fragments: list[bytes]) -> list[bytes]:
        """Packed ids of each fragment: in each round every fragment that still has a
        known pair merges all places of its pair of lowest rank, from left to right."""
        lengths = np.array([len(f) for f in fragments], dtype=np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(fragments), dtype=np.uint8)]
        own = np.repeat(np.arange(len(fragments)), lengths)
        # Merges sorted by rank would do without ``ranks``; files need not list them so.
        never = np.int64(1) << 60
        ranks = np.append(self.ranks, never)
        rule = np.full(len(ids), -1, dtype=np.int32)
        if len(ids) > 1:
            rule[:-1] = self._rules(ids[:-1], ids[1:])
            rule[:-1][own[:-1] != own[1:]] = -1
        done_own, done_ids = [], []
        while len(ids):
            rank = ranks[rule]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            finished = least == never
            if finished.any():
                out = np.repeat(finished, sizes)
                done_own.append(own[out])
                done_ids.append(ids[out])
                left = ~out
                ids, own, rule, rank = ids[left], own[left], rule[left], rank[left]
                least, sizes = least[~finished], sizes[~finished]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # Of hits side by side (a pair of equal ids) every other one merges.
            beside = np.append(False, np.diff(at) == 1)
            if beside.any():
                k = np.arange(len(at))
                first = np.maximum.accumulate(np.where(beside, 0, k))
                at = at[(k - first) % 2 == 0]
            ids[at] = self.results[rule[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))
            ids, own, rule = ids[keep], own[keep], rule[keep]
            # Only the pairs that a merged place belongs to have changed.
            for place in (new, new[new > 0] - 1):
                inside = place[place < len(ids) - 1]
                found = self._rules(ids[inside], ids[inside + 1])
                found[own[inside] != own[inside + 1]] = -1
                rule[inside] = found
                rule[place[place == len(ids) - 1]] = -1
        if not done_own:
            return [b""] * len(fragments)
        owners, packed = np.concatenate(done_own), np.concatenate(done_ids)
        order = np.argsort(owners, kind="stable")
        every = packed[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owners, minlength=len(fragments))) * 4).tolist()
        return [every[a:b] for a, b in zip([0, *ends], ends)]

    def of_pieces(self, data: list[bytes]) -> list[bytes]:
        """Packed ids of pieces: cut at pairs that no token holds, merge each fragment once."""
        joined = np.frombuffer(b"".join(data), dtype=np.uint8)
        ends = np.cumsum([len(d) for d in data])
        cut = np.append(~self.holds[joined[:-1], joined[1:]], True) if len(joined) else \
            np.zeros(0, dtype=bool)
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        every = joined.tobytes()
        fragments = [every[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        distinct = list(dict.fromkeys(fragments))
        packed = dict(zip(distinct, self.merged(distinct)))
        last = np.searchsorted(stops, ends, "right").tolist()
        return [packed[fragments[a]] if b - a == 1 else b"".join([packed[f] for f in fragments[a:b]])
                for a, b in zip([0, *last], last)]

    def _of_units(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of distinct units that are no added tokens."""
        self.known.turn()
        single, several = [], {}
        for unit in self.known.missing(units):
            if is_piece(unit):
                single.append(unit)
            else:
                several[unit] = pieces(unit)
        inner = set().union(*several.values()).difference(several)
        new = list(dict.fromkeys([*single, *self.known.missing(inner)]))
        # A unit of one piece that ``is_piece`` did not tell is among ``several``.
        new += [u for u, own in several.items() if len(own) == 1]
        table = self.known.young
        if new:
            table.update(zip(new, self.of_pieces(new)))
        for unit, own in several.items():
            if len(own) > 1:
                table[unit] = b"".join([table[p] for p in own])
        return [table[u] for u in units]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        units = Units([t.encode() for t in texts], self.find_added)
        out, counts = [], [np.zeros(0, dtype=np.int64)]
        for first, last in units.runs():
            distinct, which = units.distinct(first, last)
            special = np.zeros(len(distinct), dtype=bool)
            special[which[units.added[first:last]]] = True
            packed = self._of_units([u for u, s in zip(distinct, special.tolist()) if not s])
            for k in np.flatnonzero(special).tolist():
                packed.insert(k, self.added_ids[distinct[k]])
            ids, lengths = gathered(np.frombuffer(b"".join(packed), dtype="<u4"),
                                    np.cumsum([0, *map(len, packed)]) // 4, which)
            out.append(ids.tobytes())
            counts.append(lengths)
        every = b"".join(out)
        ends = np.append(0, np.cumsum(np.concatenate(counts)))[units.bounds].tolist()
        return [every[4 * a:4 * b] for a, b in zip(ends[:-1], ends[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        out, lengths = gathered(self.bytes_of, self.ends_of, ids)
        every = out.tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.cumsum([0, *map(len, packed)]) // 4].tolist()
        return [every[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, packed: bytes) -> str:
        return self.decode_all([packed])[0]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One for each worker process, so its tables serve all its tasks."""
    return Bpe(path)


def _runs(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in runs of about SLICE_CHARS; null is empty."""
    run, chars = [], 0
    for value in column:
        text = value.as_py() or ""
        run.append(text)
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """All columns of the documents and ``__tokens``, ids packed as little-endian uint32; input
    columns of the new names are replaced.

    With ``decode``, also ``__decoded``, the text that the ids decode to.
    """
    path = path or default_path()
    fields = [T.StructField("__tokens", T.BinaryType())]
    if decode:
        fields.append(T.StructField("__decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            done = 0
            for texts in _runs(batch.column("text")):
                packed = bpe.encode_all(texts)
                more = [pa.array(packed, pa.binary())]
                if decode:
                    more.append(pa.array(bpe.decode_all(packed), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(done, len(texts)) for c in batch.columns], *more],
                    names=[*batch.schema.names, *[f.name for f in fields]])
                done += len(texts)
        # The worker lives on: its batches' memory does not.
        pa.default_memory_pool().release_unused()

    docs = docs.drop(*[f.name for f in fields])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def n_tokens(packed: Column) -> Column:
    """The number of ids in a packed column."""
    return (F.length(packed) / 4).cast("bigint")
