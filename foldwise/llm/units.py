"""Texts cut before spaces into units that a byte-level pre-tokenizer treats alone.

The pattern of byte-level pre-tokenizers starts a new piece before every space
that has no white space beside it. Cut there, and at added tokens, each unit has
the same pieces alone as in its text. Distinct units are found by a hash in
numpy, and every occurrence is compared byte by byte with its representative.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

from foldwise.llm.tokens import mix, numbers

# Fixed value: the pattern of byte-level pre-tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN_BYTES = 1 << 20
# Never part of UTF-8: stands between texts.
_BETWEEN = 0xFF
_pieces = regex.compile(PATTERN).findall
_PLACES = 64
_TABLE = numbers(_PLACES * 256, 3)
# White space of one byte, and first bytes of characters that may be white space.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_MAYBE = np.zeros(256, dtype=bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Units:
    """The units of some texts: bytes ``starts[k]`` to ``ends[k]`` of ``data``.

    Text t has the units ``bounds[t]`` to ``bounds[t + 1]``; an empty text has
    none. ``added[k]`` tells whether a unit is one of the added tokens.
    """

    def __init__(self, texts: list[bytes], added: re.Pattern | None):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.joined = bytes([_BETWEEN]).join([*texts, b""]) if texts else b""
        data = self.data = np.frombuffer(self.joined, dtype=np.uint8)
        begins = np.cumsum(sizes + 1) - sizes - 1
        full = sizes > 0
        starts, stops = [begins[full], self._sure_spaces()], [begins[full] + sizes[full]]
        own = np.array([m.span() for m in added.finditer(self.joined)] if added else [],
                       dtype=np.int64).reshape(-1, 2)
        if len(own):
            # No cut lies inside an added token; one lies at each of its ends.
            spaces = starts[1]
            at = np.searchsorted(own[:, 0], spaces, "right") - 1
            starts[1] = spaces[(at < 0) | (spaces >= own[np.maximum(at, 0), 1])]
            after = own[:, 1][data[own[:, 1]] != _BETWEEN]
            starts += [own[:, 0], after]
        # Places that cut, as flags: no sort.
        cut = np.zeros(len(data), dtype=bool)
        for places in starts:
            cut[places] = True
        self.starts = np.flatnonzero(cut)
        # A unit ends where the next begins, or where its text ends.
        every = np.append(self.starts[1:], len(data))
        if len(self.starts):
            text_end = stops[0][np.searchsorted(stops[0], self.starts, "right")]
            self.ends = np.minimum(every, text_end)
        else:
            self.ends = every[:0]
        self.bounds = np.searchsorted(self.starts, np.append(begins, len(data)))
        self.added = np.zeros(len(self.starts), dtype=bool)
        self.added[np.searchsorted(self.starts, own[:, 0])] = True

    def _sure_spaces(self) -> np.ndarray:
        """Places of spaces between two characters that are surely not white space."""
        data = self.data
        at = np.flatnonzero(data == 0x20)
        at = at[(at > 0) & (at < len(data) - 1)]
        before, after = data[at - 1], data[at + 1]
        sure = ~(_WHITE[before] | _WHITE[after] | _MAYBE[after]
                 | (before == _BETWEEN) | (after == _BETWEEN))
        # A character of several bytes before the space: look at its first byte.
        wide = sure & (before >= 0x80)
        sure[wide] = ~((data[at[wide] - 2] == 0xC2) | _MAYBE[data[np.maximum(at[wide] - 3, 0)]])
        return at[sure]

    def runs(self) -> Iterator[tuple[int, int]]:
        """Units in runs of about RUN_BYTES."""
        first = 0
        while first < len(self.starts):
            last = int(np.searchsorted(self.ends, self.starts[first] + RUN_BYTES, "right"))
            last = max(last, first + 1)
            yield first, last
            first = last

    def distinct(self, first: int, last: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct units of a run, and for each unit which of them it is."""
        starts, ends = self.starts[first:last], self.ends[first:last]
        lengths = ends - starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        where = place + np.repeat(starts, lengths)
        own = self.data[where]
        value = _TABLE[(place & (_PLACES - 1)) * 256 + own]
        if lengths.max() > _PLACES:
            value = value * (place // _PLACES * 2 + 1).astype(np.uint64)
        hashes = mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))
        order = np.argsort(hashes)
        new = np.append(True, np.diff(hashes[order]) != 0)
        rep = order[new]
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        model = starts[rep][which]
        same = (lengths == lengths[rep][which]).all() and np.array_equal(
            self.data[np.minimum(place + np.repeat(model, lengths), len(self.data) - 1)], own)
        if not same:  # Two units of one hash: take them apart by their bytes.
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(self.joined[a:b], len(number))
                              for a, b in zip(starts.tolist(), ends.tolist())])
            return list(number), which
        joined = self.joined
        return [joined[a:b] for a, b in zip(starts[rep].tolist(), ends[rep].tolist())], which


def is_piece(unit: bytes) -> bool:
    """Whether a unit is surely one piece: letters, with or without a space before.

    Letters up to U+024F are the same in all versions of Unicode.
    """
    word = unit[1:] if unit[:1] == b" " else unit
    if word.isalpha():
        return True
    if word.isascii():
        return False
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250"


def pieces(unit: bytes) -> list[bytes]:
    """The pieces of the pattern in a unit.

    Which characters are letters differs between versions of Unicode beyond
    U+024F, so there the library itself cuts.
    """
    text = unit.decode()
    if max(text) < "\u0250":
        return [p.encode() for p in _pieces(text)]
    return [text[a:b].encode() for _, (a, b) in _library().pre_tokenize_str(text)]


@lru_cache(maxsize=1)
def _library() -> ByteLevel:
    return ByteLevel(add_prefix_space=False, use_regex=True)


def gathered(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[offsets[k]:offsets[k + 1]]`` for each k of ``which``, end to end,
    and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(offsets[:-1][which] - begin, lengths)
    return values[at], lengths
