"""Ids and decoded texts beside the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwise.llm import bpe

PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "à", "漢", "🙂", "12", "٣", "!!", " ",
          "\u0085", " ", "\x1c", "\x00", "<|endoftext|>", "<|", "zzz", "aaaaaaa", "https://"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=30))
def test_as_library(library, own, parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_letters_of_newer_unicode(own, library):
    """Characters that only some versions of Unicode call letters or numbers."""
    for c in ["\U00012550", "\u1c89", "\ua7cb", "\U00010d40", "\u0870", "\U0001e5d0", "漢", "ж", "\u2028"]:
        for text in (f"{c}'s {c}1 a{c}, {c}{c} .{c}", f" {c}\n{c}  {c}"):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(text), "<u4").tolist() == ids


def test_full_tables_change_nothing(own, monkeypatch):
    texts = [f"some words{i} of text number {i % 5}" for i in range(200)]
    expected = own.encode_all(texts)
    monkeypatch.setattr(bpe, "ENTRIES", 3)
    small = bpe.Bpe(bpe.default_path())
    assert [small.encode(t) for t in texts] == expected


def test_rows(odd_docs, no_docs, library):
    got = bpe.encoded(odd_docs, decode=True)
    assert got.columns == [*odd_docs.columns, "__tokens", "__decoded"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert hashlib.sha256(np.array(ids, "<u4").tobytes()).digest() == \
            hashlib.sha256(r["__tokens"]).digest()
        assert r["__decoded"] == (r["text"] or "")
    assert bpe.encoded(no_docs).collect() == []
