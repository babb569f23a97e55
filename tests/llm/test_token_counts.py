"""Numbers of tokens beside the tokenizers library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwise.llm import bpe, token_counts
from foldwise.llm.units import Units, pieces
from test_bpe import PIECES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def plain(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=20),
                max_size=5))
def test_pieces_alone(library, texts):
    """Pieces of units, each counted alone, add up to the whole text."""
    model = bpe.load(bpe.default_path())
    texts = ["".join(t).encode("utf-8", "replace") for t in texts]
    units = Units(texts, model.find_added)
    for k, text in enumerate(texts):
        n = 0
        for u in range(units.bounds[k], units.bounds[k + 1]):
            data = units.joined[units.starts[u]:units.ends[u]]
            n += 1 if units.added[u] else sum(len(p) // 4 for p in model.of_pieces(pieces(data)))
        assert n == plain(library, text.decode())
        assert b"".join(units.joined[a:b] for a, b in zip(
            units.starts[units.bounds[k]:units.bounds[k + 1]],
            units.ends[units.bounds[k]:units.bounds[k + 1]])) == text


def test_equal_hashes(monkeypatch):
    """Two units of one hash are told apart by their bytes."""
    units = Units([b"some words and some more words"], None)
    monkeypatch.setattr("foldwise.llm.units.mix", lambda x: x & np.uint64(1))
    distinct, which = units.distinct(0, len(units.starts))
    assert [distinct[k] for k in which] == [b"some", b" words", b" and", b" some", b" more", b" words"]


def test_rows(odd_docs, no_docs, library):
    got = token_counts.counted(odd_docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), plain(library, r["text"]))
                      for r in odd_docs.collect())
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == expected
    assert token_counts.counted(no_docs).collect() == []


def test_small_blocks(spark, library, monkeypatch):
    """Blocks of single texts, many shards, added tokens, one text in several runs of units."""
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1)
    monkeypatch.setattr(token_counts, "ASKED", 2)
    monkeypatch.setattr("foldwise.llm.units.RUN_BYTES", 50)
    texts = ["a <|endoftext|> b<|endoftext|>", "  \n", "the end " * 40, "the end " * 40, None]
    block = token_counts._Block()
    added = bpe.load(bpe.default_path()).find_added
    block.add(list(range(5)), [(t or "").encode() for t in texts], added)
    assert sum(len(n) for _, n in block.pairs) > len(block.number)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r[0]: (r[1], r[2]) for r in token_counts.counted(docs).collect()}
    assert got == {k: (len((t or "").encode()), plain(library, t)) for k, t in enumerate(texts)}


def test_every_pre_token_is_counted_once(spark, monkeypatch):
    """Blocks ask a shard for the same pre-token; each shard has its own ones."""
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1)
    docs = spark.createDataFrame([(i, f"the same words and own{i}") for i in range(20)],
                                 "doc_id int, text string")
    found = token_counts.blocks(docs, "doc_id", bpe.default_path())
    shards = {}
    for r in token_counts.asked(found, 7).collect():
        for piece in token_counts._unpacked(r["pieces"]):
            shards.setdefault(piece, set()).add(r["shard"])
    assert len(shards) >= 5 and all(len(s) == 1 for s in shards.values())
    assert len(set().union(*shards.values())) > 3
