"""Hits beside a search of every window in every document."""

import re

import pytest

from conftest_llm import LOWER
from foldwise.llm import decontam


def ws(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for i, text in docs:
        w = ws(text)
        hit, names = set(), set()
        for item, of in items:
            b = ws(of)
            size = min(13, len(b))
            for k in range(len(b) - size + 1 if b else 0):
                for at in range(len(w) - size + 1):
                    if w[at:at + size] == b[k:k + size]:
                        hit |= set(range(at, at + size))
                        names.add(str(item))
        out.append((i, len(w), len(hit), sorted(names),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def held(docs, items):
    got = [tuple(r) for r in decontam.decontaminated(docs, items).collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=repr) == brute(rows, [tuple(r) for r in items.collect()])


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly box a jug of É wine"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, ITEM), (10, ITEM), (2, "one two three"), (3, None), (4, ""), (5, "..."),
         (9, "the the the the the the the the the the the the the the the")],
        "item_id bigint, text string")


def test_planted(spark, items):
    rows = [(1, ITEM), (2, ITEM.upper()), (3, ITEM.replace("wizards", "witches")),
            (4, "x " * 500 + ITEM.replace(" ", ", ") + " y" * 10), (5, "the " * 40),
            (6, "One-two. THREE!"), (7, "one two"), (8, ITEM.replace("É", "é")),
            (9, " ".join(ITEM.split()[1:14])), (10, " ".join(ITEM.split()[1:13])), (11, None),
            (12, "1one two three two one two three")]
    held(spark.createDataFrame(rows, "doc_id bigint, text string"), items)


def test_odd_rows(odd_docs, items):
    held(odd_docs, items)


def test_empty_tables(no_docs, odd_docs, items):
    assert decontam.decontaminated(no_docs, items).collect() == []
    held(odd_docs, items.limit(0))


def test_shuffle_join_same(spark, items, monkeypatch):
    rows = [(i, f"word {ITEM} {i}" if i % 2 else f"one two three {i}") for i in range(20)]
    monkeypatch.setattr("foldwise.llm.common.BROADCAST_ROWS", 0)
    held(spark.createDataFrame(rows, "doc_id bigint, text string"), items)


def test_words_travel_without_their_text(spark, items, monkeypatch):
    """Beyond a broadcast, no exchange carries a text's words beside a single word."""
    monkeypatch.setattr("foldwise.llm.common.BROADCAST_BYTES", 0)
    rows = [(1, ITEM), (1, ITEM), (1, "other " + ITEM), (None, ITEM), (2, f"{ITEM} " + "filling " * 99)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    held(docs, items)
    found = decontam.hits(docs.selectExpr("*", "xxhash64(text) AS h"), items, ["doc_id", "h"])
    joins = [n for n in _nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    by_word = [j for j in joins if re.search(r"\bkey#", j.simpleString(1000))]
    assert by_word
    for join in by_word:
        names = [a.name() for a in _items(join.left().output())]
        assert "at" in names and "w" not in names


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan):
    yield plan
    for child in _items(plan.children()):
        yield from _nodes(child)
