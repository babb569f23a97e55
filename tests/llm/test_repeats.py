"""Passages that occur before go, all else stays."""

import random
import re

import numpy as np

from conftest_llm import LONG
from foldwise.llm import repeats

SENTENCES = [" ".join(f"Word{s}x{k}" for k in range(9)).capitalize() + "." for s in range(12)]
PASSAGE = " ".join(SENTENCES[:7])


def cleaned(docs):
    return {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}


def own(i, n=3):
    return " ".join(f"Own{i}y{k} text here number {i * 31 + k}." for k in range(n))


def test_passages(spark):
    rows = [(1, f"{own(1)} {PASSAGE} {own(11)}"), (2, f"{own(2)}\n{PASSAGE}\n{own(22)}"),
            (3, f"{own(3)} and then {PASSAGE} {own(33)}"), (4, PASSAGE), (5, own(5)),
            (6, f"{own(6)} {SENTENCES[0]} {own(66)}"), (7, "Yes. No. Yes."), (8, "Yes. No.")]
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    texts = dict(rows)
    assert got[1]["text"] == texts[1] and not got[1]["__spans"]
    assert got[2]["text"] == f"{own(2)}\n{own(22)}"
    assert SENTENCES[3] not in got[3]["text"] and own(33) in got[3]["text"]
    assert got[4]["text"] == ""
    # Too few words in a row for a passage.
    assert all(got[i]["text"] == texts[i] for i in (5, 6, 7, 8))
    for i, r in got.items():
        left, at = [], 0
        for span in r["__spans"] or []:
            left.append(texts[i][at:span["first"]])
            at = span["end"]
        left.append(texts[i][at:])
        assert " ".join(left).split() == r["text"].split()


def test_inside_a_long_sentence(spark):
    """Without stops, units are cut at the same words wherever a passage stands."""
    passage = " ".join(f"term{k}" for k in range(80))
    rows = [(1, " ".join(f"a{k}" for k in range(40)) + " " + passage),
            (2, " ".join(f"b{k}" for k in range(33)) + " " + passage + " and more of b")]
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got[1]["text"] == rows[0][1]
    assert len(set(got[2]["text"].split()) & set(passage.split())) < 40
    assert "b0" in got[2]["text"] and "more" in got[2]["text"]


def test_no_gap_without_cuts(spark):
    """Of every passage of 51 words at most 20 stay at each end, also of few distinct words."""
    rows, passages = [], []
    for k in range(400):
        kinds = 51 if k % 2 else 3
        passage = [f"p{k}w{j * j % 7 % kinds if kinds == 3 else j}" for j in range(51)]
        passages.append(passage)
        rows += [(2 * k + e, " ".join([f"l{k}e{e}x{j}" for j in range(25 + k % 9)] + passage
                                      + [f"r{k}e{e}x{j}" for j in range(25 + k % 7)]))
                 for e in range(2)]
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for k, passage in enumerate(passages):
        text = rows[2 * k + 1][1]
        around = [w for w in text.split() if w[0] != "p"]
        left = got[2 * k + 1]["text"].split()
        assert [w for w in left if w[0] != "p"] == around
        spans = got[2 * k + 1]["__spans"]
        assert spans and text[:spans[0]["first"]].split()[-21:][0][0] == "l"
        assert text[spans[-1]["end"]:].split()[:21][-1][0] == "r"
        assert sum(w[0] == "p" for w in left) <= 40


def test_odd_offsets():
    """Texts shorter than a window, and sentences of just one window, are not cut."""
    for n in (1, 19, 20, 21):
        data = " ".join(f"w{k}" for k in range(n)).encode()
        units = repeats._units(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert sum(units[4]) == n and (len(units[4]) == 1 or n > repeats.LONG)


def test_whitespace_and_case(spark):
    rows = [(1, PASSAGE), (2, "Start. " + PASSAGE.upper().replace(" ", "  ")), (3, "é" + PASSAGE)]
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got[2]["text"] == "Start." and got[3]["text"].startswith("é")


def test_odd_rows(odd_docs, no_docs):
    out = repeats.without_repeats(odd_docs)
    assert out.columns == [*odd_docs.columns, "__spans"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    first, second = sorted(i for i, t in texts.items() if t == LONG)
    by_id = {r["doc_id"]: r for r in rows}
    # The very long text repeats itself, so its first copy is shortened too.
    assert by_id[second]["text"].strip() == ""
    assert by_id[0]["text"] is None and by_id[None]["text"] == texts[None]
    assert repeats.without_repeats(no_docs).collect() == []


def brute(rows):
    """Texts by plain sets: sentences of up to 20 words, stretches of 10 words, first ones stay."""
    def units_of(text):
        return [u.lower().split() for u in re.findall(r"[^.\n]+[.]?", text) if u.split()]

    seen, out = {}, {}
    docs = {i: units_of(t) for i, t in rows}
    for i in sorted(docs):
        units, gone = docs[i], set()
        size = [len(u) for u in units]
        found = set()
        for a in range(len(units)):
            onward = [b for b in range(a, len(units)) if sum(size[a:b + 1]) >= 10][:1]
            found.update((a, b) for b in onward)
            back = [b for b in range(a, -1, -1) if sum(size[b:a + 1]) >= 10][:1]
            found.update((b, a) for b in back)
        for a, b in sorted(found):
            key = tuple(tuple(u) for u in units[a:b + 1])
            if key in seen:
                gone.update(range(a, b + 1))
            else:
                seen[key] = i, a
        out[i] = [u for k, u in enumerate(units) if k not in gone]
    return {i: [w for u in left for w in u] for i, left in out.items()}


def test_beside_brute_force(spark):
    """Few kinds of short sentences, so that they repeat in many orders."""
    rng = random.Random(3)
    kinds = [" ".join(f"k{k}w{j}" for j in range(rng.randint(1, 12))) + "." for k in range(9)]
    rows = [(i, "".join(rng.choice(kinds) + rng.choice([" ", "\n", "  "])
                        for _ in range(rng.randint(0, 9)))) for i in range(200)]
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    for i, words in brute(rows).items():
        assert got[i]["text"].lower().split() == words, (i, rows[i])


def test_sentences_of_several_documents_are_no_passage(spark):
    """What never stood beside each other before is no repetition."""
    parts = ["Alpha beta gamma delta.", "One two three.", "Red green blue.", "North south east west."]
    rows = [(i, f"{own(i)} {p} {own(i + 50)}") for i, p in enumerate(parts)]
    rows.append((9, " ".join(parts)))
    got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert all(r["text"] == dict(rows)[i] and not r["__spans"] for i, r in got.items())


def test_two_texts_under_one_id(spark):
    """Spans of one text are not cut from another of the same id."""
    rows = [(1, PASSAGE), (2, f"{own(2)} {PASSAGE}"), (2, own(7)), (2, own(7)), (3, "é" * 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["text"]) for r in repeats.without_repeats(docs).collect())
    assert got == sorted([(1, PASSAGE), (2, own(2)), (2, own(7)), (2, own(7)), (3, "é" * 500)])
