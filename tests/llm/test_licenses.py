"""Matches beside a plain comparison of every unit with every template."""

import re
import textwrap

import numpy as np
import pytest

from conftest_llm import LOWER
from foldwise.llm import licenses


def bigrams(text):
    w = re.findall("[a-z0-9\u0080-\U0010ffff]+", text.translate(LOWER))
    return set(zip(w, w[1:]))


def brute(text):
    """Best (coefficient, name) over the whole text, its lines and sentences."""
    best = (0.0, "")
    for unit in {text, *text.split("\n"), *re.split(r"(?<=[.!?])[ \t-\r]|\n", text)}:
        a = bigrams(unit)
        for name, template in licenses.TEMPLATES:
            b = bigrams(template)
            if a:
                best = max(best, (2 * len(a & b) / (len(a) + len(b)), name))
    return best


TEXTS = ["Some text.\nReleased under the MIT License.\nMore text here.",
         "Intro words. Licensed under the Apache License, Version 2.0. More of it follows here.",
         "licensed UNDER the apache license version 2 0", "Licensed under CC BY-NC 4.0.",
         "This work is licensed under the GNU General Public License, version 3.",
         "the license of the work is under the version", "All rights reserved. All rights reserved.",
         licenses.TEMPLATES[-3][1], " ".join(t for _, t in licenses.TEMPLATES),
         "plain prose without any notice at all, of the usual kind"]


def test_beside_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in licenses.matches(df).collect():
        value, _ = brute(TEXTS[r["doc_id"]])
        if value >= licenses.LEAST:
            assert max(m["dice"] for m in r["matches"]) == pytest.approx(value)
        else:
            assert r["matches"] == []
        for m in r["matches"]:
            part = TEXTS[r["doc_id"]].encode()[m["first"]:m["end"]].decode()
            assert any(m["dice"] == pytest.approx(
                2 * len(bigrams(part) & bigrams(t)) / (len(bigrams(part)) + len(bigrams(t))))
                for n, t in licenses.TEMPLATES if n == m["license"])


def test_wrapped_notices(spark):
    """Notices wrapped over lines in the middle of a long text, as files have them."""
    prose = " ".join(f"Prose number {k} goes on about thing{k}." for k in range(300))
    notices = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) > 9]
    texts = []
    for _, t in notices:
        for width, mark in ((40, "# "), (76, " * ")):
            lines = "\n".join(mark + part for part in textwrap.wrap(t, width, break_long_words=False))
            texts.append(f"{prose}\n{lines}\n{mark}\nimport something\n{prose}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licenses.matches(df).collect():
        name, notice = notices[r["doc_id"] // 2]
        m = max(r["matches"], key=lambda m: m["dice"])
        part = texts[r["doc_id"]].encode()[m["first"]:m["end"]].decode()
        assert m["license"] == name and m["dice"] == pytest.approx(1)
        assert bigrams(part) == bigrams(notice)


def test_repeated_notices():
    """Every one of many notices in a row is told, without work that grows with their square."""
    data = "Released under the MIT License.\n".encode() * 3_000
    own = licenses._Templates(licenses.TEMPLATES, licenses.LEAST)
    found = licenses._scan(own, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(found) == 3_000 and {f[3:] for f in found} == {("MIT", 1.0)}


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.matches(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["matches"] == [] for r in rows)
    assert licenses.matches(no_docs).collect() == []
    assert all(r["matches"] == [] for r in licenses.matches(odd_docs, templates=[]).collect())


FREE = ("This {what} is free software; you can redistribute it and/or modify\nit under the terms of the "
        "GNU {kind}General Public License as published by\nthe Free Software Foundation; either version "
        "{n} of the License, or\n(at your option) any later version.\n\nThis {what} is distributed in the "
        "hope that it will be useful,\nbut WITHOUT ANY WARRANTY.")
BSD = ("Copyright (c) 2020, Some Owner\nAll rights reserved.\n\nRedistribution and use in source and binary "
       "forms, with or without\nmodification, are permitted provided that the following conditions are met:"
       "\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of "
       "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the "
       "above copyright notice,\n   this list of conditions and the following disclaimer in the "
       "documentation\n   and/or other materials provided with the distribution.\n\n{third}THIS SOFTWARE IS "
       "PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES.")
THIRD = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to "
         "endorse or promote products derived from\n   this software without specific prior written "
         "permission.\n\n")


@pytest.mark.parametrize("text, expected", [
    (FREE.format(what="program", kind="", n="2"), "GPL-2.0-or-later"),
    (FREE.format(what="program", kind="", n="3"), "GPL-3.0-or-later"),
    (FREE.format(what="program", kind="Affero ", n="3"), "AGPL-3.0-or-later"),
    (FREE.format(what="library", kind="Lesser ", n="2.1"), "LGPL-2.1-or-later"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
     "License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
     "International License.", "CC-BY-NC-ND-4.0"),
    (BSD.format(third=THIRD), "BSD-3-Clause"), (BSD.format(third=""), "BSD-2-Clause"),
    ("Copyright 2020 Some Owner. All rights reserved.", "Proprietary"),
    ("This work is licensed under the GNU General Public License, version 7.", None)])
def test_licences_that_read_alike(text, expected):
    """Telling words, wider notices around their parts, and rights reserved before a licence."""
    own = licenses._Templates(licenses.TEMPLATES, licenses.LEAST)
    for shown in (text, f"Some words before it.\n\n{text}\n\nSome words after it, and more of them."):
        data = np.frombuffer(shown.encode(), np.uint8)
        names = {f[3] for f in licenses._scan(own, data, np.array([0, len(data)]))}
        assert names == ({expected} if expected else set())


@pytest.mark.parametrize("text, expected", [
    ("some plain words the.\nMIT.\nLicense", set()),
    ("some plain words the.\nMIT.\nLicense\n\nReleased under\nthe\nMIT License.", {"MIT"})])
def test_sentence_of_one_word(text, expected):
    """A sentence of one word between known neighbours has no bigram, so nothing to judge."""
    own = licenses._Templates(licenses.TEMPLATES, licenses.LEAST)
    data = np.frombuffer(text.encode(), np.uint8)
    assert {f[3] for f in licenses._scan(own, data, np.array([0, len(data)]))} == expected
