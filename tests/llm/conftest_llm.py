"""Texts and plain definitions that the tests share."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score double, h string, band int, n_tokens int, spans string")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i % 7}" for i in range(60)) + "."
# Nulls, empty and white texts, short ones, a very long one, copies, near copies.
TEXTS = [None, "", "  \n\t ", "One", "one TWO three", "One two\nthree four five six.", LONG, LONG,
         BASE, BASE.upper(), BASE.replace("alpha30", "gamma"), BASE + " More.", "É ñ 漢字 🙂 é",
         "x" * 5_000, "a b c d e f g h i j k l m n o p q", "a b c d e f g h i j k l m n o p q"]


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "h", i, i, "s")
            for i, t in enumerate(texts)]
