"""The audit beside filters applied one after the other."""

import random
import re
from itertools import permutations

from foldwise.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0D]+")


def fails(letter, text, doc_id, rows):
    w = WORD.findall(text)
    if letter == "A":
        return len(w) < 200
    if letter == "B":
        return 100 * len(set(w)) < 50 * len(w)
    if letter == "C":
        return 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)
    if letter == "D":
        return bool(re.search("[#$%&*|]", text))
    return doc_id is not None and any(i is not None and i < doc_id and (t or "") == text
                                      for i, t, *_ in rows)


def brute(rows, labels):
    """Apply all orders to all documents of each part."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    bad = [{c for c in "ABCDE" if fails(c, t or "", i, rows)} for i, t, *_ in rows]
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, (_, _, s) in enumerate(rows) if (s or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [k for k in left if c in bad[k]]
                left = [k for k in left if c not in bad[k]]
                shares[c] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(c in bad[k] for k in own) - len(gone),
                    sum(bad[k] == {c} for k in own), sum(rows[k][0] in good for k in gone),
                    sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), r in out.items():
            if p == part:
                r.append(shares[order[step - 1]])
    return out


def rows_of(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_as_applied(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(200))
    texts = [None, "", "one two", long, long.upper(), "same " * 250, long + " $", "A" * 30,
             "x\x1cy " * 100 + "é" * 9, long + "\n#", " ".join(["Aa"] * 110 + [f"b{k}" for k in range(110)])]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "a", "b"])) for i in range(150)]
    # Equal ids with equal texts, ids in two parts, null ids.
    rows += [(rows[3][0], rows[3][1], "z"), (7, long, "a"), (7, long, "b"), (7, long, "a"),
             (None, long, "a"), (None, "one two", "a"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant",
                           "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows_of(out) == brute(rows, labels)


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rows_of(filter_audit.audit(odd_docs.withColumn("part", odd_docs.lang).withColumn(
        "words", odd_docs.lang), labels))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert got == brute(rows, [])
    assert filter_audit.audit(no_docs, labels).collect() == []


def test_other_filters(spark):
    """Two filters and copies: potentials of three players."""
    own = {"X": lambda text, words: text.contains("x"), "Y": lambda text, words: text.contains("y")}
    docs = spark.createDataFrame([(1, "x"), (2, "xy"), (3, "xy"), (4, "y"), (5, "z")],
                                 "doc_id int, text string").selectExpr("*", "'p' AS source")
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id int, quality int, toxic int")
    got = rows_of(filter_audit.audit(docs, labels, filters=own))
    assert len(got) == 18
    assert got["p", "XYE", 1] == [2, 3, 0, 1, 1, 1, 11]
    assert got["p", "EXY", 2] == [2, 2, 1, 1, 0, 0, 11]
    # Shares of one order of three add up to what goes in all six orders.
    assert sum(got["p", "EXY", s][-1] for s in (1, 2, 3)) == 6 * 4
