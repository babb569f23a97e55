"""The pipeline's stages, each beside brute force on its own input, and the queries."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest_llm import TEXTS, shingle_set, words
from foldwise.llm import bpe
from foldwise.llm.queries import QUERIES
from test_decontam import ITEM, brute as contaminations
from test_neardup import brute as components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables: good and bad documents, copies, passages, benchmark text, odd rows."""
    rng = np.random.default_rng(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []

    def prose(n):
        out = []
        for _ in range(n):
            own = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(9)]
            out.append(" ".join(own).capitalize() + ".")
        return " ".join(out)

    passage = prose(8)
    base = prose(14)
    for i in range(160):
        text = prose(int(rng.integers(4, 12)))
        if i % 5 == 0:
            text = "!! ".join(text.upper().split()) + "!!"
        elif i % 11 == 1:
            text = base if i % 2 else base.replace(base.split()[20], f"edit{i}")
        elif i % 13 == 2:
            text = f"{text} {passage} {prose(2)}"
        elif i % 17 == 3:
            text = f"{prose(2)} {ITEM} {prose(1)}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if i % 5 == 0 else 1, 0))
    rows += [(1000 + i, t, None, None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(None, prose(3), "en", "s", None)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<article><p>Page {i}</p></article>")
             for i in range(9)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(
        f"{folder}/pages.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tables}/stage-{name}")
        docs = spark.read.parquet(f"{tables}/stage-{name}")
        kept[name] = before, docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["quality"]
    ids = {r["doc_id"] for r in after}
    assert all((i in ids) == (i % 5 != 0) for i in range(160))
    before, after = kept["near_copies"]
    group = components([(i, t) for i, t in before])
    assert {r["doc_id"] for r in after} == {i for i, _ in before if i is None or group[i] == i}
    before, after = kept["passages"]
    assert {r["doc_id"] for r in after} == {i for i, _ in before}
    seen = {}
    for r in after:
        w = words(r["text"])
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"] or "")
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k:k + 51]), r["doc_id"]) == r["doc_id"]
    before, after = kept["benchmark"]
    dirty = {i for i, *_, bad in contaminations(list(before), [(1, ITEM)]) if bad}
    assert dirty and {r["doc_id"] for r in after} == {i for i, _ in before} - dirty
    before, after = kept["tokens"]
    library = Tokenizer.from_file(bpe.default_path())
    assert {r["doc_id"] for r in after} == {i for i, _ in before}
    for r in after:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["tokens"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
    whole = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, after))


def test_queries_hold_their_contracts(spark, tables):
    docs = {r["doc_id"]: r["text"] or "" for r in
            spark.read.parquet(f"{tables}/documents.parquet").collect()}
    library = Tokenizer.from_file(bpe.default_path())

    def rows(name):
        return QUERIES[name](spark, tables).collect()

    got = rows("op3_licenses")
    assert len(got) == len(docs)
    for r in rows("op4_near_duplicates"):
        assert r["n_shingles"] == len(shingle_set(docs[r["doc_id"]]))
    for r in rows("op5_bpe"):
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    expected = {(r[0], r[1]): r for r in contaminations(list(docs.items()), [(1, ITEM)])}
    for r in rows("op6_decontaminate"):
        _, n, hit, items, bad = expected[r["doc_id"], r["n_words"]]
        assert (r["n_hit"], r["n_items"], r["contaminated"]) == (hit, len(items), bad)
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
    for r in rows("op7_quality"):
        own = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(own.encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.5)
    assert len(rows("op8_repeated_passages")) == len(docs)
    got = rows("op9_shards")
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 for r in got)
    got = rows("op10_wrappers")
    assert all(r["text"] == f"Page {r['page_id']}" and r["n_chars"] == len(r["text"]) for r in got)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for query in QUERIES.values():
        assert query(spark, str(tmp_path)).collect() == []
