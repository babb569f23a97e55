"""A word bigram model by deleted interpolation, and the log probability of each text.

    P(w | v) = a2[b] * c(v, w) / c(v) + a1[b] * c(w) / N + a0[b] / (V + 1)

b is the bucket of the context's frequency c(v) (by powers of two; one for
unseen contexts). The weights a are learned by expectation-maximisation on a
deleted part of the training documents: their tokens are predicted from the
counts of the other training documents. The scores use all training counts.

Tokens are words, A-Z lowered, and one end; the context of the first token is
a begin mark. Words and pairs are 64-bit hashes.

Nothing is joined token by token. Texts are cut into blocks of about
``BLOCK_BYTES``; each block asks for the counts of its distinct words and pairs
(sorted keys in as few bytes as they need), keys are dealt into shards by their
top bits, and each shard adds up what all blocks have counted and answers in
the order of the keys. A frequent word is one key of each block, so it weighs
no more than a rare one. Blocks and shards are bounded; shards grow in number.

A null text is empty: one token, the end. A null id counts as the empty string
for the folds. Rows are scored one by one, so repeated rows need no rule.
Without training tokens every count is zero and only a0 is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stored
from foldwise.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from foldwise.llm.tokens import combine, text_slices, words

BLOCK_BYTES = 8 << 20
KEYS_A_SHARD = 1 << 21
BUCKETS = 34
ROUNDS = 12
FOLDS, HELD_OUT, DELETED = 10, 0, 1
END, BEGIN = np.uint64(3), np.uint64(5)
_ONE = np.uint64(1)
_BLOCK = ("block string, kind int, ids array<bigint>, bounds binary, words binary, "
          "tokens binary, n_tokens bigint")


def _fold(doc_id: object) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _sequence(text_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row with an end after them, and the new bounds. Words have odd hashes."""
    rows = len(bounds) - 1
    at = bounds[1:]
    return (np.insert(text_hashes | _ONE, at, END), bounds + np.arange(rows + 1))


def _pairs(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The even key of each token with the one before it."""
    before = np.roll(tokens, 1)
    before[bounds[:-1]] = BEGIN
    return combine(before, tokens) & ~_ONE


def _block(name: str, kind: int, ids: list, parts: list) -> dict:
    """One row: distinct words, and tokens as places of words."""
    tokens = np.concatenate([t for t, _ in parts])
    bounds = np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, b in parts])))
    vocabulary, place = np.unique(tokens, return_inverse=True)
    return {"block": name, "kind": kind, "ids": ids, "bounds": pack_sorted(bounds),
            "words": pack_sorted(vocabulary), "tokens": pack(place), "n_tokens": len(tokens)}


class _Keys:
    """A block's tokens, and its distinct words and pairs as sorted keys."""

    def __init__(self, row):
        self.vocabulary = unpack_sorted(row["words"])
        self.place = unpack(row["tokens"]).astype(np.int64)
        self.bounds = unpack_sorted(row["bounds"]).astype(np.int64)
        self.token_pairs = _pairs(self.vocabulary[self.place], self.bounds)
        self.pairs, self.times = np.unique(self.token_pairs, return_counts=True)
        keys = np.concatenate([self.vocabulary, self.pairs])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> np.ndarray:
        """How often each key occurs in the block."""
        own = np.bincount(self.place, minlength=len(self.vocabulary))
        return np.concatenate([own, self.times])[self.order]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of three kinds: held out, deleted, and other training documents."""
    task = TaskContext.get().partitionId()
    open_: dict[int, tuple[list, list, int]] = {}
    made = 0
    schema = pa.schema([("block", pa.string()), ("kind", pa.int32()),
                        ("ids", pa.list_(pa.int64())), ("bounds", pa.binary()),
                        ("words", pa.binary()), ("tokens", pa.binary()),
                        ("n_tokens", pa.int64())])

    def closed(kind: int) -> pa.RecordBatch:
        nonlocal made
        ids, parts, _ = open_.pop(kind)
        made += 1
        return pa.RecordBatch.from_pylist([_block(f"{task}-{made}", kind, ids, parts)], schema)

    for batch in batches:
        every = batch.column("doc_id").to_pylist()
        for first, data, offsets in text_slices(batch.column("text")):
            hashes, bounds = words(data, offsets)
            own = every[first:first + len(bounds) - 1]
            kinds = np.array([min(_fold(i), DELETED + 1) for i in own])
            row = np.repeat(np.arange(len(own)), np.diff(bounds))
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                sizes = np.diff(bounds)[mine]
                part = _sequence(hashes[mine[row]], np.append(0, np.cumsum(sizes)))
                ids, parts, size = open_.get(kind, ([], [], 0))
                ids += [i for i, m in zip(own, mine) if m]
                parts.append(part)
                size += int(np.diff(offsets)[mine].sum()) + len(sizes)
                open_[kind] = ids, parts, size
                if size >= BLOCK_BYTES:
                    yield closed(kind)
    for kind in list(open_):
        yield closed(kind)


def _asked(bits: int):
    """Each block's keys, dealt into 2^bits shards by their top bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
        for batch in batches:
            for row in batch.to_pylist():
                own = _Keys(row)
                keys, train = own.keys, own.counts()
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [{"shard": s, "block": row["block"], "kind": row["kind"],
                         "keys": pack_sorted(keys[a:b]),
                         "train": pack(train[a:b] if row["kind"] != HELD_OUT else train[:0])}
                        for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(
                    [("shard", pa.int32()), ("block", pa.string()), ("kind", pa.int32()),
                     ("keys", pa.binary()), ("train", pa.binary())]))
    return run


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of one shard's keys over all blocks, in the order in which each block asked.

    Deleted blocks also get the counts of the training blocks that are not deleted.
    """
    asked = [unpack_sorted(k) for k in rows["keys"]]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    total, rest = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    cuts = np.cumsum([0, *[len(k) for k in asked]])
    where = [place[a:b] for a, b in zip(cuts, cuts[1:])]
    for kind, train, at in zip(rows["kind"], rows["train"], where):
        if kind != HELD_OUT:
            counts = unpack(train).astype(np.int64)
            total[at] += counts
            if kind != DELETED:
                rest[at] += counts
    seen = int(((total > 0) & (keys & _ONE == _ONE)).sum())
    out = pd.DataFrame({
        "shard": rows["shard"].iloc[0], "block": rows["block"], "kind": rows["kind"],
        "total": [pack(total[at]) for at in where],
        "rest": [pack(rest[at]) if kind == DELETED else None
                 for kind, at in zip(rows["kind"], where)], "seen": 0})
    out.loc[out.index[0], "seen"] = seen
    return out


class _Counts:
    """A block with the counts of its words and pairs."""

    def __init__(self, block: pd.DataFrame, answers: pd.DataFrame, column: str):
        row = block.iloc[0]
        answers = answers.sort_values("shard")
        own = _Keys(row)
        counts = np.empty(len(own.keys))
        counts[own.order] = np.concatenate([unpack(a) for a in answers[column]])
        words_ = len(own.vocabulary)
        self.bounds = own.bounds
        self.ids = list(row["ids"])
        self.word = counts[:words_][own.place]
        self.pair = counts[words_:][np.searchsorted(own.pairs, own.token_pairs)]
        self.context = np.roll(self.word, 1)

    def parts(self, n: float, texts: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the context, and the two maximum-likelihood estimates of each token."""
        context = self.context
        context[self.bounds[:-1]] = texts
        bucket = np.where(context > 0, 1 + np.log2(np.maximum(context, 1)), 0).astype(np.int64)
        return (np.minimum(bucket, BUCKETS - 1), self.pair / np.maximum(context, 1),
                self.word / max(n, 1))


def _expected(weights: np.ndarray, floor: float):
    """Expected uses of each estimate in each bucket, from tokens of deleted documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 3))
        for batch in batches:
            for row in batch.to_pylist():
                bucket = np.frombuffer(row["bucket"], dtype=np.uint8)
                share = np.stack([np.frombuffer(row["p2"], dtype=np.float32).astype(np.float64),
                                  np.frombuffer(row["p1"], dtype=np.float32).astype(np.float64),
                                  np.full(len(bucket), floor)], axis=1) * weights[bucket]
                share /= share.sum(axis=1, keepdims=True)
                for k in range(3):
                    total[:, k] += np.bincount(bucket, share[:, k], BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(BUCKETS), 3)), pa.array(np.tile(np.arange(3), BUCKETS)),
             pa.array(total.ravel())], names=["bucket", "part", "n"])
    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = stored(own.mapInArrow(_blocked, _BLOCK), "lm-blocks")
    train = F.when(F.col("kind") != HELD_OUT, F.col("n_tokens"))
    of = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum(train).alias("n"),
                    F.sum(F.when(F.col("kind") != HELD_OUT, F.size("ids"))).alias("texts"),
                    F.sum(F.when(F.col("kind") > DELETED, F.col("n_tokens"))).alias("rest"),
                    F.sum(F.when(F.col("kind") > DELETED, F.size("ids"))).alias("rest_texts"))
    of = {k: v or 0 for k, v in of.first().asDict().items()}
    # A block has at most two keys for each token.
    bits = max(3, (2 * of["tokens"] // KEYS_A_SHARD).bit_length())
    shards = 1 << bits
    asked = blocks.drop("ids", "n_tokens").mapInArrow(
        _asked(bits), "shard int, block string, kind int, keys binary, train binary")
    answers = stored(asked.repartition(shards, "shard").groupBy("shard").applyInPandas(
        _answered, "shard int, block string, kind int, total binary, rest binary, seen bigint"),
        "lm-counts")
    seen = answers.agg(F.sum("seen")).first()[0] or 0
    floor = 1.0 / (seen + 1)
    weights = _learned(blocks, answers, of, floor)
    n, texts = float(of["n"]), float(of["texts"])

    def score(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        counts = _Counts(block, answer, "total")
        bucket, p2, p1 = counts.parts(n, texts)
        p = weights[bucket, 0] * p2 + weights[bucket, 1] * p1 + weights[bucket, 2] * floor
        base = np.log10((counts.word + 0.1) / (n + 0.1 * (seen + 1)))
        starts = counts.bounds[:-1]
        return pd.DataFrame({
            "doc_id": pd.array(counts.ids, dtype="Int64"),
            "held_out": bool(block["kind"].iloc[0] == HELD_OUT),
            "n_tokens": np.diff(counts.bounds),
            "n_known": np.add.reduceat((counts.word > 0).astype(np.int64), starts),
            "train_tokens": int(n), "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10(p), starts)})

    return _beside(blocks, answers.drop("rest", "seen", "kind"), score,
                   "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                   "train_tokens bigint, base_score double, score double")


def _beside(blocks: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(block, its answers) for every block: both are bounded by the block's size."""
    slim = blocks.drop("n_tokens")
    return (slim.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(f, schema))


def _learned(blocks: DataFrame, answers: DataFrame, of: dict, floor: float) -> np.ndarray:
    """Weights of the three estimates for each bucket."""
    n, texts = float(of["rest"]), float(of["rest_texts"])

    def parts(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        bucket, p2, p1 = _Counts(block, answer, "rest").parts(n, texts)
        return pd.DataFrame({"bucket": [bucket.astype(np.uint8).tobytes()],
                             "p2": [p2.astype(np.float32).tobytes()],
                             "p1": [p1.astype(np.float32).tobytes()]})

    deleted = stored(_beside(blocks.where(F.col("kind") == DELETED),
                             answers.where(F.col("kind") == DELETED).drop("total", "kind", "seen"),
                             parts, "bucket binary, p2 binary, p1 binary"), "lm-deleted")
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        rows = (deleted.mapInArrow(_expected(weights, floor), "bucket bigint, part bigint, n double")
                .groupBy("bucket", "part").agg(F.sum("n").alias("n")).collect())
        total = np.zeros((BUCKETS, 3))
        for r in rows:
            total[r["bucket"], r["part"]] = r["n"]
        # A tenth of a use each, and a bucket without tokens takes the mean weights.
        mean = (total.sum(axis=0) + 0.1) / (total.sum() + 0.3)
        new = (total + mean) / (total.sum(axis=1, keepdims=True) + 1)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < 1e-4:
            break
    return weights
