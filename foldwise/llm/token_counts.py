"""Numbers of tokens without ids: pieces are counted once per distinct pre-token.

Documents are read in blocks. A block is one row: its distinct pre-tokens, and
for each document how often it holds which of them, as packed numbers. A
pre-token belongs to the shard that its checksum names. Blocks send each shard
its part of their pre-tokens; there every distinct pre-token is merged once, for
its number of pieces, and each block gets the numbers of its own back. Joined to
the frequencies they are summed by document. No ids of a document are ever made.

A block asks once for a pre-token, however many of its documents hold it, and
shards are even by their checksums, so a word that every document holds makes
no hot key. A block's pre-tokens stand in order of their checksums: what a shard
is asked is a stretch of them, and its answers need no places. Blocks are stored,
as their order must not change between the two places that read them.

The tokenizer is a file of the tokenizers library with byte-level BPE; others
raise. Added tokens inside a text count one each. Null and empty texts have 0
bytes and 0 tokens. Every row is counted by itself, so ties, repeated rows and
null keys need no rule; an empty table gives an empty table. Only the key and
the text are read, so further columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm import bpe
from foldwise.llm.common import stored
from foldwise.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from foldwise.llm.units import Units, gathered, is_piece, pieces

# Bytes of text after which a block ends; one text is never divided.
BLOCK_BYTES = 1 << 24
# Pre-tokens that blocks ask of one shard, about.
ASKED = 1 << 19
_SUMS = 1 << 32


class _Block:
    """Frequencies of distinct pre-tokens in the documents of a block."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.texts = self.bytes = 0
        self.keys: list = []
        self.n_bytes: list[int] = []
        self.n_added: list[np.ndarray] = []
        # Document and pre-token as one number, and frequency, by runs of units.
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def _numbers(self, unit: bytes) -> list[int]:
        number = self.number
        own = [unit] if is_piece(unit) else pieces(unit)
        return [number.setdefault(p, len(number)) for p in own]

    def add(self, keys: list, texts: list[bytes], added) -> None:
        units = Units(texts, added)
        text_of = np.repeat(np.arange(len(texts)), np.diff(units.bounds))
        self.n_added.append(np.bincount(text_of[units.added], minlength=len(texts)))
        for first, last in units.runs():
            distinct, which = units.distinct(first, last)
            plain = ~units.added[first:last]
            special = np.zeros(len(distinct), dtype=bool)
            special[which[~plain]] = True
            numbers = [[] if s else self._numbers(u) for u, s in zip(distinct, special.tolist())]
            flat = np.array([n for own in numbers for n in own], dtype=np.int64)
            own, lengths = gathered(flat, np.cumsum([0, *map(len, numbers)]), which)
            key = (np.repeat(text_of[first:last] + self.texts, lengths) << 32) | own
            self.pairs.append(_counts(key))
        self.keys += keys
        self.n_bytes += [len(t) for t in texts]
        self.texts += len(texts)
        self.bytes += sum(len(t) for t in texts)

    def row(self, block: int, key_type: pa.DataType) -> pa.RecordBatch:
        key = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in self.pairs]])
        n = np.concatenate([np.zeros(0, np.int64), *[n for _, n in self.pairs]])
        # Pre-tokens in the order of their checksums from here on.
        pieces = sorted(self.number, key=lambda piece: (crc32(piece), piece))
        place = np.empty(max(1, len(pieces)), dtype=np.int64)
        place[[self.number[piece] for piece in pieces]] = range(len(pieces))
        dense = (key >> 32) * len(place) + place[key & 0xFFFFFFFF]
        order = np.argsort(dense, kind="stable")
        dense, n = dense[order], n[order]
        cells = {"block": pa.array([block], pa.int64()),
                 "keys": pa.array([self.keys], pa.list_(key_type)),
                 "n_bytes": pa.array([self.n_bytes], pa.list_(pa.int64())),
                 "n_added": pa.array([np.concatenate(self.n_added)], pa.list_(pa.int64())),
                 "n_pieces": pa.array([len(pieces)], pa.int64()),
                 "pieces": pa.array([_packed(pieces)], pa.binary()),
                 "pairs": pa.array([pack_sorted(dense.astype(np.uint64))], pa.binary()),
                 "freq": pa.array([pack(n)], pa.binary())}
        return pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


def _counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[at], np.diff(np.append(at, len(key)))


def blocks(docs: DataFrame, key: str, path: str) -> DataFrame:
    """One row for about BLOCK_BYTES of text: pre-tokens, documents and their frequencies."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)),
        T.StructField("n_bytes", T.ArrayType(T.LongType())),
        T.StructField("n_added", T.ArrayType(T.LongType())),
        T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.BinaryType()),
        T.StructField("pairs", T.BinaryType()), T.StructField("freq", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = bpe.load(path).find_added
        number = TaskContext.get().partitionId() << 32
        block, key_type = _Block(), pa.null()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for first, texts in _runs(batch.column(1)):
                block.add(batch.column(0).slice(first, len(texts)).to_pylist(), texts, added)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(number, key_type)
                    block, number = _Block(), number + 1
        if block.texts:
            yield block.row(number, key_type)

    own = docs.select(F.col(f"`{key}`"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return own.mapInArrow(run, schema)


def _runs(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of about SLICE_CHARS bytes."""
    first, run, size = 0, [], 0
    for k, value in enumerate(column):
        text = value.as_py()
        run.append(text)
        size += len(text)
        if size >= bpe.SLICE_CHARS:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run


def _packed(pieces: list[bytes]) -> bytes:
    """Byte strings as one: lengths, then what they hold, both compressed."""
    lengths = pack(np.array([len(p) for p in pieces], dtype=np.uint64))
    held = zstandard.ZstdCompressor(level=3).compress(b"".join(pieces))
    return len(lengths).to_bytes(4, "little") + lengths + held


def _unpacked(data: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:at])).tolist()
    held = zstandard.ZstdDecompressor().decompress(data[at:])
    return [held[a:b] for a, b in zip([0, *ends], ends)]


def asked(found: DataFrame, shards: int) -> DataFrame:
    """(shard, block, pieces): what each block asks of each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block"), batch.column("pieces")):
                own = _unpacked(packed.as_py())
                sums = np.array([crc32(p) for p in own], dtype=np.int64)
                ends = np.searchsorted(sums * shards // _SUMS, np.arange(shards), "right").tolist()
                rows = [(s, own[a:b]) for s, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int32()),
                     pa.array([block.as_py()] * len(rows), pa.int64()),
                     pa.array([_packed(part) for _, part in rows], pa.binary())],
                    names=["shard", "block", "pieces"])

    return found.select("block", "pieces").mapInArrow(run, "shard int, block bigint, pieces binary")


def answered(questions: DataFrame, path: str) -> DataFrame:
    """(block, shard, n): numbers of tokens of the pre-tokens that a block asked of a shard.

    All questions about a pre-token are in one group, where it is counted once.
    """
    def count(rows: pa.Table) -> pa.Table:
        model, known = bpe.load(path), {}
        out = []
        for packed in rows.column("pieces"):
            own = _unpacked(packed.as_py())
            new = [p for p in own if p not in known]
            known.update(zip(new, (len(ids) // 4 for ids in model.of_pieces(new))) if new else ())
            out.append(pack(np.array([known[p] for p in own], dtype=np.uint64)))
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"),
                         "n": pa.array(out, pa.binary())})

    return questions.groupBy("shard").applyInArrow(count, "block bigint, shard int, n binary")


def counted(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """For each row its key, ``n_bytes`` (UTF-8) and ``n_tokens``."""
    path = path or bpe.default_path()
    found = stored(blocks(docs, key, path), "token-blocks")
    shards = max(1, -(-(found.agg(F.sum("n_pieces")).first()[0] or 0) // ASKED))
    answers = answered(asked(found, shards), path)
    # Back to the blocks: the answers of all shards in their order.
    learned = answers.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("learned"))
    out = found.drop("pieces").join(learned, "block", "left")
    fields = [T.StructField(key, docs.schema[key].dataType),
              T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _summed(batch.slice(k, 1), key)

    narrow = out.select("keys", "n_bytes", "n_added", "pairs", "freq",
                        F.col("learned")["n"].alias("n"))
    return narrow.mapInArrow(run, T.StructType(fields))


def _summed(row: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """The documents of one block: frequency times number of tokens, summed."""
    keys, n_bytes, n_added, n = (row.column(c).flatten() for c in
                                 ("keys", "n_bytes", "n_added", "n"))
    total = n_added.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n):
        tokens = np.concatenate([unpack(part.as_py()) for part in n]).astype(np.int64)
        pairs = unpack_sorted(row.column("pairs")[0].as_py()).astype(np.int64)
        freq = unpack(row.column("freq")[0].as_py()).astype(np.int64)
        sums = np.append(0, np.cumsum(tokens[pairs % len(tokens)] * freq))
        bounds = np.searchsorted(pairs, np.arange(len(total) + 1) * len(tokens))
        total = total + sums[bounds[1:]] - sums[bounds[:-1]]
    return pa.RecordBatch.from_arrays([keys, n_bytes, pa.array(total, pa.int64())],
                                      names=[key, "n_bytes", "n_tokens"])
