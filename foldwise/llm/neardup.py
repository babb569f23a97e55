"""Near-duplicate documents by SetSketch registers, bands, likelihood and exact checks.

A document is the set of its distinct five-word shingles. Two documents are
linked if 100 * |intersection| >= 75 * |union|; components of the links are
groups, and the smallest id of a group stays.

1. Each set gets 128 registers: per register the smallest of as many random
   exponentials as the set has elements, on a logarithmic scale of base
   ``BASE``. Registers of a union are the maxima of registers.
2. Equal sets are one class with the smallest id; only classes go on.
3. 32 bands of four registers put classes into buckets. Two sets of similarity
   0.75 share none with a chance of (1 - 0.75^4)^32, about 5 in a million.
4. First each class meets the head of its buckets, the member that shares most
   buckets with others: a line of pairs for each bucket, however large it is.
   Those pairs whose similarity, estimated from both sketches by maximum
   likelihood, could reach 0.75 are checked on their full sets, and linked
   classes are merged to components.
5. Then remain pairs of other members of a bucket that lie in different
   components; pairs inside a component can join nothing. The members outside
   a bucket's largest component are joined with all members of such buckets by
   the rarest shingles: sets of sizes m and n that are linked share at least
   3 (m + n) / 7 shingles, so the first ones of both, in any common order, have
   one in common. A large group of copies never meets itself, and its loose
   members meet only those that share what is rare in them.

Rows without words have an empty set: they are linked with nothing. A null id
takes no part: its component is null and it is kept. Rows that share an id are
one node of the graph, with the links of all their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import broadcast_if_small, stored
from foldwise.llm.tokens import combine, mix, numbers, shingles, text_slices, words

REGISTERS, BANDS = 128, 32
BASE, RATE, LIMIT = 1.001, 20.0, 65_535
PERCENT = 75
# Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
_FACTOR = numbers(REGISTERS, 11) | np.uint64(1)
_SHIFT = numbers(REGISTERS, 12)
_SALT = numbers(2, 13)
_ROWS = 2_048
# Slots of the table of frequencies, and the rows in which it travels.
SLOT_BITS, PARTS = 18, 16
# Sets whose sizes differ by less than this factor are one size class.
SIZE_STEP = 1.04


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.uint64(2**64 - 1))
    for k in range(0, len(elements), _ROWS):
        spread = elements[k:k + _ROWS, None] * _FACTOR + _SHIFT
        least = np.minimum(least, spread.min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    x = np.maximum(x, 2.0**-70)
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, LIMIT).astype("<u2")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity of each pair of sketches (rows) of sets of known sizes.

    The likelihood of how many registers of a are larger, smaller and equal is
    concave in the similarity; its maximum is found by ternary search.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        pa_, pb_ = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return (more * np.log(np.maximum(pa_, tiny)) + less * np.log(np.maximum(pb_, tiny))
                + same * np.log(np.maximum(1 - pa_ - pb_, tiny)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = batch.column("doc_id"), batch.column("text")
        for first, data, offsets in text_slices(text):
            sets = list(shingles(*words(data, offsets)))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sets)), pa.array(n),
                 *[pa.array([int(mix(s ^ salt).sum(dtype=np.uint64).view(np.int64))
                             for s in sets], pa.int64()) for salt in _SALT],
                 pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and its registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _sketched, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, sketch binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = REGISTERS // BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype="<u2")
        sketch = sketch.reshape(-1, BANDS, width).astype(np.uint64)
        keys = combine(*[sketch[:, :, k].ravel() for k in range(width)],
                       np.tile(np.arange(BANDS, dtype=np.uint64), len(sketch)))
        id_ = np.repeat(np.arange(len(sketch)), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), batch.column("id").take(pa.array(id_))],
            names=["band", "id"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2")
                .reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
        goal = PERCENT / 100
        low = goal - MARGIN * np.sqrt(goal * (1 - goal) / REGISTERS)
        fits = np.minimum(na, nb) >= goal * np.maximum(na, nb) - 1e-9
        fits &= likely(a, b, na, nb) >= low
        kept = pa.array(np.flatnonzero(fits))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        hits = []
        for k, (x, y) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
            right = y.as_py()
            if last[0] != right:
                last = (right, _set_of(right))
            left, right = _set_of(x.as_py()), last[1]
            both = len(np.intersect1d(left, right, assume_unique=True))
            if both and 100 * both >= PERCENT * (len(left) + len(right) - both):
                hits.append(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[k] for k in hits], batch.column("a").type),
             pa.array([b[k] for k in hits], batch.column("b").type)], names=["a", "b"])


def _set_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return next(shingles(*words(data, np.array([0, len(data)]))))


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every end of a link (a, b)."""
    edges = stored(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(edges.groupBy(F.col("a").alias("id"))
                   .agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = (edges.join(label, F.col("b") == F.col("id")).groupBy("a")
                .agg(F.min("c").alias("m")))
        new = label.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # A label is an id too: take over what it has found meanwhile.
        jump = label.select(F.col("id").alias("j"), F.col("c").alias("jc"))
        label = stored(new.join(jump, F.col("c") == F.col("j")).select(
            "id", "old", F.least("c", "jc").alias("c")), "labels")
        changed = label.where(F.col("c") != F.col("old")).limit(1).count()
        label = label.select("id", "c")
        if not changed:
            return label.select("id", F.col("c").alias("component"))


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Those pairs (a, b) of class ids that are linked: estimate first, then full sets."""
    kind = classes.schema["id"].dataType.simpleString()

    def side(c: str) -> DataFrame:
        return classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"),
                              F.col("sketch").alias(f"sketch_{c}"))

    likely_ = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        _estimated, f"a {kind}, b {kind}"), f"{name}-likely")
    wanted = stored(likely_.select(F.col("a").alias("id")).union(likely_.select("b")).distinct(),
                    f"{name}-wanted")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(
        broadcast_if_small(wanted, wanted.count()), "id", "left_semi")
    joined = (likely_.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return stored(joined.mapInArrow(_linked, f"a {kind}, b {kind}"), f"{name}-links")


def _least_common(m: int, n: int) -> int:
    """Shingles that linked sets of these sizes have in common at least."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def _ordered(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rarest first, by the counts of hash slots; ties by the element."""
    return elements[np.lexsort((elements, counts[elements >> np.uint64(64 - SLOT_BITS)]))]


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task have elements in each slot, in PARTS rows."""
    total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for batch in batches:
        for _, data, offsets in text_slices(batch.column("text")):
            found = np.concatenate([np.zeros(0, np.uint64), *shingles(*words(data, offsets))])
            total += np.bincount((found >> np.uint64(64 - SLOT_BITS)).astype(np.int64),
                                 minlength=len(total))
    if total.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(PARTS)), pa.array([p.tobytes() for p in np.split(total, PARTS)])],
            names=["part", "counts"])


def _added_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in rows["counts"])
    return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})


def _size_class(n: int) -> int:
    return int(np.log(n) / np.log(SIZE_STEP))


def _prefixes(counts: np.ndarray, loose: bool):
    """(element, size class of the other set, id, component, set size, place in the order, loose)
    of the rarest shingles of each set.

    A set gives its own size class, with as many shingles as any partner can
    ask for; a loose one gives each class that a partner can have, with as many
    as the smallest partner of it asks for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in ("id", "c", "loose")]
            for first, data, offsets in text_slices(batch.column("text")):
                elements, classes, of, sizes_, places = [], [], [], [], []
                for k, own in enumerate(shingles(*words(data, offsets)), first):
                    n = len(own)
                    if not n:
                        continue
                    own = _ordered(own, counts)
                    low = -(-PERCENT * n // 100)
                    if loose:
                        sizes = range(_size_class(low), _size_class(100 * n // PERCENT) + 1)
                        least = [max(low, int(np.floor(SIZE_STEP ** c))) for c in sizes]
                        given = [(c, n - _least_common(n, m) + 1) for c, m in zip(sizes, least)]
                    else:
                        given = [(_size_class(n), n - low + 1)]
                    for c, length in given:
                        elements.append(own[:max(length, 0)])
                        classes.append(np.full(len(elements[-1]), c))
                        of.append(np.full(len(elements[-1]), k))
                        sizes_.append(np.full(len(elements[-1]), n))
                        places.append(np.arange(len(elements[-1])))
                if not elements:
                    continue
                of_rows = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(elements).view(np.int64)),
                     pa.array(np.concatenate(classes).astype(np.int32)),
                     *[column.take(of_rows) for column in kept],
                     pa.array(np.concatenate(sizes_).astype(np.int32)),
                     pa.array(np.concatenate(places).astype(np.int32))],
                    names=["element", "size", "id", "c", "loose", "n", "place"])
    return run


def _across(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of a loose member and another one that may be linked.

    ``members`` has id, component c and loose, a row for each class.
    """
    members = stored(members, "members-across")
    n = members.count()
    kind = members.schema["id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(
        broadcast_if_small(members, n), "id")
    # Frequencies are counted in slots of bounded number, so the order is too.
    sums = (texts.select("text").mapInArrow(_slot_counts, "part bigint, counts binary")
            .groupBy("part").applyInPandas(_added_up, "part bigint, counts binary").collect())
    counts = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), dtype=np.int64)
    for r in sums:
        counts[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    counts = counts.ravel()
    schema = (f"element bigint, size int, id {kind}, c {kind}, loose boolean, n int, place int")
    texts = texts.select("id", "c", "loose", "text")
    every = texts.mapInArrow(_prefixes(counts, False), schema)
    loose = (texts.where("loose").mapInArrow(_prefixes(counts, True), schema)
             .select("element", "size", F.col("id").alias("x"), F.col("c").alias("cx"),
                     F.col("n").alias("nx"), F.col("place").alias("px")))
    # At their first common element linked sets have enough left, it included.
    left = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place"))
    enough = left * (100 + PERCENT) >= (F.col("nx") + F.col("n")) * PERCENT
    # Two loose sets find each other from both sides; one side is enough.
    once = ~F.col("loose") | (F.col("x") < F.col("id"))
    return (every.join(loose, ["element", "size"])
            .where((F.col("c") != F.col("cx")) & enough & once)
            .select(F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b")).distinct())


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = stored(sketches(docs), "sketches")
    equal = (rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
             .groupBy("d1", "d2").agg(F.min("doc_id").alias("id"),
                                      F.first("n_shingles").alias("n"),
                                      F.first("sketch").alias("sketch")))
    classes = stored(equal, "classes")
    kind = classes.schema["id"].dataType.simpleString()
    bands = classes.select("id", "sketch").mapInArrow(_bands, f"band bigint, id {kind}")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowded = stored(bands.join(sizes, "band"), "crowded")
    weight = crowded.groupBy("id").agg(F.sum("n").alias("weight"))
    heads = (crowded.join(weight, "id").groupBy("band")
             .agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("m"))
             .select("band", (-F.col("m.id")).alias("head")))
    headed = stored(crowded.join(heads, "band").where(F.col("id") != F.col("head"))
                    .select("band", "id", "head", "n"), "headed")
    pairs = (headed.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b"))
             .distinct())
    links = _checked(pairs, classes, docs, "first")
    member = stored(rows.drop("sketch").join(classes.select("d1", "d2", "id"), ["d1", "d2"], "left")
                    .select("doc_id", "n_shingles", "id"), "members")
    # Rows that share an id tie their classes together.
    several = (member.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))
               .where(F.col("doc_id").isNotNull() & (F.col("low") != F.col("high"))))
    shared = (member.join(several, "doc_id").where(F.col("id") != F.col("low"))
              .select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    links = stored(links.unionByName(shared), "links")
    found = components(links)
    labelled = headed.where(F.col("n") > 2).join(found, "id", "left").select(
        "band", "id", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("band")
    crowd = stored(labelled.join(mixed, "band", "left_semi"), "mixed")
    largest = (crowd.groupBy("band", "c").count()
               .groupBy("band").agg(F.max(F.struct("count", "c")).alias("m"))
               .select("band", F.col("m.c").alias("main")))
    loose = crowd.join(largest, "band").groupBy("id", "c").agg(
        F.max(F.col("c") != F.col("main")).alias("loose"))
    across = _across(loose, docs)
    more = _checked(across, classes, docs, "second")
    found = components(stored(links.unionByName(more), "links"))
    out = member.join(found, "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(
        F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
