"""Benchmark decontamination as a prefix-filtered set join, in SQL operators only.

A window is 13 consecutive words of an item (all words, if it has fewer). A
window occurs in a document where the same words stand in the same order, so
containment is 1 and a prefix of one token is enough: each window is joined by
its rarest word only, rarity being counted over all words of all documents.
A matching word fixes where the window would begin; beginnings before the
first or beyond the last possible word are ruled out by length and position,
and the rest are compared word by word.

The words of a document are exploded and joined in one stage; beside the
counts of the items' words and the hits, nothing is shuffled. The items'
windows are broadcast if they are counted to be few and short. Else words travel
to them by themselves, with their places; what meets there comes back to its
document to be compared, so a text is never sent with each of its words.

Null or empty texts have no words and are not contaminated; an empty benchmark
hits nothing. Rows that share a doc_id and a text have the same result, each in
its own row. A null item_id hits, but has no name in the list of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import broadcast_if_small, is_small, measured, stored

WORDS = 13
# What separates words, before letters are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words as they are written; only their ASCII letters are lowered later."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def windows(items: DataFrame, size: int = WORDS) -> DataFrame:
    """item_id, text (words joined by a space) and length of every distinct window."""
    own = items.select("item_id", words(lowered(F.col("text"))).alias("w"))
    own = own.where(F.size("w") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return (own.select("item_id", "w", first.alias("at"))
            .select("item_id", F.slice("w", F.col("at"), size).alias("window"))
            .distinct())


def _key(word: Column) -> Column:
    """A key that words equal after lowering A-Z share; ``lower`` is fast, and coarser."""
    return F.lower(word)


def rarest(windows_of: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its rarest word (key) and that word's offset."""
    vocabulary = stored(windows_of.select(F.explode("window").alias("word"))
                        .select(_key(F.col("word")).alias("key")).distinct(), "item-words")
    spread = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = (spread.select(_key(F.col("word")).alias("key"))
              .join(broadcast_if_small(vocabulary, *measured(vocabulary, "key")), "key")
              .groupBy("key").agg(F.count("*").alias("n")))
    each = windows_of.select("item_id", "window", F.posexplode("window").alias("offset", "word"))
    each = (each.withColumn("key", _key(F.col("word"))).join(counts, "key", "left")
            .fillna(0, ["n"]))
    return (each.groupBy("item_id", "window")
            .agg(F.min(F.struct("n", "key", "offset")).alias("m"))
            .select("item_id", F.array_join("window", " ").alias("joined"),
                    F.size("window").alias("length"), "m.key", "m.offset"))


def hits(docs: DataFrame, items: DataFrame, keys: list[str], size: int = WORDS) -> DataFrame:
    """keys, item_id, first word (from 0) and length of every occurrence in a document."""
    prefixes = stored(rarest(stored(windows(items, size), "windows"), docs), "prefixes")
    own = docs.select(*keys, words(F.col("text")).alias("w"))
    spread = (own.select(*keys, "w", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
              .withColumn("key", _key(F.col("word"))))
    first = F.col("at") - F.col("offset")
    inside = (first >= 0) & (first + F.col("length") <= F.col("n"))
    if is_small(*measured(prefixes, "joined", "key")):
        near = spread.join(F.broadcast(prefixes), "key").where(inside)
    else:
        met = spread.select(*keys, "n", "at", "key").join(prefixes, "key").where(inside)
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
        # Rows that share their keys have one text.
        near = met.alias("m").join(own.dropDuplicates(keys).alias("d"), same).select("m.*", "d.w")
    found = lowered(F.array_join(F.slice("w", first + 1, F.col("length")), " "))
    return (near.where(found == F.col("joined"))
            .select(*keys, "item_id", first.alias("first"), "length").distinct())


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) and contaminated of every document."""
    return judged(docs, items, size).drop("h")


def judged(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """The same with h, a hash of the text, which tells apart texts under one id."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    found = stored(hits(own, items, ["doc_id", "h"], size), "hits")
    key = Window.partitionBy("doc_id", "h")
    last = F.max(F.col("first") + F.col("length")).over(
        key.orderBy("first", "length").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("doc_id", "h", "first", "length").distinct()
    covered = (spans.withColumn("from", F.greatest(F.col("first"), F.coalesce(last, F.lit(0))))
               .groupBy("doc_id", "h")
               .agg(F.sum(F.greatest(F.col("first") + F.col("length") - F.col("from"), F.lit(0)))
                    .alias("n_hit")))
    named = found.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    of = _paired(covered, named)
    counted = own.select("doc_id", "h", F.size(words(F.col("text"))).cast("bigint")
                         .alias("n_words"))
    joined = counted.alias("d").join(
        of.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
        & (F.col("d.h") == F.col("f.h")), "left")
    n_hit = F.coalesce(F.col("f.n_hit"), F.lit(0)).cast("bigint")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.h").alias("h"), F.col("d.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.col("f.items"), F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("d.n_words"))).alias("contaminated"))


def _paired(covered: DataFrame, named: DataFrame) -> DataFrame:
    """Both have a row for each document that was hit."""
    return covered.alias("c").join(
        named.alias("n"), F.col("c.doc_id").eqNullSafe(F.col("n.doc_id"))
        & (F.col("c.h") == F.col("n.h"))).select("c.*", "n.items")
