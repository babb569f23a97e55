"""What each filter of a chain removes, in every order, and its fair share of it.

Each document gets a bit mask of the filters that it fails. Filters don't change
texts, so every order follows from the counts of masks in a part: v(S), the
number of documents that fail any filter of the coalition S, is the removal game.

Steps are differences of coalitions: a filter that comes after the filters in S
removes v(S + f) - v(S). Fair shares come from the Hart-Mas-Colell potential
P(S) = (v(S) + sum of P(S - f) over f in S) / |S|, with P of nothing 0, computed
over all coalitions from small to large: the Shapley value of f is
P(all) - P(all - f). Potentials are kept times lcm(1..k), so all stays whole.

Documents are read once. Only ids, masks and digests of texts are shuffled;
copies are counted within their part before they meet, so a text that a third
of the rows hold is no hot key. What follows has one row for each part.

Null texts count as empty, a null part as the empty one. A document that fails
E (a copy) has a document with a smaller id and the same text; rows with equal
ids and texts are no copies of each other, and rows with a null id neither are
copies nor make others copies. Of several label rows of one id, any that says 1
counts. Empty tables give an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filters of a document by itself, in the order of their bits, from text and words.
Filter = Callable[[Column, Column], Column]
FILTERS: dict[str, Filter] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: (100 * F.length(F.regexp_replace(text, "[^A-Z]+", ""))
                              > 2 * F.length(text)),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"
_COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame, part: str = "source", filters: dict[str, Filter] = FILTERS) -> DataFrame:
    """part, doc_id, digest of the text, and the bits of the filters that each row fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), "doc_id",
                       text.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words)
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits + F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    return rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"),
                       bits.cast("int").alias("bits"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic, 1 where a label says so."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("bigint"))
    # Rows with a null id find nothing, but must not all go to one task.
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    out = rows.withColumn("salt", salt).join(known, ["doc_id", "salt"], "left").drop("salt")
    return out.fillna(0, ["good", "toxic"])


def mask_counts(rows: DataFrame, copies_bit: int) -> DataFrame:
    """n, good and toxic for each part and mask; ``copies_bit`` is set for copies.

    Copies of one text share their bits. In each (text, part) the documents are
    counted, and those with its smallest id apart; only where that id is the
    smallest of the whole table, these are no copies.
    """
    one = F.col("doc_id").isNotNull()
    per_id = rows.groupBy("digest", "part", "bits", "doc_id").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    groups = per_id.groupBy("digest", "part", "bits").agg(
        F.min(F.when(one, F.struct("doc_id", *_COUNTS))).alias("head"),
        *[F.sum(c).alias(c) for c in _COUNTS],
        *[F.sum(F.when(~one, F.col(c)).otherwise(0)).alias(f"no_id_{c}") for c in _COUNTS])
    least = groups.groupBy("digest").agg(F.min("head.doc_id").alias("least"))
    joined = groups.join(least, "digest")
    first = F.col("head.doc_id") == F.col("least")
    kept = {c: F.col(f"no_id_{c}") + F.when(first, F.col(f"head.{c}")).otherwise(0) for c in _COUNTS}
    sums = joined.groupBy("part", "bits").agg(
        *[F.sum(kept[c]).alias(f"kept_{c}") for c in _COUNTS],
        *[F.sum(F.col(c) - kept[c]).alias(f"copies_{c}") for c in _COUNTS])
    sides = F.explode(F.array(*[
        F.struct((F.col("bits") + extra).alias("mask"), *[F.col(f"{side}_{c}").alias(c) for c in _COUNTS])
        for side, extra in (("kept", 0), ("copies", copies_bit))]))
    return (sums.select("part", sides.alias("side")).select("part", "side.*").where("n > 0"))


def audited(counts: DataFrame, letters: str) -> DataFrame:
    """For each part, order of filters and step, from its counts of masks.

    kept, removed, redundant (fails, but removed before), unique_fails (fails
    nothing else), good_lost, toxic_lost, and shapley, the removals of the
    step's filter summed over all orders. Bit k of a mask is letter k.
    """
    k = len(letters)
    everything = (1 << k) - 1
    scale = lcm(*range(1, k + 1))
    parts = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"), F.sum("n").alias("total"))
    # v[S] for every coalition S, by count: at most 2^k masks are summed.
    for c in _COUNTS:
        parts = parts.withColumn(f"v_{c}", F.expr(f"""
            transform(sequence(0, {everything}), s -> aggregate(masks, 0L, (sum, m) ->
                sum + if((m.mask & s) != 0, m.{c}, 0L)))"""))
    parts = parts.withColumn("potential", F.expr(f"""
        aggregate(sequence(1, {everything}), array(0L), (p, s) -> concat(p, array(
            ({scale} * v_n[s] + aggregate(sequence(0, {k - 1}), 0L, (sum, i) ->
                sum + if((s & shiftleft(1, i)) != 0, p[s ^ shiftleft(1, i)], 0L)))
            div bit_count(s))))"""))
    orders = ",".join(sorted("".join(o) for o in permutations(letters)))
    rows = parts.drop("masks").withColumn("filter_order", F.explode(F.split(F.lit(orders), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = f"shiftleft(1, instr('{letters}', substr(filter_order, {{}}, 1)) - 1)"
    rows = rows.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(
        f"aggregate(sequence(1, step), 0, (m, j) -> m | if(j < step, {bit.format('j')}, 0))"))
    after = "before | own"
    removed = f"v_n[{after}] - v_n[before]"
    out = {"kept": f"total - v_n[{after}]", "removed": removed,
           "redundant": f"v_n[own] - ({removed})",
           "unique_fails": f"v_n[{everything}] - v_n[{everything} ^ own]",
           "good_lost": f"v_good[{after}] - v_good[before]",
           "toxic_lost": f"v_toxic[{after}] - v_toxic[before]",
           "shapley": f"{factorial(k) // scale} * (potential[{everything}] - potential[{everything} ^ own])"}
    return rows.select("part", "filter_order", "step",
                       *[F.expr(f"cast({e} as bigint)").alias(c) for c, e in out.items()])


def audit(docs: DataFrame, labels: DataFrame, part: str = "source",
          filters: dict[str, Filter] = FILTERS) -> DataFrame:
    """The audit of ``filters`` and, as the last one, of removing copies."""
    rows = labelled(failures(docs, part, filters), labels)
    return audited(mask_counts(rows, 1 << len(filters)), "".join(filters) + COPIES)
