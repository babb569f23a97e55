"""Document fingerprints by one-permutation MinHash, in SQL operators only.

Every five-word shingle is hashed once. The top eight bits of the hash choose
one of 256 bins, and each bin keeps its smallest hash. An empty bin takes over
the value of another one, found by trying bins in the order of hash functions
of (bin, attempt) until one is filled (optimal densification), hashed with the
bin's number. The lowest four bits of each bin make the fingerprint, 256
hexadecimal digits.

Two fingerprints agree in a digit where the minima agree, and by chance in one
of 16 other places; the likeness corrects for that: (share - 1/16) / (15/16),
but at least 0.

Rows equal in id and text are one document for the question which document
comes next; a null id comes first. A null text is empty. A text of fewer than
five words is one shingle; one without words has the fingerprint of zeros.

Texts are shuffled once, by id: a narrow table of ids says how many characters
each document lends to the one before it, and only these travel on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import stored

BINS, BITS = 256, 4
SHINGLE = 5
TRIES, MORE_TRIES = 8, 64
_DIGITS = "0123456789abcdef"
_PRIME = 65_537
_LEAST_ID = -(2**63)


def _probe(bin_: Column, attempt: int | Column) -> Column:
    """A bin, by a hash of (bin, attempt) modulo a prime."""
    if isinstance(attempt, int):
        a, b = (attempt * 40_503 + 12_345) % _PRIME, (attempt * 30_011 + 977) % _PRIME
        return ((bin_ * a + b) % _PRIME).bitwiseAND(BINS - 1)
    return F.xxhash64(bin_, attempt).bitwiseAND(BINS - 1).cast("int")


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 56).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of a column that is not null."""
    w, s, m, b = (f"__{out}_{k}" for k in "wsmb")
    col = F.col
    df = df.withColumn(w, F.array_remove(F.split(col(text), r"[\x20\x09-\x0D]+"), ""))
    whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
        F.array().cast("array<bigint>"))
    # Sorted by signed value: those of a bin lie together, the smallest first.
    df = df.withColumn(s, F.sort_array(F.when(
        F.size(w) >= SHINGLE, F.transform(
            F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)),
            lambda i: F.xxhash64(F.slice(col(w), i, SHINGLE)))).otherwise(whole)))
    df = df.withColumn(m, F.sort_array(F.transform(F.filter(
        col(s), lambda x, i: (i == 0) | (_bin(x) != _bin(col(s)[F.greatest(i - 1, F.lit(0))]))),
        lambda x: F.struct(_bin(x).alias("bin"), x.alias("value")))))
    # Empty bins between the filled ones become nulls.
    none = F.lit(None).cast("bigint")
    ends = F.concat(col(m), F.array(F.struct(F.lit(BINS).alias("bin"), none.alias("value"))))
    gap = F.flatten(F.transform(ends, lambda x, i: F.concat(
        F.array_repeat(none, x["bin"] - F.when(
            i == 0, F.lit(-1)).otherwise(col(m)[F.greatest(i - 1, F.lit(0))]["bin"]) - 1),
        F.array(x["value"]))))
    df = df.withColumn(b, F.slice(gap, 1, BINS))
    tries = [lambda i, t=t: col(b)[_probe(i, t)] for t in range(1, TRIES + 1)]

    def filled(x: Column, i: Column) -> Column:
        later = F.aggregate(F.sequence(F.lit(1), F.lit(MORE_TRIES)), none,
                            lambda found, t: F.coalesce(found, col(b)[_probe(i, t)]))
        last = col(m)[F.pmod(i, F.greatest(F.size(m), F.lit(1)))]["value"]
        # Bins that take over one value agree by chance each for itself.
        return F.coalesce(x, F.xxhash64(F.coalesce(*[t(i) for t in tries], later, last), i))

    digit = F.transform(col(b), lambda x, i: F.substring(
        F.lit(_DIGITS), filled(x, i).bitwiseAND(2**BITS - 1).cast("int") + 1, 1))
    df = df.withColumn(out, F.when(F.size(m) > 0, F.array_join(digit, ""))
                       .otherwise(F.lit("0" * BINS)))
    return df.drop(w, s, m, b)


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1."""
    other = F.lit(0)
    for k in range(0, BINS, 16):
        x, y = (F.conv(F.substring(c, k + 1, 16), 16, -10).cast("bigint") for c in (a, b))
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        other = other + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    share = (F.lit(BINS) - other) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def _following(ids: DataFrame) -> DataFrame:
    """key, h, n_chars and next_key, next_h: the next document, after the last the first.

    The ids are dealt by ranges and numbered beside each other; of each range
    only the first row is looked up by the range before.
    """
    ranged = stored(ids.repartitionByRange("key", "h")
                    .withColumn("part", F.spark_partition_id()), "fingerprint-ids")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("key", "h")).alias("f"))
    # One row for each range.
    parts = Window.orderBy("part")
    ahead = F.coalesce(F.lead("f").over(parts), F.first("f").over(
        parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = firsts.select("part", ahead.alias("other"))
    own = Window.partitionBy("part").orderBy("key", "h")
    lead = F.lead(F.struct("key", "h")).over(own)
    joined = ranged.withColumn("n", lead).join(ends, "part")
    following = F.coalesce("n", "other")
    return joined.select("key", "h", "n_chars", following["key"].alias("next_key"),
                         following["h"].alias("next_h"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text's digest, both fingerprints and likenesses of every row.

    The edited text is the text whose last quarter is replaced by the first
    characters of the next document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST_ID)).alias("key"),
                      text.alias("text"), F.xxhash64(text).alias("h"))
    ids = own.select("key", "h", F.length("text").cast("bigint").alias("n_chars")).distinct()
    after = stored(_following(ids), "fingerprint-next")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    lent = after.select(F.col("next_key").alias("key"), F.col("next_h").alias("h"),
                        F.col("key").alias("to_key"), F.col("h").alias("to_h"),
                        quarter.alias("quarter"))
    heads = own.join(lent, ["key", "h"]).select(
        F.col("to_key").alias("key"), F.col("to_h").alias("h"), "quarter",
        F.expr("substring(text, 1, quarter)").alias("head")).dropDuplicates(["key", "h"])
    edited = own.join(heads, ["key", "h"]).withColumn("n", F.length("text")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, n - quarter)"), F.col("head")))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = with_fingerprint(edited, "text", "fingerprint").drop("text")
    prints = with_fingerprint(prints, "edited", "edited_fingerprint").drop("edited")
    prints = stored(prints.select("key", "h", F.col("n").cast("bigint").alias("n_chars"),
                                  "edited_sha256", "fingerprint", "edited_fingerprint"),
                    "fingerprints")
    following = (after.select("key", "h", "next_key", "next_h").join(
        prints.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"),
                      F.col("fingerprint").alias("next")).dropDuplicates(["next_key", "next_h"]),
        ["next_key", "next_h"]).select("key", "h", "next"))
    out = prints.join(following, ["key", "h"])
    doc_id = F.when(F.col("key") != _LEAST_ID, F.col("key"))
    return out.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", "fingerprint",
                      "edited_fingerprint",
                      likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                      likeness("fingerprint", "next").alias("near_next"))
