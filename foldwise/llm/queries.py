"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import (bpe, decontam, filter_audit, fingerprint, licenses, lm, neardup, periodic,
                          quality, repeats, shards, token_counts, wrappers)
from foldwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

# Windows as joined words. Thirteen words from each place of a document are
# compared as a whole; windows of short items with the beginning of them.
ORACLES["op6_decontaminate"] = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
    g AS (SELECT doc_id, k, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k
                 ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS gram FROM t),
    s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS f
          FROM b WHERE len(w) > 0),
    v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
                 array_to_string(list_slice(w, f, f + 12), ' ') AS win FROM s),
    h AS (SELECT doc_id, k, n, item_id FROM g JOIN v ON gram = win WHERE n = 13
          UNION ALL
          SELECT doc_id, k, n, item_id FROM g
          JOIN v ON n < 13 AND starts_with(gram || ' ', win || ' ')),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) q GROUP BY doc_id),
    i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
          FROM h GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


@query
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(table(spark, sf_dir, "documents"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.matches(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("matches")["license"]))
    return out.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"),
                      F.array_join(names, ",").alias("licenses"),
                      F.coalesce(F.array_max(F.col("matches")["dice"]), F.lit(0.0))
                      .alias("best_dice"), "matches")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.grouped(table(spark, sf_dir, "documents"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, decode=True)
    return out.select("doc_id", bpe.n_tokens(F.col("__tokens")).alias("n_tokens"),
                      F.sha2("__tokens", 256).alias("ids_sha256"),
                      F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminated(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit",
                      F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256)
                      .alias("items_sha256"), "contaminated")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", (quality.remainder(F.col("doc_id")) == 1).alias("held_out"),
                         F.col("__score").alias("score"),
                         (F.col("__score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs).select(
        "doc_id", "text", F.col("__spans").alias("spans"))


@query
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrappers.extracted(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts get a repetition to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", F.floor(h / 10).alias("g"),
                      F.when(h % 10 == 0, words).alias("words"))
    own = own.withColumn("n", F.size("words").cast("bigint"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    own = own.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("""array_join(transform(sequence(0L, n - 1), i ->
        words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')""")
    return own.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.with_runs(_planted(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda t: F.concat(t, F.lit("\n"))), "")
               .cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# Masks, then a row for each order and step from sums over masks.
ORACLES["op12_filter_audit"] = """
    WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                      list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                  lambda x: x <> '') AS w FROM documents),
    f AS (SELECT part, doc_id,
                 CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                 + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)
                        THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                 + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask
          FROM w),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good,
                 sum(coalesce(toxic, 0)) AS toxic
          FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
    o AS (SELECT b1.c || b2.c || b3.c || b4.c || b5.c AS filter_order
          FROM b b1, b b2, b b3, b b4, b b5
          WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31
            AND (b1.bit | b2.bit | b3.bit | b4.bit | b5.bit) = 31),
    s AS (SELECT filter_order, step, bit AS own,
                 coalesce((SELECT sum(p.bit) FROM b p
                           WHERE strpos(substr(filter_order, 1, step - 1), p.c) > 0), 0)::INT AS before
          FROM o, (SELECT unnest(range(1, 6)) AS step) k, b WHERE c = substr(filter_order, step, 1)),
    r AS (SELECT part, filter_order, step, own,
                 sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept,
                 sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
                 sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant,
                 sum(n) FILTER (WHERE mask = own) AS unique_fails,
                 sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost,
                 sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost
          FROM m, s GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0)::BIGINT AS kept,
           coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
           coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.counted(table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
