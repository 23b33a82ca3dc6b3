"""Registered queries of the operators in this package, and their SQL where it can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax.llm import (bpe, byte_cnn, conversation_repair, cover_tree, exact_dedup, filter_audit, hd_langid, license_scan,
                          mixing, packing, pii, simhash, token_store)
from pertinax.llm.common import documents
from pertinax.session import scratch_dir, written

#: The tokenizer of the queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return byte_cnn.predict(docs, byte_cnn.train(docs, labels))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, f"token-store-{uuid.uuid4().hex}")
    return token_store.read(spark, token_store.write(documents(spark, sf_dir), folder, TOKENIZER, end_id=2))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return cover_tree.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS vec
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.vec, d.vec) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return hd_langid.predict(docs, hd_langid.train(docs.where(~hd_langid.held_out(F.col("doc_id")))))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(documents(spark, sf_dir), TOKENIZER)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_ASCII}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


#: Water-filling by search of the level, then the cut by a running sum in key order.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5('mix:' || doc_id), 1, 15) AS BIGINT) AS key
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
levels AS (SELECT a.source, (max(t.total) - coalesce(sum(3 * b.z) FILTER (WHERE 3.0 * b.z / b.w < 3.0 * a.z / a.w), 0))
                  / sum(b.w) FILTER (WHERE 3.0 * b.z / b.w >= 3.0 * a.z / a.w) AS level
           FROM s a, s b, (SELECT sum(z) AS total FROM s) t GROUP BY a.source),
t AS (SELECT source, z, least(CAST(3 * z AS DOUBLE), (SELECT max(level) FROM levels) * w) AS target FROM s),
p AS (SELECT source, z, target, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
r AS (SELECT d.doc_id, d.size, p.z, p.target, CASE WHEN p.z > 0 THEN p.budget // p.z ELSE 0 END AS e, p.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) - d.size AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target,
       CAST(e * size + least(size, greatest(0, budget - e * z - before)) AS BIGINT) AS taken
FROM r
"""

def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def _op10_sql() -> str:
    """The votes, spans and labels of the scan; grams are compared as strings."""
    templates = license_scan.PHRASES + license_scan.NOTICES
    grams, facts = [], []
    for i, t in enumerate(templates):
        words = license_scan.template_words(t.text)
        own = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
        grams += [f"({i}, {k}, '{g}')" for k, g in enumerate(own)]
        facts.append(f"({i}, '{t.label}', {t.exact}, {len(words)}, {sum(1 << k for k, g in enumerate(own) if g == t.key)})")
    covered = "bit_count({0} | ({0} << 1) | ({0} << 2))"
    return rf"""
WITH t(template, spot, gram) AS (VALUES {", ".join(grams)}),
f(template, label, exact, n, key) AS (VALUES {", ".join(facts)}),
w AS (SELECT doc_id, regexp_extract_all({LOWER_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS gram
      FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM w)),
v AS (SELECT doc_id, template, i - spot AS diagonal, bit_or(CAST(1 AS BIGINT) << spot) AS mask, min(i) AS first, max(i) + 2 AS last
      FROM g JOIN t USING (gram) GROUP BY ALL),
s AS (SELECT v.*, label, exact, n, key, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER p <= 4 THEN 0 ELSE 1 END AS start
      FROM v JOIN f USING (template) WINDOW p AS (PARTITION BY doc_id, template ORDER BY diagonal)),
p AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM s),
m AS (SELECT doc_id, label, exact, n, key, bool_or(bit_count(mask) = n - 2) AS whole, bit_or(mask) AS mask,
             max({covered.format("mask")}) AS alone, min(first) AS first, max(last) AS last
      FROM p GROUP BY doc_id, template, label, exact, n, key, span),
c AS (SELECT *, greatest(alone, CASE WHEN last - first + 1 <= n * 1.5 THEN {covered.format("mask")} ELSE 0 END) / CAST(n AS DOUBLE) AS coverage FROM m),
r AS (SELECT *, exact AND whole AS base, CASE WHEN exact THEN whole ELSE mask & key = key AND coverage >= 0.8 END AS verified FROM c)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN (
  SELECT doc_id, count_if(base) AS n_base, CAST(min(first) FILTER (WHERE base) AS BIGINT) AS first_word,
         CAST(max(first) FILTER (WHERE base) AS BIGINT) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified) AS labels,
         max(coverage) FILTER (WHERE verified) AS score FROM r GROUP BY doc_id) USING (doc_id)
"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), room=1024, end_id=2)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that a hash of each row's key calls for."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = (F.crc32(key) % 20).alias("harm")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role, text, harm).where("harm <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))))
    return rows.drop("col")


def repair_report(rows: DataFrame) -> DataFrame:
    """Each original conversation's counts, cheapest edits and digest after damage and repair."""
    ids = rows.select(F.col("conv_id").alias("of")).distinct()
    done = conversation_repair.report(damaged(rows))
    out = ids.join(done, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def filter_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters: too short, repetitive, shouting, symbols, copy of an earlier text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       words.alias("words")).select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        filter_audit.fail_mask([n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * F.length("text"),
                                F.col("text").rlike(r"[#$%&*|]")]).alias("mask"))
    flagged = filter_audit.first_holders(written(rows, "filter-masks"), "digest", "doc_id", "copy")
    # repeated rows collapse before ids are looked up, so a hot id is a handful of rows
    few = flagged.groupBy("doc_id", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask")).agg(
        F.count(F.lit(1)).alias("copies"))
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    rows = few.join(marks, F.col("doc_id") == F.col("of"), "left")
    weights = {c: F.col("copies") * F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")}
    counts = filter_audit.cells(rows, F.col("part"), F.col("mask"), weights, F.col("copies"))
    return filter_audit.audit(counts, "ABCDE", ["good", "toxic"])


#: Every order and step by itself, from the failures of each document.
OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
d AS (SELECT w.doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
      FROM w JOIN first USING (t)),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
      FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
      WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT list_aggregate(list_transform(p, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order,
             x.i AS step, p[x.i] AS own, p[:x.i - 1] AS before FROM o, x),
r AS (SELECT part, filter_order, step, own, f[own] AND NOT list_bool_or([false] || list_transform(before, lambda i: f[i])) AS gone,
             list_bool_or([false] || list_transform(before, lambda i: f[i])) AS earlier, f, good, toxic, n FROM m, s),
c AS (SELECT part, filter_order, step, own,
        CAST(coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT f[own]), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (WHERE f[own] AND earlier), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (WHERE f[own] AND len(list_filter(f, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (WHERE gone AND good), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(n) FILTER (WHERE gone AND toxic), 0) AS BIGINT) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quality": op3_quality,
    "op4_token_store": op4_token_store,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_license_scan": op10_license_scan,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op5_exact_top_k": OP5_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_license_scan": _op10_sql(),
    "op13_filter_audit": OP13_SQL,
}
