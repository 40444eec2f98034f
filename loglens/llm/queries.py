"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import (chat_format, embedding_dedup, exact_dedup, filter_audit, hard_negatives, labelled, mixing, packing, quality, secret_scan, shingle_join,
                         token_counts, toxicity, warc)
from loglens.llm.common import shared_folder, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = table(spark, sf_dir, "documents"), labelled.held_out("doc_id", 3, 1)
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"), ~back))
    return scored.select("doc_id", back.alias("held_out"), "score", "predicted")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_format.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ",")
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return views.select("conv_id", "part", "piece", "perspective", "n_turns", "rendered", F.length("rendered").cast("long").alias("n_chars"), spans.alias("mask"), masked.alias("masked_chars"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    records = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=False).filter("kind = 'record'")
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = table(spark, sf_dir, "documents"), labelled.held_out("doc_id", 4, 2)
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~back))
    return scored.select("doc_id", back.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flag_copies(table(spark, sf_dir, "documents"), keep="max")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.KINDS))
    return found.select("doc_id", *[number(k) for k in secret_scan.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_chat_format, op4_warc, op5_toxicity, op6_packing, op7_mixing, op8_shingle_join,
                                   op9_exact_dedup, op10_embedding_dedup, op11_filter_audit, op12_hard_negatives, op13_secret_scan)}

ORACLE_SQL = {
    "op3_chat_format": r"""
WITH m AS (
  SELECT conv_id, CAST(floor(turn / 128) AS BIGINT) AS part, turn, coalesce(role, '') AS who,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1| >', 'g') AS text
  FROM conversations
), n AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id, part) AS rows_here, CAST(ceil(count(*) OVER (PARTITION BY conv_id, part, turn) / 128) AS BIGINT) AS pieces FROM m
), d AS (
  SELECT DISTINCT conv_id, part, turn, who, text,
         CASE WHEN rows_here > 512 THEN coalesce(turn - part * 128, 0) * 4294967296 + CAST('0x' || substr(md5(who || ':' || text), 1, 8) AS BIGINT) % pieces ELSE 0 END AS piece
  FROM n
), rules AS (
  SELECT conv_id AS r_conv, part AS r_part, piece AS r_piece, text AS r_text FROM d WHERE who = 'system'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, text) = 1
), v AS (
  SELECT d.*, p.who AS perspective,
         CASE WHEN r_text IS NOT NULL AND (r_part IS DISTINCT FROM part OR r_piece <> piece) THEN '<|im_start|>system' || chr(10) || r_text || '<|im_end|>' || chr(10) ELSE '' END AS opening,
         '<|im_start|>' || CASE WHEN d.who = p.who THEN 'assistant' WHEN d.who = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(CASE WHEN d.who = '' THEN 'unknown' ELSE d.who END, '[^A-Za-z0-9_.-]', '_', 'g') END || chr(10) AS head
  FROM d JOIN (SELECT DISTINCT conv_id, who FROM m WHERE who <> 'system') p ON d.conv_id IS NOT DISTINCT FROM p.conv_id
  LEFT JOIN rules ON d.conv_id IS NOT DISTINCT FROM r_conv
), o AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS body,
         length(opening) + coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, part, piece, perspective ORDER BY turn, who, text
                                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM v
)
SELECT conv_id, part, CAST(piece AS BIGINT) AS piece, perspective, count(*) AS n_turns, any_value(opening) || string_agg(body, '' ORDER BY turn, who, text) AS rendered,
       CAST(length(any_value(opening)) + sum(length(body)) AS BIGINT) AS n_chars,
       coalesce(string_agg(CASE WHEN who = perspective THEN CAST(start AS VARCHAR) || ':' || CAST(start + length(text) + 10 AS VARCHAR) END, ',' ORDER BY turn, who, text), '') AS mask,
       CAST(coalesce(sum(CASE WHEN who = perspective THEN length(text) + 10 END), 0) AS BIGINT) AS masked_chars
FROM o GROUP BY conv_id, part, piece, perspective""",
    "op4_warc": """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))""",
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / (0.25::DOUBLE + 0.75::DOUBLE * (length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w
  FROM d GROUP BY source
), caps AS (SELECT count(*) AS n FROM s), steps AS (
  -- shared by weight; whatever exceeds its limit is capped, and the rest is shared again
  WITH RECURSIVE r AS (
    SELECT 0 AS step, list(struct_pack(source := source, w := w, lim := 2.0::DOUBLE * source_size, capped := false)) AS a,
           1.5::DOUBLE * sum(source_size) AS total FROM s
    UNION ALL
    SELECT step + 1, list_transform(a, lambda x: struct_pack(source := x.source, w := x.w, lim := x.lim,
             capped := x.capped OR x.w * ((total - coalesce(list_sum(list_transform(list_filter(a, lambda y: y.capped), lambda y: y.lim)), 0))
                       / list_sum(list_transform(list_filter(a, lambda y: NOT y.capped), lambda y: y.w))) > x.lim)), total
    FROM r WHERE step < (SELECT n FROM caps)
  )
  SELECT a, (total - coalesce(list_sum(list_transform(list_filter(a, lambda y: y.capped), lambda y: y.lim)), 0))
            / list_sum(list_transform(list_filter(a, lambda y: NOT y.capped), lambda y: y.w)) AS level
  FROM r WHERE step = (SELECT n FROM caps)
), t AS (
  SELECT x.source AS source, CASE WHEN x.capped THEN x.lim ELSE x.w * level END AS target
  FROM (SELECT unnest(a) AS x, level FROM steps)
), st AS (
  SELECT s.source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT doc_id, size, source_size, target, epochs, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS prefix
  FROM d JOIN st ON d.source IS NOT DISTINCT FROM st.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN prefix - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
  FROM d
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, bits
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0) AS INTEGER) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), r AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (bits & before <> 0 AND bits & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (bits = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & bit <> 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5""",
}
