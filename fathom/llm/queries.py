"""One query per operator over the whole driver tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import alignment, board, compression, ctw, decontam, importance, jaccard, langid, mixing, repeats, sharding, tokencount, warc
from fathom.llm.shared import table


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), repeats.Repeats(length=200)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Join(width=4, percent=85)).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), n_shards=16, keep=["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.learn(documents.filter(~langid.held_out(F.col("doc_id"))))
    held = documents.select("doc_id", "text")
    return langid.identify(held, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, cap=2.0).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(table(spark, sf_dir, "documents"))


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def tokenizer_file(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op11_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokencount.Limit(tokens=1024))


def op12_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment.Pair(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")))


def op13_board_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.changes(*(table(spark, sf_dir, name) for name in ("sale_lines", "vendors", "items")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_capture_index, op2_importance_resampling, op3_difference_cover, op4_context_tree, op5_ngram_jaccard, op6_virtual_slots, op7_word_backoff, op8_entropy_mixing, op9_compression_bands, op10_prefix_decontamination, op11_token_transducer, op12_elementary_intervals, op13_board_changes, pipeline)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op1_warc_capture_index": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS ss FROM w
), x AS (SELECT doc_id, unnest(ss) AS g FROM s), k AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM k JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * c >= 85 * (len(p.ss) + len(q.ss) - c)
), r(node, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT node, b FROM r JOIN l ON l.a = other)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, (SELECT min(other) FROM r WHERE node = s.doc_id) AS component_id, (SELECT count(*) FROM l WHERE a = s.doc_id) AS n_links FROM s""",
    "op10_prefix_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda j: array_to_string(ws[j:j + least(13, len(ws)) - 1], ' '))) AS w FROM i WHERE len(ws) > 0
), ks AS (SELECT DISTINCT k FROM iw), p AS (
  SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, ks WHERE len(ws) >= k
), h AS (SELECT p.doc_id, p.j, p.k, iw.item_id FROM p JOIN iw ON iw.k = p.k AND iw.w = array_to_string(p.ws[p.j:p.j + p.k - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT n) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS n FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
