"""The driver's tables as the engine's own: memories, links, recall events. Times are hours before a fixed moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def memories(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("decision", "error", "pattern", "learning", "dead_end")])
    makers = F.array(*[F.lit(k) for k in ("human", "agent", "auto-extracted", "bot")])
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        i.alias("id"), F.col("text").alias("content"), "source", "lang", F.array("lang", "source").alias("tags"),
        F.when(i % 6 < 5, F.element_at(kinds, (i % 6 + 1).cast("int"))).alias("type"),
        (F.col("quality").cast("double") * 0.5 + 0.25 + (i % 5) * 0.05).alias("quality_score"),
        (i % 9).alias("access_count"), ((i * 37) % 3000).alias("age_hours"), F.when(i % 9 > 0, (i * 17) % 900).alias("idle_hours"),
        (i % 4).alias("correction_count"), (i % 11 == 0).alias("is_invariant"), (i % 10 == 7).alias("is_invalid"),
        F.when(i % 3 > 0, (i * 13) % 1000 - 100).alias("from_hours"), F.when(i % 4 > 0, (i * 7) % 500 - 200).alias("until_hours"),
        F.when(i % 7 > 0, (i % 13) / 10.0).alias("confidence"), F.element_at(makers, (i % 4 + 1).cast("int")).alias("source_type"),
        F.concat(F.lit("p"), (i % 3).cast("string")).alias("project"),
    )


#: The same for DuckDB.
MEM = """mem AS (
  SELECT d.doc_id AS id, d.text AS content, d.source, d.lang, [d.lang, d.source] AS tags,
    CASE d.doc_id % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'error' WHEN 2 THEN 'pattern' WHEN 3 THEN 'learning' WHEN 4 THEN 'dead_end' END AS type,
    CAST(l.quality AS DOUBLE) * 0.5::DOUBLE + 0.25::DOUBLE + (d.doc_id % 5) * 0.05::DOUBLE AS quality_score,
    d.doc_id % 9 AS access_count, (d.doc_id * 37) % 3000 AS age_hours, CASE WHEN d.doc_id % 9 > 0 THEN (d.doc_id * 17) % 900 END AS idle_hours,
    d.doc_id % 4 AS correction_count, d.doc_id % 11 = 0 AS is_invariant, d.doc_id % 10 = 7 AS is_invalid,
    CASE WHEN d.doc_id % 3 > 0 THEN (d.doc_id * 13) % 1000 - 100 END AS from_hours, CASE WHEN d.doc_id % 4 > 0 THEN (d.doc_id * 7) % 500 - 200 END AS until_hours,
    CASE WHEN d.doc_id % 7 > 0 THEN (d.doc_id % 13) / 10.0::DOUBLE END AS confidence,
    CASE d.doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'agent' WHEN 2 THEN 'auto-extracted' ELSE 'bot' END AS source_type,
    'p' || (d.doc_id % 3) AS project
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def recall_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("memory_id"), (F.col("event_type") == "purchase").alias("was_used"), (F.col("event_id") % 10 + 1).alias("rank_position"), "event_id")


RECALL = "rec AS (SELECT user_id AS memory_id, event_type = 'purchase' AS was_used, event_id % 10 + 1 AS rank_position, event_id FROM events)"


def pairs(spark: SparkSession, d: str, threshold: float = 0.3) -> DataFrame:
    from fathom.operators.retrieval import similar_pairs

    return similar_pairs(table(spark, d, "embeddings"), threshold)


PAIRS = """pr AS (
  SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3
)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between near vectors."""
    return pairs(spark, d).select(F.col("id_a").alias("source_id"), F.col("id_b").alias("target_id"), F.lit("similar_to").alias("relation"), F.col("similarity").alias("weight"))


def cells(spark: SparkSession, d: str, threshold: float = 0.3):
    """The same links in packed rows."""
    from fathom.operators import cells

    return cells.near(table(spark, d, "embeddings"), threshold)
