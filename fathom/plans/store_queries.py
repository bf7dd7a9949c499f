"""Queries on kept stores: vectors in cells, word postings in segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import store, word_index
from fathom.operators.vector_index import Collection
from fathom.plans import data
from fathom.plans.catalogue import query
from fathom.plans.retrieval_queries import BM25
from fathom.sources import readers


def _collection(spark, d) -> Collection:
    """Two thirds of the vectors as base; the others added, every seventh turned round, every fifth deleted and half of those put back."""
    e = data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    width = e.agg(F.max(F.size("vector"))).first()[0] or 1
    held = Collection(spark, store.new_folder(spark, "vectors"), width)
    held.rebuild(e.filter("id % 3 <> 0"))
    held.upsert(e.filter("id % 3 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 7 == 0, F.transform("vector", lambda x: -x)).otherwise(F.col("vector")).alias("vector")))
    held.delete(e.filter("id % 5 = 0").select("id"))
    held.upsert(e.filter("id % 10 = 0"))
    return held


def _questions(spark, d):
    return data.table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


_LIVE = """live AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 AND vec_id % 10 <> 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS vector FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0
)"""


@query(
    "vector_store",
    f"""WITH {_LIVE}, s AS (
  SELECT q.vec_id AS query_id, l.id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(l.vector AS DOUBLE[])) AS score FROM embeddings q, live l WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def vector_store(spark, d):
    """The exact path over a collection after upserts and deletes."""
    found = _collection(spark, d).search(_questions(spark, d), 10, exact=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_search")
def vector_search(spark, d):
    """The same by cells: tests/test_stores.py measures its recall against the exact path."""
    found = _collection(spark, d).search(_questions(spark, d), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_store_rebuilt", f"WITH {_LIVE} SELECT id, CAST(list_sum(list_transform(vector, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT))) AS BIGINT) AS total FROM live")
def vector_store_rebuilt(spark, d):
    """What a rebuild keeps of it."""
    held = _collection(spark, d)
    held.rebuild()
    return held.live().select("id", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1000)).alias("total"))


@query("word_index_changed", f"WITH {BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 5 <> 0)')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM wsc) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def word_index_changed(spark, d):
    """Search after half of the documents were indexed, a fifth of all removed, the rest added and segments merged; nothing is tokenized twice but the questions."""
    docs = readers.spread(data.table(spark, d, "documents").select("doc_id", "text"))
    held = word_index.WordIndex(spark, store.new_folder(spark, "words"))
    held.add_texts(docs.filter("doc_id % 2 = 0"))
    held.remove(docs.filter("doc_id % 5 = 0").select("doc_id"))
    held.merge()
    held.add_texts(docs.filter("doc_id % 2 = 1 and doc_id % 5 <> 0"))
    asked = word_index.text_terms(docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))
    return held.top(asked, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
