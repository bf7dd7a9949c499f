"""Queries on search, ranking and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import scoring as S
from fathom.functions import text as T
from fathom.functions import vectors as V
from fathom.operators import bm25, graph, hooks, metrics, retrieval, store, walks, word_index
from fathom.plans import data, sqltext
from fathom.plans.catalogue import query
from fathom.sources import readers

_Q = "q(query_id, qt) AS (SELECT doc_id, coalesce(text, '') FROM documents WHERE doc_id % 100 = 0)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document is a question, its whole text."""
    return data.table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("qt"))


def kept_index(spark: SparkSession, d: str) -> word_index.WordIndex:
    """The index of this documents table as its files are now; made by the first query that asks for it, and read by all later ones."""
    docs = data.table(spark, d, "documents")
    held = word_index.WordIndex(spark, f"{store.shared_root(spark)}/words-{word_index.FORM}-{store.content_key(docs)}")
    if not held.exists():
        held.add_texts(readers.spread(docs.select("doc_id", "text")))
    return held


def _question_terms(spark: SparkSession, d: str) -> DataFrame:
    return word_index.text_terms(questions(spark, d).select("query_id", F.col("qt").alias("text")))


def _best_words(spark: SparkSession, d: str, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by words."""
    return kept_index(spark, d).top(_question_terms(spark, d), k)


BM25 = f"""{_Q},
qterm AS (SELECT CAST(query_id AS BIGINT) AS query_id, unnest({sqltext.doc_tokens('qt')}) AS term FROM q),
tok AS (SELECT doc_id, {sqltext.doc_tokens("coalesce(text, '')")} AS tokens FROM documents),
dl AS (SELECT doc_id, len(tokens) AS len FROM tok),
st AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM dl),
post AS (SELECT doc_id, unnest(tokens) AS term FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
wsc AS (
  SELECT query_id, p.doc_id, sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * 2.3 / (1 + 1.3 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM qterm JOIN post p USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL
)"""


@query("bm25_search", f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM wsc) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_search(spark, d):
    return _best_words(spark, d, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_idf", f"WITH {BM25} SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st WHERE df >= 20")
def bm25_idf(spark, d):
    held = kept_index(spark, d)
    found = held.frequencies().filter("df >= 20").crossJoin(F.broadcast(held.statistics()))  # one row
    return found.select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n_docs")), 6).alias("idf"))


@query(
    "bm25_incremental",
    f"WITH {BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 5 <> 0)')} SELECT (SELECT n_docs FROM st) AS n_docs, round((SELECT avgdl FROM st), 6) AS avgdl, count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM post",
)
def bm25_incremental(spark, d):
    """Half of the documents indexed, a fifth of all removed, the other half added."""
    docs = data.table(spark, d, "documents")
    tokens = T.doc_tokens(F.coalesce("text", F.lit("")))
    first, rest = bm25.build(docs.filter("doc_id % 2 = 0"), tokens), bm25.build(docs.filter("doc_id % 2 = 1 and doc_id % 5 <> 0"), tokens)
    now = bm25.changed(first, docs.filter("doc_id % 5 = 0").select("doc_id"), rest)
    counts = now.postings.agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("term").alias("n_terms"))
    return now.statistics().crossJoin(counts).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_postings", "n_terms")


@query(
    "identifier_boost",
    f"""WITH {BM25.replace(_Q, "q(query_id, qt) AS (VALUES (1, 'tion'))")},
f AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\btion\\b') THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS times FROM documents WHERE contains(lower(text), 'tion'))
SELECT coalesce(w.doc_id, f.doc_id) AS doc_id, round(CASE WHEN times IS NOT NULL THEN coalesce(score, 0) * times + 5 ELSE coalesce(score, 0) END, 6) AS score FROM wsc w FULL JOIN f ON w.doc_id = f.doc_id""",
)
def identifier_boost(spark, d):
    one = spark.createDataFrame([(1, "tion")], "query_id long, qt string")
    scored = kept_index(spark, d).scores(bm25.query_terms(one, T.doc_tokens(F.col("qt")))).drop("query_id")
    return bm25.identifier_boost(scored, data.table(spark, d, "documents"), "tion").select("doc_id", F.round("score", 6).alias("score"))


def _nearest(spark, d, every: int, k: int, threshold: float = -1.0):
    e = data.table(spark, d, "embeddings")
    return retrieval.knn(e, e.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), k, threshold)


COS = """cs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % {0} = 0
), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM cs)"""


@query("knn_cosine", f"WITH {COS.format(25)} SELECT query_id, id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5")
def knn_cosine(spark, d):
    return _nearest(spark, d, 25, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_threshold", f"WITH {COS.format(10)} SELECT query_id, id, round(score, 6) AS score FROM rk WHERE rank <= 20 AND score >= 0.3")
def knn_threshold(spark, d):
    return _nearest(spark, d, 10, 20, 0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query("similar_pairs", f"WITH {data.PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pr")
def similar_pairs(spark, d):
    return data.pairs(spark, d).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query("cosine_scalar", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1")
def cosine_scalar(spark, d):
    e = data.table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(
    "reference_similarity",
    """WITH r AS (SELECT embedding FROM embeddings WHERE vec_id < 5)
SELECT e.vec_id AS id, round(greatest(0.0, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])))), 6) AS max_similarity,
  round(avg(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))), 6) AS mean_similarity FROM embeddings e, r GROUP BY e.vec_id""",
)
def reference_similarity(spark, d):
    e = data.table(spark, d, "embeddings")
    return retrieval.reference_similarity(e, e.filter("vec_id < 5").select(F.col("embedding").alias("ref_vec"))).select("id", F.round("max_similarity", 6).alias("max_similarity"), F.round("mean_similarity", 6).alias("mean_similarity"))


@query(
    "mean_vector",
    """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)
SELECT label, CAST(i AS BIGINT) AS i, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM x GROUP BY ALL""",
)
def mean_vector(spark, d):
    return data.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))


_LISTS = """la AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank FROM documents),
lb AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS rank FROM documents)"""


@query("rrf_fusion", f"WITH {_LISTS}, u AS (SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) AS p FROM la WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) FROM lb WHERE rank <= 40) SELECT query_id, doc_id, round(sum(p), 8) AS score FROM u GROUP BY ALL")
def rrf_fusion(spark, d):
    docs = data.table(spark, d, "documents").withColumn("query_id", F.col("lang"))
    first = retrieval.top(docs.withColumn("score", F.length("text")), 40, ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.md5("text"), "doc_id")
    second = docs.withColumn("rank", F.row_number().over(w)).filter("rank <= 40")
    return retrieval.fuse([(first, 0.6), (second, 0.4)]).select("query_id", "doc_id", F.round("score", 8).alias("score"))


HYBRID = f"""{BM25},
vs AS (SELECT q.query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM q JOIN embeddings x ON x.vec_id = q.query_id, embeddings e),
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM wsc),
b AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM vs WHERE score >= 0.1),
u AS (SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) AS p FROM a WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) FROM b WHERE rank <= 50),
f AS (SELECT query_id, doc_id, sum(p) AS score FROM u GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)"""


def _hybrid(spark, d, limit: int = 10) -> DataFrame:
    e = data.table(spark, d, "embeddings")
    seeds = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")).join(questions(spark, d).select("query_id"), "query_id", "left_semi")
    near = retrieval.knn(e, seeds, 5 * limit, 0.1).select("query_id", F.col("id").alias("doc_id"), "score")
    return retrieval.hybrid(_best_words(spark, d, 3 * limit), near, limit, alpha=0.4, threshold=0.1)


@query("hybrid_search", f"WITH {HYBRID} SELECT query_id, doc_id, round(score, 8) AS score, rank FROM h WHERE rank <= 10")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("query_id", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


_HALF = "exp(-ln(2) / 168.0 * {0})"
RESULTS = f"""{data.MEM}, near AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vid, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vid) AS rank FROM near),
top AS (SELECT r.query_id, r.similarity, r.rank, m.* FROM ranked r JOIN mem m ON m.id = r.vid)"""


def _results(spark, d, k: int = 8) -> DataFrame:
    """The nearest memories of some queries."""
    return _nearest(spark, d, 50, k).join(data.memories(spark, d), "id").withColumnRenamed("score", "similarity")


@query(
    "temporal_score",
    f"""WITH {RESULTS}, t AS (SELECT * FROM top WHERE rank <= 8 AND NOT (from_hours IS NOT NULL AND from_hours < 0) AND NOT (until_hours IS NOT NULL AND until_hours > 0))
SELECT query_id, id, round(0.8::DOUBLE * similarity + 0.2::DOUBLE * least(1.0, CASE WHEN coalesce(idle_hours, age_hours) <= 0 THEN 1.0 ELSE greatest(0.1, {_HALF.format('coalesce(idle_hours, age_hours)')}) END + CASE WHEN access_count <= 0 THEN 0.0 ELSE least(access_count * 0.05::DOUBLE, 0.3) END), 6) AS score FROM t""",
)
def temporal_score(spark, d):
    r = _results(spark, d).filter("(from_hours is null or from_hours >= 0) and (until_hours is null or until_hours <= 0)")
    return r.select("query_id", "id", F.round(S.temporal_score(F.col("similarity"), F.coalesce("idle_hours", "age_hours"), F.col("access_count")), 6).alias("score"))


@query(
    "readiness",
    f"""WITH {RESULTS}, t AS (SELECT * FROM top WHERE rank <= 8), g AS (
SELECT query_id, least(count(*) / 5.0::DOUBLE, 1.0) AS coverage, max(CASE WHEN rank = 1 THEN similarity END) AS top_similarity,
  CASE WHEN count(*) = 1 THEN 0.5 WHEN avg(similarity) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - stddev_pop(similarity) / avg(similarity))) END AS coherence,
  coalesce(avg(quality_score), 0.5) AS quality_avg, coalesce(avg(CASE WHEN idle_hours IS NOT NULL THEN greatest(0.1, {_HALF.format('greatest(idle_hours, 0)')}) END), 0.5) AS freshness FROM t GROUP BY query_id
), c AS (SELECT *, 0.2::DOUBLE * coverage + 0.3::DOUBLE * top_similarity + 0.15::DOUBLE * coherence + 0.2::DOUBLE * quality_avg + 0.15::DOUBLE * freshness AS confidence FROM g)
SELECT query_id, round(confidence, 6) AS confidence, round(coherence, 6) AS coherence, round(freshness, 6) AS freshness, CASE WHEN confidence >= 0.7 THEN 'proceed' WHEN confidence >= 0.4 THEN 'warn' ELSE 'insufficient' END AS recommendation,
  array_to_string(list_filter([CASE WHEN coverage < 0.5 THEN 'coverage' END, CASE WHEN top_similarity < 0.5 THEN 'top_similarity' END, CASE WHEN coherence < 0.5 THEN 'coherence' END, CASE WHEN quality_avg < 0.5 THEN 'quality_avg' END, CASE WHEN freshness < 0.5 THEN 'freshness' END], lambda x: x IS NOT NULL), ',') AS weak_factors FROM c""",
)
def readiness(spark, d):
    r = retrieval.readiness(_results(spark, d).withColumn("age_hours", F.col("idle_hours")))
    return r.select("query_id", *[F.round(c, 6).alias(c) for c in ("confidence", "coherence", "freshness")], "recommendation", "weak_factors")


@query("quality_multiplier", f"WITH {RESULTS} SELECT query_id, id, round(CASE WHEN quality_score > 0 THEN similarity * (0.85::DOUBLE + 0.15::DOUBLE * quality_score) ELSE similarity END, 6) AS score FROM top WHERE rank <= 8")
def quality_multiplier(spark, d):
    return _results(spark, d).select("query_id", "id", F.round(S.quality_multiplier(F.col("similarity"), F.col("quality_score")), 6).alias("score"))


@query(
    "symbol_boost",
    f"""WITH {RESULTS}, t AS (SELECT query_id, id, similarity, lower(type) AS s, ['pat', 'pattern', 'decision', 'err'] AS toks FROM top WHERE rank <= 8),
h AS (SELECT *, list_filter(list_transform(toks, lambda t: CASE WHEN s = t THEN 0.15::DOUBLE WHEN contains(s, t) OR contains(t, s) THEN 0.08::DOUBLE END), lambda x: x IS NOT NULL) AS hits FROM t)
SELECT query_id, id, round(CASE WHEN len(hits) > 0 THEN least(1.0, similarity + hits[1]) ELSE similarity END, 6) AS score FROM h""",
)
def symbol_boost(spark, d):
    tokens = F.array(*map(F.lit, ("pat", "pattern", "decision", "err")))
    return _results(spark, d).select("query_id", "id", F.round(retrieval.symbol_boost(F.col("similarity"), F.col("type"), tokens), 6).alias("score"))


@query("centrality_boost", f"WITH {RESULTS}, {data.PAIRS}, e AS (SELECT id_a AS id FROM pr UNION ALL SELECT id_b FROM pr), dg AS (SELECT id, count(*) AS n FROM e GROUP BY id) SELECT query_id, t.id, round(least(1.0, similarity + 0.1::DOUBLE * coalesce(n / (SELECT max(n) FROM dg), 0.0)), 6) AS score FROM top t LEFT JOIN dg ON dg.id = t.id WHERE rank <= 8")
def centrality_boost(spark, d):
    central = graph.degrees(data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), data.edges(spark, d))
    r = _results(spark, d).join(central, "id", "left")
    return r.select("query_id", "id", F.round(F.least(F.lit(1.0), F.col("similarity") + 0.1 * F.coalesce("normalized_degree", F.lit(0.0))), 6).alias("score"))


@query("union_best", f"WITH {COS.format(25)}, k AS (SELECT id, score FROM rk WHERE rank <= 10) SELECT id, round(max(score), 6) AS score FROM k GROUP BY id")
def union_best(spark, d):
    return _nearest(spark, d, 25, 10).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


_JUDGED = """j AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 + b.vec_id % 3 AS relevance FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id)"""


@query(
    "ir_metrics",
    f"""WITH {COS.format(25)}, {_JUDGED}, r AS (SELECT query_id, id, rank FROM rk WHERE rank <= 10),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS f, sum((pow(2.0, relevance) - 1) / log2(rank + 1)) AS dcg FROM r JOIN j USING (query_id, id) GROUP BY query_id),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS n FROM j),
b AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN (pow(2.0, relevance) - 1) / log2(n + 1) END) AS idcg FROM i GROUP BY query_id)
SELECT query_id, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS "precision", round(CASE WHEN coalesce(hits, 0) = 0 THEN 0 ELSE 2 * (hits / relevant) * (hits / 10) / (hits / relevant + hits / 10) END, 6) AS f1,
  round(coalesce(1.0 / f, 0)::DOUBLE, 6) AS reciprocal_rank, round(coalesce(dcg, 0), 6) AS dcg, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM b LEFT JOIN h USING (query_id)""",
)
def ir_metrics(spark, d):
    e = data.table(spark, d, "embeddings")
    a = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "label")
    judged = a.join(e.select(F.col("vec_id").alias("id"), "label"), "label").filter("query_id <> id").select("query_id", "id", (1 + F.col("id") % 3).alias("relevance"))
    got = metrics.retrieval_quality(_nearest(spark, d, 25, 10), judged, 10)
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query("mmr")
def mmr(spark, d):
    pool = _nearest(spark, d, 25, 20).join(data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    return retrieval.mmr(pool.select("query_id", "id", F.col("score").alias("similarity"), "vec"), limit=10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("diversity_filter")
def diversity_filter(spark, d):
    pool = _nearest(spark, d, 25, 20).join(data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id")
    return retrieval.diverse(pool.select("query_id", "id", "rank", "vec"), 0.35)


@query(
    "decomposed_search",
    f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM wsc), s AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM r WHERE rank <= 20 GROUP BY doc_id)
SELECT doc_id, round(score, 8) AS score FROM s""",
)
def decomposed_search(spark, d):
    """The questions as parts of one query, fused without weights."""
    ranked = _best_words(spark, d, 20).withColumn("whole", F.lit(1))
    return retrieval.fuse([(ranked, 1.0)], by="whole").select("doc_id", F.round("score", 8).alias("score"))


@query("rerank")
def rerank(spark, d):
    """Hybrid results scored again by the rerank hook."""
    x = _hybrid(spark, d).join(data.table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(questions(spark, d), "query_id")
    return x.select("query_id", "doc_id", F.round(hooks.rerank_score(F.col("qt"), F.col("text"), F.col("score")), 6).alias("score"))


@query("graph_search")
def graph_search(spark, d):
    """Every question's hybrid results as seeds of its personalised PageRank, both lists fused."""
    base = graph.cut(_hybrid(spark, d, 20))
    v = data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    known = base.join(v, base.doc_id == v.id, "left_semi")
    seeds = known.filter("rank <= 10").select("query_id", F.col("doc_id").alias("id"), F.col("score").alias("weight"))
    walked = walks.best_ranks(data.cells(spark, d), seeds, 20).select("query_id", F.col("id").alias("doc_id"), F.round("rank", 12).alias("score"))
    fused = retrieval.fuse([(base, 0.6), (retrieval.top(walked, 20, ["query_id"]), 0.4)])
    return retrieval.top(fused, 10, ["query_id"]).select("query_id", "doc_id", F.round("score", 8).alias("score"))


@query("hook_embedding")
def hook_embedding(spark, d):
    return data.table(spark, d, "documents").select("doc_id", hooks.hook("embed")(F.col("text")).alias("embedding"))
