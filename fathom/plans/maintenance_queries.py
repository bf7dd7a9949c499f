"""Queries on the upkeep of a store."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import bm25, flow, maintenance, transcripts
from fathom.plans import data, sqltext
from fathom.plans.catalogue import query
from fathom.plans.text_queries import _SPEC

_H = lambda p: sqltext.has("text", p)
_CONS = f"""{data.MEM}, pv AS (SELECT id AS source_id, id + 1 AS target_id FROM mem WHERE id % 10 = 0 UNION ALL SELECT id, id + 2 FROM mem WHERE id % 20 = 0),
cm AS (SELECT id, CASE WHEN id % 20 = 0 THEN 'consolidation-llm' ELSE source END AS source, CASE WHEN id % 10 = 1 OR id % 40 = 2 THEN id // 10 * 10 END AS invalidated_by FROM mem)"""


def _consolidated(spark, d):
    """Every tenth memory superseded the next; every twentieth was merged and superseded the one after that too, of which half had been restored before."""
    m = data.memories(spark, d)
    i = F.col("id")
    rows = m.select("id", F.when(i % 20 == 0, maintenance.MERGED).otherwise(F.col("source")).alias("source"), F.when((i % 10 == 1) | (i % 40 == 2), F.floor(i / 10) * 10).alias("invalidated_by"), F.when(i % 10 == 1, F.lit(data.AS_OF)).alias("valid_until"))
    link = lambda x, step: x.select(i.alias("source_id"), (i + step).alias("target_id"), F.lit("supersedes").alias("relation"))
    links = link(m.filter("id % 10 = 0"), 1).unionAll(link(m.filter("id % 20 = 0"), 2)).unionAll(m.select(i.alias("source_id"), (i + 5).alias("target_id"), F.lit("similar_to").alias("relation")))
    return rows, links


@query("undo_report", f"WITH {_CONS}, x AS (SELECT p.source_id AS id, p.target_id AS t, c.invalidated_by IS NOT NULL AS ok FROM pv p LEFT JOIN cm c ON c.id = p.target_id) SELECT x.id, coalesce(string_agg(CASE WHEN ok THEN CAST(t AS VARCHAR) END, ',' ORDER BY t), '') AS restored, coalesce(string_agg(CASE WHEN NOT ok THEN CAST(t AS VARCHAR) END, ',' ORDER BY t), '') AS failed, x.id % 20 = 0 AS deleted FROM x GROUP BY x.id")
def undo_report(spark, d):
    rows, links = _consolidated(spark, d)
    listed = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)
    return maintenance.undo_consolidation(rows, links, rows.filter("id % 10 = 0")).report.select("id", listed("restored"), listed("failed"), "deleted")


@query("undo_consolidation", f"WITH {_CONS} SELECT id, source, CASE WHEN id IN (SELECT target_id FROM pv) THEN NULL ELSE invalidated_by END AS invalidated_by FROM cm WHERE id % 20 <> 0")
def undo_consolidation(spark, d):
    rows, links = _consolidated(spark, d)
    return maintenance.undo_consolidation(rows, links, rows.filter("id % 10 = 0")).memories.select("id", "source", "invalidated_by")


@query("undo_links", f"WITH {data.MEM} SELECT id AS source_id, id + 5 AS target_id, 'similar_to' AS relation FROM mem")
def undo_links(spark, d):
    rows, links = _consolidated(spark, d)
    return maintenance.undo_consolidation(rows, links, rows.filter("id % 10 = 0")).links


@query("link_metadata", "SELECT doc_id, array_to_string(list_sort(list_distinct([source] || CASE WHEN doc_id % 3 = 0 THEN [lang, source] ELSE [lang] END || CASE WHEN doc_id % 2 = 0 THEN ['x.ts'] ELSE [] END)), ',') AS code_paths, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS reason FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def link_metadata(spark, d):
    docs = data.table(spark, d, "documents").filter("lang is not null and source is not null")
    i = F.col("doc_id")
    old = F.create_map(F.lit("code_path"), F.array("source"), F.lit("reason"), F.array(F.lit("old")))
    new = F.when(i % 2 == 0, F.create_map(F.lit("code_paths"), F.array("lang", F.lit("x.ts")), F.lit("reason"), F.array(F.lit("new")))).otherwise(F.create_map(F.lit("code_paths"), F.array("lang")))
    merged = maintenance.merge_metadata(old, new)
    return docs.select("doc_id", F.array_join(merged["code_paths"], ",").alias("code_paths"), merged["reason"][0].alias("reason"))


_DEAD = "'DEAD END: Tried \"' || {0} || '\" — Failed because: ' || {1}"


@query("dead_end_text", f"SELECT doc_id, md5({_DEAD.format('text', 'source')} || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Context: ' || lang ELSE '' END) AS digest FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def dead_end_text(spark, d):
    docs = data.table(spark, d, "documents").filter("text is not null and source is not null and lang is not null")
    return docs.select("doc_id", F.md5(maintenance.dead_end(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""))).alias("digest"))


@query("dead_end_dedup", f"WITH {data.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) AS n FROM pr WHERE similarity >= 0.35), f AS (SELECT * FROM r WHERE n = 1 AND id_b % 3 = 0) SELECT vec_id AS new_id, CASE WHEN f.id_a IS NULL THEN 'saved' ELSE 'duplicate' END AS result, f.id_b AS duplicate_of FROM embeddings LEFT JOIN f ON f.id_a = vec_id")
def dead_end_dedup(spark, d):
    """Every third stored row is a dead end; the threshold fits the spread of the table's vectors."""
    pairs = data.pairs(spark, d).select(F.col("id_a").alias("new_id"), F.col("id_b").alias("id"), F.when(F.col("id_b") % 3 == 0, "DEAD END: x").otherwise("x").alias("content"), "similarity")
    near = data.table(spark, d, "embeddings").select(F.col("vec_id").alias("new_id")).join(pairs, "new_id", "left")
    return maintenance.dead_end_decisions(near, 0.35)


_SKILLS = f"""q AS (SELECT p_partkey AS query_id, p_type AS qt FROM part WHERE p_partkey % 100 = 0),
qterm AS (SELECT query_id, unnest({sqltext.doc_tokens('qt')}) AS term FROM q),
tok AS (SELECT p_partkey AS doc_id, {sqltext.doc_tokens("p_name || ' ' || p_type")} AS tokens FROM part), dl AS (SELECT doc_id, len(tokens) AS len FROM tok), st AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM dl),
post AS (SELECT doc_id, unnest(tokens) AS term FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, p.doc_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * 2.3 / (1 + 1.3 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM qterm JOIN post p USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM sc)"""


@query("skill_candidates", f"WITH {_SKILLS} SELECT query_id, doc_id, round(score, 6) AS score, rank, best < 0.8 AS needs_ranking, round(CASE WHEN best >= 0.8 THEN least(best, 0.95::DOUBLE) END, 6) AS confidence FROM r WHERE rank <= 15")
def skill_candidates(spark, d):
    """Parts as skills; the types of every hundredth as keywords."""
    p = data.table(spark, d, "part")
    index = bm25.build(p.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), T.doc_tokens(F.col("text")), stored=True)
    asked = bm25.query_terms(p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("qt")), T.doc_tokens(F.col("qt")))
    got = maintenance.skill_candidates(index, asked)
    return got.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "needs_ranking", F.round("confidence", 6).alias("confidence"))


@query("recall_cleanup", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAYS")
def recall_cleanup(spark, d):
    e = data.table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    return maintenance.clean_recalls(e, F.lit(data.AS_OF).cast("timestamp_ntz"), 14).select("event_id")


_KIND = ["transcript_tokens", "extraction_input", "extraction_output", "synthesis_input", "synthesis_output"]


@query(
    "session_budgets",
    "WITH r AS (SELECT user_id AS session, CASE WHEN event_id % 97 = 0 THEN 'reset' ELSE list_extract(["
    + ", ".join(f"'{k}'" for k in _KIND)
    + "], CAST(event_id % 5 AS INT) + 1) END AS counter, event_id % 50 AS tokens, ts, event_id % 2 = 0 AS early FROM events), e AS (SELECT session, max(CASE WHEN counter = 'reset' AND early THEN ts END) AS c1, max(CASE WHEN counter = 'reset' AND NOT early THEN ts END) AS c2 FROM r GROUP BY session), x AS (SELECT r.*, c1, c2 FROM r JOIN e USING (session)) SELECT session, CAST(sum(CASE WHEN counter = 'transcript_tokens' AND (CASE WHEN early THEN c2 IS NULL AND (c1 IS NULL OR ts > c1) ELSE c2 IS NULL OR ts > c2 END) THEN tokens ELSE 0 END) AS BIGINT) AS transcript_tokens, CAST(sum(CASE WHEN counter NOT IN ('transcript_tokens', 'reset') THEN tokens ELSE 0 END) AS BIGINT) AS total FROM x GROUP BY session",
)
def session_budgets(spark, d):
    """Half of the events are counted and flushed, the other half goes on from there."""
    kinds = F.array(*map(F.lit, _KIND))
    e = data.table(spark, d, "events")
    counter = F.when(F.col("event_id") % 97 == 0, "reset").otherwise(F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")))
    records = e.select("event_id", F.col("user_id").alias("session"), counter.alias("counter"), (F.col("event_id") % 50).alias("tokens"), F.col("ts").alias("at"))
    none = spark.createDataFrame([], "session long, " + ", ".join(f"{k} long" for k in _KIND) + ", updated_at timestamp_ntz")
    flushed = maintenance.budgets(none, records.filter("event_id % 2 = 0")).drop("total")
    return maintenance.budgets(flushed, records.filter("event_id % 2 = 1")).select("session", "transcript_tokens", "total")


@query("observation_due", "WITH x AS (SELECT conv_id, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size FROM conversations GROUP BY conv_id) SELECT conv_id, (ceil(greatest(0, size - conv_id % 4 * 100) / 3.5) >= 150 OR conv_id % 40 >= 30) AND greatest(0, size - conv_id % 4 * 100) > 200 AS due FROM x")
def observation_due(spark, d):
    x = data.table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"))
    return x.select("conv_id", maintenance.observation_due(F.col("size"), F.col("conv_id") % 4 * 100, F.col("conv_id") % 40, 150, 30).alias("due"))


@query("weak_factors", "WITH x AS (SELECT doc_id, doc_id % 10 / 10.0::DOUBLE AS a, doc_id % 7 / 7.0::DOUBLE AS b, doc_id % 3 / 3.0::DOUBLE AS c FROM documents), y AS (SELECT doc_id, unnest([struct_pack(v := a, i := 0, n := 'coverage'), struct_pack(v := b, i := 1, n := 'quality'), struct_pack(v := c, i := 2, n := 'freshness')]) AS f FROM x) SELECT x.doc_id, coalesce((SELECT string_agg(f.n, ',' ORDER BY f.v, f.i) FROM y WHERE y.doc_id = x.doc_id AND f.v < 0.5), '') AS weak FROM x")
def weak_factors(spark, d):
    i = F.col("doc_id")
    x = data.table(spark, d, "documents").select("doc_id", (i % 10 / 10.0).alias("coverage"), (i % 7 / 7.0).alias("quality"), (i % 3 / 3.0).alias("freshness"))
    return maintenance.weak_factors(x, ["coverage", "quality", "freshness"]).select("doc_id", "weak")


@query("needs_embedding", "SELECT doc_id AS id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN vec_id % 11 = 0 THEN 'dimension' WHEN vec_id % 5 = 0 THEN 'model' END AS reason FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR vec_id % 11 = 0 OR vec_id % 5 = 0")
def needs_embedding(spark, d):
    """Every eleventh vector is too short, every fifth of an old model."""
    e = data.table(spark, d, "embeddings")
    size = e.select(F.max(F.size("embedding"))).first()[0]
    vectors = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("model"))
    return maintenance.needs_embedding(data.table(spark, d, "documents").select(F.col("doc_id").alias("id")), vectors, size, "new")


@query("supersession", f"WITH {data.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) AS n FROM pr WHERE similarity >= 0.32) SELECT id_a AS new_id, count(*) AS checked, coalesce(string_agg(CASE WHEN id_b % 3 = 0 AND id_b % 10 >= 4 THEN CAST(id_b AS VARCHAR) END, ',' ORDER BY id_b), '') AS superseded, CAST(sum(CASE WHEN id_b % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS refined FROM r WHERE n <= 5 GROUP BY id_a")
def supersession(spark, d):
    """What a model would say follows from the id; the threshold fits the spread of the table's vectors."""
    b = F.col("id_b")
    relation = F.when(b % 3 == 0, "supersedes").when(b % 3 == 1, "refines").otherwise("unrelated")
    c = data.pairs(spark, d).select(F.col("id_a").alias("new_id"), b.alias("id"), "similarity", relation.alias("relation"), F.when(b % 10 >= 4, 0.95).otherwise(0.5).alias("confidence"))
    got = maintenance.superseded(c, 0.32)
    return got.select("new_id", "checked", F.array_join(F.transform("superseded", lambda x: x.cast("string")), ",").alias("superseded"), F.col("refined").cast("long").alias("refined"))


@query("memory_link_enrichment", f"WITH {data.PAIRS} SELECT id_a AS source_id, id_b AS target_id, CASE WHEN (id_a + id_b) % 3 = 0 THEN 'leads_to' ELSE 'similar_to' END AS relation FROM pr WHERE (id_a = 7 OR id_b = 7) AND (id_a + id_b) % 4 <> 0")
def memory_link_enrichment(spark, d):
    """The links of memory 7."""
    links = data.edges(spark, d).withColumn("enriched", (F.col("source_id") + F.col("target_id")) % 4 == 0)
    judged = links.select("source_id", "target_id", F.lit("leads_to").alias("relation"), F.when((F.col("source_id") + F.col("target_id")) % 3 == 0, 0.9).otherwise(0.2).alias("confidence"))
    return maintenance.enrich_memory_links(links, 7, judged)


@query("vector_blobs", "SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes, true AS same FROM embeddings")
def vector_blobs(spark, d):
    """Vectors to little-endian float32 bytes and back."""
    e = data.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    blob = e.withColumn("blob", maintenance.to_blob(F.col("embedding")))
    return blob.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (maintenance.from_blob(F.col("blob")) == F.col("embedding")).alias("same"))


@query("compact_chain", "WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn >= 3) SELECT conv_id, turn, CASE WHEN before IS NOT NULL THEN conv_id || '-' || before END AS parent FROM x")
def compact_chain(spark, d):
    """Conversations cut before turn 3, the chain of parents closed again and verified."""
    c = data.table(spark, d, "conversations")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    rows = c.select("conv_id", "turn", name(F.col("turn")).alias("uuid"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"))
    out = transcripts.compact(rows, "conv_id", "turn", F.lit(2))
    return out.join(transcripts.broken_chains(out, "conv_id").select("uuid"), "uuid", "left_anti").select("conv_id", "turn", "parent")


_GAP = r"[ \t\n\r\f\x0B]"
_RUN = "len(list_filter(range(1, len(cs) - 3), lambda i: cs[i] = cs[i + 1] AND cs[i] = cs[i + 2] AND cs[i] = cs[i + 3] AND cs[i] = cs[i + 4] AND cs[i] <> chr(10) AND cs[i] <> chr(13))) > 0"
_CLEAR = " + ".join([
    "0.5::DOUBLE", rf"CASE WHEN length(text) / greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[^ \t\n\r\f\x0B]'))), 1) BETWEEN 30 AND 150 THEN 0.15::DOUBLE ELSE 0 END",
    f"CASE WHEN {_H(r'\A[-*•]|\n[-*•]|\n[0-9]+\.')} THEN 0.1::DOUBLE ELSE 0 END", f"CASE WHEN {_H(rf'\n\n|:{_GAP}*\n')} THEN 0.05::DOUBLE ELSE 0 END", f"CASE WHEN {_H(rf'[.!?]{_GAP}*\z')} THEN 0.1::DOUBLE ELSE 0 END",
    "CASE WHEN len(regexp_extract_all(text, '[A-Z]{3,}')) > 2 THEN -0.1::DOUBLE ELSE 0 END", "CASE WHEN length(text) > 50 AND NOT contains(text, ' ') THEN -0.3::DOUBLE ELSE 0 END", f"CASE WHEN {_RUN} THEN -0.2::DOUBLE ELSE 0 END",
])


@query("quality_heuristics", f"WITH d AS (SELECT *, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, greatest(0, least(1, {_SPEC})) AS s, greatest(0, least(1, {_CLEAR})) AS c FROM d) SELECT doc_id, round(c, 6) AS clarity, round(0.3 * s + 0.3 * c + 0.1 + 0.2 * (1 - doc_id % 10 / 10.0::DOUBLE), 6) AS score FROM x")
def quality_heuristics(spark, d):
    docs = data.table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.round(T.clarity(F.col("text")), 6).alias("clarity"), F.round(T.heuristic_quality(F.col("text"), F.col("doc_id") % 10 / 10.0), 6).alias("score"))


_FLOW = """e AS (SELECT user_id AS session, event_id AS pos, CASE event_id % 8 WHEN 0 THEN 'read' WHEN 1 THEN 'grant' WHEN 2 THEN 'taint' ELSE 'write' END AS kind,
  CASE WHEN event_id % 8 = 0 THEN event_id // 8 % (user_id % 4 + 1) WHEN event_id % 8 IN (3, 4) THEN event_id // 8 % 4 END AS level,
  CASE WHEN event_id % 8 = 0 AND user_id % 2 = 0 THEN ['c' || (event_id // 8 % 3)] WHEN event_id % 8 = 3 THEN ['c0', 'c1'] ELSE [] END AS marks,
  CASE WHEN event_id % 8 IN (1, 5) THEN 'a' || (event_id // 8 % 2) END AS act, event_id % 8 = 2 AND user_id % 3 = 0 AS taints FROM events),
w AS (SELECT *, coalesce(max(CASE WHEN kind = 'read' THEN level END) OVER p, 0) AS own, list_distinct(flatten(coalesce(list(CASE WHEN kind = 'read' THEN marks ELSE [] END) OVER p, []))) AS cs, coalesce(bool_or(taints) OVER p, false) AS tainted
  FROM e WINDOW p AS (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, own = 0 AND len(cs) = 0 AS clean FROM w),
u AS (SELECT pos, lag(kind) OVER (PARTITION BY session, act ORDER BY pos) = 'grant' AS granted FROM b WHERE act IS NOT NULL AND (kind = 'grant' OR NOT clean))"""


WRITE_DECISIONS = f"WITH {_FLOW} SELECT pos AS event_id, CAST(own AS INT) AS level, array_to_string(list_sort(cs), ',') AS compartments, tainted, CASE WHEN clean OR granted THEN 'allow' WHEN level >= own AND len(list_filter(cs, lambda x: NOT list_contains(marks, x))) = 0 THEN 'allow' WHEN own = 3 OR own = 2 AND tainted THEN 'deny' WHEN own = 2 THEN 'ask' WHEN own = 1 THEN 'warn' ELSE 'allow' END AS decision FROM b LEFT JOIN u USING (pos) WHERE kind = 'write'"


def flow_events(spark, d):
    """Events as reads, grants, taints and writes of users."""
    i, u = F.col("event_id"), F.col("user_id")
    turn, none = F.floor(i / 8), F.array().cast("array<string>")
    kind = F.when(i % 8 == 0, "read").when(i % 8 == 1, "grant").when(i % 8 == 2, "taint").otherwise("write")
    level = F.when(i % 8 == 0, turn % (u % 4 + 1)).when((i % 8).isin(3, 4), turn % 4).cast("int")
    marks = F.when((i % 8 == 0) & (u % 2 == 0), F.array(F.concat(F.lit("c"), (turn % 3).cast("string")))).when(i % 8 == 3, F.array(F.lit("c0"), F.lit("c1"))).otherwise(none)
    return data.table(spark, d, "events").select(
        u.alias("session"), i.alias("at"), kind.alias("kind"), level.alias("level"), marks.alias("compartments"),
        F.when((i % 8 == 2) & (u % 3 == 0), "web").alias("taint"), F.when((i % 8).isin(1, 5), F.concat(F.lit("a"), (turn % 2).cast("string"))).alias("action"),
    )


@query("write_decisions", WRITE_DECISIONS)
def write_decisions(spark, d):
    found = flow.write_decisions(flow_events(spark, d))
    return found.select(F.col("at").alias("event_id"), "level", F.array_join("compartments", ",").alias("compartments"), "tainted", "decision")
