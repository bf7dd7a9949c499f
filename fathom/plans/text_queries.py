"""Queries on tokenizers, chunks, redaction, safety, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import safety
from fathom.functions import text as T
from fathom.operators import chunking, hooks, semantic, transcripts
from fathom.plans import data, sqltext
from fathom.plans.catalogue import query
from fathom.sources import readers


def _docs(spark, d):
    return readers.spread(data.table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _talks(spark, d):
    return readers.spread(data.table(spark, d, "conversations"))


@query("token_count", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("code_tokens", f"WITH x AS (SELECT unnest({sqltext.code_tokens('text')}) AS token FROM conversations) SELECT token, count(*) AS n FROM x GROUP BY token")
def code_tokens(spark, d):
    return _talks(spark, d).select(F.explode(T.code_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("doc_tokens_stem", f"WITH x AS (SELECT doc_id, unnest({sqltext.doc_tokens('text')}) AS token FROM documents) SELECT token, count(*) AS n FROM x GROUP BY token")
def doc_tokens_stem(spark, d):
    return _docs(spark, d).select(F.explode(T.doc_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "boosted_code_tokens",
    f"WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS sym FROM part), x AS (SELECT p_partkey, unnest({sqltext.code_tokens('p_name')}) AS token FROM p UNION ALL SELECT p_partkey, unnest({sqltext.code_tokens('p_brand')}) FROM p UNION ALL SELECT p_partkey, lower(p_brand) FROM p UNION ALL SELECT p_partkey, unnest({sqltext.code_tokens('sym')}) FROM p UNION ALL SELECT p_partkey, unnest({sqltext.code_tokens('sym')}) FROM p) SELECT token, count(*) AS n FROM x GROUP BY token",
)
def boosted_code_tokens(spark, d):
    p = data.table(spark, d, "part")
    return p.select(F.explode(T.boosted_code_tokens(F.col("p_name"), F.array("p_brand"), F.substring_index("p_name", " ", 1))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("classify_query", f"WITH x AS (SELECT conv_id, turn, text AS t FROM conversations), y AS (SELECT conv_id, turn, {sqltext.query_type('t')} AS kind FROM x) SELECT conv_id, turn, kind, CASE kind WHEN 'identifier' THEN 0.3::DOUBLE WHEN 'natural_language' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS alpha FROM y")
def classify_query(spark, d):
    kind = T.query_type(F.col("text"))
    return _talks(spark, d).select("conv_id", "turn", kind.alias("kind")).withColumn("alpha", T.query_alpha(F.col("kind")))


@query("should_decompose", f"SELECT conv_id, turn, {sqltext.decompose('text')} AS decompose FROM conversations")
def should_decompose(spark, d):
    return _talks(spark, d).select("conv_id", "turn", T.should_decompose(F.col("text")).alias("decompose"))


_REDACT = "text"
for _p, _to in (
    (r"[a-zA-Z0-9_%+\-.]{1,64}@[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"https?://[^\s\"''<>()\[\]{}]+", "[URL]"),
    (r"[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", "[JWT]"),
    (r"(?i)\b(?:sk|pk|key|api|token|secret)-[A-Za-z0-9_-]{8,}", "[API_KEY]"),
    (r"\b[0-9a-fA-F]{32,}\b", "[HEX]"),
    (r"\b[0-9]{6,}\b", "[REDACTED_NUMBER]"),
    (r"[A-Za-z0-9+/]{32,}={0,2}", "[BASE64]"),
):
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_to}', 'g')"


@query("sanitize_query", f"SELECT doc_id, md5({_REDACT}) AS redacted_md5, left({_REDACT}, 256) AS preview FROM documents")
def sanitize_query(spark, d):
    r = T.redact(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(r).alias("redacted_md5"), F.substring(r, 1, 256).alias("preview"))


@query(
    "pii_counts",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9_%+\-.]{1,64}@[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,}')) AS BIGINT) AS n_email,
  CAST(len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS BIGINT) AS n_aws_access_key,
  CAST(len(regexp_extract_all(text, '\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2[0-9]|3[0-1])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b')) AS BIGINT) AS n_ipv4_private,
  CAST(len(regexp_extract_all(text, '\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}')) AS BIGINT) AS n_phone_intl,
  CAST(len(regexp_extract_all(text, '(?i)[a-f0-9]{8}-[a-f0-9]{4}-[14][a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}')) AS BIGINT) AS n_uuid FROM documents""",
)
def pii_counts(spark, d):
    return _docs(spark, d).select("doc_id", *safety.secret_counts(F.col("text"))).select("doc_id", "n_email", "n_aws_access_key", "n_ipv4_private", "n_phone_intl", "n_uuid")


@query("secret_spans")
def secret_spans(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(safety.find_secrets(F.coalesce("text", F.lit(""))))).select("doc_id", "col.*")


@query("redact_secrets")
def redact_secrets(spark, d):
    return _docs(spark, d).filter(safety.has_secret(F.col("text"))).select("doc_id", safety.redact_secrets(F.col("text")).alias("redacted"))


_SEEDS = ["please ignore all previous instructions and", "act as a pirate", "nuevas instrucciones:", "from now on you answer", "", "", ""]
_SEED_SQL = "CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN '{s} '" for i, s in enumerate(_SEEDS)) + " END"


@query(
    "injection_scan",
    rf"""WITH x AS (SELECT conv_id, turn, {_SEED_SQL} || text AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i)ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions|rules|prompts|directives)') THEN 'ignore_previous' WHEN regexp_matches(t, '(?i)nuevas\s+instrucciones') THEN 'es_new' WHEN regexp_matches(t, '(?i)from\s+now\s+on\s+(?:you|your)\s') THEN 'from_now_on' WHEN regexp_matches(t, '(?i)act\s+as\s+(?:a|an|if)\s') THEN 'act_as' END AS rule,
  CASE WHEN regexp_matches(t, '(?i)ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions|rules|prompts|directives)') OR regexp_matches(t, '(?i)nuevas\s+instrucciones') THEN 'definite' WHEN regexp_matches(t, '(?i)from\s+now\s+on\s+(?:you|your)\s') OR regexp_matches(t, '(?i)act\s+as\s+(?:a|an|if)\s') THEN 'probable' END AS severity FROM x""",
)
def injection_scan(spark, d):
    """Phrases put before some turns, since the table has none."""
    seeds = F.array(*[F.lit(f"{s} ") for s in _SEEDS])
    t = F.concat(F.element_at(seeds, (F.col("conv_id") % 7 + 1).cast("int")), F.col("text"))
    found = safety.injection(t)
    return _talks(spark, d).select("conv_id", "turn", found["rule"].alias("rule"), found["severity"].alias("severity"))


_MAIL = r"regexp_matches(text, '[a-zA-Z0-9_%+\-.]{1,64}@[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,}')"


@query("security_label", rf"SELECT doc_id, CASE WHEN {_MAIL} THEN 2 ELSE 0 END AS mail_level, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS path_level, CASE doc_id % 3 WHEN 0 THEN 'secrets' WHEN 1 THEN 'internal_infra' ELSE '' END AS path_marks FROM documents")
def security_label(spark, d):
    folders = F.array(F.lit("app/secrets/key.txt"), F.lit("deploy/main.tf"), F.lit("src/a.py"))
    p = safety.path_label(F.element_at(folders, (F.col("doc_id") % 3 + 1).cast("int")))
    c = safety.content_label(F.col("text"))
    return _docs(spark, d).select("doc_id", F.when(F.array_contains(c["compartments"], "pii"), 2).otherwise(0).alias("mail_level"), p["level"].alias("path_level"), F.array_join(p["compartments"], ",").alias("path_marks"))


@query(
    "label_lattice",
    """WITH l AS (SELECT doc_id, doc_id % 4 AS level, list_sort(list_distinct([lang, source])) AS c FROM documents), p AS (SELECT a.doc_id, a.level AS la, b.level AS lb, a.c AS ca, b.c AS cb FROM l a JOIN l b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CAST(greatest(la, lb) AS INT) AS level, array_to_string(list_sort(list_distinct(list_concat(ca, cb))), ',') AS compartments, la >= lb AND len(list_filter(cb, lambda x: NOT list_contains(ca, x))) = 0 AS dominates FROM p""",
)
def label_lattice(spark, d):
    a = _docs(spark, d).select("doc_id", safety.label(F.col("doc_id") % 4, F.array("lang", "source")).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    j = safety.label_join(F.col("a"), F.col("b"))
    return a.join(b, "doc_id").select("doc_id", j["level"].alias("level"), F.array_join(j["compartments"], ",").alias("compartments"), safety.label_dominates(F.col("a"), F.col("b")).alias("dominates"))


_H = lambda p: sqltext.has("text", p)
_SPEC = " + ".join(
    ["0.5::DOUBLE"]
    + [
        f"CASE WHEN {test} THEN {points}::DOUBLE ELSE 0 END"
        for test, points in (
            (_H(r"\d"), 0.1), (_H(r"`[^`]+`|```[\s\S]*?```"), 0.2), (_H(rf"\.({T.EXTENSIONS})\b"), 0.15), (_H(r":\d"), 0.1), (_H(rf"(?i)\b(?:{T.TECHNICAL})\b"), 0.1),
            (f"({_H('[A-Z][a-z]+(?:[A-Z][a-z]+)+')} OR {_H('[a-z]+_[a-z]+')})", 0.05), (_H(rf"(?i)\b(?:{T.ACTIONS})\b"), 0.1),
            (_H(r"(?i)\b(user|i|he|she|they|we)\s+(use[sd]?|like[sd]?|prefer[sd]?|has|have|had|want[sd]?|chose|always|never|switch)"), 0.2),
            (_H(rf"(?i)\b(?:{T.VAGUE})\b"), -0.2), (f"{_H(rf'(?i)\b(?:{T.PRAISE})\b')} AND NOT {_H(rf'(?i)\b(?:{T.NOT_PRAISE})\b')}", -0.15),
            (sqltext.has("trim(text)", r"(?i)^(the )?(code|it|this|that)?\s*(is|are|was|were)?\s*(good|nice|great|fine|ok|cool|awesome|works|working)"), -0.25),
        )
    ]
)
_PREF = _H(r"(?i)\b(user|i|he|she|they|we)\s+(use[sd]?|like[sd]?|prefer[sd]?|has|have|had|want[sd]?|chose|always|never|switch)")
_N = sqltext.words("text")
_SPEC += f" + CASE WHEN length(text) < 15 OR {_N} < 3 THEN CASE WHEN {_PREF} THEN -0.15::DOUBLE ELSE -0.35::DOUBLE END WHEN length(text) < 30 OR {_N} < 5 THEN CASE WHEN {_PREF} THEN -0.05::DOUBLE ELSE -0.2::DOUBLE END ELSE 0 END"
_SPEC += f" + CASE WHEN {_N} < 8 AND NOT {_H(r'`[^`]+`|```[\s\S]*?```')} AND NOT {_H(rf'\.({T.EXTENSIONS})\b')} AND NOT {_H(r'\d')} AND NOT {_PREF} THEN -0.15::DOUBLE ELSE 0 END"


@query("quality_score", f"SELECT doc_id, round(greatest(0, least(1, {_SPEC})), 6) AS specificity FROM documents")
def quality_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.specificity(F.col("text")), 6).alias("specificity"))


@query("summary_level", r"SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[a-z][A-Z]') OR regexp_matches(p_name, '[a-zA-Z]{2,}_[a-zA-Z]{2,}') THEN 'file' WHEN regexp_matches(lower(p_name), 'directory|folder|namespace|dir ') THEN 'directory' WHEN regexp_matches(lower(p_name), 'module|subsystem|component|layer|package') THEN 'module' WHEN regexp_matches(lower(p_name), 'project|codebase|repository|overview|architecture|describe this|what does this do') THEN 'repo' ELSE 'directory' END AS level FROM part")
def summary_level(spark, d):
    return data.table(spark, d, "part").select("p_partkey", T.summary_level(F.col("p_name")).alias("level"))


@query("bridge_relation", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(?:bug|error|fix|crash|exception|traceback|stack\s*trace|regression|broken|failed|failure)\b') OR doc_id % 5 = 0 THEN 'bug_in' WHEN regexp_matches(text, '(?i)\b(?:tests?|specs?|coverage|assertions?|mocks?|stubs?|fixtures?|jest|vitest|pytest|mocha)\b') OR doc_id % 5 = 1 THEN 'test_covers' WHEN regexp_matches(text, '(?i)\b(?:pattern|architecture|design|approach|strategy|convention|principle)\b') OR doc_id % 5 = 2 THEN 'motivates' ELSE 'documents' END AS relation FROM documents")
def bridge_relation(spark, d):
    tags = F.array(F.element_at(F.array(*map(F.lit, ("bug", "testing", "decision", "x", "y"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return _docs(spark, d).select("doc_id", T.bridge_relation(F.col("text"), tags).alias("relation"))


@query("normal_source", "SELECT url, CASE WHEN contains(list_last(string_split(url, '/')), '.') THEN regexp_replace(trim(url), '/[^/]*$', '') ELSE trim(url) END AS folder FROM pages")
def normal_source(spark, d):
    return data.table(spark, d, "pages").select("url", T.normal_source(F.col("url")).alias("folder"))


@query("escape_xml", "SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped_md5 FROM pages")
def escape_xml(spark, d):
    return data.table(spark, d, "pages").select("page_id", F.md5(T.escape_xml(F.col("html"))).alias("escaped_md5"))


@query("html_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(spark, d):
    return data.table(spark, d, "pages").select("page_id", F.md5(readers.html_text(F.col("html"))).alias("text_md5"))


@query("path_glob", r"SELECT url FROM pages WHERE regexp_matches(url, '^https?:/(?:.*/)?en/[^/]*$') AND NOT contains(url, '#')")
def path_glob(spark, d):
    """A glob on the URL's path, and an excluded one."""
    return data.table(spark, d, "pages").filter(F.col("url").rlike(T.glob_to_regex("http*:/**/en/*")) & ~F.col("url").contains("#")).select("url")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return data.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_CHUNKS = """WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS ws FROM documents WHERE text <> ''),
r(doc_id, i, a, used, cut_from) AS (SELECT doc_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(ws[1] AS BIGINT), CAST(NULL AS BIGINT) FROM t UNION ALL
  SELECT doc_id, i + 1, CASE WHEN over THEN i - back + 1 ELSE a END, CAST((CASE WHEN over THEN list_sum(ws[i - back + 1:i]) ELSE used END) + ws[i + 1] AS BIGINT), CASE WHEN over THEN a END
  FROM (SELECT *, coalesce(list_min(list_filter(range(1, i - a + 2), lambda b: list_sum(ws[i - b + 1:i]) >= 50)), i - a + 1) AS back, used + ws[i + 1] > 500 AS over FROM r JOIN t USING (doc_id) WHERE i < len(ws))),
c AS (SELECT doc_id, cut_from AS a, i - 1 AS b FROM r WHERE cut_from IS NOT NULL UNION ALL SELECT doc_id, a, i FROM r JOIN t USING (doc_id) WHERE i = len(ws))
SELECT doc_id, array_to_string(ls[a:b], chr(10)) AS content, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM c JOIN t USING (doc_id)"""


@query("chunk_text", _CHUNKS)
def chunk_text(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(chunking.text_chunks(F.col("text")))).select("doc_id", "col.*")


@query("code_chunks")
def code_chunks(spark, d):
    code = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("():\n    return '"), F.regexp_replace(F.regexp_replace("text", "[^a-zA-Z \n]", ""), "\n", "\n    "), F.lit("'\n\nclass C:\n    value = 'a class with a body that is long enough'\n"))
    return _docs(spark, d).select("doc_id", F.explode(chunking.code_chunks(code, F.lit("py")))).select("doc_id", "col.*")


@query("structural_search", "SELECT doc_id, 1 AS start_line, 'f' || doc_id AS name FROM documents WHERE text IS NOT NULL")
def structural_search(spark, d):
    """A pattern with metavariables over code made of the texts."""
    code = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("( a,\n b ) :\n    return '"), F.regexp_replace("text", "[^a-zA-Z \n]", ""), F.lit("'\n"))
    found = chunking.structural_matches(code, "def $NAME($$$ARGS):")
    return _docs(spark, d).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.start_line", F.col("m.names")["NAME"].alias("name"))


@query("injection_semantic")
def injection_semantic(spark, d):
    """Turns like injection_scan's; no phrase list or embedding has an SQL form here."""
    seeds = F.array(*[F.lit(f"{s} ") for s in _SEEDS])
    t = F.concat(F.element_at(seeds, (F.col("conv_id") % 7 + 1).cast("int")), F.col("text"))
    rows = _talks(spark, d).select(F.struct("conv_id", "turn").alias("id"), t.alias("text"))
    return semantic.semantic_injection(rows).select("id.conv_id", "id.turn", F.round("similarity", 6).alias("similarity"), "severity")


@query("segment_flatcase")
def segment_flatcase(spark, d):
    """Words of eight letters or more, split by the frequencies of the shorter ones."""
    tokens = _docs(spark, d).select(F.explode(T.doc_tokens(F.col("text"))).alias("w")).filter("w rlike '^[a-z]+$'")
    counts = tokens.filter("length(w) between 3 and 6").groupBy("w").count()
    return chunking.segmented_by(tokens.filter("length(w) >= 8").distinct(), counts, 6).select("w", F.array_join("pieces", " ").alias("pieces"))


@query("bpe_train")
def bpe_train(spark, d):
    words = _docs(spark, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    merges = chunking.bpe_train(words, 12)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query("session_breakdown", "SELECT role, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(sum(length(text)) / 3.5) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def session_breakdown(spark, d):
    block = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "id", "tool_use_id", "content", "thinking")])
    return transcripts.breakdown(_talks(spark, d).select("role", F.array(block).alias("blocks")), ["role"]).select("role", F.col("n_blocks").alias("n_turns"), "chars", "tokens")


@query("cut_points", "WITH x AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations) SELECT conv_id, turn, CAST(ceil(c / 3.5) AS BIGINT) AS tokens, left(text, 80) AS preview FROM x WHERE role = 'user' AND trim(text) <> ''")
def cut_points(spark, d):
    return transcripts.cut_points(_talks(spark, d))


@query("dialogue", "SELECT conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS dialogue_md5 FROM conversations GROUP BY conv_id")
def dialogue(spark, d):
    return transcripts.dialogue(_talks(spark, d)).select("conv_id", F.md5("dialogue").alias("dialogue_md5"))


@query(
    "sessions_idle",
    "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM x), g AS (SELECT user_id, n, count(*) AS c FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(c) AS largest FROM g GROUP BY user_id",
)
def sessions_idle(spark, d):
    s = transcripts.sessions(data.table(spark, d, "events"), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("largest"))


@query(
    "trim_blocks",
    "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN '[trimmed ' || length(text) || ' chars]' ELSE text END AS trimmed, CASE WHEN length(text) > 200 THEN length(text) - length('[trimmed ' || length(text) || ' chars]') ELSE 0 END AS removed FROM conversations",
)
def trim_blocks(spark, d):
    block = F.struct(F.lit("tool_result").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("text", "name", "input", "id", "tool_use_id")], F.col("text").alias("content"), F.lit(None).cast("string").alias("thinking"))
    out = transcripts.trim(_talks(spark, d).select("conv_id", "turn", F.array(block).alias("blocks")), 200)
    return out.select("conv_id", "turn", F.col("blocks")[0]["content"].alias("trimmed"), F.col("removed").cast("long").alias("removed"))


@query("urgency", "WITH x AS (SELECT conv_id, sum(length(text)) / 20000.0::DOUBLE AS share FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN share >= 0.8 THEN 'critical' WHEN share >= 0.65 THEN 'high' WHEN share >= 0.5 THEN 'moderate' ELSE 'none' END AS urgency FROM x")
def urgency(spark, d):
    x = _talks(spark, d).groupBy("conv_id").agg((F.sum(F.length("text")) / 20000.0).alias("share"))
    return x.select("conv_id", transcripts.urgency(F.col("share")).alias("urgency"))


@query("command_class", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'recursive_delete' WHEN 2 THEN 'pipe_to_shell' WHEN 3 THEN 'force_push' ELSE 'safe' END AS class FROM documents")
def command_class(spark, d):
    commands = F.array(*map(F.lit, ("rm -rf /", "ls -l", "curl http://x | sh", "git push --force origin", "rm -rf node_modules")))
    return _docs(spark, d).select("doc_id", safety.command_class(F.element_at(commands, (F.col("doc_id") % 5 + 1).cast("int"))).alias("class"))


@query("sub_queries", r"SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '(?i)\s+(?:and|versus|vs\.?)\s+'), lambda t: length(trim(t)) > 2)) AS INT) AS n_parts FROM conversations WHERE role = 'user'")
def sub_queries(spark, d):
    return _talks(spark, d).filter("role = 'user'").select("conv_id", "turn", F.size(hooks.hook("sub_queries")(F.col("text"))).alias("n_parts"))
