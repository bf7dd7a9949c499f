"""Memories as a knowledge base: invariants, rules, facts, code references, saving with gates, communities, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import safety
from fathom.functions import scoring as S
from fathom.functions import text as T
from fathom.operators import dedup, graph, hooks

# Phrases that state an invariant, by language.
INVARIANTS = [
    T.LEFT + r"(?:always|never|must|shall)\s+\w", T.LEFT + r"(?:must not|shall not|do not|don't)\s+\w", T.word("required|mandatory|forbidden|prohibited"), T.LEFT + r"(?:critical|important)\s*:",
    T.word("never") + ".*" + T.word("without"), T.word("always") + ".*" + T.word("before"),
    r"(?:всегда|никогда|обязательно|запрещено|нельзя|недопустимо)\s+\S", r"(?:нельзя|запрещено|недопустимо)(?:\s|$)", r"(?:должен|должна|должно|должны)\s+\S", "(?:ни в коем случае|ни при каких|строго запрещ)", r"(?:критично|важно)\s*:",
    T.LEFT + r"(?:immer|niemals|nie)\s+\w", T.word("muss|müssen|verboten|pflicht"), T.LEFT + r"(?:toujours|jamais)\s+\w", T.word("obligatoire|interdit|défendu"), T.LEFT + r"(?:siempre|nunca|jamás)\s+\w", T.word("obligatorio|prohibido|requerido"),
    "必须|绝不|永远不|禁止|始终|一定要|不得|不允许|不可以", "必ず|絶対に|禁止|してはいけない|しなければならない|常に", "반드시|절대로|금지|항상|해서는 안",
]


def states_invariant(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.coalesce(flat.rlike("|".join(f"(?:{p})" for p in INVARIANTS)), F.lit(False))


# A path in a text with an optional line, and the extensions of code.
CODE_PATH = r"(?m)(?:^|[\s`\"'(,])((?:\.{0,2}/)?(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+\.[a-zA-Z0-9]+)(?::\d+)?"
CODE = r"\.(ts|tsx|js|jsx|py|go|rs|rb|java|kt|cs|cpp|c|h|hpp|vue|svelte|php|swift|scala|sh|bash|zsh|yaml|yml|json|toml|sql|graphql|proto|md)$"


def code_paths(text: Column) -> Column:
    """Distinct paths of code files that a text names, without a leading ./"""
    found = F.transform(F.regexp_extract_all(text, F.lit(CODE_PATH), F.lit(1)), lambda p: F.regexp_replace(p, r"^\./", ""))
    return F.array_distinct(F.filter(found, lambda p: p.rlike(CODE)))


def bridge_edges(memories: DataFrame) -> DataFrame:
    """memory_id, path, relation for the code that memories (id, content, tags) name."""
    rows = memories.select("id", F.explode(code_paths(F.col("content"))).alias("path"), T.bridge_relation(F.col("content"), F.col("tags")).alias("relation"))
    return rows.select(F.col("id").alias("memory_id"), "path", "relation")


def temporal_parts(text: Column) -> Column:
    """The two parts of a question between two times; otherwise the question."""
    # The forms such a question has.
    forms = [
        r"(?iu)(?:between|между)\s+(.+?)\s+(?:and|и)\s+(.+?)(?:\?|$)",
        r"(?iu)(?:from|от|с)\s+(.+?)\s+(?:to|до|по)\s+(.+?)(?:\?|$)",
        r"(?iu)(?:after|since|после|с тех пор как)\s+(.+?)\s+(?:and|but|и|но)?\s*(?:before|until|до|перед)\s+(.+?)(?:\?|$)",
        r"(?iu)(?:first\s+(?:time\s+)?|впервые\s+|в первый раз\s+)(.+?)\s+(?:and|,|и)\s*(?:last\s+(?:time\s+)?|в последний раз\s+|последний раз\s+)(.+?)(?:\?|$)",
    ]
    out = F.array(text)
    for p in reversed(forms):
        out = F.when(text.rlike(p), F.array(F.trim(F.regexp_extract(text, p, 1)), F.trim(F.regexp_extract(text, p, 2)))).otherwise(out)
    return out


def ago(text: str, now: Column) -> Column | None:
    """A number of days, weeks, months of 30 or years of 365 days back from now, or an ISO date; None if it is neither."""
    import re

    if m := re.fullmatch(r"(?i)(\d+)([dwmy])", text):
        return now - F.make_dt_interval(F.lit(int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2].lower()]))
    return F.lit(text).cast("timestamp") if re.match(r"\d{4}-\d{2}-\d{2}", text) else None


def match_rules(rules: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, id, action: rules (id, type, tags) that hold for tool calls (call_id, tool, target). tool: tags must name the tool, any match: pattern of up to 200 characters must hold.
    Rules are few and kept by people; they go to the calls as an array if they are below the size that Spark broadcasts, by its own choice."""
    with_tag = lambda p: F.transform(F.filter("tags", lambda t: t.startswith(p)), lambda t: F.substring(t, F.lit(len(p) + 1), F.length(t)))
    r = rules.select("id", "type", with_tag("tool:").alias("tools"), F.filter(with_tag("match:"), lambda p: F.length(p) <= 200).alias("patterns"), (F.size(with_tag("match:")) > 0).alias("matches"))
    named = (F.size("tools") == 0) | F.exists("tools", lambda t: F.lower(t) == F.lower("tool"))
    holds = ~F.col("matches") | F.exists("patterns", lambda p: F.regexp_like(F.lower("target"), F.lower(p)))
    action = F.when(F.col("type") == "dead_end", "deny").when(F.col("type") == "decision", "ask").otherwise("inject")
    order = F.when(F.col("type") == "dead_end", 0).when(F.col("type") == "decision", 1).otherwise(2)
    return calls.join(r, named & holds).select("call_id", "id", action.alias("action"), order.alias("rank"))


FACT = "array<struct<content:string,type:string,confidence:double,tags:array<string>,files:array<string>>>"


def parse_facts(response: Column) -> Column:
    """Facts of a model's answer: its JSON array, contents of 50 characters or more, known types, confidence in 0..1 (0.7 if none)."""
    known = F.from_json(F.regexp_extract(response, r"(?s)(\[.*\])", 1), FACT)
    good = F.filter(known, lambda f: (F.length(f["content"]) >= 50) & f["type"].isin(*S.TYPE_WEIGHTS))
    none = F.array().cast("array<string>")
    return F.transform(good, lambda f: F.struct(F.trim(f["content"]).alias("content"), f["type"].alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f["confidence"], F.lit(0.7)))).alias("confidence"), F.coalesce(f["tags"], none).alias("tags")))


def gate(items: DataFrame, least: float = 0.3) -> DataFrame:
    """items with a verdict: secrets are refused, then poor quality; the rest may be saved."""
    c = F.col("content")
    return items.withColumn("verdict", F.when(safety.has_secret(c), "sensitive").when(T.specificity(c) < least, "low_quality").otherwise("save"))


def save_decisions(nearest: DataFrame, correct: float = 0.82, duplicate: float = 0.92, version: float = 0.85) -> DataFrame:
    """Of new rows and their nearest existing row (id, other_id, similarity, content, other_content, other_version, other_root): duplicate (nothing is saved), else saved, with what becomes of the other row."""
    s = F.col("similarity")
    kind = hooks.hook("relation")(F.col("content"), F.col("other_content"))
    banded = (s >= version) & (s < duplicate)
    return nearest.select(
        "id", "other_id", F.when(s >= duplicate, "duplicate").otherwise("saved").alias("result"), ((s >= correct) & (s < duplicate)).alias("corrects"),
        F.when(banded, kind).alias("relation"), F.when(banded, F.coalesce("other_version", F.lit(1)) + 1).otherwise(1).alias("version"),
        F.when(banded, F.coalesce("other_root", "other_id")).alias("root_id"), (banded & (kind == "updates")).alias("retires_other"), states_invariant(F.col("content")).alias("is_invariant"),
    )


def community_summaries(memories: DataFrame, communities: DataFrame, least: int = 3, members: int = 15) -> DataFrame:
    """community, size, summary of communities (id, community) with enough members, from their first members."""
    w = Window.partitionBy("community").orderBy("id")
    rows = memories.select("id", "content").join(communities, "id").withColumn("n", F.row_number().over(w))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    first = rows.filter(F.col("n") <= members).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]).alias("texts"))
    return sizes.join(first, "community").select("community", "size", hooks.hook("summary")(F.col("texts")).alias("summary"))


def cleanup(vertices: DataFrame, links: DataFrame, pairs: DataFrame, weak: float = 0.75, orphan: float = 0.6, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Links without weak similar_to ones that nobody enriched, and with the nearest of rows that are left alone; and the counts of both."""
    poor = (F.col("relation") == "similar_to") & (F.col("weight") < weak) & ~F.coalesce(F.col("llm_enriched"), F.lit(False))
    kept = links.filter(~poor)
    alone = graph.isolated(vertices, kept)
    near = dedup.auto_links(pairs, most, orphan).join(alone, F.col("source_id") == F.col("id"), "left_semi")
    added = near.select("source_id", "target_id", F.lit("similar_to").alias("relation"), "weight", F.lit(False).alias("llm_enriched"))
    counts = links.filter(poor).agg(F.count(F.lit(1)).alias("pruned")).crossJoin(added.agg(F.count(F.lit(1)).alias("connected")))
    return kept.unionByName(added), counts


def enrich_judged(links: DataFrame, relation: Column, confidence: Column, judged: Column) -> DataFrame:
    """Links judged where they stand, without a join: similar_to links that aren't enriched and are judged; confidence above 0 sets relation (unknown ones: related) and weight;
    every judged link is marked."""
    open_ = (F.col("relation") == "similar_to") & ~F.coalesce(F.col("llm_enriched"), F.lit(False)) & judged
    sure = open_ & (confidence > 0)
    known = F.when(graph.known_relation(relation), relation).otherwise("related")
    return links.withColumns({"weight": F.when(sure, confidence).otherwise(F.col("weight")), "llm_enriched": F.coalesce("llm_enriched", F.lit(False)) | open_, "relation": F.when(sure, known).otherwise(F.col("relation"))})


def enrich_links(links: DataFrame, judged: DataFrame) -> DataFrame:
    """judged (source_id, target_id, relation, confidence) from elsewhere, for similar_to links that aren't enriched: see enrich_judged."""
    j = judged.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), F.col("relation").alias("r"), "confidence")
    x = links.join(j, (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")), "left")
    return enrich_judged(x, F.col("r"), F.col("confidence"), F.col("s").isNotNull()).drop("s", "t", "r", "confidence")


def retention_run(memories: DataFrame, mode: str = "dry-run") -> DataFrame:
    """memories with tier: apply drops the delete tier, auto-cleanup invalidates it with superseder 0, dry-run only tells. Pinned rows stay."""
    pinned = F.coalesce("is_invariant", F.lit(False)) | (F.coalesce("correction_count", F.lit(0)) >= 2)
    score = S.effective_score_decayed(F.col("quality_score"), F.coalesce("idle_hours", "age_hours"), F.col("access_count"))
    rows = memories.withColumn("tier", F.when(pinned, "keep").otherwise(S.tier(score)))
    if mode == "apply":
        return rows.filter("tier <> 'delete'")
    return rows.withColumn("invalidated_by", F.when((F.col("tier") == "delete") & F.lit(mode == "auto-cleanup"), F.lit(0).cast("long")))


def auto_consolidate(memories: DataFrame, pairs: DataFrame, threshold: float = 0.85, promote: int = 5) -> DataFrame:
    """id, action, survivor for automatic memories: merged into the survivor of their group (most accesses, then least id), promoted where much used, else kept."""
    near = pairs.filter(F.col("similarity") >= threshold).select(F.col("id_a").alias("source_id"), F.col("id_b").alias("target_id"))
    groups = graph.components(near).select(F.col("node").alias("id"), F.col("component").alias("group"))
    best = dedup.survivors(groups.join(memories.select("id", "access_count"), "id"))
    x = memories.join(groups, "id", "left").join(best, "group", "left")
    merged = F.col("survivor").isNotNull() & (F.col("survivor") != F.col("id"))
    return x.select("id", F.when(merged, "merge").when(F.col("access_count") >= promote, "promote").otherwise("keep").alias("action"), F.when(merged, F.col("survivor")).alias("survivor"))


def extraction_decisions(facts: DataFrame, candidates: DataFrame, threshold: float = 0.75, most: int = 5) -> DataFrame:
    """fact_id, decision: ADD without a candidate at the threshold; else NONE, UPDATE or ADD by the relation hook to the nearest. candidates: fact_id, id, similarity, content."""
    w = Window.partitionBy("fact_id").orderBy(F.desc("similarity"), "id")
    near = candidates.filter(F.col("similarity") >= threshold).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    first = near.filter("n = 1").select("fact_id", F.col("id").alias("target"), F.col("content").alias("other"))
    kind = hooks.hook("relation")(F.col("content"), F.col("other"))
    x = facts.join(first, "fact_id", "left")
    return x.select("fact_id", F.when(F.col("target").isNull(), "ADD").when(kind == "updates", "NONE").when(kind == "extends", "UPDATE").otherwise("ADD").alias("decision"), "target")


def repo_map(symbols: DataFrame, glob: str | None = None, most: int = 5) -> DataFrame:
    """path, symbols: of each file its first definitions, those of exported kinds before others. symbols: path, name, kind, line, uses."""
    if glob:
        symbols = symbols.filter(F.col("path").rlike(T.glob_to_regex(glob)))
    w = Window.partitionBy("path").orderBy(F.desc("uses"), "line", "name")
    top = symbols.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return top.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("symbols"))


def stars(score: Column) -> Column:
    return F.when(score >= 90, 5).when(score >= 75, 4).when(score >= 50, 3).when(score >= 25, 2).otherwise(1)


# Points by least share, number or mean, best first.
MEMORY_POINTS = ((100, 20), (51, 15), (11, 10), (1, 5))
CODE_POINTS = ((76, 15), (51, 11), (26, 7), (1, 4))
DOC_POINTS = ((80, 10), (50, 7), (20, 4), (1, 2))
AGENT_POINTS = ((10, 5), (7, 3), (4, 2), (1, 1))
QUALITY_POINTS = ((0.85, 5), (0.7, 4), (0.5, 3), (0.3, 2))
FRESH_POINTS = ((100, 5), (90, 4), (70, 3), (50, 2))


def _points(value: Column, bands: tuple, below: int = 0) -> Column:
    out = F.lit(below)
    for least, points in reversed(bands):
        out = F.when(value >= least, points).otherwise(out)
    return out


def readiness_score(projects: DataFrame) -> DataFrame:
    """project, the points of nine metrics, their sum (100 at most) and stars. projects: project; memories, avg_quality (null if none is scored); source_files, indexed_code;
    has_vault, doc_files, indexed_docs; has_instructions; statement (0 none, 1 a template, 2 one's own); hooks (kinds of the five that stand), agents; indexed_files, outdated (stale
    or deleted). Null numbers are 0. Without source files, documents or indexed files there is nothing to do, which has full points; documents count only in a vault."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda part, whole: F.round(100.0 * part / F.when(whole > 0, whole))
    vault = F.coalesce("has_vault", F.lit(False))
    metrics = {
        "vault": F.when(F.coalesce("has_instructions", F.lit(False)), 10).otherwise(0) + F.when(vault & (n("doc_files") >= 5), 10).when(vault, 5).otherwise(0),
        "memories": _points(n("memories"), MEMORY_POINTS),
        "code": F.when(n("source_files") == 0, 15).otherwise(_points(share(n("indexed_code"), n("source_files")), CODE_POINTS)),
        "statement": 5 * F.least(n("statement"), F.lit(2)),
        "hooks": 2 * F.least(n("hooks"), F.lit(5)),
        "agents": _points(n("agents"), AGENT_POINTS),
        "documents": F.when(~vault, 0).when(n("doc_files") == 0, 10).otherwise(_points(share(n("indexed_docs"), n("doc_files")), DOC_POINTS)),
        "quality": F.when(F.coalesce("avg_quality", F.lit(0.0)) == 0, 0).otherwise(_points(F.col("avg_quality"), QUALITY_POINTS, 1)),
        "freshness": F.when(n("indexed_files") == 0, 5).otherwise(_points(share(n("indexed_files") - n("outdated"), n("indexed_files")), FRESH_POINTS, 1)),
    }
    got = projects.select("project", *[x.cast("int").alias(f"{name}_points") for name, x in metrics.items()])
    return got.withColumn("score", sum((F.col(f"{name}_points") for name in metrics), F.lit(0))).withColumn("stars", stars(F.col("score")))


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """problem, id, other for tasks (id, depends_on, files): missing dependencies, tasks in or behind a cycle, and files that independent tasks both change."""
    needs = tasks.select("id", F.explode("depends_on").alias("other"))
    missing = needs.join(tasks.select(F.col("id").alias("other")), "other", "left_anti").select(F.lit("missing").alias("problem"), "id", "other")
    stuck = tasks.select("id").join(graph.topological_levels(tasks), "id", "left_anti").join(missing.select("id"), "id", "left_anti").select(F.lit("cycle").alias("problem"), "id", F.lit(None).cast("string").alias("other"))
    at = tasks.select("id", F.explode("files").alias("file"))
    both = at.join(at.select(F.col("id").alias("other"), "file"), "file").filter("id < other").select("id", "other").distinct()
    direct = needs.unionByName(needs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    return missing.unionByName(stuck).unionByName(both.join(direct, ["id", "other"], "left_anti").select(F.lit("overlap").alias("problem"), "id", "other"))


def topics(text: Column, most: int = 5) -> Column:
    """Up to three paths and three identifiers that a text names, distinct, `most` at most."""
    names = F.regexp_extract_all(text, F.lit(r"(\b[a-z]+[A-Z]\w*\b|\b[A-Z][a-z]+[A-Z]\w*\b|\b[a-z]+_\w+\b)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(F.slice(code_paths(text), 1, 3), F.slice(F.array_distinct(names), 1, 3))), 1, most)


# Context sizes by the mark in a model's name.
def context_limit(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("[1m]") | m.contains("-1m"), 1_000_000).when(m.contains("[200k]") | m.contains("-200k"), 200_000)


def digest(memories: DataFrame, most: int = 50, least: float = 0.4) -> DataFrame:
    """The best entries for a report: types that teach, quality at least `least`, `most` in all, grouped by type."""
    good = memories.filter(F.col("type").isin("dead_end", "decision", "pattern", "learning") & (F.col("quality_score") >= least))
    return good.orderBy(F.desc("quality_score"), "id").limit(most).select("type", "id", "quality_score")


def audit_history(audit: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    """Events of a project's memories, newest first."""
    return audit.join(memories.filter(F.col("project") == project).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id"))


def search_history(rows: DataFrame, tool: str | None = None, text: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Web searches by what is given, newest first."""
    for test in (tool and (F.col("tool_name") == tool), text and F.contains(F.lower("query"), F.lit(text.lower())), None if start is None else F.col("created_at") >= start, None if end is None else F.col("created_at") <= end):
        rows = rows if test is None else rows.filter(test)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def skills_like(skills: DataFrame, text: str, project: str | None, now: Column) -> DataFrame:
    """Skills whose name or description has the text, of the project or of none, not expired; most used first."""
    p = f"%{text}%"
    mine = F.col("project_id").isNull() | (F.lit(project).isNotNull() & (F.col("project_id") == F.lit(project)))
    fresh = F.col("cache_expires").isNull() | (F.col("cache_expires") > now)
    return skills.filter((F.col("name").like(p) | F.col("description").like(p)) & mine & fresh).orderBy(F.desc("usage_count"), "name")


def rerun_rules(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Analyses (rule, pattern) whose pattern a changed path matches."""
    return changed.join(rules, F.regexp_like(F.col("path"), F.col("pattern"))).select("rule").distinct()
