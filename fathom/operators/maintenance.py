"""Upkeep of a store: undone consolidations, merged link metadata, dead ends, skills, clean-up, budgets, observation, migration, supersession, vector blobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import bm25, hooks

#: Source of a row that a model has merged from others.
MERGED = "consolidation-llm"


class Undone(NamedTuple):
    memories: DataFrame
    links: DataFrame
    report: DataFrame


def undo_consolidation(memories: DataFrame, links: DataFrame, merged: DataFrame) -> Undone:
    """Takes consolidations back. merged: the ids (id) that superseded others. Rows they supersede are valid again, their supersedes links go, and a merged row that only
    exists by consolidation (source MERGED) goes. memories: id, source, invalidated_by, valid_until and others. report: id, restored (sorted ids), failed (ids that
    were not invalidated or are gone), deleted."""
    ids = merged.select(F.col("id").alias("m")).distinct()
    past = links.filter("relation = 'supersedes'").join(ids, F.col("source_id") == F.col("m")).select("m", F.col("target_id").alias("t")).distinct()
    state = memories.select(F.col("id").alias("i"), F.col("invalidated_by").isNotNull().alias("invalid"))
    found = past.join(state, F.col("t") == F.col("i"), "left").select("m", "t", F.coalesce("invalid", F.lit(False)).alias("ok"))
    back = found.filter("ok").select(F.col("t").alias("i")).distinct()
    own = memories.select(F.col("id").alias("i"), F.col("source").alias("s"))
    report = found.groupBy("m").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("t")))).alias("restored"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("t")))).alias("failed"))
    report = report.join(own, F.col("m") == F.col("i"), "left").select(F.col("m").alias("id"), "restored", "failed", F.coalesce(F.col("s") == MERGED, F.lit(False)).alias("deleted"))
    gone = report.filter("deleted").select(F.col("id").alias("g"))
    rows = memories.join(back.withColumn("again", F.lit(True)), F.col("id") == F.col("i"), "left").join(gone, F.col("id") == F.col("g"), "left_anti")
    null = lambda c: F.when(F.col("again").isNull(), F.col(c)).alias(c)
    rows = rows.select(*[null(c) if c in ("invalidated_by", "valid_until") else F.col(c) for c in memories.columns])
    dropped = past.select(F.col("m").alias("source_id"), F.col("t").alias("target_id"), F.lit("supersedes").alias("relation"))
    return Undone(rows, links.join(dropped, ["source_id", "target_id", "relation"], "left_anti").select(*links.columns), report)


def merge_metadata(old: Column, new: Column) -> Column:
    """Metadata of a link (map<string, array<string>>, a plain value as an array of one) when it is saved again: new keys over old ones, and code_paths the distinct paths of both,
    single code_path values included. If one side is null, the other."""
    none = F.array().cast("array<string>")
    paths = [F.coalesce(F.try_element_at(m, F.lit(k)), none) for m in (old, new) for k in ("code_paths", "code_path")]
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k) & (k != "code_paths"))
    rest = F.map_filter(new, lambda k, _: k != "code_paths")
    both = F.map_concat(kept, rest, F.create_map(F.lit("code_paths"), F.array_sort(F.array_distinct(F.concat(*paths)))))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)


#: How texts of failed attempts begin.
DEAD_END = "DEAD END:"


def dead_end(approach: Column, why: Column, context: Column) -> Column:
    """The text of a failed attempt; null or empty context gives no line."""
    first = F.concat(F.lit(f'{DEAD_END} Tried "'), approach, F.lit('" — Failed because: '), why)
    return F.when(F.coalesce(F.length(context), F.lit(0)) > 0, F.concat(first, F.lit("\nContext: "), context)).otherwise(first)


def dead_end_decisions(near: DataFrame, threshold: float = 0.85) -> DataFrame:
    """near: new_id, id, content, similarity of stored rows to new dead ends (one row with null id where there is none). Only the nearest at the threshold counts, and only if it
    is a dead end itself: new_id, result (saved or duplicate), duplicate_of."""
    order = F.when(F.col("similarity") >= threshold, F.struct((-F.col("similarity")).alias("s"), F.col("id").alias("id"), F.startswith("content", F.lit(DEAD_END)).alias("dead")))
    first = near.groupBy("new_id").agg(F.min(order).alias("x"))
    same = F.coalesce(F.col("x.dead"), F.lit(False))
    return first.select("new_id", F.when(same, "duplicate").otherwise("saved").alias("result"), F.when(same, F.col("x.id")).alias("duplicate_of"))


def skill_candidates(index: bm25.Index, keywords: DataFrame, limit: int = 15, sure: float = 0.8, most: float = 0.95) -> DataFrame:
    """keywords: query_id, term. Skills by BM25 for each query, best first: query_id, doc_id, score, rank, needs_ranking (whether a model is to rank them, since the best score is
    below `sure`) and confidence (of the best, without a model)."""
    found = bm25.top(index, keywords, limit)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.select("query_id", "doc_id", "score", "rank", (best < sure).alias("needs_ranking"), F.when(best >= sure, F.least(best, F.lit(most))).alias("confidence"))


def clean_recalls(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Recall events that stay when those older than `days` go; with 0 or fewer days none goes."""
    return events if days <= 0 else events.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))


COUNTERS = ("transcript_tokens", "extraction_input", "extraction_output", "synthesis_input", "synthesis_output")


def budgets(flushed: DataFrame, records: DataFrame) -> DataFrame:
    """Token counters of sessions after more records (session, counter, tokens, at): those that were flushed go on, and total is what models have consumed. A record of counter `reset`
    (an extraction has been done) sets the transcript's counter to 0 for what came before. flushed: session, the COUNTERS, updated_at."""
    reset = records.filter("counter = 'reset'").groupBy("session").agg(F.max("at").alias("cleared"))
    now = records.join(reset, "session", "left").filter("counter <> 'transcript_tokens' or cleared is null or at > cleared")
    added = now.groupBy("session").agg(*[F.sum(F.when(F.col("counter") == c, F.col("tokens")).otherwise(0)).alias(f"new_{c}") for c in COUNTERS], F.max("at").alias("last"), F.max("cleared").alias("cleared"))
    rows = flushed.join(added, "session", "full")
    old = lambda c: F.coalesce(F.when(F.col("cleared").isNotNull(), F.lit(0)).otherwise(F.col(c)) if c == COUNTERS[0] else F.col(c), F.lit(0))
    rows = rows.select("session", *[(old(c) + F.coalesce(f"new_{c}", F.lit(0))).cast("long").alias(c) for c in COUNTERS], F.greatest("updated_at", "last").alias("updated_at"))
    return rows.withColumn("total", sum((F.col(c) for c in COUNTERS[2:]), F.col(COUNTERS[1])))


def observation_due(size: Column, seen_size: Column, minutes: Column, min_tokens: int, max_minutes: int) -> Column:
    """Whether a session is to be observed: enough new text (bytes / 3.5 tokens) or time since the last observation, and over 200 new characters."""
    new = F.greatest(F.lit(0), size - F.coalesce(seen_size, F.lit(0)))
    return ((F.ceil(new / 3.5) >= min_tokens) | (minutes >= max_minutes)) & (new > 200)


def weak_factors(assessed: DataFrame, factors: list[str], least: float = 0.5) -> DataFrame:
    """Of each assessed result list the factors below `least`, weakest first, joined by commas."""
    pairs = F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(factors)])
    weak = F.array_sort(F.filter(pairs, lambda x: x["v"] < least))
    return assessed.withColumn("weak", F.array_join(F.transform(weak, lambda x: x["name"]), ","))


def needs_embedding(rows: DataFrame, vectors: DataFrame, dimension: int, model: str) -> DataFrame:
    """Rows whose vector is missing, has another dimension or is of another model: id, reason. vectors: id, embedding, model."""
    found = rows.select("id").join(vectors.select("id", "embedding", F.col("model").alias("of")), "id", "left")
    reason = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dimension, "dimension").when(~F.col("of").eqNullSafe(F.lit(model)), "model")
    return found.select("id", reason.alias("reason")).filter("reason is not null")


def migrate(rows: DataFrame, vectors: DataFrame, dimension: int, model: str) -> DataFrame:
    """The vector table after a change of model: rows that need one get a vector by the embed hook, vectors of rows that are gone go."""
    again = needs_embedding(rows, vectors, dimension, model).select("id").join(rows, "id").select("id", hooks.hook("embed")(F.col("content")).alias("embedding"), F.lit(model).alias("model"))
    kept = vectors.join(rows.select("id"), "id", "left_semi").join(again.select("id"), "id", "left_anti")
    return kept.select("id", "embedding", "model").unionByName(again)


def superseded(candidates: DataFrame, near: float = 0.8, most: int = 5, sure: float = 0.9) -> DataFrame:
    """candidates: new_id, id, similarity, relation and confidence (what a model says about the pair). Of the `most` nearest at `near` those that the new row supersedes for sure:
    new_id, checked, superseded (sorted ids), refined (number)."""
    w = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "id")
    top = candidates.filter((F.col("similarity") >= near) & (F.col("id") != F.col("new_id"))).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    over = (F.col("relation") == "supersedes") & (F.col("confidence") >= sure)
    return top.groupBy("new_id").agg(F.count(F.lit(1)).alias("checked"), F.array_sort(F.collect_list(F.when(over, F.col("id")))).alias("superseded"), F.sum(F.when(F.col("relation") == "refines", 1).otherwise(0)).alias("refined"))


def enrich_memory_links(links: DataFrame, memory: int, judged: DataFrame, sure: float = 0.7) -> DataFrame:
    """One memory's similar_to links that have not been enriched, with the relation that was judged for sure: source_id, target_id, relation. judged: source_id, target_id,
    relation, confidence."""
    own = links.filter((F.col("relation") == "similar_to") & ~F.col("enriched") & ((F.col("source_id") == memory) | (F.col("target_id") == memory)))
    better = judged.filter(F.col("confidence") >= sure).select("source_id", "target_id", F.col("relation").alias("better"))
    return own.join(better, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("better", "relation").alias("relation"))


def _bytes_of(value: Column) -> Column:
    """The four bytes of a float32 that is finite, not zero and normal, or zero, as hex, least byte first."""
    x = value.cast("float").cast("double")
    sign = F.when(x < 0, 1).otherwise(0)
    size = F.abs(x)
    exponent = F.floor(F.log2(size))
    # log2 may be off by one at powers of two
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    normal = exponent >= -126
    mantissa = F.when(normal, (size / F.pow(F.lit(2.0), exponent) - 1) * (1 << 23)).otherwise(size * F.pow(F.lit(2.0), F.lit(149)))
    bits = sign * (1 << 31) + F.when(normal, (exponent + 127) * (1 << 23)).otherwise(0) + mantissa
    hexed = F.lpad(F.hex(F.when(size == 0, 0).otherwise(bits).cast("long")), 8, "0")
    return F.concat(*[F.substring(hexed, i, 2) for i in (7, 5, 3, 1)])


def to_blob(vector: Column) -> Column:
    """A vector as little-endian float32 bytes; zeros lose their sign, values are finite."""
    return F.unhex(F.array_join(F.transform(vector, _bytes_of), ""))


def from_blob(blob: Column) -> Column:
    """The vector in little-endian float32 bytes; bytes after the last whole number are left out."""
    text = F.hex(blob)

    def number(i: Column) -> Column:
        at = lambda k: F.substring(text, (i * 8 + 1 + 2 * k).cast("int"), F.lit(2))
        bits = F.conv(F.concat(at(3), at(2), at(1), at(0)), 16, 10).cast("long")
        exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
        part = bits.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
        size = F.when(exponent == 0, part * 2.0**-149).otherwise((part / (1 << 23) + 1) * F.pow(F.lit(2.0), exponent - 127))
        return (F.when(bits >= 1 << 31, -size).otherwise(size)).cast("float")

    count = F.floor(F.octet_length(blob) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).otherwise(F.when(count == 0, F.array().cast("array<float>")))
