"""Conversation transcripts: size by kind, cut points, trimming, sessions, pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "type string, uuid string, parentUuid string, sessionId string, message struct<role:string,content:array<struct<type:string,text:string,name:string,input:string,id:string,tool_use_id:string,content:string,thinking:string>>>"


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to entries; blank and broken lines are left out. Content that is plain text becomes one text block."""
    blocks = F.from_json(line, ENTRY)
    plain = F.get_json_object(line, "$.message.content")
    made = F.struct(F.lit("text").alias("type"), plain.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "id", "tool_use_id", "content", "thinking")])
    role = F.get_json_object(line, "$.message.role")
    rows = lines.filter(F.trim(line) != "").withColumn("e", blocks)
    entry = rows.select(*[c for c in lines.columns if c != line], F.col("e.type").alias("type"), F.col("e.uuid").alias("uuid"), F.col("e.parentUuid").alias("parent"), role.alias("role"), F.coalesce("e.message.content", F.when(plain.isNotNull(), F.array(made))).alias("blocks"))
    return entry.filter("type is not null")


def block_chars(b: Column) -> Column:
    return F.when(b["type"] == "text", F.length(b["text"])).when(b["type"] == "thinking", F.length(b["thinking"])).when(b["type"] == "tool_use", F.length(b["input"])).when(b["type"] == "tool_result", F.length(b["content"])).otherwise(0)


def breakdown(entries: DataFrame, by: list[str]) -> DataFrame:
    """Characters and tokens by kind of block."""
    x = entries.select(*by, F.explode("blocks").alias("b"))
    chars = F.sum(F.coalesce(block_chars(F.col("b")), F.lit(0)).cast("long"))
    return x.groupBy(*by, F.col("b.type").alias("kind")).agg(F.count(F.lit(1)).alias("n_blocks"), chars.alias("chars")).withColumn("tokens", F.ceil(F.col("chars") / 3.5).cast("long"))


def tools(entries: DataFrame) -> DataFrame:
    """Per tool: calls, characters of input and of the results that answer them."""
    b = entries.select(F.explode("blocks").alias("b")).select("b.*")
    results = b.filter("type = 'tool_result'").groupBy("tool_use_id").agg(F.sum(F.length("content")).alias("result_chars"))
    calls = b.filter("type = 'tool_use'").join(results.withColumnRenamed("tool_use_id", "r"), F.col("id") == F.col("r"), "left")
    return calls.groupBy(F.coalesce("name", F.lit("unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(F.length("input"), F.lit(0)).cast("long")).alias("input_chars"), F.sum(F.coalesce("result_chars", F.lit(0)).cast("long")).alias("result_chars"))


def cut_points(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """User turns with text: the tokens up to and with them, and a preview."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).over(w)
    return turns.withColumn("tokens", F.ceil(total / 3.5).cast("long")).filter((F.col(role) == "user") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).select(session, turn, "tokens", F.substring(text, 1, 80).alias("preview"))


def trim(entries: DataFrame, most: int, kinds: tuple[str, ...] = ("tool_use", "tool_result", "thinking")) -> DataFrame:
    """Blocks of these kinds over `most` characters are replaced by a marker; removed is the number of characters that went."""

    def one(b: Column) -> Column:
        long = b["type"].isin(*kinds) & (F.coalesce(block_chars(b), F.lit(0)) > most)
        mark = F.concat(F.lit("[trimmed "), block_chars(b).cast("string"), F.lit(" chars]"))
        return F.struct(*[F.when(long & (b["type"] == k), mark).otherwise(b[c]).alias(c) if k else b[c].alias(c) for c, k in (("type", None), ("text", None), ("name", None), ("input", "tool_use"), ("id", None), ("tool_use_id", None), ("content", "tool_result"), ("thinking", "thinking"))])

    size = lambda blocks: F.aggregate(blocks, F.lit(0), lambda s, b: s + F.coalesce(block_chars(b), F.lit(0)))
    out = entries.withColumn("__new", F.transform("blocks", one))
    return out.withColumn("removed", size(F.col("blocks")) - size(F.col("__new"))).withColumn("blocks", F.col("__new")).drop("__new")


def compact(entries: DataFrame, session: str, order: str, after: Column) -> DataFrame:
    """Entries from a cut on (order > after); the chain of parents is closed over what was cut, the first entry has none."""
    kept = entries.filter(F.col(order) > after)
    w = Window.partitionBy(session).orderBy(order)
    known = kept.select(F.col(session).alias("__s"), F.col("uuid").alias("__u")).distinct()
    linked = kept.join(known, (F.col(session) == F.col("__s")) & (F.col("parent") == F.col("__u")), "left")
    return linked.withColumn("parent", F.when(F.col("__u").isNotNull(), F.col("parent")).otherwise(F.lag("uuid").over(w))).drop("__s", "__u")


def broken_chains(entries: DataFrame, session: str) -> DataFrame:
    """Entries whose parent isn't in their session."""
    known = entries.select(F.col(session).alias("__s"), F.col("uuid").alias("__u"))
    return entries.filter("parent is not null").join(known, (F.col(session) == F.col("__s")) & (F.col("parent") == F.col("__u")), "left_anti")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events with gaps below `gap`."""
    return events.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def urgency(share: Column, threshold: float = 0.5) -> Column:
    """Pressure on a context by its used share."""
    return F.when(share >= 0.8, "critical").when(share >= threshold + 0.3, "critical").when(share >= threshold + 0.15, "high").when(share >= threshold, "moderate").otherwise("none")


def dialogue(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One text a session, its turns in order."""
    row = F.struct(turn, F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    return turns.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("dialogue"))


def last_number(text: Column, name: str) -> Column:
    """The last value of a JSON number field in a text."""
    found = F.regexp_extract_all(text, F.lit(rf'"{name}"\s*:\s*([0-9]+)'), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("long")
