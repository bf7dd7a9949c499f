"""From files to versioned chunks: what changed, what went, what the tables are afterwards; statuses and starts of time ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.operators import chunking, tables


@dataclass
class Indexed:
    """Tables after an index run, and a row of counts (indexed, unchanged, deleted, chunks)."""

    versions: DataFrame
    hashes: DataFrame
    counts: DataFrame


def index_files(listing: DataFrame, hashes: DataFrame, versions: DataFrame, at: Column, size: int = 500, overlap: int = 50, force: bool = False) -> Indexed:
    """listing: path, content, content_hash. Files whose hash is known stay as they are; chunks of changed files supersede those before; files that are gone are closed.
    versions: path, chunk_index, content, start_line, end_line, superseded_at; hashes: path, content_hash."""
    fresh = listing if force else listing.join(hashes.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    pieces = fresh.select("path", F.posexplode(chunking.text_chunks(F.col("content"), size, overlap)).alias("chunk_index", "c"))
    new = pieces.select("path", "chunk_index", "c.content", "c.start_line", "c.end_line")
    gone = hashes.join(listing.select("path"), "path", "left_anti").select("path")
    closed = tables.supersede(versions, new.limit(0).unionByName(gone.select("path", F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))), "path", at).filter("content is not null or superseded_at is not null")
    after = tables.supersede(closed, new, "path", at)
    known = listing.select("path", "content_hash")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(fresh, "indexed").crossJoin(n(listing.join(fresh.select("path"), "path", "left_anti"), "unchanged")).crossJoin(n(gone, "deleted")).crossJoin(n(new, "chunks"))
    return Indexed(after, known, counts)


def since(text: str, now: Column) -> Column | None:
    """Start of a range: today (midnight), yesterday, week, month (30 days) or an ISO date; None for anything else, which then filters nothing."""
    import re

    days = {"yesterday": 1, "week": 7, "month": 30}
    if text == "today":
        return F.date_trunc("day", now)
    if text in days:
        return now - F.make_dt_interval(F.lit(days[text]))
    return F.lit(text).cast("timestamp") if re.match(r"\d{4}-\d{2}-\d{2}", text) else None


def temporal_status(score: Column, start: Column, end: Column, now: Column) -> Column:
    """expired, future, fading (score below .3) or active."""
    return F.when(end < now, "expired").when(start > now, "future").when(score < 0.3, "fading").otherwise("active")


def idle(events: DataFrame, key: str, ts: str, now: Column, minutes: int = 30) -> DataFrame:
    """Sessions without an event for some minutes: the batch form of an idle watcher."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    return last.filter(F.col("last") < now - F.expr(f"interval {minutes} minutes"))


def top_level(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def profile(files: DataFrame) -> DataFrame:
    """extension, files, bytes, share of a repository (path, length)."""
    ext = F.lower(F.regexp_extract("path", rf"(?i)\.({T.EXTENSIONS})$", 1))
    x = files.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("files").alias("all")))).select("extension", "files", "bytes", (F.col("files") / F.col("all")).alias("share"))
