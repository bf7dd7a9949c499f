"""Flow of information in sessions: what a session has read decides what it may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import safety


def _first_seen(rows: DataFrame, what: str) -> DataFrame:
    """session, seen: of each session the distinct values of `what` with the first place where they stand; partial sums, no window over a session."""
    first = rows.filter(F.col(what).isNotNull()).groupBy("session", what).agg(F.min("at").alias("at"))
    return first.groupBy("session").agg(F.collect_list(F.struct(F.col(what).alias("value"), F.col("at"))).alias("seen"))


def _before(seen: str, at: Column) -> Column:
    return F.transform(F.filter(F.col(seen), lambda x: x["at"] < at), lambda x: x["value"])


def write_decisions(events: DataFrame) -> DataFrame:
    """session, at, level, compartments, tainted, decision for every write of a session.

    events: session, at (unique in a session, its order), kind (read, taint, grant, write), level and compartments (of what is read, or of the file that is written; null
    level of a write: a way out that has no label), taint, action (a grant's name, and the one a write refers to). Before a write, a session has the highest level, all
    compartments and all taints of earlier events. Nothing read: allow. A grant for the write's action that no other write has used up: allow, once. A file whose label dominates
    the session's: allow. Otherwise level 3 denies, level 2 asks, or denies if tainted, level 1 warns and level 0 allows. Null levels of reads are 0, null compartments none. Events of
    other kinds have no effect. Tables of levels, compartments and taints have a row for each different value of a session, so a session of any length is no single task;
    grants are followed by session and action."""
    reads, writes = events.filter("kind = 'read'"), events.filter("kind = 'write'")
    none = F.array().cast("array<string>")
    parts = [
        _first_seen(reads, "level").withColumnRenamed("seen", "levels"),
        _first_seen(reads.select("session", "at", F.explode("compartments").alias("c")), "c").withColumnRenamed("seen", "marks"),
        _first_seen(events.filter("kind = 'taint'"), "taint").withColumnRenamed("seen", "taints"),
    ]
    grants = events.filter("kind = 'grant'").select("session", "at", "kind", "action")
    known = writes
    for part in parts:
        known = known.join(part, "session", "left")
    at = F.col("at")
    own = safety.label(F.coalesce(F.array_max(_before("levels", at)), F.lit(0)), F.coalesce(_before("marks", at), none))
    known = known.withColumn("own", own).withColumn("tainted", F.size(F.coalesce(_before("taints", at), none)) > 0)
    clean = (F.col("own.level") == 0) & (F.size("own.compartments") == 0)
    # A write without a label to guard uses up no grant.
    steps = known.filter(~clean & F.col("action").isNotNull()).select("session", "at", "kind", "action").unionByName(grants.filter("action is not null"))
    last = F.lag("kind").over(Window.partitionBy("session", "action").orderBy("at"))
    granted = steps.withColumn("granted", F.coalesce(last == "grant", F.lit(False))).filter("kind = 'write' and granted").select("session", "at", "granted")
    file = safety.label(F.col("level"), F.coalesce("compartments", none))
    level = F.col("own.level")
    decision = (
        F.when(clean, "allow").when(F.col("granted"), "allow").when(F.col("level").isNotNull() & safety.label_dominates(file, F.col("own")), "allow")
        .when(level == 3, "deny").when((level == 2) & F.col("tainted"), "deny").when(level == 2, "ask").when(level == 1, "warn").otherwise("allow")
    )
    out = known.join(granted, ["session", "at"], "left").withColumn("decision", decision)
    return out.select("session", "at", level.alias("level"), F.col("own.compartments").alias("compartments"), "tainted", "decision")
