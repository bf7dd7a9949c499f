"""Copy-on-write changes of bi-temporal tables: every operator gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Upsert: rows of new replace those of old with equal keys; columns in keep stay as they were."""
    if keep:
        held = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(held, keys, "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(f"__{c}", c))
        new = new.select(old.columns)
    return old.join(new.select(keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def supersede(versions: DataFrame, new: DataFrame, path: str, at: Column) -> DataFrame:
    """Closes every current row (superseded_at null) of the paths that new touches, then adds the rows of new as current."""
    touched = new.select(F.col(path).alias("__p")).distinct()
    joined = versions.join(touched, F.col(path) == F.col("__p"), "left")
    closed = joined.withColumn("superseded_at", F.when(F.col("__p").isNotNull() & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at"))).drop("__p")
    return closed.unionByName(new.withColumn("superseded_at", F.lit(None).cast("timestamp")))


def current(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("superseded_at").isNull())


def purge(versions: DataFrame, before: Column) -> DataFrame:
    """Without rows that were superseded before a time."""
    return versions.filter(F.col("superseded_at").isNull() | (F.col("superseded_at") >= before))


def invalidate(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """ids (id, by): sets invalidated_by and valid_until of rows that aren't pinned or invalid yet."""
    hit = ids.select(F.col("id").alias("__id"), F.col("by").alias("__by"))
    open_ = F.col("__id").isNotNull() & F.col("invalidated_by").isNull() & ~pinned()
    rows = memories.join(hit, F.col("id") == F.col("__id"), "left")
    return rows.withColumns({"valid_until": F.when(open_, at).otherwise(F.col("valid_until")), "invalidated_by": F.when(open_, F.col("__by")).otherwise(F.col("invalidated_by"))}).drop("__id", "__by")


def restore(memories: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id").alias("__id"))
    back = F.col("__id").isNotNull() & F.col("invalidated_by").isNotNull()
    rows = memories.join(hit, F.col("id") == F.col("__id"), "left")
    return rows.withColumns({"valid_until": F.when(~back, F.col("valid_until")), "invalidated_by": F.when(~back, F.col("invalidated_by"))}).drop("__id")


def pinned() -> Column:
    return F.coalesce(F.col("is_invariant"), F.lit(False)) | (F.coalesce(F.col("correction_count"), F.lit(0)) >= 2)


def count_access(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """accesses (id, weight, at): adds weights to access_count and moves last_accessed."""
    more = accesses.groupBy("id").agg(F.sum("weight").alias("__w"), F.max("at").alias("__at"))
    return memories.join(more, "id", "left").withColumns({"access_count": F.coalesce("access_count", F.lit(0.0)) + F.coalesce("__w", F.lit(0.0)), "last_accessed": F.coalesce("__at", "last_accessed")}).drop("__w", "__at")


def stale_files(indexed: DataFrame, listing: DataFrame) -> DataFrame:
    """path, state: stale (newer and of other content), deleted (no longer there) or new. indexed: path, content_hash, indexed_at; listing: path, content_hash, modified_at."""
    a, b = indexed.alias("a"), listing.alias("b")
    state = F.when(F.col("b.path").isNull(), "deleted").when(F.col("a.path").isNull(), "new").when((F.col("b.modified_at") > F.col("a.indexed_at")) & (F.col("a.content_hash") != F.col("b.content_hash")), "stale")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state")).filter("state is not null")


def versions_as_of(rows: DataFrame, keys: list[str], start: str, at: Column) -> DataFrame:
    """Of each key the row that is valid at a time: started by then, the next one not yet."""
    w = Window.partitionBy(*keys).orderBy(start, *[c for c in rows.columns if c not in (*keys, start)][:1])
    timed = rows.withColumn("valid_until", F.lead(start).over(w))
    return timed.filter((F.col(start) <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def normal_provenance(memories: DataFrame) -> DataFrame:
    """Confidence outside 0..1 becomes .5, unknown kinds of source become human."""
    c = F.col("confidence")
    return memories.withColumns({"confidence": F.when(c.between(0, 1), c).otherwise(0.5), "source_type": F.when(F.col("source_type").isin("human", "agent", "system", "auto-extracted"), F.col("source_type")).otherwise("human")})


def expired(memories: DataFrame, now: Column, unused_days: int | None = None) -> DataFrame:
    """Automatic memories past forget_after, or never used for some days."""
    late = F.col("forget_after").isNotNull() & (F.col("forget_after") <= now)
    if unused_days is not None:
        late = late | ((F.coalesce("access_count", F.lit(0)) == 0) & (F.col("created_at") < now - F.expr(f"interval {unused_days} days")))
    return memories.filter((F.col("source_type") == "auto-extracted") & F.coalesce(late, F.lit(False)))


def merge_counts(old: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token frequencies with one more for every occurrence: token, frequency."""
    more = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))
    return old.select("token", "frequency").unionAll(more).groupBy("token").agg(F.sum("frequency").alias("frequency"))
