"""Live counterparts: file events, sessions, request de-duplication, pressure on contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, kind (change or delete), content, ts from JSON lines dropped into a folder."""
    return spark.readStream.schema(schema).json(path)


def latest_per_key(batch: DataFrame, key: str, ts: str) -> DataFrame:
    """Of a micro-batch the last event of every key; a delete wins among equals."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col("kind") == "delete")).alias("x")).select(key, "x.*")


def index_stream(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], every: str = "2 seconds", once: bool = False):
    """Debounced micro-batches to `apply`, which must be idempotent by batch id."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply(latest_per_key(df, "path", "ts"), n))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def distinct_requests(requests: DataFrame, ts: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """Requests without those whose content came within the time to live."""
    return requests.withColumn("content_hash", F.sha2("content", 256)).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["content_hash"])


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def pressure(events: DataFrame, limit: int, late: str = "1 hour", threshold: float = 0.5) -> DataFrame:
    """Running tokens of a session (session, tokens, ts) and a row whenever its tier rises: session, tokens, tier. A tier is told once."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, told = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        for batch in batches:
            used += int(batch.tokens.sum())
        share = used / limit
        tier = 3 if share >= 0.8 else 2 if share >= threshold + 0.15 else 1 if share >= threshold else 0
        if tier > told:
            yield pd.DataFrame({"session": [key[0]], "tokens": [used], "tier": [("none", "moderate", "high", "critical")[tier]]})
        state.update((used, max(tier, told)))
        state.setTimeoutDuration(30 * 60 * 1000)

    return events.groupBy("session").applyInPandasWithState(run, "session long, tokens long, tier string", "used long, told int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_labels(reads: DataFrame) -> DataFrame:
    """Highest level and all compartments a session has read so far, per event: the batch form. reads: session, ts, level, compartments."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("level_so_far", F.max("level").over(w)).withColumn("compartments_so_far", F.array_sort(F.array_distinct(F.flatten(F.collect_list("compartments").over(w)))))
