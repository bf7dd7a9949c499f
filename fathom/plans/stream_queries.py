"""Queries on streams with state: tables replayed in batches give what the whole table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import store
from fathom.plans import data
from fathom.plans.catalogue import query
from fathom.plans.maintenance_queries import WRITE_DECISIONS, flow_events
from fathom.sources.tail import TranscriptTail
from fathom.streaming import stateful

#: Batches that a table is replayed in.
BATCHES = 3
IDLE, COOLDOWN, QUIET = 30 * 60_000, 12 * 3_600_000, 10 * 60_000


@query("write_decisions_stream", WRITE_DECISIONS)
def write_decisions_stream(spark, d):
    found = stateful.replayed(flow_events(spark, d), stateful.WriteGuard(), BATCHES).filter("kind = 'write'")
    return found.select(F.col("at").alias("event_id"), "level", F.array_join("compartments", ",").alias("compartments"), "tainted", "decision")


@query("label_history")
def label_history(spark, d):
    """Rises of each session's label, its first 200."""
    found = stateful.replayed(flow_events(spark, d), stateful.WriteGuard(), BATCHES).filter("kind = 'raise'")
    return found.select("session", F.col("at").alias("event_id"), "level", F.array_join("compartments", ",").alias("compartments"))


def _activity(spark, d):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return data.table(spark, d, "events").select(F.col("user_id").alias("session"), at.alias("at"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "view"), "stop").otherwise("go").alias("kind"), F.col("event_id").alias("value"))


def _settled(events, found):
    """Moments that the last watermark has passed."""
    return found.crossJoin(F.broadcast(events.agg((F.max("at") - 1000).alias("until")))).filter("at < until").drop("until")  # one row


_ACTIVITY = """e AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS t, event_type IN ('purchase', 'view') AS stopped, event_id AS value, lead(epoch_us(ts) // 1000) OVER p AS nxt, row_number() OVER p AS n FROM events WINDOW p AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)),
w AS (SELECT max(t) - 1000 AS w FROM e)"""


@query(
    "idle_reflections",
    f"""WITH RECURSIVE {_ACTIVITY},
s AS (SELECT session, n, t + {IDLE} AS first, least(coalesce(nxt, w), w) AS stop, stopped FROM e, w),
r(session, n, told, first, c) AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT session, n, CASE WHEN c > 0 THEN first + (c - 1) * {COOLDOWN} ELSE told END, first, c FROM (
    SELECT session, n, told, first, CAST(CASE WHEN stopped AND first < stop THEN 1 + (stop - 1 - first) // {COOLDOWN} ELSE 0 END AS BIGINT) AS c FROM (
      SELECT r.session, s.n, r.told, greatest(s.first, coalesce(r.told + {COOLDOWN}, s.first)) AS first, s.stop, s.stopped FROM r JOIN s ON s.session = r.session AND s.n = r.n + 1))
)
SELECT session, first + i * {COOLDOWN} AS "at" FROM (SELECT session, first, unnest(range(c)) AS i FROM r WHERE c > 0)""",
)
def idle_reflections(spark, d):
    """When idle sessions would be reflected on: half an hour after a stop, not within half a day of the last time."""
    events = _activity(spark, d)
    return _settled(events, stateful.replayed(events, stateful.IdleReflection(IDLE, COOLDOWN), BATCHES, timers=True))


@query("export_debounce", f"WITH {_ACTIVITY} SELECT session, t + {QUIET} AS \"at\", value AS last FROM e, w WHERE (nxt IS NULL OR nxt > t + {QUIET}) AND t + {QUIET} < w")
def export_debounce(spark, d):
    """When a change would be exported: ten minutes after the last of a run of events."""
    events = _activity(spark, d)
    return _settled(events, stateful.replayed(events, stateful.Debounce(QUIET), BATCHES, timers=True))


@query("context_advice")
def context_advice(spark, d):
    """Events as growing transcripts with compactions now and then."""
    i = F.col("event_id")
    kind = F.when(i % 50 == 0, "compact").when(i % 11 == 0, "tokens").when(i % 7 == 0, "limit").otherwise("size")
    value = F.when(i % 7 == 0, 2000 + i % 3 * 500).otherwise(F.floor("value") + i)
    events = _activity(spark, d).select("session", "at", "value").withColumnRenamed("value", "event_id").join(data.table(spark, d, "events").select("event_id", F.col("value").alias("value")), "event_id")
    return stateful.replayed(events.select("session", "at", kind.alias("kind"), value.cast("long").alias("value")), stateful.ContextAdvice(), BATCHES)


@query("transcript_lines", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def transcript_lines(spark, d):
    """Conversations written as JSON lines and read back as a growing transcript, from byte offsets."""
    root = store.new_folder(spark, "transcripts")
    turns = data.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    turns.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(f"{root}/in")
    spark.dataSource.register(TranscriptTail)
    lines = spark.readStream.format("transcript_tail").option("path", f"{root}/in").option("suffix", ".txt").load()
    rows = lines.select(F.from_json("line", turns.schema).alias("x")).select("x.*")
    query = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").start()
    query.processAllAvailable()
    query.stop()
    found = spark.read.schema(turns.schema).parquet(f"{root}/out")
    return found.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))
