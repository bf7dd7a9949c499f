"""Sessions in a stream, with state that lives between batches: write decisions, idle reflections, advice on full contexts, trailing-edge debounce.

Each is a processor for transformWithStateInPandas, keyed by session (or by what is debounced). Rows of a key are taken in the order of `at`; batches must come in that order,
however they are cut, and the rows that come out do not depend on the cuts: a gap that ends inside a batch is judged when its end is seen, one that is still open by an
event-time timer when the watermark passes it, and the state says which has been told. `at` is a time in milliseconds for those with timers.

State and timers are kept by Spark (RocksDB in the checkpoint folder), so a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fathom.operators import store

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: An event may come this much behind the latest one.
LATE = "1 second"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with what stateful processors need; the given one keeps its own settings."""
    out = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (v := spark.conf.get(k, None)) is not None:
            out.conf.set(k, v)
    for k, v in _SETTINGS.items():
        out.conf.set(k, v)
    return out


def _ordered(rows: Iterator[pd.DataFrame]) -> list:
    """A key's rows of a batch in the order of `at`, nulls as None."""
    whole = pd.concat(list(rows)).sort_values("at", kind="stable")
    columns = [[None if not hasattr(x, "__len__") and pd.isna(x) else x for x in whole[c].tolist()] for c in whole.columns]
    return [dict(zip(whole.columns, r, strict=True)) for r in zip(*columns, strict=True)]


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class WriteGuard(_Processor):
    """Labels, taints and grants of a session, and what it may write (operators/flow.py has the rules and the batch form). Besides decisions (kind write) it gives a row for
    each rise of the label (kind raise, the event's kind as decision), of which the first `history` of a session are kept."""

    schema = "session long, at long, kind string, level int, compartments array<string>, tainted boolean, decision string"

    def __init__(self, history: int = 200):
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.label = handle.getValueState("label", "level int, tainted boolean")
        self.marks = handle.getMapState("compartments", "name string", "at long")
        self.grants = handle.getMapState("grants", "action string", "at long")
        self.past = handle.getListState("history", "at long, level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        level, tainted = self.label.get() if self.label.exists() else (0, False)
        marks = {k[0] for k in self.marks.keys()}
        grants = {k[0] for k in self.grants.keys()}
        told = sum(1 for _ in self.past.get()) if self.past.exists() else 0
        old_marks, old_grants, new_past, out = set(marks), set(grants), [], []
        for r in _ordered(rows):
            kind = r["kind"]
            if kind == "read":
                up, more = max(level, int(r["level"] or 0)), marks | set(r["compartments"] if r["compartments"] is not None else [])
                if (up, more) != (level, marks) and told + len(new_past) < self.history:
                    new_past.append((int(r["at"]), up))
                    out.append((key[0], r["at"], "raise", up, sorted(more), tainted, kind))
                level, marks = up, more
            elif kind == "taint" and r["taint"]:
                tainted = True
            elif kind == "grant" and r["action"]:
                grants.add(r["action"])
            elif kind == "write":
                out.append((key[0], r["at"], "write", level, sorted(marks), tainted, self.decide(r, level, marks, tainted, grants)))
        self.label.update((level, bool(tainted)))
        for name in marks - old_marks:
            self.marks.updateValue((name,), (0,))
        for action in old_grants - grants:
            self.grants.removeKey((action,))
        for action in grants - old_grants:
            self.grants.updateValue((action,), (0,))
        if new_past:
            self.past.appendList(new_past)
        yield pd.DataFrame(out, columns=["session", "at", "kind", "level", "compartments", "tainted", "decision"])

    @staticmethod
    def decide(r: dict, level: int, marks: set, tainted: bool, grants: set) -> str:
        if not level and not marks:
            return "allow"
        if r["action"] in grants:
            grants.discard(r["action"])  # a grant holds once
            return "allow"
        if r["level"] is not None and r["level"] >= level and marks <= set(r["compartments"] if r["compartments"] is not None else []):
            return "allow"
        return ("allow", "warn", "deny" if tainted else "ask", "deny")[level]


class IdleReflection(_Processor):
    """session, at: moments at which a session has been idle for `idle` ms after an event of kind `stop` and was not told of within `cooldown` ms; while it stays idle, again
    after each cooldown. An event at that very moment comes first."""

    schema = "session long, at long"

    def __init__(self, idle: int, cooldown: int):
        self.idle, self.cooldown = idle, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", "last long, stopped boolean, told long, timer long")

    def due(self, last: int, told: int | None) -> int:
        return last + self.idle if told is None else max(last + self.idle, told + self.cooldown)

    def until(self, state: tuple, end: int) -> tuple[list[int], int | None]:
        """(moments before end, the last one told)."""
        last, stopped, told, _ = state
        out = []
        while stopped and (at := self.due(last, told)) < end:
            out.append(at)
            told = at
        return out, told

    def keep(self, last: int, stopped: bool, told: int | None, timer: int | None) -> None:
        due = self.due(last, told) if stopped else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        self.state.update((last, stopped, told, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[int] = []
        state = self.state.get() if self.state.exists() else None
        timer = state[3] if state else None
        for r in _ordered(rows):
            told = None
            if state:
                found, told = self.until(state, r["at"])
                out += found
            state = (int(r["at"]), r["kind"] == "stop", told, None)
        self.keep(state[0], state[1], state[2], timer)
        yield pd.DataFrame({"session": [key[0]] * len(out), "at": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get()
        out, told = self.until(state, timerValues.getCurrentWatermarkInMs())
        self.keep(state[0], state[1], told, None)  # this timer is gone
        yield pd.DataFrame({"session": [key[0]] * len(out), "at": out})


class ContextAdvice(_Processor):
    """session, at, tokens, percent, urgency, advise, extract for each event of kind `size` (value: bytes of the transcript so far).

    Tokens are 0.7 of the bytes since the last compaction (kind `compact`, value: bytes then) over 3.5, rounded up, or the last count (kind `tokens`) since then if there is one;
    `limit` events set the context's size, without which nothing is said. Urgency: low from the threshold, medium and high from 15 and 30 points above it, critical from
    80 %. Advice is given at most once within `cooldown` ms; with the first high or critical one since a compaction comes a call to extract."""

    schema = "session long, at long, tokens long, percent double, urgency string, advise boolean, extract boolean"

    def __init__(self, threshold: float = 50, cooldown: int = 300_000):
        self.threshold, self.cooldown = threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "limit long, offset long, counted long, advised long, extracted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit, offset, counted, advised, extracted = self.state.get() if self.state.exists() else (None, 0, None, None, False)
        out = []
        for r in _ordered(rows):
            at, kind, value = int(r["at"]), r["kind"], int(r["value"] or 0)
            if kind == "limit":
                limit = value or None
            elif kind == "compact":
                offset, counted, advised, extracted = value, None, None, False
            elif kind == "tokens":
                counted = value
            elif kind == "size" and limit:
                # 0.7 bytes over 3.5 is a fifth; rounded up in whole numbers.
                tokens = counted if counted else -(-max(0, value - offset) // 5)
                percent = min(100.0, tokens / limit * 100)
                steps = ((80, "critical"), (self.threshold + 30, "high"), (self.threshold + 15, "medium"), (self.threshold, "low"))
                urgency = next((name for least, name in steps if percent >= least), "none")
                advise = urgency != "none" and (advised is None or at - advised >= self.cooldown)
                extract = advise and urgency in ("high", "critical") and not extracted
                advised, extracted = at if advise else advised, extracted or extract
                out.append((key[0], at, tokens, round(percent, 1), urgency, advise, extract))
        self.state.update((limit, offset, counted, advised, extracted))
        yield pd.DataFrame(out, columns=["session", "at", "tokens", "percent", "urgency", "advise", "extract"])


class Debounce(_Processor):
    """session, at, last: `quiet` ms after an event of a key that no other follows within that time; last is that event's own `value`. An event at that very moment starts anew."""

    schema = "session long, at long, last long"

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "at long, value long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        before = open_ = self.open.get() if self.open.exists() else None
        for r in _ordered(rows):
            if open_ and r["at"] > open_[0] + self.quiet:
                out.append((key[0], open_[0] + self.quiet, open_[1]))
            open_ = (int(r["at"]), r["value"])
        if before:
            self.handle.deleteTimer(before[0] + self.quiet)
        self.handle.registerTimer(open_[0] + self.quiet)
        self.open.update(open_)
        yield pd.DataFrame(out, columns=["session", "at", "last"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, value = self.open.get()
        self.open.clear()
        yield pd.DataFrame({"session": [key[0]], "at": [at + self.quiet], "last": [value]})


def processed(events: DataFrame, processor: _Processor, timers: bool = False) -> DataFrame:
    """events: a stream with session, at, and what the processor reads; timers: with a timestamp `ts`, by which the watermark goes."""
    if not timers:
        return events.groupBy("session").transformWithStateInPandas(processor, processor.schema, "append", "none")
    return events.withWatermark("ts", LATE).groupBy("session").transformWithStateInPandas(processor, processor.schema, "append", "eventTime")


def replayed(events: DataFrame, processor: _Processor, batches: int, timers: bool = False) -> DataFrame:
    """A table of events as a stream: cut by ranges of `at` into batches, for each of which the query is started anew on one checkpoint; its rows so far."""
    spark = events.sparkSession
    root, session = store.new_folder(spark, "stream"), stream_session(spark)
    low, high = events.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return spark.createDataFrame([], processor.schema)
    cut = F.least(F.lit(batches - 1), F.floor((F.col("at") - low) * batches / F.lit(max(1, high - low)))).cast("int")
    events.withColumn("batch", cut).repartition("batch", "session").write.partitionBy("batch").parquet(f"{root}/events")
    done: list[int] = []
    for k in sorted(r.batch for r in spark.read.parquet(f"{root}/events").select("batch").distinct().collect()):
        done.append(k)
        stream = session.readStream.schema(events.schema).parquet(f"{root}/events/batch={{{','.join(map(str, done))}}}")
        query = processed(stream, processor, timers).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(processor.schema).parquet(f"{root}/out")
