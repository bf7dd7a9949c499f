"""Leaderboard change feed of a stream of sale lines (operator 13).

The lines are cut into batches by the day they arrive, with each vendor's nation and each item's price beside them, and written below spark.checkpoint.dir. A stateful streaming
query is then started anew for each batch on one checkpoint:

A nation's items are dealt into `slots` by hash, so that a nation with a third of all lines is many groups. A group keeps its items' revenues in a MapState, one
entry a batch (the items that batch changed and by how much; entries are added up into one when there are `runs` of them), and its saved board. It replays the days of a
batch in order: a list ordered by negative revenue and item_id holds the items that the batch changes and the best others, of which no more than a board can matter, and is
kept in order by bisection. What a day changed on the group's own board goes out: at most two boards of rows, however many lines there were.

A nation's board is the best of its groups' boards. When the last batch is in, each nation's rows (at most slots x days x two boards) are replayed by day in the same way, and its
boards diffed. As a second stateful operator in the same query this took two tasks more for each state partition and start, which are what a start costs.

Before lines are shuffled to their groups, a task adds up those with the same nation, item and day, so an item with a third of all lines is a few rows. The joins with vendors
and items are sort-merge joins outside the stream, where Spark splits skewed keys; nothing is broadcast. The driver gets one number for each batch: its latest day, from
which the next batch's bound for late lines follows.

Lines without a nation or an items row are ignored, though their days count for that bound. A null shipped_at gets a day from the line's hash; a null amount the price, null
price or quantity 0; a null flag is not `returned`. Repeated lines count each; of vendors or items with one id the least nation and the least price hold. Days before the first batch
belong to it. Empty tables give an empty result. Other columns may have any names.

A lost executor costs tasks again; a batch that failed runs again from the checkpoint; each call takes a new folder.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fathom.llm.shared import materialise, shared_dir


@dataclass(frozen=True)
class Feed:
    batches: int = 10
    first_day: int = 19723
    days: int = 180
    #: Days that a line may lie behind the latest day of earlier batches.
    late: int = 3
    size: int = 10
    slots: int = 64
    runs: int = 16


FEED = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
_LINES = "nation_id int, item_id long, day int, arrival int, cents long, batch int"
_SUMS = "nation_id int, slot int, item_id long, arrival int, cents long"
_LOCAL = "nation_id int, arrival int, item_id long, cents long, stays boolean"
_DIFF = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"
#: Settings of the streaming session; the caller's session keeps its own.
_STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    # A start has one batch: stores that stay open after it only hold disk and memory.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxBytesPerBatch")


def batch_of(arrival: Column, feed: Feed) -> Column:
    cut = F.floor((arrival - feed.first_day) * feed.batches / F.lit(feed.days)) + 1
    return F.least(F.lit(feed.batches), F.greatest(F.lit(1), cut)).cast("int")


def prepared(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame, feed: Feed, root: str) -> DataFrame:
    """Every line with its nation, day, arrival, value in cents and batch; nation_id is null for lines to be ignored."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    day = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), feed.first_day + F.col("h") % 150)
    wait = F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    price = F.coalesce(F.floor(F.col("quantity").cast("double") * F.floor(100 * F.col("price") + 0.5)), F.lit(0))
    # One number for day, wait and whether the price is needed: the rows are shuffled twice.
    lines = sale_lines.withColumn("h", F.crc32(text)).select(
        "item_id", "vendor_id", ((day * 32 + wait) * 2 + F.col("amount").isNull().cast("int")).alias("packed"), (sign * F.coalesce(F.floor(100 * F.col("amount") + 0.5), F.col("quantity").cast("long"))).alias("value")
    )
    # Written first: Spark splits a skewed key only where both sides of the join come straight from a shuffle.
    nations = materialise(vendors.groupBy(F.col("vendor_id").alias("of_vendor")).agg(F.min("nation_id").cast("int").alias("nation_id")), f"{root}/nations")
    prices = materialise(items.groupBy(F.col("item_id").alias("of_item")).agg(F.min("price").alias("price")), f"{root}/prices")
    lines = lines.join(nations.hint("merge"), lines.vendor_id == nations.of_vendor, "left").select("item_id", "nation_id", "packed", "value")
    lines = lines.join(prices.hint("merge"), lines.item_id == prices.of_item, "left")
    asks = F.col("packed") % 2 == 1
    worth = F.when(asks, F.coalesce(F.floor(F.col("value").cast("double") * F.floor(100 * F.col("price") + 0.5)), F.lit(0))).otherwise(F.col("value"))
    day = F.floor(F.col("packed") / 64).cast("int")
    arrival = day + F.floor(F.col("packed") / 2).cast("int") % 32
    rows = lines.select(F.when(F.col("of_item").isNotNull(), F.col("nation_id")).alias("nation_id"), "item_id", day.alias("day"), arrival.alias("arrival"), worth.cast("long").alias("cents"))
    return rows.withColumn("batch", batch_of(F.col("arrival"), feed))


def added_up(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Sums of lines with one nation, slot, item and arrival, within a task."""
    keys = ["nation_id", "slot", "item_id", "arrival"]
    held: list[pa.Table] = []
    rows = 0

    def out() -> Iterator[pa.RecordBatch]:
        sums = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("cents", "sum")])
        return iter(sums.select([*keys, "cents_sum"]).rename_columns([*keys, "cents"]).to_batches(max_chunksize=10_000))

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows >= most:
            yield from out()
            held, rows = [], 0
    if rows:
        yield from out()


def packed(*columns: list[int] | np.ndarray) -> bytes:
    return b"".join(np.asarray(c, np.int64).tobytes() for c in columns)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(columns, -1)


class Ranking:
    """Positive revenues in order: the highest first, ties by item."""

    def __init__(self, revenue: dict[int, int]):
        self.revenue = revenue
        self.order = sorted((-r, i) for i, r in revenue.items() if r > 0)

    def put(self, item: int, now: int) -> None:
        before = self.revenue.get(item, 0)
        if before > 0:
            del self.order[bisect_left(self.order, (-before, item))]
        self.revenue[item] = now
        if now > 0:
            insort(self.order, (-now, item))

    def drop(self, item: int) -> None:
        self.put(item, 0)
        del self.revenue[item]

    def board(self, size: int) -> list[int]:
        return [item for _, item in self.order[:size]]


def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(items ascending, their summed revenue)."""
    items, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros(len(items), np.int64)
    np.add.at(sums, which, np.concatenate([p[1] for p in parts]))
    return items, sums


def by_day(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    rows = pd.concat(list(frames))
    return iter(rows.groupby("arrival", sort=True))


class Slots(StatefulProcessor):
    def __init__(self, feed: Feed):
        self.feed = feed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("revenues", "run int", "data binary")
        self.saved = handle.getValueState("board", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        days = list(by_day(rows))
        kept = {run: unpacked(data, 2) for (run,), (data,) in self.runs.iterator()}
        changed, by = combined([(d["item_id"].to_numpy(np.int64), d["cents"].to_numpy(np.int64)) for _, d in days])
        items, sums = combined([(x[0], x[1]) for x in kept.values()]) if kept else (np.zeros(0, np.int64),) * 2
        apart = ~np.isin(items, changed, assume_unique=True)
        # Of items that this batch leaves alone, only the best of a board's size can stand on one.
        alone_items, alone_sums = items[apart], sums[apart]
        best = np.lexsort((alone_items, -alone_sums))[: self.feed.size]
        revenue = dict.fromkeys(changed.tolist(), 0)
        revenue |= dict(zip(items[~apart].tolist(), sums[~apart].tolist(), strict=True))
        revenue |= dict(zip(alone_items[best].tolist(), alone_sums[best].tolist(), strict=True))
        ranking = Ranking(revenue)
        last = dict(zip(*unpacked(self.saved.get()[0], 2).tolist(), strict=True)) if self.saved.exists() else {}
        out = []
        for day, lines in days:
            for item, cents in zip(lines["item_id"].tolist(), lines["cents"].tolist(), strict=True):
                ranking.put(item, revenue[item] + cents)
            board = {item: revenue[item] for item in ranking.board(self.feed.size)}
            out += [(key[0], day, item, cents, True) for item, cents in board.items() if last.get(item) != cents]
            out += [(key[0], day, item, revenue[item], False) for item in last if item not in board]
            last = board
        if last or self.saved.exists():
            self.saved.update((packed(list(last), list(last.values())),))
        if len(kept) + 1 >= self.feed.runs:
            changed, by = combined([(items, sums), (changed, by)])
            for run in kept:
                self.runs.removeKey((run,))
            kept = {}
        self.runs.updateValue((max(kept, default=-1) + 1,), (packed(changed, by),))
        yield pd.DataFrame(out, columns=["nation_id", "arrival", "item_id", "cents", "stays"])

    def close(self) -> None:
        pass


def merged(rows: pd.DataFrame, feed: Feed) -> pd.DataFrame:
    """A nation's changes from those of its groups' boards (nation_id, arrival, item_id, cents, stays): days replayed, boards diffed."""
    ranking, last, out = Ranking({}), [], []
    nation = int(rows["nation_id"].iloc[0]) if len(rows) else 0
    for day, lines in rows.groupby("arrival", sort=True):
        gone = {}
        for item, cents, stays in zip(lines["item_id"].tolist(), lines["cents"].tolist(), lines["stays"].tolist(), strict=True):
            if stays:
                ranking.put(item, cents)
            else:
                gone[item] = cents
                ranking.drop(item)
        board = ranking.board(feed.size)
        old, new = ({item: n for n, item in enumerate(b, 1)} for b in (last, board))
        for item in dict.fromkeys([*board, *last]):
            was, now = old.get(item), new.get(item)
            if was != now:
                change = "enter" if was is None else "exit" if now is None else "move"
                out.append((nation, day, item, change, was, now, gone[item] if item in gone else ranking.revenue[item]))
        last = board
    made = pd.DataFrame(out, columns=["nation_id", "arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
    return made.astype({"old_rank": "Int32", "new_rank": "Int32"})


def session_for(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream's settings."""
    session = spark.newSession()
    for k in _KEPT:
        if (v := spark.conf.get(k, None)) is not None:
            session.conf.set(k, v)
    for k, v in _STREAM.items():
        session.conf.set(k, v)
    return session


def changes(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame, feed: Feed = Feed()) -> DataFrame:  # noqa: B008
    """nation_id, arrival_day, item_id, batch, change, old_rank, new_rank and revenue of each item whose rank on its nation's board changed on that day."""
    spark = sale_lines.sparkSession
    root = shared_dir(spark)
    prepared(sale_lines, vendors, items, feed, root).write.partitionBy("batch").parquet(f"{root}/feed")
    written = spark.read.schema(_LINES).parquet(f"{root}/feed")
    latest = dict(written.groupBy("batch").agg(F.max("day")).collect())  # a row for each batch
    session, bound = session_for(spark), None
    for batch in sorted(latest):
        start(session, root, [b for b in sorted(latest) if b <= batch], bound, feed)
        bound = max(latest[batch], bound) if bound is not None else latest[batch]
    if not latest:
        return spark.createDataFrame([], FEED)
    local = spark.read.schema(_LOCAL).parquet(f"{root}/local")
    out = local.groupBy("nation_id").applyInPandas(lambda rows: merged(rows, feed), _DIFF)
    return out.withColumn("batch", batch_of(F.col("arrival_day"), feed)).select(*(c.split()[0] for c in FEED.split(", ")))


def start(session: SparkSession, root: str, batches: list[int], bound: int | None, feed: Feed) -> None:
    """Starts the query on the batches so far, of which the checkpoint knows all but the last, and waits for its end."""
    lines = session.readStream.schema(_LINES.rpartition(",")[0]).parquet(f"{root}/feed/batch={{{','.join(map(str, batches))}}}")
    if bound is not None:
        lines = lines.filter(F.col("day") + feed.late >= bound)
    slot = F.pmod(F.xxhash64("item_id"), F.lit(feed.slots)).cast("int")
    sums = lines.filter(F.col("nation_id").isNotNull()).select("nation_id", slot.alias("slot"), "item_id", "arrival", "cents").mapInArrow(added_up, _SUMS)
    local = sums.groupBy("nation_id", "slot").transformWithStateInPandas(Slots(feed), _LOCAL, "append", "none")
    query = local.writeStream.format("parquet").outputMode("append").option("path", f"{root}/local").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
