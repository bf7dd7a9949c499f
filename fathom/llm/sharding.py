"""Sharding by fixed virtual slots (operator 6).

Records are hashed, by id, text and size, into n_slots virtual slots, a number that never changes; records without an id also by a number of their own, so that any number of
equal ones are many slots. The bytes of each slot are added up, and a versioned map tells the shard of every slot. Version 1 deals slots out in turn, before any bytes are
known; rebalancing edits the map: whole slots move, as few as are needed, and a new version is stored; records are never hashed anew. The law is `bytes`: shards hold
nearly equal bytes, within `slack` of the mean as far as slots can be moved.

Only the slot table (n_slots rows, a fixed number) reaches the driver. A row's place within its shard is the number of rows in the shard's
slots before its own, plus those of the parts before its own in its slot (`parts` of them, by a hash of the whole key, so that a slot that one id fills is several
tasks), plus its place within its part. So no shard and no slot is sorted in one task; rows of one id and text stay in one slot.

A null text has size 1 and the CRC of the empty text. Repeated rows get places of their own. An empty table
gives no rows and a map with every slot placed. Extra columns pass through; they are replaced where they are named like a result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.shared import id_text, materialise, quoted, shared_dir, text_bytes, unused

N_SLOTS = 4096


@dataclass
class SlotMap:
    """shard[s] is the shard of slot s in this version."""

    shard: list[int]
    n_shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)

    @staticmethod
    def initial(sizes: list[int], n_shards: int) -> SlotMap:
        """Largest slots first, each to the shard with the fewest bytes (then fewest slots, then the first)."""
        heap = [(0, 0, k) for k in range(n_shards)]
        shard = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
            total, count, k = heapq.heappop(heap)
            shard[slot] = k
            heapq.heappush(heap, (total + sizes[slot], count + 1, k))
        return SlotMap(shard, n_shards)

    def rebalanced(self, sizes: list[int], n_shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots leave shards that are over the mean by more than slack (or gone) for the lightest one, largest that fits first."""
        n = n_shards or self.n_shards
        shard, moved = list(self.shard), []
        total = [0] * n
        for s, k in enumerate(shard):
            if k < n:
                total[k] += sizes[s]
        mean = sum(sizes) / n
        homeless = [s for s, k in enumerate(shard) if k >= n]
        for s in sorted(homeless, key=lambda s: (-sizes[s], s)):
            shard[s] = min(range(n), key=lambda k: (total[k], k))
            total[shard[s]] += sizes[s]
            moved.append(s)
        open_ = range(self.n_shards, n) if n > self.n_shards else range(n)  # a grown map takes slots into the new shards only
        for s in sorted(range(len(shard)), key=lambda s: (-sizes[s], s)):
            k, to = shard[s], min(open_, key=lambda k: (total[k], k))
            if k != to and sizes[s] and total[k] > mean * (1 + slack) and total[to] + sizes[s] <= mean * (1 + slack):
                shard[s] = to
                total[k] -= sizes[s]
                total[to] += sizes[s]
                moved.append(s)
        return SlotMap(shard, n, self.version + 1, moved)

    def store(self, spark: SparkSession, path: str) -> None:
        """Versions are kept side by side; a stored one is never written again."""
        spark.createDataFrame([(s, k, self.n_shards) for s, k in enumerate(self.shard)], "slot int, shard int, n_shards int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == version).orderBy("slot").collect()
        return SlotMap([r.shard for r in found], found[0].n_shards, version)


def slot_of(id_col: str, crc: Column, size: Column, n_slots: int = N_SLOTS) -> Column:
    """Of records without an id, those that stand after each other in a task come to different slots."""
    ident = F.col(quoted(id_col))
    own = F.when(ident.isNull(), F.monotonically_increasing_id())
    return F.pmod(F.xxhash64(id_text(ident), crc, size, own), F.lit(n_slots)).cast("int")


def slot_table(rows: DataFrame, n_slots: int, number: str) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot, from columns virtual_slot, size and a number of rows."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.sum(number).alias("n")).collect():
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.b, r.n
    return sizes, counts


def shard(documents: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, map_path: str | None = None, parts: int = 16, slack: float = 0.002) -> DataFrame:
    """The columns `keep` (default: all) with size, text_crc32, virtual_slot, map_version, shard and slot, the row's place in its shard from 0."""
    spark, text = documents.sparkSession, F.col(quoted(text_col))
    size, crc = text_bytes(text) + 1, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    made = {"size": size, "text_crc32": crc, "virtual_slot": slot_of(id_col, crc, size, n_slots)}
    kept = [c for c in (documents.columns if keep is None else keep) if c not in {*made, "map_version", "shard", "slot"}]
    part, place, start, at_slot, at_part = unused([*kept, *made], "part", "place", "start", "at_slot", "at_part")
    ident = id_text(F.col(quoted(id_col)))
    rows = documents.select(*[F.col(quoted(c)) for c in kept], *(v.alias(k) for k, v in made.items()), ident.alias(place))
    rows = rows.withColumn(part, F.pmod(F.xxhash64(place, "text_crc32", "size", F.lit(5)), F.lit(parts)).cast("int"))
    where = shared_dir(spark)
    # Written, as a number of a record's own must not change between the two readings.
    rows = materialise(rows, f"{where}/sized")
    counts = materialise(rows.groupBy("virtual_slot", part).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), f"{where}/parts", n_slots * parts)
    sizes, per_slot = slot_table(counts, n_slots, "n")
    maps = map_path or f"{where}/slot_map"
    slots = SlotMap([s % n_shards for s in range(n_slots)], n_shards)
    slots.store(spark, maps)
    slots = slots.rebalanced(sizes, slack=slack)
    slots.store(spark, maps)
    before, seen = [0] * n_slots, [0] * n_shards
    for s, k in enumerate(slots.shard):
        before[s] = seen[k]
        seen[k] += per_slot[s]
    placed = spark.createDataFrame([(s, k, before[s], slots.version) for s, k in enumerate(slots.shard)], "virtual_slot int, shard int, before long, map_version int")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("virtual_slot").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("earlier", earlier).join(F.broadcast(placed), "virtual_slot")  # n_slots rows, and at most n_slots * parts
    starts = starts.select(F.col("virtual_slot").alias(at_slot), F.col(part).alias(at_part), (F.col("before") + F.col("earlier")).alias(start), "shard", "map_version")
    within = Window.partitionBy("virtual_slot", part).orderBy(place, "text_crc32", "size")
    numbered = rows.withColumn(place, F.row_number().over(within)).join(F.broadcast(starts), (F.col("virtual_slot") == F.col(at_slot)) & (F.col(part) == F.col(at_part)))
    return numbered.withColumn("slot", (F.col(start) + F.col(place) - 1).cast("long")).drop(start, place, part, at_slot, at_part)
