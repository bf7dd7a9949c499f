"""Breadth-first search from many starts at once over links between near vectors. Which starts reached a vector is a row of bits; the tasks that find near pairs pass the bits along, so
that no link and no (start, node) pair is a row before the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import cells, retrieval, store

#: Starts of one search (about), and vectors of a row of bits.
STARTS, SLICE = 8192, 2048
STATE = "b int, slice int, ids array<long>, seen binary, front binary"


def _bits(raw: bytes | pa.Buffer, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(rows, -1)


def _passed(to: np.ndarray, given: np.ndarray, front: np.ndarray, got: np.ndarray) -> None:
    """got[to] |= front[given] for links of which those to one vector stand together: the first link of each, then the second, and so on."""
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))[: len(to)]
    many = np.diff(np.append(first, len(to)))
    for k in range(many.max(initial=0)):
        at = first[many > k] + k
        got[to[at]] |= front[given[at]]


def _begin(nodes: DataFrame, starts: DataFrame, words: int) -> DataFrame:
    """STATE of every slice of vectors: the starts (b, slice, place, at) have reached themselves."""

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, own: pa.Table) -> pa.Table:
        bits = np.zeros((len(mine["ids"][0]), words), np.uint64)
        at = own["at"].to_numpy()
        bits[own["place"].to_numpy() % SLICE, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        raw = pa.array([bits.tobytes()], pa.binary())
        return pa.table([mine["b"], mine["slice"], mine["ids"], raw, raw], names=["b", "slice", "ids", "seen", "front"])

    return nodes.groupBy("b", "slice").cogroup(starts.groupBy("b", "slice")).applyInArrow(run, STATE)


def _fronts(state: DataFrame) -> DataFrame:
    """id, bits of the vectors that some start has just reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch["ids"], batch["front"], strict=True):
                bits = _bits(raw.as_buffer(), len(ids))
                live = np.flatnonzero(bits.any(axis=1))
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(live)), pa.array([x.tobytes() for x in bits[live]], pa.binary())], names=["id", "bits"])

    return state.select("ids", "front").mapInArrow(run, "id long, bits binary")


def _links(to: np.ndarray, by: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of to, row of by) of the links between two sets of unit vectors, a tile at a time in order of `to`. Products have single precision; those within its error of the threshold
    are made again in double."""
    error = 1e-6 + to.shape[1] * 2.0**-23
    single = to.astype(np.float32), by.astype(np.float32)
    for low in range(0, len(to), retrieval.TILE):
        for start in range(0, len(by), retrieval.TILE):
            part = single[1][start : start + retrieval.TILE]
            near = (single[0][low : low + retrieval.TILE] @ part.T).ravel()
            k = np.flatnonzero(near >= threshold - error)
            i, j = low + k // len(part), start + k % len(part)
            doubt = np.flatnonzero(near[k] <= threshold + error)
            keep = np.ones(len(k), bool)
            keep[doubt] = np.einsum("ij,ij->i", to[i[doubt]], by[j[doubt]]) >= threshold
            yield i[keep], j[keep]


def _met(units: DataFrame, width: int, words: int, threshold: float) -> DataFrame:
    """b, slice, got: for slices of either block of a unit the bits of the near vectors of the other side. Only vectors with bits are multiplied with the other side; if these are most,
    both sides are multiplied once for both ways."""

    def run(key: tuple[pa.Scalar, ...], unit: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(unit).sort_by("id")
        given = rows["bits"].is_valid().to_numpy()
        if not given.any():
            return
        front, got = np.zeros((2, len(rows), words), np.uint64)
        front[given] = _bits(b"".join(x.as_buffer() for x in rows["bits"].filter(given)), int(given.sum()))
        ids, block, m = rows["id"].to_numpy(), rows["b"].to_numpy(), retrieval._unit_matrix(rows["v"].combine_chunks(), width)
        p, q = (np.flatnonzero(block == k.as_py()) for k in key)
        if key[0] != key[1] and 2 * given.sum() > len(rows):
            for i, j in _links(m[p], m[q], threshold):
                to, by = p[i], q[j]
                _passed(to, by, front, got)
                order = np.argsort(j, kind="stable")
                _passed(by[order], to[order], front, got)
        else:
            for to, by in [(p, q), (q, p)][: 1 + (key[0] != key[1])]:
                by = by[given[by]]
                for i, j in _links(m[to], m[by], threshold):
                    _passed(to[i], by[j], front, got)
        for x in {k.as_py() for k in key}:
            own = np.flatnonzero(block == x)
            if not len(own):
                continue
            first = np.flatnonzero(np.concatenate([[True], ids[own[1:]] != ids[own[:-1]]]))  # rows of one id become one
            mine = np.bitwise_or.reduceat(got[own], first, axis=0)
            for low in range(0, len(mine), SLICE):
                if (part := mine[low : low + SLICE]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([low // SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["b", "slice", "got"])

    return units.groupBy("p", "q").applyInArrow(run, "b int, slice int, got binary")


def _next(state: DataFrame, met: DataFrame) -> DataFrame:
    """STATE after a round: the front is what was not seen before."""

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, found: pa.Table) -> pa.Table:
        seen = _bits(mine["seen"][0].as_buffer(), len(mine["ids"][0])).copy()
        front = np.zeros_like(seen)
        for x in found["got"]:
            front |= _bits(x.as_buffer(), len(seen))
        front &= ~seen
        return pa.table([mine["b"], mine["slice"], mine["ids"], *(pa.array([x.tobytes()], pa.binary()) for x in (seen | front, front))], names=["b", "slice", "ids", "seen", "front"])

    return state.groupBy("b", "slice").cogroup(met.groupBy("b", "slice")).applyInArrow(run, STATE)


def _rows(state: DataFrame, names: DataFrame) -> DataFrame:
    """start, node of the front; names: one row with the starts in order of their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, starts in zip(batch["ids"], batch["front"], batch["starts"], strict=True):
                ids, starts = ids.values.to_numpy(), starts.values.to_numpy()
                whole = _bits(raw.as_buffer(), len(ids)).view(np.uint8)
                for low in range(0, len(ids), 64):
                    node, at = np.nonzero(np.unpackbits(whole[low : low + 64], axis=1, bitorder="little"))
                    yield pa.RecordBatch.from_arrays([pa.array(starts[at]), pa.array(ids[low + node])], names=["start", "node"])

    return state.select("ids", "front").crossJoin(F.broadcast(names)).mapInArrow(run, "start long, node long")


def near_depths(vectors: DataFrame, starts: DataFrame, threshold: float, depth: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """start, node, depth: vectors within `depth` steps of each start (id) over the links of retrieval.similar_pairs; a start is its own node at depth 0.

    A step multiplies all pairs of blocks again instead of keeping their links, for about STARTS starts at a time: a task holds two blocks and a bit for each of their vectors and
    each of these starts. Rows without an id have no links."""
    rounds = store.Rounds(vectors.sparkSession, "front")
    base = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n, width = retrieval._blocks(base, 1024)
    home = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b")
    placed = cells._numbered(base.select(home, "id").distinct()).withColumn("slice", F.floor(F.col("place") / SLICE).cast("int"))
    placed, _ = rounds.put(placed)
    nodes, _ = rounds.put(placed.groupBy("b", "slice").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = starts.select("id").filter("id is not null").distinct()
    searches = max(1, -(-asked.count() // STARTS))
    asked = asked.withColumn("search", F.pmod(F.xxhash64("id", F.lit(0)), F.lit(searches)).cast("int"))
    asked, _ = rounds.put(asked.withColumn("at", F.row_number().over(Window.partitionBy("search").orderBy("id")) - 1))
    out = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).cast("long").alias("depth"))
    for search, size in sorted(asked.groupBy("search").count().collect()):
        mine, words = asked.filter(F.col("search") == search), -(-size // 64)
        names = mine.agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("z")).select(F.col("z.id").alias("starts"))
        state, _ = rounds.put(_begin(nodes, placed.join(mine, "id").select("b", "slice", "place", "at"), words))
        for step in range(1, depth + 1):
            units = retrieval._paired(base.join(_fronts(state), "id", "left"), n)
            state, _ = rounds.put(_next(state, _met(units, width, words, threshold)))
            out = out.unionAll(_rows(state, names).select("start", "node", F.lit(step).cast("long").alias("depth")))
    return out
