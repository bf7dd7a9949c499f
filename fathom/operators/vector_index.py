"""A kept vector store: upsert, delete, search and rebuild of a collection, in cells of near vectors.

A collection is a folder. Its base has `centroids` (k-means over a bounded sample, by distributed Lloyd rounds) and inverted lists: (cell, part, id, code, step) with the vector's
unit form in one signed byte a dimension, sorted by cell so that a scan skips other cells' row groups; whole vectors stand beside them. An upsert writes a segment
of the same form with the next generation, a delete writes ids; of an id the last generation counts, so nothing is rewritten until `rebuild`, which trains anew over what
is live. The log (store.Log) says which folders hold.

A search finds the `probes` nearest cells of each question (without a number: as many as the wanted recall took for a sample of the base's own vectors, measured at
each rebuild, for vectors without near neighbours need many), multiplies questions with the lists' codes cell by cell, keeps `refine` times k candidates a question and ranks
them by the cosine of the whole vectors. A cell is dealt into parts of about part_rows, so copies of one vector, which all fall into one cell, are many groups.
`search(exact=True)` multiplies all live vectors instead.

Vectors that are null, empty or of another length than the collection's are left out; vectors of length zero score 0. Of several rows for an id in one upsert one stays, the
greatest vector. Equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators import retrieval, store

_LIST = "cell int, id long, code binary, step float"


@dataclass(frozen=True)
class Cells:
    """How a base is trained. cells: None for the square root of the number of vectors. Centroids go to every task: most_cells x dimensions x 8 bytes bound them."""

    cells: int | None = None
    rounds: int = 8
    sample: int = 100_000
    most_cells: int = 16_384
    part_rows: int = 50_000
    seed: int = 7
    #: Share of the ten nearest that a search without a number of probes is to find, judged on calls vectors of the base when it is built.
    recall: float = 0.95
    calls: int = 200


def unit(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows of the vectors that have this width, which those are)."""
    sizes = np.array([len(v) if v is not None else -1 for v in vectors.to_pylist()]) if vectors.null_count else np.diff(vectors.offsets.to_numpy())
    good = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0), good


def nearest(rows: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """Places of the k centroids of greatest product, for unit rows and unit centroids."""
    got = np.round(rows @ centroids.T, 12)
    if k == 1:
        return got.argmax(axis=1)[:, None]
    return np.argsort(-got, axis=1, kind="stable")[:, :k]


def train(vectors: DataFrame, width: int, count: int, how: Cells) -> np.ndarray:
    """Unit centroids of a sample (id, vector): each round, tasks add up the rows of each cell and only sums come back, a row a cell. Cells that lose all rows keep their centroid."""
    spark = vectors.sparkSession
    share = min(1.0, how.sample / max(count, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = store.written(drawn, store.new_folder(spark, "sample"))
    cells = max(1, min(how.most_cells, how.cells or round(count**0.5)))
    first = sample.orderBy(F.xxhash64("id", F.lit(how.seed + 1)), "id").limit(cells).collect()
    start, _ = unit(pa.array([r.vector for r in first], pa.list_(pa.float64())), width)
    centroids = np.unique(start, axis=0)
    for _ in range(how.rounds):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            middle = sent.value
            total, n = np.zeros_like(middle), np.zeros(len(middle), np.int64)
            for batch in batches:
                rows, _ = unit(batch.column(1), width)
                cell = nearest(rows, middle)[:, 0]
                np.add.at(total, cell, rows)
                n += np.bincount(cell, minlength=len(middle))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64())), pa.array(n[used], pa.int64())], ["cell", "total", "n"])

        parts = sample.mapInArrow(sums, "cell int, total array<double>, n long")
        added = parts.select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("x")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
        new = centroids.copy()
        for cell, xs in added.select("cell", F.transform("xs", lambda p: p["x"])).collect():
            v = np.array(xs)
            if (norm := np.linalg.norm(v)) > 0:
                new[cell] = v / norm
        sent.unpersist()
        if np.allclose(new, centroids, atol=1e-9):
            break
        centroids = new
    return centroids


@dataclass
class Collection:
    """One collection of vectors (documents, memories, ...) below a folder."""

    spark: SparkSession
    path: str
    width: int
    how: Cells = Cells()

    def _log(self) -> store.Log:
        return store.Log(self.spark, self.path)

    def _centroids(self, base: str) -> np.ndarray:
        rows = self.spark.read.parquet(f"{base}/centroids").orderBy("cell").collect()
        return np.array([r.centroid for r in rows]).reshape(len(rows), self.width)

    def _usable(self, items: DataFrame) -> DataFrame:
        """id, vector: one row for each id."""
        rows = items.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        return rows.filter(F.col("id").isNotNull() & (F.size("vector") == self.width)).groupBy("id").agg(F.max("vector").alias("vector"))

    def _segment(self, items: DataFrame, folder: str, centroids: np.ndarray) -> None:
        """Vectors and lists of one generation."""
        rows = store.written(items, f"{folder}/vectors")
        sent, width = self.spark.sparkContext.broadcast(centroids), self.width

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit_rows, good = unit(batch.column(1), width)
                step = np.maximum(np.abs(unit_rows).max(axis=1, initial=0), 1e-30) / 127
                codes = np.round(unit_rows / step[:, None]).astype(np.int8)
                cell = nearest(unit_rows, sent.value)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).take(pa.array(good)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step, pa.float32())], ["cell", "id", "code", "step"])

        lists = rows.mapInArrow(code, _LIST)
        parts = lists.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / self.how.part_rows)).cast("int").alias("parts"))
        store.written(parts, f"{folder}/parts")
        dealt = lists.join(self.spark.read.parquet(f"{folder}/parts"), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        dealt.repartitionByRange("cell", "part", "id").sortWithinPartitions("cell", "part").select("cell", "part", "id", "code", "step").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/lists")

    def rebuild(self, items: DataFrame | None = None) -> None:
        """A new base: of items (id, vector), or of what is live."""
        log = self._log()
        entries = log.entries()
        generation = entries[-1][0] + 1 if entries else 0
        folder = f"{self.path}/base-{generation:09d}"
        rows = store.written(self._usable(self.live() if items is None else items), f"{folder}/rows")
        count = rows.count()
        centroids = train(rows, self.width, count, self.how)
        made = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
        store.written(made.coalesce(1), f"{folder}/centroids")
        self._segment(rows, folder, centroids)
        log.add(generation, "base", folder, count, self._probes(rows, folder, centroids, count))

    def _probes(self, rows: DataFrame, folder: str, centroids: np.ndarray, count: int) -> int:
        """How many of its nearest cells a sampled vector has to look at for the wanted share of its ten nearest others."""
        share = min(1.0, self.how.calls / max(count, 1))
        drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(self.how.seed + 2)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vec"))
        drawn = store.written(drawn, store.new_folder(self.spark, "calls"))
        others = retrieval.knn(rows, drawn, 11, id_col="id", vector_col="vector").filter("id <> query_id").select("query_id", "id")
        cells = {}
        for r in others.join(self.spark.read.parquet(f"{folder}/lists").select("id", "cell"), "id").select("query_id", "cell").collect():
            cells.setdefault(r.query_id, []).append(r.cell)
        ranks = []
        for r in drawn.collect():
            v, _ = unit(pa.array([r.query_vec], pa.list_(pa.float32())), self.width)
            place = np.argsort(nearest(v, centroids, len(centroids))[0])
            ranks += place[cells.get(r.query_id, [])].tolist()
        return int(np.quantile(ranks, self.how.recall, method="higher")) + 1 if ranks else 1

    def upsert(self, items: DataFrame) -> None:
        """items (id, vector): new ones, and other vectors for ids that are there. One segment is written; the others stay as they are."""
        log = self._log()
        entries = log.entries()
        if not entries:
            return self.rebuild(items)
        generation = entries[-1][0] + 1
        folder = f"{self.path}/segment-{generation:09d}"
        self._segment(self._usable(items), folder, self._centroids(entries[0][2]))
        log.add(generation, "segment", folder, self.spark.read.parquet(f"{folder}/vectors").count())

    def delete(self, ids: DataFrame) -> None:
        """ids (id)."""
        log = self._log()
        entries = log.entries()
        if entries:
            generation = entries[-1][0] + 1
            folder = f"{self.path}/gone-{generation:09d}"
            gone = store.written(ids.select(F.col("id").cast("long").alias("id")).distinct(), folder)
            log.add(generation, "gone", folder, gone.count())

    def _all(self, kind: str, columns: str, entries: list) -> DataFrame | None:
        """Tables of base and segments with their generation."""
        out = None
        for generation, what, folder, *_ in entries:
            if what != "gone":
                one = self.spark.read.schema(columns).parquet(f"{folder}/{kind}").withColumn("generation", F.lit(generation))
                out = one if out is None else out.unionByName(one)
        return out

    def _replaced(self, entries: list) -> DataFrame | None:
        """id, until: rows of an id with a lower generation are dead. Only upserts and deletes since the base are read."""
        out = None
        for generation, what, folder, *_ in entries[1:]:
            one = self.spark.read.schema("id long").parquet(folder if what == "gone" else f"{folder}/vectors").select("id", F.lit(generation).alias("until"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("id").agg(F.max("until").alias("until")) if out is not None else None

    def _alive(self, rows: DataFrame, entries: list) -> DataFrame:
        dead = self._replaced(entries)
        if dead is None:
            return rows
        dead = dead.withColumnRenamed("id", "dead_id")
        return rows.join(dead, (F.col("id") == F.col("dead_id")) & (F.col("generation") < F.col("until")), "left_anti")

    def live(self) -> DataFrame:
        """id, vector as they are now."""
        entries = self._log().entries()
        rows = self._all("vectors", "id long, vector array<float>", entries)
        if rows is None:
            return self.spark.createDataFrame([], "id long, vector array<float>")
        return self._alive(rows, entries).select("id", "vector")

    def search(self, questions: DataFrame, k: int, threshold: float = -1.0, probes: int | None = None, refine: int = 4, exact: bool = False) -> DataFrame:
        """query_id, id, score, rank of the k nearest live vectors for each question (query_id, query_vec)."""
        entries = self._log().entries()
        usable = questions.select("query_id", F.col("query_vec").cast("array<float>").alias("query_vec")).filter(F.size("query_vec") == self.width)
        if exact or not entries:
            return retrieval.knn(self.live(), usable, k, threshold, "id", "vector")
        usable = store.written(usable, store.new_folder(self.spark, "questions"))
        width, kept = self.width, k * refine
        probes = probes or int(entries[0][4])
        sent = self.spark.sparkContext.broadcast(self._centroids(entries[0][2]))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, good = unit(batch.column(1), width)
                cells = nearest(rows, sent.value, min(probes, len(sent.value)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(rows), pa.list_(pa.float64()))], ["query_id", "cells", "q"])

        asked = usable.mapInArrow(probe, "query_id long, cells array<int>, q array<double>").select("query_id", F.explode("cells").alias("cell"), "q")
        parts = self._all("parts", "cell int, parts int", entries).groupBy("cell").agg(F.max("parts").alias("parts"))
        asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")
        lists = self._alive(self._all("lists", "cell int, part int, id long, code binary, step float", entries), entries).drop("generation")
        lists = lists.join(asked.select("cell").distinct(), "cell", "left_semi")

        def score(key: tuple, rows: pa.Table, questions: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            if rows.num_rows and questions.num_rows:
                codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.int8).reshape(-1, width).astype(np.float32) * rows["step"].to_numpy()[:, None]
                ids, names = rows["id"].to_numpy(), questions["query_id"].to_numpy()
                q = np.array(questions["q"].to_pylist(), np.float32)
                pieces = []
                for low in range(0, len(q), 256):
                    got = q[low : low + 256] @ codes.T
                    n = min(kept, got.shape[1])
                    best = np.argpartition(-got, n - 1, axis=1)[:, :n]
                    pieces.append((np.repeat(names[low : low + 256], n), ids[best].ravel(), np.take_along_axis(got, best, 1).ravel()))
                out = [np.concatenate(x) for x in zip(*pieces, strict=True)]
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "near": pa.array(out[2], pa.float64())})

        found = lists.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(score, "query_id long, id long, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= kept).select("query_id", "id")
        exactly = found.join(self.live(), "id").join(usable.withColumnRenamed("query_id", "of"), F.col("query_id") == F.col("of")).select("query_id", "id", "vector", "query_vec")

        def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, _ = unit(batch.column(2), width)
                b, _ = unit(batch.column(3), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(axis=1), pa.float64())], ["query_id", "id", "score"])

        scored = exactly.mapInArrow(cosines, "query_id long, id long, score double").filter(F.col("score") >= threshold)
        by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
        return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
