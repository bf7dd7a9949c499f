"""Ranked lists: vector search, fusion, hybrid search, boosts, diversification, readiness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import vectors as V

RRF_K = 60
#: Queries and blocks of vectors that a task holds at once.
BLOCK = 2048
#: Queries that a task multiplies with one batch at a time, which bounds its memory whatever the number of queries.
STRIP = 128


def top(df: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of every group, with rank; ties by id. Spark keeps k rows a task and group before the exchange."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK) -> DataFrame:
    """query_id, id, score (cosine), rank: the k nearest of every query with at least the threshold, exactly.

    queries (query_id, query_vec) come to the tasks in blocks of block_rows, each multiplied with the scanned batches; a task gives k rows a query
    and batch, and the last exchange keeps k. Zero vectors and vectors of another length score 0."""
    lists = None
    pulled = queries.select("query_id", "query_vec").toLocalIterator(prefetchPartitions=True)  # a block at a time, whatever the number of queries
    block: list = []

    def flush(block: list) -> DataFrame:
        ids = [r.query_id for r in block]
        matrix = _unit_rows([r.query_vec for r in block])
        sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            asked = np.array(names)
            for batch in batches:
                m = _unit_matrix(batch.column(1), q.shape[1])
                own = batch.column(0).to_numpy(zero_copy_only=False)
                for low in range(0, len(asked) if len(own) else 0, STRIP):
                    which, place, score = _best(q[low : low + STRIP] @ m.T, own, k, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[low + which], pa.int64()), pa.array(own[place], pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

        return vectors.select(id_col, vector_col).mapInArrow(run, "query_id long, id long, score double")

    for row in pulled:
        block.append(row)
        if len(block) == block_rows:
            part = flush(block)
            lists = part if lists is None else lists.unionAll(part)
            block = []
    if block or lists is None:
        part = flush(block) if block else vectors.sparkSession.createDataFrame([], "query_id long, id long, score double")
        lists = part if lists is None else lists.unionAll(part)
    return top(lists, k, ["query_id"], tie="id")


def _best(got: np.ndarray, own: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best of each row of got with at least the threshold; scores are compared by 12 decimal places, equal ones go by own."""
    rounded = np.where(np.isnan(got), -np.inf, np.round(got, 12))
    kept = min(k, got.shape[1])
    least = np.partition(rounded, got.shape[1] - kept, axis=1)[:, got.shape[1] - kept]
    row, col = np.nonzero(rounded >= least[:, None])  # the k best and what is equal to the last of them
    order = np.lexsort((own[col], -rounded[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(got)))
    keep = np.arange(len(row)) - start[row] < kept
    row, col = row[keep], col[keep]
    score = got[row, col]
    keep = score >= threshold
    return row[keep], col[keep], score[keep]


def _unit_rows(rows: list, width: int | None = None) -> np.ndarray:
    width = width or max((len(r) for r in rows if r is not None), default=1)
    m = np.array([r if r is not None and len(r) == width else [0.0] * width for r in rows], float).reshape(len(rows), width)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Blocks that vectors are dealt to, so that their copies are so many times the table at most, and rows a block may have before there are more.
BLOCKS, LARGEST = 24, 65536
#: Rows of either side of one matrix product.
TILE = 1024


def _unit_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1; vectors of another length than width are zeros."""
    good = pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), width)
    m = np.zeros((len(vectors), width))
    m[good.to_numpy(zero_copy_only=False)] = vectors.filter(good).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _blocks(rows: DataFrame, block_rows: int) -> tuple[int, int]:
    """How many blocks rows (id, v) are dealt to, and the vectors' length. Blocks grow with the table before they get more, so a row is sent BLOCKS times at most up to
    BLOCKS * LARGEST rows."""
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return max(1, min(-(-count // block_rows), max(BLOCKS, -(-count // LARGEST)))), max(width or 1, 1)


def _paired(rows: DataFrame, n: int) -> DataFrame:
    """Rows (p, q, b, the columns of rows) of every pair of n blocks."""
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", *rows.columns)


def _units(vectors: DataFrame, id_col: str, vector_col: str, block_rows: int) -> tuple[DataFrame, int]:
    """Rows (p, q, b, id, v) of every pair of blocks, and the vectors' length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n, width = _blocks(rows, block_rows)
    return _paired(rows, n), width


def _near(key: tuple, unit: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other id, cosine) of the pairs of one unit with at least the threshold, each pair once, a tile at a time."""
    rows = pa.Table.from_batches(unit)
    p, q = (k.as_py() for k in key)
    ids, blocks, m = rows["id"].to_numpy(), rows["b"].to_numpy(), _unit_matrix(rows["v"].combine_chunks(), width)
    sides = [(ids[blocks == x], m[blocks == x]) for x in ((p,) if p == q else (p, q))]
    (left, lm), (right, rm) = sides[0], sides[-1]
    for low in range(0, len(left), TILE):
        for start in range(low if p == q else 0, len(right), TILE):
            got = lm[low : low + TILE] @ rm[start : start + TILE].T
            i, j = np.nonzero(got >= threshold)
            if p == q and start == low:
                i, j = i[i < j], j[i < j]
            a, b, s = left[low + i], right[start + j], got[i, j]
            keep = a != b
            yield a[keep], b[keep], s[keep]


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024) -> DataFrame:
    """id_a < id_b, similarity: all pairs with at least this cosine, by blocked matrix products.

    A pair of blocks meets in one task, which gives its pairs a tile at a time; no row pair is ever a row before the threshold. Vectors of another length than the longest
    have cosine 0."""
    units, width = _units(vectors, id_col, vector_col, block_rows)

    def run(key: tuple[pa.Scalar, ...], unit: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, s in _near(key, unit, width, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], names=["id_a", "id_b", "similarity"])

    return units.groupBy("p", "q").applyInArrow(run, "id_a long, id_b long, similarity double")


def near_rows(rows: DataFrame, threshold: float, give: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, block_rows: int = 1024, by: str = "id") -> DataFrame:
    """What `give` makes of the pairs of similar_pairs, a tile at a time, in the tasks that find them: of rows (id, v and more columns), places of the pairs' rows a with the lesser id and
    b, and similarities. Rows with equal `by` are in one block, so the pairs of two values of it meet in one task; give is called with empty places when a task's pairs are through."""
    n, width = _blocks(rows, block_rows)
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    units = dealt.select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", *rows.columns)

    def run(key: tuple[pa.Scalar, ...], unit: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(unit).combine_chunks()
        ids = whole["id"].to_numpy()
        placed = whole.select(["b", "v"]).append_column("id", pa.array(np.arange(len(ids))))
        for a, b, s in _near(key, placed.to_batches(), width, threshold):
            other = ids[a] != ids[b]
            a, b, s = a[other], b[other], s[other]
            if len(a):
                less = ids[a] < ids[b]
                yield from give(whole, np.where(less, a, b), np.where(less, b, a), s)
        yield from give(whole, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return units.groupBy("p", "q").applyInArrow(run, schema)


def packed_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024) -> DataFrame:
    """The pairs of similar_pairs as rows (p, q, sources, targets) of ids: a row for each tile that has some. p and q are the blocks of the two vectors, so a pair has one (p, q)."""
    units, width = _units(vectors, id_col, vector_col, block_rows)

    def run(key: tuple[pa.Scalar, ...], unit: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = (k.as_py() for k in key)
        for a, b, _ in _near(key, unit, width, threshold):
            if len(a):
                whole = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(x)) for x in (np.minimum(a, b), np.maximum(a, b))]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), *whole], names=["p", "q", "sources", "targets"])

    return units.groupBy("p", "q").applyInArrow(run, "p int, q int, sources array<long>, targets array<long>")


def nearest_pairs(vectors: DataFrame, k: int, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024) -> DataFrame:
    """id_a < id_b, similarity: the pairs with at least this cosine that are among the k nearest of one of their rows, ties by the other's id. Every task keeps k for each of its
    rows, so what is shuffled grows with the rows, not with the pairs."""
    units, width = _units(vectors, id_col, vector_col, block_rows)

    def best(parts: list[tuple]) -> tuple:
        a, b, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
        keep = np.arange(len(a)) - first < k
        return a[keep], b[keep], s[keep]

    def run(key: tuple[pa.Scalar, ...], unit: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = [], [], 0
        for a, b, s in _near(key, unit, width, threshold):
            waiting += [(a, b, s), (b, a, s)]
            size += 2 * len(a)
            if size > 1 << 20:
                held, waiting, size = [best(held + waiting)], [], 0
        if held or waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(held + waiting)], names=["id", "other", "similarity"])

    mine = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    rows = units.groupBy("p", "q").applyInArrow(run, "id long, other long, similarity double").withColumn("n", F.row_number().over(mine)).filter(F.col("n") <= k)
    return rows.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "similarity").distinct()


def fuse(lists: list[tuple[DataFrame, float]], k: int = RRF_K, by: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, doc_id, rank) with their weights."""
    parts = [df.select(by, "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy(by, "doc_id").agg(F.sum("part").alias("score"))


def hybrid(words: DataFrame, vectors: DataFrame, limit: int, alpha: float = 0.4, threshold: float = 0.0) -> DataFrame:
    """Word scores (query_id, doc_id, score) cut to 3 times the limit and vector scores cut to 5 times, the threshold on vectors only, fused with weights
    1 - alpha and alpha, best `limit`."""
    a = top(words, 3 * limit, ["query_id"])
    b = top(vectors.filter(F.col("score") >= threshold), 5 * limit, ["query_id"])
    return top(fuse([(a, 1 - alpha), (b, alpha)]), limit, ["query_id"])


def symbol_boost(score: Column, symbol: Column, tokens: Column) -> Column:
    """The first query token that hits: equal to the symbol +0.15, one inside the other +0.08; at most 1."""
    s = F.lower(symbol)
    hits = F.filter(F.transform(tokens, lambda t: F.when(s == t, 0.15).when(s.contains(t) | F.contains(t, s), 0.08)), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.least(F.lit(1.0), score + hits[0])).otherwise(score)


def readiness(results: DataFrame, expected: int = 5, memories: bool = True, by: str = "query_id") -> DataFrame:
    """Per query: coverage, top_similarity, coherence, quality_avg, freshness, confidence, recommendation. results: similarity, rank, quality_score, age_hours (of the
    last access, null if unknown)."""
    weights = (0.2, 0.3, 0.15, 0.2, 0.15) if memories else (0.3, 0.4, 0.3, 0.0, 0.0)
    decay = F.greatest(F.lit(0.1), F.exp(F.lit(-np.log(2) / 168.0) * F.greatest(F.col("age_hours"), F.lit(0.0))))
    n = F.count(F.lit(1))
    mean = F.avg("similarity")
    got = results.groupBy(by).agg(
        F.least(n / expected, F.lit(1.0)).alias("coverage"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top_similarity"),
        F.when(n == 1, 0.5).when(mean == 0, 0.0).otherwise(V.clamp(1 - F.stddev_pop("similarity") / mean)).alias("coherence"),
        F.coalesce(F.avg("quality_score"), F.lit(0.5)).alias("quality_avg"),
        F.coalesce(F.avg(F.when(F.col("age_hours").isNotNull(), decay)), F.lit(0.5)).alias("freshness"),
    )
    names = ("coverage", "top_similarity", "coherence", "quality_avg", "freshness")
    confidence = sum((F.col(c) * w for c, w in zip(names, weights, strict=True)), F.lit(0.0))
    weak = F.array_join(F.array_compact(F.array(*[F.when((F.col(c) < 0.5) & F.lit(w > 0), c) for c, w in zip(names, weights, strict=True)])), ",")
    got = got.withColumn("confidence", confidence).withColumn("weak_factors", weak)
    return got.withColumn("recommendation", F.when(F.col("confidence") >= 0.7, "proceed").when(F.col("confidence") >= 0.4, "warn").otherwise("insufficient"))


def _greedy(pool: pd.DataFrame, lam: float) -> pd.DataFrame:
    with_vector = pool[pool.vec.map(lambda v: v is not None)]
    rest = pool.drop(with_vector.index)
    m = _unit_rows(list(with_vector.vec)) if len(with_vector) else np.zeros((0, 1))
    similar = m @ m.T
    relevance, ids = with_vector.similarity.to_numpy(float), with_vector.id.to_numpy()
    left, chosen, scores = list(range(len(with_vector))), [], []
    nearest = np.zeros(len(with_vector))
    while left:
        value = {i: lam * relevance[i] - (1 - lam) * nearest[i] for i in left}
        best = min(left, key=lambda i: (-round(value[i], 12), ids[i]))
        chosen.append(best)
        scores.append(value[best])
        left.remove(best)
        nearest = np.maximum(nearest, similar[best])
    out = with_vector.iloc[chosen].assign(score=scores)
    out = pd.concat([out, rest.sort_values("id").assign(score=rest.similarity)])
    return out.assign(rank=np.arange(1, len(out) + 1))


def mmr(pools: DataFrame, lam: float = 0.8, limit: int | None = None) -> DataFrame:
    """Maximal marginal relevance in each query's pool (query_id, id, similarity, vec): score is lam * similarity - (1 - lam) * the greatest similarity to a row chosen
    before (0 at least). Rows without a vector follow. Pools are over-fetched lists of bounded length."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        out = _greedy(pool, lam)[["query_id", "id", "score", "rank"]]
        return out if limit is None else out[out["rank"] <= limit]

    return pools.groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, rank int")


def diverse(pools: DataFrame, most: float = 0.85) -> DataFrame:
    """Rows of each pool in rank order, without those whose cosine to a kept one is over `most`; rows without a vector stay."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank")
        kept: list[np.ndarray] = []
        keep = []
        for v in pool.vec:
            if v is None:
                keep.append(True)
                continue
            u = _unit_rows([list(v)])[0]
            keep.append(all(len(u) != len(w) or u @ w <= most for w in kept))
            if keep[-1]:
                kept.append(u)
        return pool[keep][["query_id", "id", "rank"]]

    return pools.groupBy("query_id").applyInPandas(run, "query_id long, id long, rank int")


def working_set(memories: DataFrame, limit: int) -> DataFrame:
    """Pinned rows (invariant or corrected twice) first, then valid ones by priority; ties by id."""
    pinned = F.col("is_invariant") | (F.col("correction_count") >= 2)
    rows = memories.filter(pinned | F.col("valid")).withColumn("pinned", pinned)
    order = [F.desc("pinned"), F.desc("priority"), F.col("id")]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reference_similarity(vectors: DataFrame, references: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greatest (0 at least) and mean cosine of every vector to a small registered set (name, ref_vec)."""
    m = F.broadcast(references.groupBy().agg(F.collect_list("ref_vec").alias("refs")))
    cos = F.transform("refs", lambda r: V.cosine(F.col(vector_col), r))
    return vectors.crossJoin(m).select(F.col(id_col).alias("id"), F.greatest(F.lit(0.0), F.array_max(cos)).alias("max_similarity"), (F.aggregate(cos, F.lit(0.0), lambda s, x: s + x) / F.size("refs")).alias("mean_similarity"))


def ppr_rerank(results: DataFrame) -> DataFrame:
    """semantic, ppr and centrality, each over its greatest in the query, blended .5, .3, .1 and scaled by feedback. results: query_id, id, semantic, ppr, centrality, feedback."""
    w = Window.partitionBy("query_id")
    share = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    return results.withColumn("score", (0.5 * share("semantic") + 0.3 * share("ppr") + 0.1 * share("centrality")) * (1 + 0.1 * (F.col("feedback") - 1)))
