"""N-gram Jaccard join by blocked sparse matrix products (operator 5).

1. Every text becomes its set of word shingles, as fingerprints of 128 bits. Documents with the same set are one class, so copies cost one row.
2. Document frequencies of all shingles come from the packed exchange. A pair at the threshold shares a shingle among the first
   n - ceil(t n) + 1 of each set in order of rarity; shingles of one document alone are left out of sets, as they overlap with nothing.
3. Documents that share such a prefix shingle are joined to the least of them; the components of these candidate edges are groups outside which no
   pair can link.
4. A group is dealt into blocks by size band and hash. Blocks whose sizes can reach the threshold meet in one task, which multiplies the
   document by n-gram incidence matrices, column block by column block, adding up overlap counts; pairs below the bound that follows from the two sizes are
   discarded. A task gives one row per document (its root in a spanning forest, its number of links), never pairs.
5. Components of the forests are the result. A third of all documents in one near-copy group makes many blocks of bounded size, not one task.

Null or empty texts, and texts with no word, have no shingle and link with nothing; their component is their own id. A text with fewer words than a
shingle is one shingle. A component's id is its least id that is not null, or null if all are. Repeated rows are members of one class. An empty table gives no
row. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import exchange
from fathom.llm.components import components
from fathom.llm.hashing import shingle_sets
from fathom.llm.shared import map_rows, materialise, quoted, shared_dir, unused


@dataclass(frozen=True)
class Join:
    width: int = 4
    #: Linked: 100 * intersection >= percent * union.
    percent: int = 85
    block: int = 512
    chunk_bytes: int = 4 << 20
    columns: int = 4096


def sets_of(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text its shingles, two lanes of 64 bits, ascending by the first."""
    return shingle_sets([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], width)


def _class_key(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if items.shape[1] else None


def _members(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_class_key, sets), pa.binary()), pa.array([x.shape[1] for x in sets], pa.int64())], names=["doc_id", "node", "n"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, node binary, n long")


def _representatives(texts: DataFrame, width: int, chunks: int) -> DataFrame:
    """(chunk, node, text), a row for each class; texts are compressed. A task sends a class once, and what several tasks send becomes one row before Python gets
    the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[tuple[int, bytes, bytes]] = []
            found = batch.column(0).to_pylist()
            for text, key in zip(found, map(_class_key, sets_of(found, width)), strict=True):
                if key and key not in seen:
                    seen.add(key)
                    out.append((int.from_bytes(key[:8], "little") % chunks, key, press.compress(text.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "node", "text"])

    sent = texts.mapInArrow(run, "chunk long, node binary, text binary").repartition("chunk")
    return sent.groupBy("chunk", "node").agg(F.first("text").alias("text"))


def _sets(chunk: pa.Table, width: int) -> dict[bytes, np.ndarray]:
    press = zstandard.ZstdDecompressor()
    nodes, texts = chunk["node"].to_pylist(), [press.decompress(x.as_py()).lower() for x in chunk["text"]]
    found = dict(zip(nodes, shingle_sets(texts, width), strict=True))
    return {k: found[k] for k in sorted(found)}


def _frequency_bits(items: int) -> int:
    """Bits of a fingerprint's first lane that the frequency exchange sends: enough that one of `items` shingles shares them with another in few thousandths of all cases,
    which makes it look frequent and costs work, never a pair."""
    return min(64, max(40, items.bit_length() + 12))


def _short(items: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(items[0] >> np.uint64(64 - bits))


def _candidates(chunks: DataFrame, how: Join, items: int) -> DataFrame:
    """Classes with a prefix shingle that another has: node, n (size of the set), items (shingles of two classes or more, sorted), prefix."""
    width, percent, bits = how.width, how.percent, _frequency_bits(items)

    def extract(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([_short(s, bits) for s in _sets(chunk, width).values()]), return_counts=True)

    def use(chunk: pa.Table, found: list[bytes]) -> pa.Table:
        sets = _sets(chunk, width)
        keys = np.unique(np.concatenate([_short(s, bits) for s in sets.values()]))
        frequency = np.frombuffer(b"".join(found), np.uint8)
        out: list[tuple[bytes, int, bytes, list[int]]] = []
        for node, s in sets.items():
            often = frequency[np.searchsorted(keys, s[0] >> np.uint64(64 - bits))]
            n = s.shape[1]
            first = np.lexsort((s[0], often))[: n + (-percent * n // 100) + 1]  # n - ceil(percent * n / 100) + 1
            first = first[often[first] > 1]
            if len(first):
                out.append((node, n, s[:, often > 1].tobytes(), s[0, first].view(np.int64).tolist()))
        return pa.table({k: pa.array([o[j] for o in out], t) for j, (k, t) in enumerate((("node", pa.binary()), ("n", pa.int64()), ("items", pa.binary()), ("prefix", pa.list_(pa.int64()))))})

    requests = exchange.request(chunks, extract, bits, exchange.bucket_count(items))
    replies = exchange.answers(requests, lambda totals: np.minimum(totals, 255).astype(np.uint8).tobytes())
    return exchange.resolve(chunks, replies, use, "node binary, n long, items binary, prefix array<long>")


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least row that each row reaches in a symmetric boolean matrix."""
    m = len(linked)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            reached = np.zeros(m, bool)
            edge = reached.copy()
            edge[i] = True
            while edge.any():
                reached |= edge
                edge = linked[edge].any(axis=0) & ~reached
            root[reached] = i
    return root


def product(nodes: list[bytes], sizes: np.ndarray, weight: np.ndarray, items: list[np.ndarray], side: np.ndarray | None, how: Join) -> tuple[list[int], list[int]]:
    """Of the rows of one task: root of each row, and the documents linked to it. side: 0 or 1, pairs of one side are another task's; None: all pairs."""
    m = len(nodes)
    flat = np.concatenate(items, axis=1)
    row = np.repeat(np.arange(m), [x.shape[1] for x in items])
    order, new = exchange.ranked(flat[0], flat[1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=0) > 1
    order, column = order[shared[column]], column[shared[column]]
    row, column = row[order], (np.cumsum(shared) - 1)[column]
    overlap = np.zeros((m, m), np.float32)
    for start in range(0, int(shared.sum()), how.columns):
        a, b = np.searchsorted(column, (start, start + how.columns))
        incidence = np.zeros((m, how.columns), np.float32)
        incidence[row[a:b], column[a:b] - start] = 1
        overlap += incidence @ incidence.T
    both = sizes[:, None] + sizes[None, :]
    linked = (100 + how.percent) * overlap.astype(np.int64) >= how.percent * both  # overlap over its bound by the two sizes
    if side is not None:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return _roots(linked).tolist(), (linked @ weight).tolist()


def _units(candidates: DataFrame, groups: DataFrame, how: Join, path: str) -> DataFrame:
    """A row for each document and task that it takes part in: unit, side, and what product() needs."""
    base = math.log(100 / how.percent) * 1.001 if how.percent < 100 else 1e-9
    rows = candidates.join(groups, "node").withColumn("band", F.floor(F.log("n") / F.lit(base)).cast("int"))
    n = candidates.count()
    rows = materialise(rows, f"{path}/grouped", 20 * n)  # rows with whole sets count for more
    counts = rows.groupBy("group", "band").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("group").agg(F.sum("c").alias("all"))
    dealt = counts.join(whole, "group").withColumn("k", F.when(F.col("all") <= how.block, 1).otherwise(F.ceil(F.col("c") / how.block)).cast("int"))
    dealt = materialise(dealt, f"{path}/dealt", n)

    def near(step: int, name: str) -> DataFrame:
        return dealt.select("group", (F.col("band") - step).alias("band"), F.col("k").alias(name))

    dealt = dealt.join(near(1, "up"), ["group", "band"], "left").join(near(-1, "down"), ["group", "band"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    unit = lambda b1, k1, b2, k2, side: F.struct(F.struct(b1.alias("b1"), k1.cast("int").alias("k1"), b2.alias("b2"), k2.cast("int").alias("k2")).alias("unit"), side.cast("int").alias("side"))
    band, zero = F.col("band"), F.lit(0)
    small = F.array(unit(zero, zero, zero, zero, F.lit(-1)))

    def blocks(k: str):
        return F.sequence(zero, F.col(k) - 1)

    none = F.array().cast("array<struct<unit:struct<b1:int,k1:int,b2:int,k2:int>,side:int>>")
    own = F.transform(blocks("k"), lambda j: unit(band, F.least(mine, j), band, F.greatest(mine, j), F.when(j == mine, -1).otherwise((mine > j).cast("int"))))
    up = F.when(F.col("up").isNull(), none).otherwise(F.transform(blocks("up"), lambda j: unit(band, mine, band + 1, j, zero)))
    down = F.when(F.col("down").isNull(), none).otherwise(F.transform(blocks("down"), lambda j: unit(band - 1, j, band, mine, F.lit(1))))
    meets = F.when(F.col("all") <= how.block, small).otherwise(F.concat(own, up, down))
    joined = rows.join(dealt, ["group", "band"]).withColumn("x", F.explode(meets))
    return joined.select("group", F.col("x.unit").alias("unit"), F.col("x.side").alias("side"), "node", "n", "docs", "items")


def _forest(units: DataFrame, how: Join) -> DataFrame:
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("node")
        nodes, sides = unit["node"].to_pylist(), unit["side"].to_numpy()
        items = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in unit["items"]]
        roots, links = product(nodes, unit["n"].to_numpy(), unit["docs"].to_numpy(), items, None if sides[0] < 0 else sides, how)
        keep = [i for i, (r, x) in enumerate(zip(roots, links, strict=True)) if r != i or x]
        return pa.table({"node": pa.array([nodes[i] for i in keep], pa.binary()), "root": pa.array([nodes[roots[i]] for i in keep], pa.binary()), "links": pa.array([links[i] for i in keep], pa.int64())})

    return units.groupBy("group", "unit").applyInArrow(run, "node binary, root binary, links long")


def join(documents: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents linked to it, copies included), node (its set's key)."""
    path = shared_dir(documents.sparkSession)
    rows = documents.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    members = materialise(_members(rows, how.width), f"{path}/members")
    classes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"), F.max("n").alias("n"))
    n_docs = members.count()
    classes = materialise(classes, f"{path}/classes", n_docs)
    items = classes.agg(F.sum("n")).first()[0] or 0
    chunks = _representatives(rows.select("text"), how.width, exchange.chunk_count(7 * items, how.chunk_bytes))
    candidates = materialise(_candidates(chunks, how, items), f"{path}/candidates")
    posted = candidates.select("node", F.explode("prefix").alias("s"))
    hubs = posted.groupBy("s").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("s").alias("s2"), "hub")
    groups = components(posted.join(hubs, F.col("s") == F.col("s2")).select("node", "hub"), f"{path}/groups").withColumnRenamed("component", "group")
    weighed = candidates.drop("prefix").join(classes.select("node", "docs"), "node")
    forest = materialise(_forest(_units(weighed, groups, how, path), how), f"{path}/forest")
    found = components(forest.select("node", "root"), f"{path}/linked")
    least = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    ids = found.join(least, "component").select("node", "component_id").join(forest.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    known = classes.join(ids, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    known = materialise(known, f"{path}/known", n_docs)  # so that both sides of the next join are plain exchanges, whose hot keys Spark can split
    with_set = members.filter("node is not null").join(known, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "node")
    return with_set.unionByName(members.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "node"))


def keep_one(documents: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each component: that with the least id. Rows of one id and one shingle set are kept once; of components whose ids are all null,
    and of null ids, one row of a set stays. Documents without shingles all stay."""
    made = join(documents, how, id_col, text_col)
    node, key, kept_id = unused(documents.columns, "node", "key", "kept_id")
    kept = made.filter("node is not null and doc_id <=> component_id").select(F.col("node").alias(key), F.col("doc_id").alias(kept_id)).distinct()
    width, at = how.width, documents.columns.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("more", pa.array(map(_class_key, sets_of(batch.column(at).to_pylist(), width)), pa.binary()))

    rows = map_rows(documents, keyed, node)
    own = [F.col(quoted(c)) for c in documents.columns]
    bare = rows.filter(F.col(node).isNull()).select(own)
    stay = rows.filter(F.col(node).isNotNull()).join(kept, (F.col(node) == F.col(key)) & F.col(quoted(id_col)).eqNullSafe(F.col(kept_id)), "left_semi")
    return stay.dropDuplicates([id_col, node]).select(own).unionAll(bare)
