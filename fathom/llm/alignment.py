"""Tokens of two tokenizers laid over each other by bytes, and how often their ids meet (operator 12).

Each text is encoded twice: " " + text by a byte-level BPE file (A) and the text by a sentencepiece model that adds the space itself (B). The ends of both token sequences cut
the bytes into elementary intervals; the owners of an interval, found by binary search in the two arrays of ends, are one overlapping pair, and each pair that overlaps has
exactly one interval. An end in both arrays closes a group. All texts of a batch are done at once, laid one after another, as the end of a text is in both arrays.

A pair of ids counts the documents that hold it. A task gathers its documents into chunks of about chunk_bytes, writes for each document its pairs as places in the chunk's
sorted list of distinct pairs, and for each chunk that list with its documents' counts; lists are added up by a partly pre-aggregated groupBy, the highest count of each A id is
a maximum over its at most 32 000 pairs, and what a chunk asked for comes back to it by a join on the pair and a cogroup on the chunk. So a pair that stands in every document
is one row a chunk, nothing is broadcast, and no table of pairs is held in one place.

A null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens: its numbers are 0 and its groups_sha256 is ''. Special tokens' strings are
plain text. Repeated rows are aligned one by one and each counts as a document; null and repeated ids are kept as they are; an empty table gives an empty result. Only the id
and the text are read. Memory: a chunk, or the largest single text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.pretokens import Splitter, pieces, texts_of
from fathom.llm.shared import shared_dir, small_batches
from fathom.llm.transducer import alphabet

#: Pairs are A id << B_BITS | B id.
B_BITS = 15
_MOST_PIECES = 300_000


@dataclass(frozen=True)
class Pair:
    """Paths of the two files, which driver and executors can read."""

    a: str
    b: str
    chunk_bytes: int = 12 << 20


class Encoder:
    """Both tokenizers. A's regular splitting is done for whole batches, so that the library encodes each distinct piece once."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = alphabet()
        vocabulary = json.loads(Path(a).read_text(encoding="utf-8"))["model"]["vocab"]
        entries = {n: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w, n in vocabulary.items()}
        self.a_bytes = [entries.get(n, b"") for n in range(max(entries) + 1)]
        names = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(names)]
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 31 - B_BITS:
            raise ValueError(f"vocabularies of {len(self.a_bytes)} and {len(self.b_bytes)} tokens: pairs would need more than 31 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_names = [np.array([f"{n}{end}" for n in range(len(self.a_bytes))], object) for end in ",|"]
        self.b_names = [np.array([f"{n}{end}" for n in range(len(self.b_bytes))], object) for end in ",;"]
        self.splitter = Splitter()
        self.known: dict[bytes, tuple[list[int], bool]] = {}

    def encode_a(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, tokens of each text, whether each text comes back byte by byte)."""
        starts = self.splitter.starts(data, edges)
        found = pieces(data, starts)
        distinct = found.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        ids = [e.ids for e in self.a.encode_batch([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)]
        fresh = {p: (i, b"".join(map(self.a_bytes.__getitem__, i)) == p) for p, i in zip(new, ids, strict=True)}
        each = [fresh[p] if p in fresh else self.known[p] for p in distinct]
        if len(self.known) > _MOST_PIECES:
            self.known.clear()
        self.known.update((p, v) for p, v in fresh.items() if len(p) <= 32)
        which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(i) for i, _ in each], np.int64)
        flat = np.fromiter(chain.from_iterable(i for i, _ in each), np.int64, int(sizes.sum()))
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        per = sizes[which]
        ends = np.cumsum(per)
        out = flat[np.repeat(begins[which] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.searchsorted(starts, edges)
        sums, bad = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(~np.array([good for _, good in each], bool)[which])])
        return out, sums[cut[1:]] - sums[cut[:-1]], bad[cut[1:]] == bad[cut[:-1]]

    def encode_b(self, data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
        lists = self.b.encode(texts, num_threads=1)
        counts = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
        good = np.array([b"".join(map(self.b_bytes.__getitem__, x)) == data[a:b] for x, a, b in zip(lists, edges.tolist(), edges[1:].tolist(), strict=False)], bool)
        return ids, counts, good


@lru_cache(maxsize=2)
def encoder(a: str, b: str) -> Encoder:
    return Encoder(a, b)


@dataclass
class Laid:
    """Texts of a batch that have tokens, laid over each other: per text numbers, and the text and pair of each overlap."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[str]
    owner: np.ndarray
    pair: np.ndarray


def lay(both: Encoder, data: np.ndarray, edges: np.ndarray) -> Laid:
    """data: each text with the space before it, one after another; edges: where they start, and the end."""
    n = len(edges) - 1
    a, n_a, good_a = both.encode_a(data, edges)
    b, n_b, good_b = both.encode_b(data.tobytes(), edges)
    good = good_a & good_b
    of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    ends_a, ends_b = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[own_a] == ends) & (ends_b[own_b] == ends)
    owner = of_a[own_a]
    closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    closes_a[own_a[shared]], closes_b[own_b[shared]] = True, True
    groups = np.bincount(owner[shared], minlength=n) if len(ends) else np.zeros(n, np.int64)
    return Laid(n_a, n_b, groups, np.bincount(owner, minlength=n), digests(both, a, b, closes_a, closes_b, n_a, n_b), owner, a[own_a] << B_BITS | b[own_b])


def digests(both: Encoder, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3`, the ids of each group, for each text; '' without tokens."""
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    words = np.concatenate([np.where(closes_a, both.a_names[1][a], both.a_names[0][a]), np.where(closes_b, both.b_names[1][b], both.b_names[0][b])])[order].tolist() if len(a) else []
    out, at = [], 0
    for k in (n_a + n_b).tolist():
        out.append(hashlib.sha256("".join(words[at : at + k])[:-1].encode()).hexdigest() if k else "")
        at += k
    return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_LAID = "chunk long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<int>, docs array<int>"
_OUT = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(documents: DataFrame, pair: Pair) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    path = f"{shared_dir(spark)}/laid"
    a, b, most = pair.a, pair.b, pair.chunk_bytes

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, part = encoder(a, b), 0, TaskContext.get().partitionId()
        held: list[tuple] = []
        held_bytes = 0
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for low, high in blocks(offsets, 1 << 20):
                size = np.diff(offsets[low : high + 1])
                full = np.flatnonzero(size)
                edges = np.concatenate([[0], np.cumsum(size[full] + 1)])
                spaced = np.full(edges[-1], 32, np.uint8)
                inside = np.ones(edges[-1], bool)
                inside[edges[:-1]] = False
                spaced[inside] = data[offsets[low] : offsets[high]]
                found = lay(both, spaced, edges)
                key, times = np.unique(found.owner << 31 | found.pair, return_counts=True)
                held.append((batch.column(0).slice(low, high - low), high - low, full, found, key >> 31, (key & 0x7FFFFFFF).astype(np.int32), times))
                held_bytes += edges[-1]
            if held_bytes >= most:
                yield chunk(part << 32 | number, held)
                number, held, held_bytes = number + 1, [], 0
        if held:
            yield chunk(part << 32 | number, held)

    def answered(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        at = np.argsort(found["pos"].to_numpy())
        n, best = found["n"].to_numpy()[at], found["best"].to_numpy()[at].astype(np.int64)
        sums, bests = [], []
        for places, times in zip(rows["places"].to_pylist(), rows["times"].to_pylist(), strict=True):
            where, often = np.cumsum(np.frombuffer(places, np.uint32), dtype=np.int64), np.frombuffer(times, np.uint32).astype(np.int64)
            sums.append(int((n[where] * often).sum()))
            bests.append(int((best[where] * often).sum()))
        columns = [rows["doc_id"], *(rows[c] for c in _NUMBERS), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), rows["groups_sha256"]]
        return pa.table(columns, ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    shape = documents.select("doc_id", "text").mapInArrow(laid, _LAID.format(kind))
    shape.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(shape.schema).parquet(path)
    asked = rows.filter(F.col("pairs").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("pos", "x")).select("chunk", "pos", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    answers = asked.select(F.col("chunk").alias("of"), "pos", "pair").join(counts.select("pair", "n", best.alias("best")), "pair").select("of", "pos", "n", "best")
    return rows.drop("pairs", "docs").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(answered, _OUT.format(kind))


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size)))
        high = min(high, len(offsets) - 1)
        yield low, high
        low = high


def chunk(name: int, held: list[tuple]) -> pa.RecordBatch:
    """A row for each document, its pairs as differences of places in the list of pairs that the first row carries."""
    pairs, docs = np.unique(np.concatenate([h[5] for h in held]), return_counts=True)
    columns: dict[str, list] = {c: [] for c in (*_NUMBERS, "sha", "places", "times")}
    for _, n, full, found, owner, pair, times in held:
        for c in _NUMBERS:
            numbers = np.zeros(n, np.int64)
            numbers[full] = getattr(found, c)
            columns[c].append(numbers)
        at = np.searchsorted(pairs, pair)
        cut = np.searchsorted(owner, np.arange(len(full) + 1))
        sha, places, often = [""] * n, [b""] * n, [b""] * n
        for k, row in enumerate(full.tolist()):
            sha[row] = found.sha[k]
            low, high = cut[k], cut[k + 1]
            places[row] = np.diff(at[low:high], prepend=0).astype(np.uint32).tobytes()
            often[row] = times[low:high].astype(np.uint32).tobytes()
        for c, v in (("sha", sha), ("places", places), ("times", often)):
            columns[c] += v
    rows = sum(h[1] for h in held)
    listed = lambda x: pa.array([x.astype(np.int32), *[None] * (rows - 1)], pa.list_(pa.int32()))
    arrays = [pa.array([name] * rows, pa.int64()), pa.concat_arrays([h[0] for h in held]), *(pa.array(np.concatenate(columns[c]), pa.int64()) for c in _NUMBERS), pa.array(columns["sha"], pa.string()), pa.array(columns["places"], pa.binary()), pa.array(columns["times"], pa.binary()), listed(pairs), listed(docs)]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "doc_id", *_NUMBERS, "groups_sha256", "places", "times", "pairs", "docs"])
