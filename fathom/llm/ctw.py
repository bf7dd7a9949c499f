"""Language-model scoring by context-tree weighting (operator 4).

Bytes are coded as eight binary decisions. Every node of that decision tree has a context tree over the `depth` preceding bytes; a tree node keeps counts of
zeros and ones, its Krichevsky-Trofimov block probability P_e, and P_w = (P_e + product of the children's P_w) / 2, at full depth P_w = P_e. The
tree is learned from the training documents and then frozen: a decision's probability at a node is the mean of the node's KT estimate and the next deeper node's
probability, weighted by P_e and the product of the children's P_w, so that all depths are mixed; a node that has seen nothing says 1/2. A text is coded
from an empty context (zero bytes) to a closing zero byte, so probabilities of texts add up to one. Its code length follows from the distinct (depth + 1)-grams.

Counting goes through the packed exchange: a chunk of about 8 MB sends each distinct gram and each distinct word once, with its training count. Gram names start
with the three nearest context bytes, scattered; all nodes from depth 3 down lie within one bucket, which computes their P_w. Depths 2 to 0 have at most 65 536 contexts of
255 nodes; they alone are sent to the driver, and back to the buckets (4 KB for each pair of bytes that occurs). Bucket by bucket the grams of a chunk are answered with
their log probability. Counts and statistics are over all documents.

The base score is the unigram model of the contract; words are compared as they are. Null texts are empty and still have the end. A null id counts as the empty text. Repeated
rows count as often as they stand and have equal scores. Without training documents every decision has probability 1/2. An empty table gives no row. Only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import exchange, hashing
from fathom.llm.shared import id_text, materialise, quoted, shared_dir, text_bytes

_WORD, _GRAM = 0, 1
#: An odd number that scatters the nearest context bytes.
_SCATTER = 0x9E3779


def _near(depth: int) -> int:
    """Context bytes that a bucket's grams may share; nodes of this depth and below are the bucket's."""
    return min(3, depth)


@dataclass(frozen=True)
class Tree:
    depth: int = 5
    modulus: int = 10
    chunk_bytes: int = 8 << 20
    batch_bytes: int = 1 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: the recurrence up to 8 and above, then Stirling's series."""
    x = np.asarray(x, float)
    small = x < 8
    down = np.where(small, x, 1.0)
    shift = np.where(small, sum(np.log(down + k) for k in range(8)), 0.0)
    y = np.where(small, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def gram_codes(text: bytes, depth: int) -> np.ndarray:
    """A code for every byte and the closing one: nearest context bytes scattered, further context bytes, the byte."""
    data = np.frombuffer(bytes(depth) + text + b"\0", np.uint8).astype(np.uint64)
    n, top = len(text) + 1, _near(depth)
    code = np.zeros(n, np.uint64)
    for k in range(1, depth + 1):
        code = (code << np.uint64(8)) | data[depth - k : depth - k + n]
        if k == top:
            code = (code * np.uint64(_SCATTER)) & np.uint64((1 << 8 * top) - 1)
    return (code << np.uint64(8)) | data[depth : depth + n]


def _nearest(codes: np.ndarray, above: int, depth: int) -> np.ndarray:
    """The nearest context bytes, from their scattered form that stands `above` bits up."""
    bits = 8 * _near(depth)
    return ((codes >> np.uint64(above)) * np.uint64(pow(_SCATTER, -1, 1 << bits))) & np.uint64((1 << bits) - 1)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


@dataclass
class Level:
    """Nodes of one depth and one place in the byte: keys sorted, counts, log(P_e / product of the children's P_w)."""

    keys: np.ndarray
    total: np.ndarray
    ones: np.ndarray
    log_pw: np.ndarray
    log_beta: np.ndarray | None


def grow(codes: np.ndarray, counts: np.ndarray, depth: int) -> dict[tuple[int, int], Level]:
    """Levels from `depth` up to that of the nearest bytes; codes are sorted and distinct, counts above 0."""
    levels: dict[tuple[int, int], Level] = {}
    for d in range(depth, _near(depth) - 1, -1):
        at = ((codes >> np.uint64(8 * (depth - d) + 8)) << np.uint64(8)) | (codes & np.uint64(255))
        grams, inverse = np.unique(at, return_inverse=True)
        n = np.bincount(inverse, weights=counts, minlength=len(grams))
        for k in range(8):
            node = grams >> np.uint64(8 - k)
            starts = _runs(node)
            keys = node[starts]
            total = np.add.reduceat(n, starts) if len(starts) else n
            ones = np.add.reduceat(n * ((grams >> np.uint64(7 - k)) & np.uint64(1)), starts) if len(starts) else n
            pe = kt_block(total - ones, ones)
            if d == depth:
                levels[d, k] = Level(keys, total, ones, pe, None)
                continue
            child = levels[d + 1, k]
            parent = ((child.keys >> np.uint64(k + 8)) << np.uint64(k)) | (child.keys & np.uint64((1 << k) - 1))
            below = np.bincount(np.searchsorted(keys, parent), weights=child.log_pw, minlength=len(keys))
            levels[d, k] = Level(keys, total, ones, np.logaddexp(pe, below) - math.log(2), pe - below)
    return levels


def roots(levels: dict[tuple[int, int], Level], codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the depth above needs of one bucket, by context there: (contexts, sums of log P_w by node (1 to 255), byte counts)."""
    top = _near(depth)
    at_byte = _nearest(codes, 8 * (depth - top) + 8, depth) >> np.uint64(8)
    contexts, row = np.unique(at_byte, return_inverse=True)
    below, seen = np.zeros((len(contexts), 256)), np.zeros((len(contexts), 256))
    np.add.at(seen, (row, (codes & np.uint64(255)).astype(np.int64)), counts)
    for k in range(8):
        level = levels[top, k]
        node = (1 << k) | (level.keys & np.uint64((1 << k) - 1)).astype(np.int64)
        np.add.at(below, (np.searchsorted(contexts, _nearest(level.keys, k, depth) >> np.uint64(8)), node), level.log_pw)
    return contexts, below, seen


def _node_counts(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(..., 256) counts by byte to counts by node: all, and ones."""
    total, ones = np.zeros_like(byte_counts), np.zeros_like(byte_counts)
    for k in range(8):
        parts = byte_counts.reshape(*byte_counts.shape[:-1], 1 << k, 2, 128 >> k).sum(axis=-1)
        total[..., 1 << k : 2 << k] = parts.sum(axis=-1)
        ones[..., 1 << k : 2 << k] = parts[..., 1]
    return total, ones


@dataclass
class Shallow:
    """One depth above the buckets: contexts sorted, and by context and node the probability of a one by KT and its weight against deeper nodes."""

    contexts: np.ndarray
    one: np.ndarray
    own: np.ndarray


def shallow(contexts: np.ndarray, below: np.ndarray, seen: np.ndarray, depth: int) -> list[Shallow]:
    """The depths above the buckets, deepest first."""
    levels = []
    for d in range(_near(depth) - 1, -1, -1):
        total, ones = _node_counts(seen)
        pe = kt_block(total - ones, ones)
        levels.append(Shallow(contexts, (ones + 0.5) / (total + 1), _share(pe - below)))
        pw = np.where(total > 0, np.logaddexp(pe, below) - math.log(2), 0.0)
        contexts, row = np.unique(contexts >> np.uint64(8), return_inverse=True)
        parts = pw, seen
        below, seen = (np.zeros((len(contexts), 256)) for _ in range(2))
        np.add.at(below, row, parts[0])
        np.add.at(seen, row, parts[1])
    return levels


def _share(log_beta: np.ndarray) -> np.ndarray:
    """beta / (1 + beta)."""
    return 1 / (1 + np.exp(-np.clip(log_beta, -700, 700)))


def log_probability(queries: np.ndarray, levels: dict[tuple[int, int], Level], top: list[Shallow], depth: int) -> np.ndarray:
    """Natural log of the probability of each gram's byte in its context."""
    result = np.zeros(len(queries))
    deepest = _near(depth)
    near = _nearest(queries, 8 * (depth - deepest) + 8, depth)
    rows = []
    for j, level in enumerate(top):
        context = near >> np.uint64(8 * (j + 1))
        at = np.minimum(np.searchsorted(level.contexts, context), max(len(level.contexts) - 1, 0))
        rows.append((at, level.contexts[at] == context if len(level.contexts) else np.zeros(len(queries), bool)))
    for k in range(8):
        bit = ((queries >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        prefix = (queries & np.uint64(255)) >> np.uint64(8 - k)
        p = np.full(len(queries), 0.5)
        for d in range(depth, deepest - 1, -1):
            level = levels[d, k]
            key = ((queries >> np.uint64(8 * (depth - d) + 8)) << np.uint64(k)) | prefix
            at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
            known = level.keys[at] == key if len(level.keys) else np.zeros(len(queries), bool)
            at = at[known]
            own = (np.where(bit[known], level.ones[at], level.total[at] - level.ones[at]) + 0.5) / (level.total[at] + 1)
            weight = 1.0 if level.log_beta is None else _share(level.log_beta[at])
            p[known] = weight * own + (1 - weight) * p[known]  # a node without counts mixes 1/2 with 1/2
        node = (1 << k) | prefix.astype(np.int64)
        for level, (at, known) in zip(top, rows, strict=True):
            at, n = at[known], node[known]
            one, own = level.one[at, n], level.own[at, n]
            p[known] = own * np.where(bit[known], one, 1 - one) + (1 - own) * p[known]
        result += np.log(p)
    return result


def is_held_out(doc_id: str, modulus: int) -> bool:
    return zlib.crc32(doc_id.encode()) % modulus == 0


def _word_array(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and how many each has."""
    data = b" ".join(texts).lower()
    starts, ends = hashing.words(data)
    letters = np.frombuffer(data, np.uint8)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[~hashing.SPACE[letters]])])
    return words, np.diff(np.searchsorted(starts, np.r_[0, np.cumsum([len(t) + 1 for t in texts])]))


class _Chunk:
    """Documents of a chunk in batches of about batch_bytes."""

    def __init__(self, chunk: pa.Table, tree: Tree):
        self.tree = tree
        self.ids = chunk["id_text"].to_pylist()
        self.texts = chunk["text"]
        self.held = np.array([is_held_out(i, tree.modulus) for i in self.ids], bool)
        self.sizes = chunk["n"].to_pylist()

    def batches(self):
        start = size = 0
        texts: list[bytes] = []
        press = zstandard.ZstdDecompressor()
        for i, x in enumerate(self.texts):
            texts.append(press.decompress(x.as_py()))
            size += len(texts[-1])
            if size >= self.tree.batch_bytes or i + 1 == len(self.texts):
                yield start, texts
                start, size, texts = i + 1, 0, []

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams, sorted; their counts in training documents; the place of every gram of the chunk among them, and how many each text has."""
        sizes = np.array([n + 1 for n in self.sizes])
        codes, at = np.empty(int(sizes.sum()), np.uint64), 0
        for _, texts in self.batches():
            for t in texts:
                codes[at : at + len(t) + 1] = gram_codes(t, self.tree.depth)
                at += len(t) + 1
        inverse, keys = pd.factorize(codes)
        del codes
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        inverse = place[inverse]
        return keys[order], np.bincount(inverse[np.repeat(~self.held, sizes)], minlength=len(keys)).astype(np.uint64), inverse, sizes

    def vocabulary(self, buckets: int) -> tuple[pa.Array, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """Distinct words in an order that follows from them alone; their counts in training documents; (bucket, from, to); and places and numbers as for grams."""
        parts, sizes = [], []
        for _, texts in self.batches():
            words, n = _word_array(texts)
            parts.append(words.dictionary_encode())
            sizes.append(n)
        every = pa.concat_arrays([p.dictionary for p in parts]).dictionary_encode()
        known, index = every.dictionary, np.split(every.indices.to_numpy(), np.cumsum([len(p.dictionary) for p in parts])[:-1])
        inverse, sizes = np.concatenate([i[p.indices.to_numpy()] for i, p in zip(index, parts, strict=True)]), np.concatenate(sizes)
        total = np.bincount(inverse, weights=np.repeat(~self.held, sizes), minlength=len(known))
        plain = known.to_pylist()
        hashes = np.concatenate([hashing.word_hashes(b" ".join(plain[i : i + 4096])) for i in range(0, len(plain), 4096)] or [np.zeros(0, np.uint64)]) >> np.uint64(32)
        order = exchange.by_word(known, hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return known.take(pa.array(order)), total[order].astype(np.uint64), exchange.split_buckets(hashes[order], 32, buckets), place[inverse], sizes


def _count(chunks: DataFrame, tree: Tree, words: int, grams: int) -> DataFrame:
    """Requests of both kinds; words travel as they are."""

    def run(chunk: pa.Table) -> pa.Table:
        of, number = _Chunk(chunk, tree), chunk["chunk"][0].as_py()
        keys, counts, *_ = of.grams()
        first = exchange.request_rows(number, keys, counts, exchange.split_buckets(keys, 8 * (tree.depth + 1), grams))
        found, counts, parts, *_ = of.vocabulary(words)
        press = zstandard.ZstdCompressor(level=1)
        second = pa.table({
            "bucket": pa.array([p[0] for p in parts], pa.int32()), "chunk": pa.array([number] * len(parts), pa.int64()),
            "keys": pa.array([press.compress(b" ".join(found[a:b].to_pylist())) for _, a, b in parts], pa.binary()), "counts": pa.array([exchange.pack(counts[a:b]) for _, a, b in parts], pa.binary()),
        })
        return pa.concat_tables([rows.append_column("kind", pa.array([kind] * len(rows), pa.int32())) for kind, rows in ((_GRAM, first), (_WORD, second))])

    return chunks.groupBy("chunk").applyInArrow(run, f"{exchange.REQUEST}, kind int")


def _trained(bucket: pa.Table, depth: int) -> tuple[dict[tuple[int, int], Level], np.ndarray, np.ndarray, tuple]:
    keys, totals, place, ends = exchange.merged(bucket)
    known = totals > 0
    codes, counts = keys[known], totals[known].astype(float)
    return grow(codes, counts, depth), codes, counts, (keys, place, ends)


def _top(requests: DataFrame, depth: int) -> list[Shallow]:
    def run(bucket: pa.Table) -> pa.Table:
        levels, codes, counts, _ = _trained(bucket, depth)
        contexts, below, seen = roots(levels, codes, counts, depth)
        some = (below != 0) | (seen != 0)
        packed = [np.flatnonzero(x).astype(np.uint8).tobytes() for x in some]
        rows = range(len(contexts))
        return pa.table({
            "context": pa.array(contexts, pa.int64()), "bucket": pa.array([bucket["bucket"][0].as_py()] * len(contexts), pa.int32()), "at": pa.array(packed, pa.binary()),
            "below": pa.array([below[r, some[r]].tobytes() for r in rows], pa.binary()), "seen": pa.array([seen[r, some[r]].tobytes() for r in rows], pa.binary()),
        })

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros((2, 256))
        for r in rows.sort_by("bucket").to_pylist():  # sums of doubles in one order, so that reruns agree
            at = np.frombuffer(r["at"], np.uint8)
            total[0, at] += np.frombuffer(r["below"])
            total[1, at] += np.frombuffer(r["seen"])
        some = total.any(axis=0)
        return pa.table({"context": rows["context"][:1], "at": pa.array([np.flatnonzero(some).astype(np.uint8).tobytes()], pa.binary()), "sums": pa.array([total[:, some].tobytes()], pa.binary())})

    parts = requests.groupBy("bucket").applyInArrow(run, "context long, bucket int, at binary, below binary, seen binary")
    found = sorted(parts.groupBy("context").applyInArrow(add, "context long, at binary, sums binary").collect(), key=lambda r: r.context)  # 65 536 rows at most
    below, seen = np.zeros((len(found), 256)), np.zeros((len(found), 256))
    for i, r in enumerate(found):
        at = np.frombuffer(r["at"], np.uint8)
        below[i, at], seen[i, at] = np.frombuffer(r.sums).reshape(2, -1)
    return shallow(np.array([r.context for r in found], np.uint64), below, seen, depth)


def _gram_answers(requests: DataFrame, top: list[Shallow], depth: int) -> DataFrame:
    sent = requests.sparkSession.sparkContext.broadcast(top)

    def run(bucket: pa.Table) -> pa.Table:
        levels, _, _, (keys, place, ends) = _trained(bucket, depth)
        found = log_probability(keys, levels, sent.value, depth)
        return exchange.answer_rows(bucket, [x.tobytes() for x in np.split(found[place], ends[:-1])])

    return requests.groupBy("bucket").applyInArrow(run, exchange.ANSWER)


def _word_answers(requests: DataFrame) -> DataFrame:
    """Totals of the words; the first row of a bucket has its numbers of distinct training words and of their tokens, the others 0."""

    def run(bucket: pa.Table) -> pa.Table:
        press = zstandard.ZstdDecompressor()
        words = [pa.array(press.decompress(x.as_py()).split(b" "), pa.binary()) for x in bucket["keys"]]
        every = pa.concat_arrays(words).dictionary_encode()
        place = every.indices.to_numpy()
        counts = np.concatenate([exchange.unpack(x.as_py()) for x in bucket["counts"]]).astype(np.int64)
        totals = np.zeros(len(every.dictionary), np.int64)
        np.add.at(totals, place, counts)
        rows = exchange.answer_rows(bucket, [exchange.pack(x) for x in np.split(totals[place], np.cumsum([len(w) for w in words])[:-1])])
        for name, n in (("n_distinct", int((totals > 0).sum())), ("n_tokens", int(totals.sum()))):
            rows = rows.append_column(name, pa.array([n] + [0] * (len(rows) - 1), pa.int64()))
        return rows

    return requests.groupBy("bucket").applyInArrow(run, f"{exchange.ANSWER}, n_distinct long, n_tokens long")


_SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def score(documents: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the scores."""
    spark, path = documents.sparkSession, shared_dir(documents.sparkSession)
    rows = documents.select(F.col(quoted(id_col)).alias("doc_id"), id_text(F.col(quoted(id_col))).alias("id_text"), F.col(quoted(text_col)).alias("text"))
    kind_of_id = dict(rows.dtypes)["doc_id"]
    total = rows.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    n_chunks = exchange.chunk_count(total, tree.chunk_bytes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(map(press.compress, texts), pa.binary()), pa.array(map(len, texts), pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id_text", "text", "n", "chunk"])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id_text", "text"), F.lit(n_chunks)))
    chunks = dealt.mapInArrow(packed, f"doc_id {kind_of_id}, id_text string, text binary, n long, chunk long")
    # Rows sent: at most one for 4 bytes; the buckets' number follows from that bound.
    buckets = exchange.bucket_count(total // 20)
    requests = materialise(_count(chunks, tree, min(buckets, 1 << 31), min(buckets, 1 << 8 * _near(tree.depth))), f"{path}/requests")
    of = lambda kind: requests.filter(F.col("kind") == kind).drop("kind")
    words = materialise(_word_answers(of(_WORD)), f"{path}/words")
    stats = words.agg(F.sum("n_distinct"), F.sum("n_tokens")).first()
    ends = rows.filter(F.crc32(F.col("id_text").cast("binary")) % tree.modulus != 0).count()
    distinct, tokens = (stats[0] or 0) + (ends > 0), (stats[1] or 0) + ends
    grams = _gram_answers(of(_GRAM), _top(of(_GRAM), tree.depth), tree.depth)
    replies = words.drop("n_distinct", "n_tokens").withColumn("kind", F.lit(_WORD)).unionAll(grams.withColumn("kind", F.lit(_GRAM)))
    norm, log10 = math.log10(tokens + 0.1 * (distinct + 1)), math.log(10)
    alone = math.log10(ends + 0.1) - norm

    def use(chunk: pa.Table, found: pa.Table) -> pa.Table:
        made = _Chunk(chunk, tree)
        (*_, gram, n_grams), (*_, word, n_words) = made.grams(), made.vocabulary(1)
        kinds = found["kind"].to_numpy()
        replies = {k: exchange.in_order(found.filter(pa.array(kinds == k))) for k in (_WORD, _GRAM)}
        totals = np.concatenate([exchange.unpack(a) for a in replies[_WORD]]).astype(float) if replies[_WORD] else np.zeros(0)
        logs = np.concatenate([np.frombuffer(a, np.float64) for a in replies[_GRAM]])
        def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            """Sums over neighbours, one for each text; a text may have none."""
            return np.add.reduceat(np.append(values, 0.0), np.cumsum(np.r_[0, sizes[:-1]])) * (sizes > 0)

        points, times = summed(logs[gram], n_grams) / log10, totals[word]
        columns = (made.held, n_words + 1, summed(times > 0, n_words).astype(np.int64) + (ends > 0), np.full(len(n_words), tokens), summed(np.log10(times + 0.1) - norm, n_words) + alone, points, n_grams - 1, -points * math.log2(10) / n_grams)
        kinds_of = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
        names = [c.split() for c in _SCORES.split(", ")]
        return pa.table({"doc_id": chunk["doc_id"]} | {k: pa.array(values, kinds_of[t]) for (k, t), values in zip(names, columns, strict=True)})

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(use, f"doc_id {kind_of_id}, {_SCORES}")
