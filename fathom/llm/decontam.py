"""Benchmark decontamination by a prefix-filtered set join (operator 10).

Every item gives windows of `width` consecutive words (a shorter one gives itself). A window can only stand in a document that has all of
its words, so one necessary prefix token is enough to find it: the window's rarest word, by counts over all documents. Documents are joined
on that token; the token's place in the window bounds where the window may start and must leave room for the rest of it, and the whole
window is then compared word by word at that place.

Items reach the executors as broadcast blocks of at most block_bytes of item text (a larger table becomes more blocks, of which a task holds
one at a time), so memory does not grow with the benchmark. The documents are read once for the rarity counts and once for the join; there is no
shuffle of texts.

Null or empty documents have no words and are never contaminated. Null items, and items with no word, give no window. A null item_id counts as
the empty text. Repeated items are found each by its own id; repeated documents are judged one by one. Only the id and text columns are read, except
by filter_documents, which passes whole rows on.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import map_rows, quoted, small_batches

#: Bytes to the bytes of words: ASCII letters lower-cased, digits and everything from 0x80 up as they are, the rest to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Rule:
    width: int = 13
    #: contaminated: at least one hit, and share * hits >= words.
    share: int = 20
    block_bytes: int = 16 << 20


class WindowIndex:
    """Windows of one block, by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], rarity: dict[bytes, int], width: int):
        self.by_token: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            k = min(width, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                owners[tuple(words[i : i + k])].add(item)
        self.windows = [(list(w), sorted(ids)) for w, ids in sorted(owners.items())]
        for n, (window, _) in enumerate(self.windows):
            at = min(range(len(window)), key=lambda j: (rarity.get(window[j], 0), window[j], j))
            self.by_token[window[at]].append((n, at))
        self.by_token = dict(self.by_token)

    def find(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        get, windows = self.by_token.get, self.windows
        for i, word in enumerate(words):
            found = get(word)
            if found:
                for n, at in found:
                    window, ids = windows[n]
                    start = i - at
                    if start >= 0 and words[start : start + len(window)] == window:
                        spans.append((start, start + len(window)))
                        items.update(ids)


def covered(spans: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def _blocks(items: DataFrame, rule: Rule) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, a block of about block_bytes at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // rule.block_bytes) or 1
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r.item, split_words(r.text)) for r in part.collect()]


def _rarity(texts: DataFrame, vocabulary: Broadcast) -> dict[bytes, int]:
    """Counts over all documents of the words of one block (at most block_bytes of them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(split_words(text.as_py()))
            total = Counter({w: total[w] for w in total.keys() & vocabulary.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def build_index(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> list[Broadcast]:
    """One broadcast index a block."""
    small_batches(documents.sparkSession)
    sc = documents.sparkSession.sparkContext
    texts = documents.select(F.col(quoted(text_col)).alias("__text"))
    items = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(quoted(item_text_col)), F.lit("")).alias("text"))
    found = []
    for block in _blocks(items, rule):
        vocabulary = sc.broadcast({w for _, words in block for w in words})
        found.append(sc.broadcast(WindowIndex(block, _rarity(texts, vocabulary), rule.width)))
        vocabulary.destroy()
    return found


def _judge(texts: list[str | None], index: list[Broadcast], rule: Rule) -> list[tuple[int, int, list[str], bool]]:
    words = [split_words(t) for t in texts]
    spans: list[list] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for block in index:
        for w, s, i in zip(words, spans, items, strict=True):
            block.value.find(w, s, i)
        if len(index) > 1:
            del block._value  # read again from the executor's disk for the next batch
    hits = [covered(s) for s in spans]
    return [(len(w), h, sorted(i), h > 0 and rule.share * h >= len(w)) for w, h, i in zip(words, hits, items, strict=True)]


def contamination(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside any occurrence of a window), items (sorted ids that occur), contaminated."""
    index = build_index(documents, benchmark, rule, text_col)
    rows = documents.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _judge(batch.column(1).to_pylist(), index, rule)
            n, hit, items, bad = ([x[k] for x in found] for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(bad, pa.bool_())], names=[id_col, "n_words", "n_hit", "items", "contaminated"])

    return rows.mapInArrow(run, f"{quoted(id_col)} {dict(rows.dtypes)[id_col]}, n_words long, n_hit long, items array<string>, contaminated boolean")


def filter_documents(documents: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    index, at = build_index(documents, benchmark, rule, text_col), documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([not x[3] for x in _judge(texts, index, rule)], pa.bool_()))

    return map_rows(documents, run)


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
