"""Repeated byte strings by a distributed difference-cover suffix method (operator 3).

Suffixes that agree on `length` bytes would be neighbours in a suffix array; only that is wanted here, not the lexicographic order. So names are fingerprints
(any total order under which equal strings are neighbours serves), and the steps are:

1. Sample the positions whose residue modulo v is in a difference cover D. Any two positions have a shift below v that puts both in the sample.
   Tuples of length - v + 1 bytes at sampled positions are named; the recursion over names of shorter tuples folds into one step, since
   a fingerprint of a long tuple is put together from those of its parts.
2. Names are sorted by ranges of the name space over all chunks. Names that stand once are discarded with all that depends on them: a string that is
   repeated has, within v bytes of its start, a sampled position with a repeated name.
3. The remaining suffixes, those less than v before a repeated name, get names of their first `length` bytes and are merged in name order.
4. Neighbours in that order with equal names are the repeated strings; each document marks the bytes they cover.

Exact copies are one text with a number of copies from the start: they meet under their SHA-256 before a chunk sees them, so a text that a third of all documents
share is one text. A name in a third of all documents costs an entry a chunk of about 8 MB. Names of step 3 have 64 + `more_bits` bits in two independent
lanes: of N remaining suffixes about N^2 / 2^97 pairs of unequal strings are taken as equal (10^-3 of a pair for 10^13 suffixes). Step 1 uses fewer bits, where a
clash only keeps a suffix for step 3.

Null texts are empty. Texts shorter than `length` keep all bytes. Strings never cross documents, overlaps with themselves count. Repeated rows are copies of each other.
An empty table gives no row. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import exchange, hashing
from fathom.llm.shared import materialise, shared_dir, text_bytes

#: A perfect difference set modulo 91.
_COVER_91 = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)


def difference_cover(v: int) -> tuple[int, ...]:
    """Residues whose differences give every residue modulo v; for v = 3 the positions of triples."""
    if v == 91:
        return _COVER_91
    cover, open_ = [0], set(range(1, v))
    while open_:
        gain = lambda x: len({(x - c) % v for c in cover} | {(c - x) % v for c in cover} & open_)
        best = max((x for x in range(v) if x not in cover), key=lambda x: (gain(x), -x))
        open_ -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return tuple(sorted(cover))


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    #: The period of the sample; tuples are length - period + 1 bytes.
    period: int = 91
    chunk_bytes: int = 8 << 20
    #: Bits of a name in step 1 beyond the logarithm of the number of names.
    spare_bits: int = 12
    #: Bits of the second lane that names of step 3 carry besides the 64 of the first.
    more_bits: int = 32


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; a binary search each, whatever the size of `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bits(found: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).view(bool) for x, n in zip(found, sizes, strict=True)]) if found else np.zeros(0, bool)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (from, to) covered by strings of this length at ascending starts."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.column_stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length]).astype(np.int64)


def _tallied(order: np.ndarray, first: np.ndarray, copied: np.ndarray) -> np.ndarray:
    """Of each run of equal names 1 or, where the chunk itself repeats it or a copied text holds it, 2."""
    starts = np.flatnonzero(first)
    many = np.diff(np.r_[starts, len(order)]) > 1
    return 1 + (many | np.logical_or.reduceat(copied[order], starts)).astype(np.uint64) if len(order) else np.zeros(0, np.uint64)


class _Names:
    """The two rounds of one chunk, each derived anew from the texts, some of them at a time."""

    def __init__(self, chunk: pa.Table, how: Repeats, short_bits: int, buckets: int):
        press = zstandard.ZstdDecompressor()
        rows = sorted(zip(chunk["key"].to_pylist(), chunk["text"].to_pylist(), chunk["copies"].to_pylist(), strict=True))
        self.texts = [(k, press.decompress(t), n > 1) for k, t, n in rows]
        self.how, self.buckets, self.bits = how, buckets, short_bits
        width = how.length - how.period + 1
        longest = max((len(t) for _, t, _ in self.texts), default=0)
        cover = (np.arange(0, longest + 1, how.period)[:, None] + np.array(difference_cover(how.period))).ravel()
        self.parts, self.short = [], []
        for a, b in hashing.batches([len(t) for _, t, _ in self.texts]):
            sizes = np.array([len(t) for _, t, _ in self.texts[a:b]])
            bounds = np.r_[0, np.cumsum(sizes)]
            # A text that is too short for a string has no places; texts of a part stand one behind the other.
            upto = np.searchsorted(cover, np.where(sizes < how.length, 0, sizes - width + 1))
            at = np.concatenate([cover[:n] + start for n, start in zip(upto.tolist(), bounds.tolist())])
            self.parts.append((a, b, bounds, at, np.repeat([c for *_, c in self.texts[a:b]], upto)))
            self.short.append(self._strings(a, b, 0).at(at, width) >> np.uint64(64 - short_bits))

    def _strings(self, a: int, b: int, lane: int) -> hashing.Strings:
        return hashing.Strings(b"".join(t for _, t, _ in self.texts[a:b]), lane)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of the sample and their counts (1, or 2 for more)."""
        if not self.short:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        names = np.concatenate(self.short)
        order = np.argsort(names)
        names = names[order]
        new = np.r_[True, names[1:] != names[:-1]][: len(names)]
        return names[new], _tallied(order, new, np.concatenate([p[4] for p in self.parts]))

    def repeated(self, keys: np.ndarray, found: list[bytes], bits: int) -> np.ndarray:
        return _bits(found, [b - a for _, a, b in exchange.split_buckets(keys, bits, self.buckets)]) if found else np.zeros(len(keys), bool)

    def second(self, found: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of each part the places of its remaining suffixes: those that have a whole string and lie less than a period before a repeated name. Of all places their
        names in two lanes, and whether the text has copies."""
        keys = self.first()[0]
        known = keys[self.repeated(keys, found, self.bits)]
        places, lanes, copied = [], ([], []), []
        for (a, b, bounds, at, _), short in zip(self.parts, self.short, strict=True):
            hit = at[_among(short, known)]
            low = np.maximum(hit - self.how.period + 1, bounds[np.searchsorted(bounds, hit, "right") - 1])
            near, whole = (np.zeros(bounds[-1] + 2, np.int32) for _ in range(2))
            np.add.at(near, low, 1)
            np.add.at(near, hit + 1, -1)
            np.add.at(whole, bounds[:-1], 1)
            np.add.at(whole, np.maximum(bounds[1:] - self.how.length + 1, bounds[:-1]), -1)
            i = np.flatnonzero((np.cumsum(near) > 0) & (np.cumsum(whole) > 0)) if len(hit) else hit
            places.append(i)
            copied.append(np.array([c for *_, c in self.texts[a:b]], bool)[np.searchsorted(bounds, i, "right") - 1])
            for lane in (0, 1):
                lanes[lane].append(self._strings(a, b, lane).at(i, self.how.length) if len(i) else np.zeros(0, np.uint64))
        one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in lanes)
        return places, one, two >> np.uint64(64 - self.how.more_bits), np.concatenate(copied) if copied else np.zeros(0, bool)


def _twice(totals: np.ndarray) -> bytes:
    return np.packbits(totals > 1).tobytes()


def _distinct_texts(rows: DataFrame, chunks: int) -> DataFrame:
    """(chunk, key, text, copies), a row for each distinct text; texts are compressed. A task sends a text twice at most, and the rows of a text become one before
    Python gets the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            new: list[tuple[int, bytes, bytes]] = []
            for x in batch.column(0):
                text = (x.as_py() or "").encode("utf-8", "surrogatepass")
                key = hashlib.sha256(text).digest()
                if sent.setdefault(key, 0) < 2:  # two of them in one task are enough to know that it has copies
                    sent[key] += 1
                    new.append((int.from_bytes(key[:8], "little") % chunks, key, press.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([n[j] for n in new], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "key", "text"])

    sent = rows.mapInArrow(run, "chunk long, key binary, text binary").repartition("chunk")
    return sent.groupBy("chunk", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def repeated_spans(documents: DataFrame, how: Repeats = Repeats(), text_col: str = "text") -> DataFrame:
    """One row per distinct text: key (its SHA-256), copies (whether it has any), starts and ends of the maximal repeated runs in bytes, kept_sha256."""
    texts = documents.select(F.col(text_col).alias("text"))
    total = texts.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    names = total * len(difference_cover(how.period)) // how.period
    short_bits = min(64, max(32, names.bit_length() + how.spare_bits))
    buckets = exchange.bucket_count(names)
    chunks = _distinct_texts(texts, exchange.chunk_count(total, how.chunk_bytes))
    made = lambda chunk: _Names(chunk, how, short_bits, buckets)
    first = exchange.answers(exchange.request(chunks, lambda c: made(c).first(), short_bits, buckets), _twice)

    def ask(chunk: pa.Table, found: list[bytes]) -> pa.Table:
        _, one, two, copied = made(chunk).second(found)
        order, new = exchange.ranked(one, two)
        keys, more = one[order][new], two[order][new]
        rows = exchange.request_rows(chunk["chunk"][0].as_py(), keys, _tallied(order, new, copied), parts := exchange.split_buckets(keys, 64, buckets))
        return rows.append_column("more", pa.array([exchange.pack(more[a:b]) for _, a, b in parts], pa.binary()))

    second = exchange.answers(exchange.resolve(chunks, first, ask, f"{exchange.REQUEST}, more binary"), _twice)
    replies = first.withColumn("round", F.lit(1)).unionAll(second.withColumn("round", F.lit(2)))

    def settle(chunk: pa.Table, found: pa.Table) -> pa.Table:
        of = made(chunk)
        turn = found["round"].to_numpy() if len(found) else np.zeros(0, int)
        one, two = (exchange.in_order(found.filter(pa.array(turn == k))) if len(found) else [] for k in (1, 2))
        places, lane, more, _ = of.second(one)
        order, new = exchange.ranked(lane, more)
        hit = np.zeros(len(lane), bool)
        hit[order] = of.repeated(lane[order][new], two, 64)[np.cumsum(new) - 1] if len(lane) else hit
        out, done = [], 0
        for (a, b, bounds, *_), i in zip(of.parts, places, strict=True):
            i, done = i[hit[done : done + len(i)]], done + len(i)
            cut = np.searchsorted(i, bounds)
            for k, (key, text, copied) in enumerate(of.texts[a:b]):
                runs = covered(len(text), i[cut[k] : cut[k + 1]] - bounds[k], how.length)
                if copied and len(text) >= how.length:
                    runs = np.array([[0, len(text)]])
                kept, last = hashlib.sha256(), 0
                for x, y in runs:
                    kept.update(text[last:x])
                    last = y
                kept.update(text[last:])
                out.append((key, copied, runs[:, 0].tolist(), runs[:, 1].tolist(), kept.hexdigest()))
        kinds = (("key", pa.binary()), ("copied", pa.bool_()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()))
        return pa.table({k: pa.array([o[j] for o in out], t) for j, (k, t) in enumerate(kinds)})

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(settle, "key binary, copied boolean, starts array<long>, ends array<long>, kept_sha256 string")


def remove_repeats(documents: DataFrame, how: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends."""
    found = materialise(repeated_spans(documents, how, text_col), f"{shared_dir(documents.sparkSession)}/spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text_bytes(F.col(text_col)).alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("k"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.join(found, F.col("k") == F.col("key")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256", "starts", "ends")
