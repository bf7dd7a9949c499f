"""Token counts of whole texts by a compiled transducer (operator 11).

Texts of a batch are cut into pieces by array operations (pretokens.py), equal pieces of a batch are counted once, and each distinct piece runs through the
transducer (transducer.py), whose transitions carry the tokens they add.

A text longer than chunk_bytes is cut into chunks that go to different tasks. What a chunk does to any state it may be entered in is a map with three parts: the bytes
before its first start of a piece (head), which continue whatever piece was open; the tokens of what follows; and the transducer's state after its last open piece (tail). A
chunk without any start is all head. Two neighbouring maps make one by running the head of the second from the tail of the first, and as this is associative, the maps of a
text are put together as the up-sweep of a prefix scan: runs of SCAN neighbours in parallel, then runs of their results, until one is left. Within a run the scan
also tells how many tokens stand before each chunk.

Strings of special tokens count as one token each, as the library takes them by default, and nothing reaches over them; a text is cut at them first.

A null or empty text has no tokens. Repeated rows are counted one by one, null and repeated ids are kept as they are; an empty table gives an empty result. Only the id and the
text are read, so other columns may have any names. Memory: a batch of texts, and the transducer's tables, which are emptied at a bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.pretokens import AFTER, BEFORE, Splitter, pieces, texts_of
from fathom.llm.shared import materialise, shared_dir, small_batches
from fathom.llm.transducer import Transducer, compiled

#: Neighbouring maps that one round of the scan puts together; two rounds and a last one hold any text Spark can hold.
SCAN = 256
_MOST_PIECES = 400_000


@dataclass(frozen=True)
class Limit:
    tokens: int = 1024
    chunk_bytes: int = 32 << 10


@dataclass(frozen=True)
class Map:
    """What a stretch of text does: head, then (where crossed, that is, where a piece starts in it) tokens counted after the head, and the state of the piece left open."""

    head: bytes
    crossed: bool
    tokens: int
    tail: bytes


def compose(a: Map, b: Map, machine: Transducer) -> Map:
    if not a.crossed:
        return Map(a.head + b.head, b.crossed, b.tokens, b.tail)
    state, more = machine.run(b.head, machine.local(a.tail))
    return Map(a.head, True, a.tokens + more + b.tokens, b.tail if b.crossed else machine.portable(state))


def scan(maps: Iterable[Map], machine: Transducer) -> Iterator[Map]:
    """The maps of all prefixes."""
    done = None
    for m in maps:
        done = m if done is None else compose(done, m, machine)
        yield done


class Counter:
    """Counts pieces, remembering those met before."""

    def __init__(self, machine: Transducer, splitter: Splitter):
        self.machine, self.splitter = machine, splitter
        self.known: dict[bytes, int] = {}

    def count(self, distinct: list[bytes]) -> np.ndarray:
        known, tokens = self.known, self.machine.tokens
        if len(known) > _MOST_PIECES:
            known.clear()
        out = np.empty(len(distinct), np.int64)
        for k, piece in enumerate(distinct):
            n = known.get(piece)
            if n is None:
                n = tokens(piece)
                if len(piece) <= 64:
                    known[piece] = n
            out[k] = n
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        stops = special_spans(data, offsets, self.machine.special)
        starts = self.splitter.starts(data, np.unique(np.concatenate([offsets, stops.ravel()])))
        found = pieces(data, starts)
        counts = self.count(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        if len(stops):
            which = np.searchsorted(starts, stops)
            for a, b in which.tolist():
                counts[a:b] = 0
                counts[a] = 1
        sums = np.concatenate([[0], np.cumsum(counts)])
        at = np.searchsorted(starts, offsets)
        return sums[at[1:]] - sums[at[:-1]]

    def chunk(self, data: bytes, before: int, after: int) -> Map:
        """before, after: bytes of context that belong to the neighbours; before 0: the text starts here, after 0: it ends here."""
        array = np.frombuffer(data, np.uint8)
        starts = self.splitter.starts(array, np.array([0, len(data)]))
        end = len(data) - after
        starts = starts[(starts >= before) & (starts < end)]
        if not len(starts):
            return Map(data[before:end], False, 0, b"")
        found = pieces(array[: starts[-1]], starts[:-1]) if len(starts) > 1 else None
        counted = int(self.count(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)].sum()) if found is not None else 0
        state, last = self.machine.run(data[starts[-1] : end])
        return Map(data[before : starts[0]], True, counted + last, self.machine.portable(state))


def special_spans(data: np.ndarray, offsets: np.ndarray, special: set[bytes]) -> np.ndarray:
    """(from, to) of the special strings inside texts, from the left."""
    whole, out = data.tobytes(), []
    for word in special:
        at = whole.find(word)
        while at >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(word) - 1, "right"):
                out.append((at, at + len(word)))
                at = whole.find(word, at + len(word))
            else:
                at = whole.find(word, at + 1)
    kept: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def cuts(data: bytes, chunk_bytes: int) -> Iterator[tuple[bytes, int, int]]:
    """(chunk with its context, bytes of context before and after): chunks start between characters."""
    edge = lambda at: next((k for k in range(at, min(at + 4, len(data))) if data[k] & 0xC0 != 0x80), len(data))
    places = [0]
    while places[-1] < len(data):
        places.append(min(edge(places[-1] + chunk_bytes), len(data)) if places[-1] + chunk_bytes < len(data) else len(data))
    for a, b in zip(places, places[1:], strict=False):
        low, high = a, b
        for _ in range(BEFORE):
            low = next((k for k in range(low - 1, max(low - 5, -1), -1) if data[k] & 0xC0 != 0x80), low)
        for _ in range(AFTER):
            high = edge(high + 1) if high < len(data) else high
        yield data[low:high], a - low, high - b


_CUT = "doc_id {}, row string, place long, n_bytes long, n_tokens long, before int, after int, piece binary"
_MAP = "row string, place long, head binary, crossed boolean, tokens long, tail binary"


def count_tokens(documents: DataFrame, tokenizer: str, limit: Limit = Limit()) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_tokens, over_limit for each document. tokenizer: path of a byte-level BPE file that driver and executors can read."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    path = shared_dir(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        counter, number, part = Counter(machine, Splitter()), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            sizes = np.diff(offsets)
            long = np.flatnonzero(sizes > limit.chunk_bytes)
            short = np.repeat(sizes <= limit.chunk_bytes, sizes)
            kept = np.concatenate([[0], np.cumsum(np.where(sizes > limit.chunk_bytes, 0, sizes))])
            tokens = counter.texts(data[short] if len(long) else data, kept)
            rows = {"row": [None] * len(sizes), "place": [0] * len(sizes), "n_bytes": sizes.tolist(), "n_tokens": tokens.tolist(), "before": [0] * len(sizes), "after": [0] * len(sizes), "piece": [None] * len(sizes)}
            ids = batch.column(0)
            owners = list(range(len(sizes)))
            for k in long.tolist():
                number, place = number + 1, 0
                text = data[offsets[k] : offsets[k + 1]]
                rows["row"][k] = name = f"{part}-{number}"
                stops = special_spans(text, np.array([0, len(text)]), machine.special)
                rows["n_tokens"][k] = len(stops)
                bounds = [0, *stops.ravel().tolist(), len(text)]
                for a, b in zip(bounds[::2], bounds[1::2], strict=True):
                    for piece, before, after in cuts(text[a:b].tobytes(), limit.chunk_bytes):
                        place += 1
                        owners.append(k)
                        for c, v in zip(("row", "place", "n_bytes", "n_tokens", "before", "after", "piece"), (name, place, 0, 0, before, after, piece), strict=True):
                            rows[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owners, pa.int64())), pa.array(rows["row"], pa.string()), *(pa.array(rows[c], pa.int64()) for c in ("place", "n_bytes", "n_tokens")), pa.array(rows["before"], pa.int32()), pa.array(rows["after"], pa.int32()), pa.array(rows["piece"], pa.binary())],
                ["doc_id", "row", "place", "n_bytes", "n_tokens", "before", "after", "piece"],
            )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(compiled(tokenizer), Splitter())
        for batch in batches:
            before, after = batch.column("before").to_pylist(), batch.column("after").to_pylist()
            maps = [counter.chunk(p, b, a) for p, b, a in zip(batch.column("piece").to_pylist(), before, after, strict=True)]
            yield as_rows(batch.column("row"), batch.column("place"), maps)

    def joined(run: pa.Table) -> pa.Table:
        run = run.sort_by("place")
        *_, whole = scan((Map(*m) for m in zip(*(run[c].to_pylist() for c in ("head", "crossed", "tokens", "tail")), strict=True)), compiled(tokenizer))
        return pa.Table.from_batches([as_rows(run["row"].combine_chunks()[:1], pa.array([run["place"][0].as_py()], pa.int64()), [whole])])

    rows = materialise(documents.select("doc_id", "text").mapInArrow(cut, _CUT.format(kind)), f"{path}/cut")
    maps = rows.filter(F.col("piece").isNotNull()).select("row", "place", "before", "after", "piece").repartition("row", "place").mapInArrow(mapped, _MAP)
    for width in (SCAN, SCAN * SCAN, None):
        run = F.lit(0) if width is None else F.floor(F.col("place") / width)
        maps = maps.groupBy("row", run.alias("run")).applyInArrow(joined, _MAP)
    totals = maps.select(F.col("row").alias("of"), F.col("tokens").alias("more"))
    texts = rows.filter(F.col("piece").isNull())
    out = texts.join(totals, texts.row == totals.of, "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit.tokens).alias("over_limit"))


def as_rows(row: pa.Array, place: pa.Array, maps: list[Map]) -> pa.RecordBatch:
    parts = (pa.array([m.head for m in maps], pa.binary()), pa.array([m.crossed for m in maps], pa.bool_()), pa.array([m.tokens for m in maps], pa.int64()), pa.array([m.tail for m in maps], pa.binary()))
    return pa.RecordBatch.from_arrays([row, place, *parts], ["row", "place", "head", "crossed", "tokens", "tail"])
