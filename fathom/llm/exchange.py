"""Packed request and answer: how chunks of documents learn corpus-wide counts without a row per occurrence.

Texts are dealt into chunks of a few MB. A chunk sends every distinct 64-bit key it holds once, with its own count, as sorted delta-coded arrays, one
a bucket of the key range. A bucket adds up the counts of equal keys over all chunks and answers each chunk with an array that stands in the order of
what the chunk sent; the chunk derives its keys again and so needs no keys back. A key that stands in a third of all documents costs one
entry a chunk, never one a document, and nothing is collected to the driver.

The chunk exchange is the same subtree for request and answer, so Spark reuses one shuffle of the texts for both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REQUEST = "bucket int, chunk long, keys binary, counts binary"
ANSWER = "chunk long, bucket int, answer binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the first byte is that width."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    rows = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys: the first as it is, then the differences."""
    return int(keys[0]).to_bytes(8, "little") + pack(np.diff(keys)) if len(keys) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(data, np.uint64, 1)
    return np.concatenate([first, first + np.cumsum(unpack(data[8:]), dtype=np.uint64)])


def bucket_count(items: int, each: int = 1_000_000, least: int = 64) -> int:
    """A power of two, so that a bucket gets about `each` keys at most."""
    return 1 << max(least - 1, items // each).bit_length()


def chunk_count(total_bytes: int, chunk_bytes: int = 8 << 20, least: int = 64) -> int:
    return max(least, -(-total_bytes // chunk_bytes))


def split_buckets(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted keys below 2^bits; buckets is a power of two."""
    if not len(keys):
        return []
    which = (keys >> np.uint64(bits - buckets.bit_length() + 1)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    return [(int(which[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]


def request_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, parts: list[tuple[int, int, int]]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([p[0] for p in parts], pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            "keys": pa.array([pack_sorted(keys[a:b]) for _, a, b in parts], pa.binary()),
            "counts": pa.array([pack(counts[a:b]) for _, a, b in parts], pa.binary()),
        }
    )


def request(chunks: DataFrame, extract: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], bits: int, buckets: int) -> DataFrame:
    """extract gives a chunk's distinct sorted keys (below 2^bits) and its counts."""

    def run(chunk: pa.Table) -> pa.Table:
        keys, counts = extract(chunk)
        return request_rows(chunk["chunk"][0].as_py(), keys, counts, split_buckets(keys, bits, buckets))

    return chunks.groupBy("chunk").applyInArrow(run, REQUEST)


def answer_rows(bucket: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table({"chunk": bucket["chunk"].cast(pa.int64()), "bucket": bucket["bucket"].cast(pa.int32()), "answer": pa.array(answers, pa.binary())})


def ranked(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys (by a second lane where the first agrees), and which of them in this order are the first of their kind."""
    order = np.argsort(keys, kind="stable")
    one = keys[order]
    same = one[1:] == one[:-1]
    if more is not None and (same & ((two := more[order])[1:] != two[:-1])).any():
        order = np.lexsort((more, keys))
        one, two = keys[order], more[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    return order, np.r_[True, ~same][: len(keys)]


def by_word(words: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """The order of distinct words by their hashes and then by themselves."""
    order = np.argsort(hashes, kind="stable")
    one = hashes[order]
    same = np.flatnonzero(one[1:] == one[:-1])
    for i in same[np.r_[True, np.diff(same) > 1][: len(same)]].tolist():  # where a run of equal hashes starts
        j = i + 1 + int(np.argmax(np.r_[one[i + 1 :] != one[i], True]))
        order[i:j] = sorted(order[i:j].tolist(), key=lambda k: words[k].as_py())
    return order


def merged(bucket: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: distinct keys, their totals, and for every entry sent its place among them; last, where each row's entries end. A column `more` is a
    second lane of the keys."""
    keys = [unpack_sorted(x.as_py()) for x in bucket["keys"]]
    counts = np.concatenate([unpack(x.as_py()) for x in bucket["counts"]]).astype(np.int64)
    more = np.concatenate([unpack(x.as_py()) for x in bucket["more"]]) if "more" in bucket.column_names else None
    ends = np.cumsum([len(k) for k in keys])
    flat = np.concatenate(keys)
    order, first = ranked(flat, more)
    place = np.empty(len(flat), np.int64)
    place[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return flat[order[starts]], np.add.reduceat(counts[order], starts), place, ends


def answers(requests: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """For every request the totals of its keys over all chunks, encoded."""

    def run(bucket: pa.Table) -> pa.Table:
        _, totals, place, ends = merged(bucket)
        return answer_rows(bucket, [encode(x) for x in np.split(totals[place], ends[:-1])])

    return requests.groupBy("bucket").applyInArrow(run, ANSWER)


def in_order(replies: pa.Table) -> list[bytes]:
    """A chunk's answers by bucket, so that joined they stand in the order of its keys."""
    return [x.as_py() for x in replies.sort_by("bucket")["answer"]]


def resolve(chunks: DataFrame, replies: DataFrame, use: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """use gets a chunk's rows and its answers in order."""

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        return use(chunk, in_order(found))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
