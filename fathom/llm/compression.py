"""Quality rules by compression bands (operator 9).

A whole text and its fixed chunks are compressed with zstandard; the ratio (bytes in / bytes out) must lie in a band that depends on the
length, since short texts compress little and long ones more. Above the band a text repeats itself, below it is noise. The limits lie
between the ratios of clean text (texts of sf0.1 and check_l that pass the base rule) and those of random words, with room on both sides. Chunks are
short, so that texts of nearly all lengths have some and a short stretch of noise or repetition fills one: 512 bytes of clean text have ratios of 1.38 to 2.0 in sf0.1, of random
words or base64 at most 1.24, of a loop of twelve words over 5. The last chunk is the text's last chunk_bytes, so that the tail counts; a text below one chunk is
judged as a whole. One map over the documents: no shuffle, memory for one text and its compressed form.

Null or empty texts, and texts with no word, have all counts 0 and fail the base rule. Ties and repeated rows are judged one by one.
Only the id and text columns are read, except by filter_documents, which passes whole rows on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import map_rows, quoted, small_batches

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (length below which the row holds, least ratio, most ratio). chunk_bad: the share of a text's chunks
    outside the band for chunk_bytes at which the text is rejected."""

    whole: tuple[tuple[float, float, float], ...] = (
        (100, 0.0, 2.0), (200, 0.95, 2.0), (300, 1.25, 2.0), (400, 1.25, 2.2), (600, 1.3, 2.3), (800, 1.39, 2.6), (1_000, 1.43, 2.6), (1_500, 1.57, 2.8),
        (2_000, 1.68, 2.9), (4_096, 1.74, 3.1), (8_192, 1.85, 3.2), (float("inf"), 1.95, 3.4),
    )
    chunk_bytes: int = 512
    chunk: tuple[float, float] = (1.3, 2.3)
    chunk_bad: float = 0.1
    level: int = 3
    min_words: int = 50
    repeat_share: tuple[int, int] = (50, 100)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    pair = seq[:-1] * m + seq[1:]
    if m >= 1 << 20:  # three ids would not fit 63 bits: rename pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * m + seq[2:]
    order = np.argsort(triple, kind="stable")
    same = np.diff(triple[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word, split at \\n, equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def judge(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> dict:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, repeats = len(words), repeat_words(words)
    part, whole = bands.repeat_share
    base_failed = n < bands.min_words or whole * repeats > part * n
    ratio = len(data) / len(press.compress(data)) if data else 0.0
    low, high = next((a, b) for top, a, b in bands.whole if len(data) < top)
    size = bands.chunk_bytes
    ratios = [size / len(press.compress(data[i : i + size])) for i in (min(k, len(data) - size) for k in range(0, len(data), size))] if len(data) >= size else []
    bad = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in ratios)
    banded = low <= ratio <= high and not (ratios and bad >= bands.chunk_bad * len(ratios))
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")) if text else 0,
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": duplicate_lines(data),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": banded and not base_failed,
        "zstd_ratio": ratio,
        "n_chunks": len(ratios),
        "n_bad_chunks": bad,
    }


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"
_TYPES = pa.schema([(k, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for k, t in (x.split() for x in _FIELDS.split(", "))])


def quality(documents: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, and whether the bands keep it."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            found = pa.RecordBatch.from_pylist([judge(x.as_py(), bands, press) for x in batch.column(1)], schema=_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[id_col, *_TYPES.names])

    return rows.mapInArrow(run, f"{quoted(id_col)} {dict(rows.dtypes)[id_col]}, {_FIELDS}")


def filter_documents(documents: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns as they were."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([judge(x.as_py(), bands, press)["kept"] for x in texts], pa.bool_()))

    return map_rows(documents, run)
