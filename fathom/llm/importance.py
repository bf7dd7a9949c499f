"""Quality by importance resampling (operator 2).

Two generative models over hashed word n-grams (unigrams and bigrams, `buckets` of them, add-one smoothing): one of the target (labelled documents of
high quality that are not toxic), one of all raw text. A document's log weight is the sum over its n-grams of log p_target - log p_raw;
sampling k documents without replacement by these weights is keeping the k greatest keys of log weight + Gumbel noise.

Raw counts are over all documents. The target model is fitted on a bounded sample: labelled documents with the least hash of their id, about
`labelled` of them. A task counts into two arrays of `buckets` numbers, so the model that reaches the driver has a fixed size. The k-th
greatest key is found by narrowing histograms over all rows, never by a sort in one task.

Noise comes from a hash of the id: reruns agree, and rows of one id and text are kept or dropped together. Ties at the k-th key are all kept. Null or empty
texts have log weight 0. With no usable label the target equals the raw model, and the choice is uniform. An empty table gives no row. Only the id and
text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.hashing import mix, word_hashes
from fathom.llm.shared import id_text, materialise, shared_dir


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    #: Bound of the labelled sample, in rows.
    labelled: int = 20_000
    #: Share of the documents that are kept.
    rate: float = 0.75
    seed: int = 17


def features(text: str | None, buckets: int) -> np.ndarray:
    """Bucket of every unigram and bigram of the lower-cased text, repeats included."""
    if not text:
        return np.zeros(0, np.int64)
    h = word_hashes(text.lower().encode("utf-8", "surrogatepass"))
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64)


def _unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def target_ids(labels: DataFrame, how: Resampling) -> set[str]:
    """Ids of the labelled sample, at most about how.labelled."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("string").alias("i")).distinct()
    n = good.count()
    if n > how.labelled:
        good = good.filter(_unit(F.col("i"), how.seed + 1) < how.labelled / n)
    return {r.i for r in good.collect()}


def fit(documents: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> np.ndarray:
    """log p_target - log p_raw of every bucket."""
    ids = documents.sparkSession.sparkContext.broadcast(target_ids(labels, how))
    buckets = how.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = features(text.as_py(), buckets)
                if i in ids.value:
                    counts[1] += np.bincount(found, minlength=buckets)
                np.add.at(counts[0], found, 1)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], names=["b", "raw", "target"])

    rows = documents.select(id_text(F.col("doc_id")), "text").mapInArrow(run, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in rows:
        raw[r.b] += r.raw
        target[r.b] += r.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_greatest(keys: DataFrame, column: str, k: int, small: int = 50_000) -> float:
    """The k-th greatest of a double column: histograms over a range that shrinks to a bin of at most `small` rows, or of one value."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return low
    above = 0
    while True:
        inside = keys.filter((F.col(column) >= low) & (F.col(column) <= high))
        if n <= small or low == high:
            rows = inside.select(column).orderBy(F.desc(column)).limit(k - above).collect() if n <= small else []
            return rows[-1][0] if rows else low
        width = (high - low) / 1024 or math.ulp(low)
        bins = {int(r.b): r for r in inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b].n >= k:
                low, high, n = bins[b].low, bins[b].high, bins[b].n
                break
            above += bins[b].n


def resample(documents: DataFrame, labels: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """One row per document: doc_id, log_weight, n_features, gumbel_key, selected."""
    ratio = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, how))
    rows = documents.select("doc_id", F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py(), how.buckets) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(ratio.value[f].sum()) for f in found], pa.float64()), pa.array(map(len, found), pa.int64())], names=["doc_id", "log_weight", "n_features"])

    scored = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, log_weight double, n_features long")
    noise = -F.log(-F.log(_unit(id_text(F.col("doc_id")), how.seed)))
    scored = materialise(scored.withColumn("gumbel_key", F.col("log_weight") + noise), f"{shared_dir(documents.sparkSession)}/scored")
    cut = kth_greatest(scored, "gumbel_key", math.ceil(how.rate * scored.count()))
    return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(cut))
