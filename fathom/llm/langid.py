"""Language identification by word-first backoff (operator 7).

A known word scores by its log frequency in each language. An unseen word, framed by spaces, is covered from left to right by the longest character n-gram
that is known (from `longest` down to 1), each scored by its log frequency among n-grams of its length in that language; its score is the mean of these.
A document's score for a language is the mean over its words, and the posterior is the softmax of that mean times min(words, trust).

Learning is on a bounded sample: about `sample` documents a language, those with the least hash of their id, among the documents that `train` selects. Every word and
n-gram of the sample is kept, so the model that is sent to the tasks is bounded by the sample alone. Frequencies are counted by partial sums in each task and one exchange
of (language, word) rows. Prediction is a map: no shuffle, one text at a time, whole texts.

lang_pred is `und` with score 0 where the text is null or has no letter, or where nothing could be learned. Rows with null text or null language teach nothing. Ties
go to the language that sorts first. Repeated rows get equal results. An empty table gives no row. Only id, text and (in learning) language columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import id_text, quoted, small_batches

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Backoff:
    longest: int = 4
    sample: int = 3_000
    add: float = 0.5
    trust: int = 20
    seed: int = 29


def fold(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, longest: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for n in range(1, longest + 1) for i in range(len(framed) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    longest: int
    trust: int

    def backed_off(self, word: str) -> np.ndarray:
        framed, i, found = f" {word} ", 0, []
        while i < len(framed):
            for n in range(min(self.longest, len(framed) - i), 0, -1):
                row = self.grams.get(framed[i : i + n])
                if row is not None:
                    found.append(row)
                    i += n
                    break
            else:
                i += 1
        return self.gram_rows[found].mean(axis=0) if found else np.zeros(len(self.languages))

    def predict(self, text: str | None, memo: dict[str, np.ndarray]) -> tuple[str, float]:
        words = fold(text)
        if not words or not self.languages:
            return "und", 0.0
        total, known, times = np.zeros(len(self.languages)), [], []
        for word, n in Counter(words).items():
            at = self.words.get(word)
            if at is not None:
                known.append(at)
                times.append(n)
                continue
            row = memo.get(word)
            if row is None:
                if len(memo) > 200_000:
                    memo.clear()
                row = memo[word] = self.backed_off(word)
            total += n * row
        if known:
            total += np.array(times) @ self.word_rows[known]
        mean = total / len(words)
        odds = np.exp((mean - mean.max()) * min(len(words), self.trust))
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(id_text(doc_id).cast("binary")) % modulus == remainder


def learn(documents: DataFrame, how: Backoff = Backoff(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """documents: those to learn from."""
    rows = documents.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.shiftrightunsigned(F.xxhash64(id_text(F.col("i")), F.lit(how.seed)), 11).cast("double") / float(1 << 53)
    share = F.lit(1.0)
    for lang in sorted(counts):
        if counts[lang] > how.sample:
            share = F.when(F.col("lang") == lang, how.sample / counts[lang]).otherwise(share)
    sample = rows.filter(unit < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(fold(text.as_py()))
        out: Counter = Counter()
        for lang, words in found.items():
            for word, n in words.items():
                out[lang, 0, word] += n
                for g in grams(word, how.longest):
                    out[lang, len(g), g] += n
        keys = list(out)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(out.values(), pa.int64())], names=["lang", "kind", "key", "n"])

    counted = sample.mapInArrow(run, "lang string, kind int, key string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    found = counted.toArrow().combine_chunks()  # columns, not rows of Python; its size follows from the sample's
    languages = sorted(counts)
    spoken = found["lang"].combine_chunks().dictionary_encode()
    place = {lang: k for k, lang in enumerate(languages)}
    number = np.array([place[x] for x in spoken.dictionary.to_pylist()], int)[spoken.indices.to_numpy()]
    kinds, times = found["kind"].to_numpy(), found["n"].to_numpy()
    tables = []
    for of in (kinds == 0, kinds > 0):
        keys = found["key"].filter(pa.array(of)).combine_chunks().dictionary_encode()
        n, kind = np.zeros((len(keys.dictionary), len(languages))), np.zeros(len(keys.dictionary), int)
        np.add.at(n, (keys.indices.to_numpy(), number[of]), times[of])
        kind[keys.indices.to_numpy()] = kinds[of]
        rows_of = np.zeros_like(n)
        for k in set(kind.tolist()):
            at = kind == k
            rows_of[at] = np.log((n[at] + how.add) / (n[at].sum(axis=0) + how.add * at.sum()))
        tables += [{key: i for i, key in enumerate(keys.dictionary.to_pylist())}, rows_of]
    return Model(languages, *tables, how.longest, how.trust)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            found = [sent.value.predict(x.as_py(), memo) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{quoted(id_col)} {dict(rows.dtypes)[id_col]}, lang_pred string, score double")
