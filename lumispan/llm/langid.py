"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of letters per language. The log-probability matrix
(languages x buckets, of a fixed size) is broadcast; each Arrow batch is scored as a sparse
indicator matrix (bucket indices plus row offsets) times that matrix, in numpy.

Defined results: a null text, or one without a letter, gives ``und`` and score 0; rows with a
null language teach nothing; with no training rows every text gives ``und``. Equal posteriors
go to the language that comes first by code point. Repeated rows are scored alike. Extra columns
are kept, and an input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import every, quoted, release, releasing, scratch, small_batches

UNKNOWN = "und"
ORDERS = 3
SEGMENT = 1 << 19
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageModel:
    """``log_prob[language, bucket]``, with a last bucket of zeros for windows that don't count."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray

    @property
    def bits(self) -> int:
        return (self.log_prob.shape[1] - 1).bit_length() - 1 if len(self.languages) else 0


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _windows(text_codes: np.ndarray, bits: int, limit: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of each window that starts at each code point, by order, and which code points are letters.

    Code 0 stands between texts; a window that touches it, or has no letter, gets the neutral bucket.
    """
    letter = _letter_table()[text_codes]
    codes = np.where(letter | (text_codes == 0), text_codes, np.uint32(32))
    n, out = len(codes), []
    h = np.zeros(n, np.uint32)
    some = np.zeros(n, bool)
    bad = np.zeros(n, bool)
    for k in range(ORDERS):
        shifted = codes[k:]
        m = n - k
        if m <= 0:
            break
        h[:m] += shifted * _MIX[k]
        h[:m] ^= h[:m] >> np.uint32(15)
        h[:m] *= np.uint32(0x2C1B3C6D)
        some[:m] |= letter[k:]
        bad[:m] |= shifted == 0
        bad[m:] = True
        bucket = (h >> np.uint32(32 - bits)).astype(np.int32)
        drop = bad | ~some
        if limit is not None:
            drop |= limit
        bucket[drop] = 1 << bits
        out.append(bucket)
    return out, letter


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray | None]]:
    """Runs of texts of about SEGMENT code points: (rows, code points, starts, positions that only serve as look-ahead).

    Every text ends with a zero code. A longer text comes in several slices.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0

    def pack():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
        return rows, codes, starts, None

    for i, text in enumerate(texts):
        if not text:
            continue
        text = text.replace("\0", " ").lower()
        if len(text) > SEGMENT:
            for at in range(0, len(text), SEGMENT):
                codes = np.frombuffer((text[at : at + SEGMENT + ORDERS - 1] + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
                yield [i], codes, np.zeros(1, np.int64), np.arange(len(codes)) >= SEGMENT
            continue
        rows.append(i)
        parts.append(text + "\0")
        held += len(text)
        if held >= SEGMENT:
            yield pack()
            rows, parts, held = [], [], 0
    if rows:
        yield pack()


def uniform(key: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for each key."""
    return (F.pmod(F.xxhash64(F.lit(seed), key.cast("string")), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 4000, bits: int = 16, max_languages: int = 512, seed: int = 17) -> LanguageModel:
    """Fit on a sample of about ``docs_per_language`` rows of each language, drawn by a hash of the id.

    ``docs_per_language`` is the documented bound of the training sample; each sampled text is
    read whole. More than ``max_languages`` languages raise ValueError. With many languages the
    buckets shrink, so that the matrix has at most 2**24 entries.
    """
    small_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((0, 1), np.float32))
    while bits > 8 and len(languages) << bits > 1 << 24:
        bits -= 1
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in sizes.items()], "lang string, rate double")
    sample = labelled.join(F.broadcast(rates), "lang").filter(uniform(F.col("id"), seed) < F.col("rate")).select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), (1 << bits) + 1), np.int64)
        for batch in batches:
            lang = [index[x] for x in batch.column(0).to_pylist()]
            for rows, codes, starts, limit in _slices(batch.column(1).to_pylist()):
                of = np.repeat(np.array([lang[r] for r in rows]), np.diff(np.append(starts, len(codes))))
                for bucket in _windows(codes, bits, limit)[0]:
                    np.add.at(total, (of, bucket), 1) if len(codes) < 64 else np.add(total, np.bincount(of * total.shape[1] + bucket, minlength=total.size).reshape(total.shape), out=total)
        at, bucket = np.nonzero(total[:, :-1])
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[at, bucket]})

    # at most languages x buckets rows, whatever the corpus holds
    counted = sample.mapInArrow(count, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), 1 << bits))
    counts[counted["at"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    counts += 0.5
    log_prob = np.zeros((len(languages), (1 << bits) + 1), np.float32)
    log_prob[:, :-1] = np.log(counts / counts.sum(axis=1, keepdims=True))
    total = sum(sizes.values())
    return LanguageModel(languages, np.array([math.log(sizes[k] / total) for k in languages]), log_prob)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior of each whole text."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    total = np.zeros((n, len(model.languages)))
    letters = np.zeros(n, bool)
    for rows, codes, starts, limit in _slices(texts):
        buckets, letter = _windows(codes, model.bits, limit)
        rows_a = np.array(rows)
        letters[rows_a] |= np.logical_or.reduceat(letter, starts)
        for k, row in enumerate(model.log_prob):
            total[rows_a, k] += sum(np.add.reduceat(row[b], starts, dtype=np.float64) for b in buckets)
    total += model.log_prior
    best = total.argmax(axis=1)
    with np.errstate(under="ignore"):
        posterior = 1.0 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, posterior, 0.0)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. Only ``text_col`` is an input of the prediction."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                labels, score = score_texts(LanguageModel(*shared.value), [None if x is None else str(x) for x in texts])
                yield pd.DataFrame({"lang_pred": labels, "score": score})
        finally:
            release()

    made = scratch(docs, "_judged")
    judged = docs.withColumn(made, judge(quoted(text_col).cast("string")))
    return judged.select(*every(docs, ("lang_pred", "score")), f"{made}.lang_pred", f"{made}.score")
