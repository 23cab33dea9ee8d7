"""Operator 10: toxicity severity by cumulative-link ordinal regression.

Grades are ordered (0 none, 1 mild, 2 severe). One weight vector over sparse word features is shared by all
thresholds: P(grade <= k) = sigmoid(theta_k - w.x). The result is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HASH_BITS = 22
#: Labelled documents that the fit looks at, at most (a hash sample of each class).
SAMPLE_PER_CLASS = 3000
#: Bytes of the beginnings of longer words that are features as well: they stand for all forms of a stem.
BEGINNINGS = (5, 6, 7, 8)
#: Words that the model keeps: the strongest by smoothed log-odds, each in so many toxic documents of the sample at least.
FEATURES, LEAST_DOCUMENTS, LEAST_LOG_ODDS = 1024, 3, 2.5

_BREAK = np.ones(256, bool)
_BREAK[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each word (letters and apostrophes, lower case) of a block and of the beginnings of longer ones, in order of rows."""
    blank = np.where(_BREAK[data], 32, data).astype(np.uint8)
    starts, ends, first = common.word_spans(blank, offsets)
    prefix = common.POLY_A.prefix(lowered(data))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, hashes = [row], [common.POLY_A.of(prefix, starts, ends)]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        rows.append(row[long])
        hashes.append(common.mixed(common.POLY_A.of(prefix, starts[long], starts[long] + n) + np.uint64(n)))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], (np.concatenate(hashes)[order] >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Model:
    features: np.ndarray  # hashed words, sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, x: np.ndarray) -> np.ndarray:
        """P(grade = k) of each row."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -60, 60)))
        return np.diff(np.concatenate((np.zeros((len(x), 1)), below, np.ones((len(x), 1))), 1), axis=1)


def design(features: np.ndarray, rows: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log(1 + count) of the model's words."""
    at = np.searchsorted(features, word)
    hit = at < len(features)
    hit[hit] = features[at[hit]] == word[hit]
    return np.log1p(np.bincount(row[hit] * max(1, len(features)) + at[hit], minlength=rows * len(features)).reshape(rows, len(features)).astype(np.float64))


def fit(docs: list[np.ndarray], toxic: np.ndarray, steps: int = 600, ridge: float = 1e-3) -> Model:
    """Words by log-odds, grades by how many of those words a toxic document holds, then the ordinal fit by gradient steps.

    The labels are 0 and 1; severe are the toxic documents with more of the chosen words than the median one.
    """
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    pairs = np.unique(np.stack((rows, flat), 1), axis=0) if len(flat) else np.zeros((0, 2), np.int64)
    vocabulary, at = np.unique(pairs[:, 1], return_inverse=True)
    in_toxic = np.bincount(at, toxic[pairs[:, 0]].astype(float), minlength=len(vocabulary))
    in_clean = np.bincount(at, minlength=len(vocabulary)) - in_toxic
    odds = np.log((in_toxic + 0.5) / (toxic.sum() + 1)) - np.log((in_clean + 0.5) / ((~toxic).sum() + 1))
    chosen = np.flatnonzero((in_toxic >= min(LEAST_DOCUMENTS, max(1, toxic.sum() // 4))) & (odds >= LEAST_LOG_ODDS))
    chosen = chosen[np.lexsort((vocabulary[chosen], -odds[chosen] * np.sqrt(in_toxic[chosen])))][:FEATURES]
    features = np.sort(vocabulary[chosen])
    x = design(features, len(docs), rows, flat)
    total = x.sum(1)
    grade = np.where(toxic, 1 + (total > np.median(total[toxic])) if toxic.any() else 1, 0)
    w, theta = np.full(len(features), 0.5), np.array([1.0, 2.0])
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))  # both classes weigh the same
    m = [np.zeros(len(w)), np.zeros(2), np.zeros(len(w)), np.zeros(2)]
    for step in range(1, steps + 1):
        z = np.clip(theta[None, :] - (x @ w)[:, None], -40, 40)
        cum = 1 / (1 + np.exp(-z))
        full = np.concatenate((np.zeros((len(x), 1)), cum, np.ones((len(x), 1))), 1)
        p = np.clip(full[np.arange(len(x)), grade + 1] - full[np.arange(len(x)), grade], 1e-9, None)
        slope = cum * (1 - cum)
        d = np.zeros((len(x), 2))
        for k in range(2):
            d[:, k] = slope[:, k] * ((grade == k).astype(float) - (grade == k + 1)) / p
        d *= share[:, None]
        g_theta, g_w = -d.sum(0), x.T @ d.sum(1) + ridge * w
        for k, g in enumerate((g_w, g_theta)):
            m[k] = 0.9 * m[k] + 0.1 * g
            m[k + 2] = 0.99 * m[k + 2] + 0.01 * g * g
            move = 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(m[k + 2] / (1 - 0.99**step)) + 1e-8)
            if k:
                theta = np.sort(theta - move)
            else:
                w = w - move
    return Model(features, w, theta)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.text_buffer(batch.column(1))
        for lo, hi in common.row_blocks(offsets):
            row, word = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([np.unique(word[a:b], return_counts=True)[0].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32()))], ["toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, *, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from the labelled documents, a bounded hash sample of each class. Null labels and texts are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have.get(True):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([30.0, 40.0]))
    part = lambda k: F.lit(min(1.0, sample_per_class / max(1, have.get(k, 0))))
    dealt = (F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < F.when(F.col("toxic"), part(True)).otherwise(part(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most 2 x sample_per_class ids, so they are broadcast rather than the texts shuffled
    sample = texts.join(F.broadcast(known.where(dealt)), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic boolean, words array<int>").toArrow()
    docs_words, toxic = [np.asarray(x, np.int64) for x in sample.column("words").to_pylist()], np.array(sample.column("toxic").to_pylist(), bool)
    order = sorted(range(len(toxic)), key=lambda k: (toxic[k], docs_words[k].tobytes()))
    return fit([docs_words[k] for k in order], toxic[order])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            for lo, hi in common.row_blocks(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                x = np.zeros((hi - lo, len(model.features)))
                for a, b, part, edge in _chunks(own, at):
                    row, word = words(part, edge)
                    x[a:b] += np.expm1(design(model.features, b - a, row, word))
                p = model.grades(np.log1p(x))
                expected = p[:, 1] + 2 * p[:, 2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(expected), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(p[:, 1] + p[:, 2] >= 0.5)], ["doc_id", "severity", "p_mild", "p_severe", "toxic_pred"])

    return run


def _chunks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A block as it is, or one long row in parts cut between words."""
    if len(at) > 2 or len(data) <= 2 * common.BLOCK_BYTES:
        yield 0, len(at) - 1, data, at
        return
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + common.BLOCK_BYTES)
        while hi < len(data) and not _BREAK[data[hi]]:
            hi += 1
        yield 0, 1, data[lo:hi], np.array([0, hi - lo])
        lo = hi


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), p_mild, p_severe, toxic_pred: a row for every row with a doc_id.

    A null or empty text has no features and gets the grade of such a text; rows that repeat a doc_id are each
    predicted; where no toxic label exists every severity is about 0. Other columns are not looked at.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return d.mapInArrow(_predict(model), "doc_id long, severity double, p_mild double, p_severe double, toxic_pred boolean")
