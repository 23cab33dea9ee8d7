"""Operator 3: language by the nearest of several TF-IDF n-gram centroids per language.

Byte bigrams and trigrams of the letters are hashed to a fixed number of features. Each language's training
vectors are split into a few spherical clusters; a document takes the language of the centroid with the highest
cosine. Where even that is lower than what the centroid's own training documents show, the document is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 4096
#: Training documents per language at most; a classifier's fit is the one thing that may look at a sample.
SAMPLE_PER_LANGUAGE = 600
CENTROIDS = 4
#: A document is rejected below this part of its centroid's lowest training cosine of a thousand.
REJECT_PART = 0.3

# letters stay, in lower case; bytes of non-ASCII characters stay; the rest is one separator
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, offsets: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams, a row for each document; long rows are added up in chunks."""
    rows = len(offsets) - 1
    out = np.zeros((rows, features), np.float32)
    if rows == 1 and len(data) > 2 * common.BLOCK_BYTES:
        for lo in range(0, len(data), common.BLOCK_BYTES):
            part = data[lo : lo + common.BLOCK_BYTES + 2]
            out += gram_counts(part[: common.BLOCK_BYTES + 2], np.array([0, len(part)]), features)
        return out
    if len(data) < 2:
        return out
    c = _CLASS[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets)) * features
    for n in (2, 3):
        m = len(c) - n + 1
        if m <= 0:
            continue
        code = c[:m] * np.uint32(65599) + c[1 : m + 1]
        if n == 3:
            code = code * np.uint32(65599) + c[2:]
        code = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) % features
        inside = (row[:m] == row[n - 1 :]) & (c[1 : m + 1] != 32 if n == 3 else (c[:m] != 32) | (c[1:] != 32))
        out += np.bincount((row[:m] + code)[inside], minlength=rows * features).reshape(rows, features)
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # of each centroid: the cosine below which a document is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm > 0, norm, 1)


def fit(counts: np.ndarray, languages: list[str], centroids: int = CENTROIDS) -> Model:
    """Centroids by a few rounds of spherical k-means within each language, from spread-out seeds."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    model = Model([], idf, np.zeros((0, counts.shape[1]), np.float32), np.zeros(0, np.float32))
    x = model.vectors(counts)
    lang = np.array(languages, dtype=object)
    parts, floors = [], []
    for name in sorted(set(languages)):
        own = x[lang == name]
        unit = lambda v: v / max(float(np.sqrt((v * v).sum())), 1e-12)
        seeds = [unit(own.mean(0))]
        while len(seeds) < min(centroids, len(own)):
            seeds.append(own[int(np.argmin((own @ np.array(seeds).T).max(1)))])
        c = np.array(seeds, np.float32)
        for _ in range(8):
            near = np.argmax(own @ c.T, 1)
            c = np.array([unit(own[near == k].mean(0)) if (near == k).any() else c[k] for k in range(len(c))], np.float32)
        best = (own @ c.T).max(1)
        parts.append(c)
        floors += [REJECT_PART * float(np.quantile(best, 0.001))] * len(c)
        model.languages += [name] * len(c)
    if parts:
        model.centroids = np.concatenate(parts)
        model.floor = np.array(floors, np.float32)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.text_buffer(batch.column(1))
        for lo, hi in common.row_blocks(offsets):
            counts = gram_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            index = [np.flatnonzero(r).astype(np.int32) for r in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(index, pa.list_(pa.int32())), pa.array([r[i].astype(np.float32) for r, i in zip(counts, index, strict=True)], pa.list_(pa.float32()))], ["lang", "ix", "n"])


def train(docs: DataFrame, *, sample_per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """A model from text and non-null lang of the documents whose crc32(doc_id) mod 4 is not 2, a bounded hash sample per language."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32))
    share = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(min(1.0, sample_per_language / n)))])
    dealt = (F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share[F.col("lang")]
    sample = rows.where(dealt).select("lang", "text").mapInArrow(_features, "lang string, ix array<int>, n array<float>").toArrow()
    counts = np.zeros((len(sample), FEATURES), np.float32)
    ix, n = sample.column("ix").combine_chunks(), sample.column("n").combine_chunks()
    row = np.repeat(np.arange(len(sample)), np.diff(ix.offsets.to_numpy()))
    counts[row, ix.flatten().to_numpy()] = n.flatten().to_numpy()
    langs = sample.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda k: (langs[k], counts[k].tobytes()))  # rows come in any order
    return fit(counts[order], [langs[k] for k in order], centroids)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ANY_LETTER = re.compile(r"[^\W\d_]")


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = common.text_buffer(texts)
            for lo, hi in common.row_blocks(offsets):
                own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[own])))
                letter = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                for k in np.flatnonzero(~letter & (np.diff(at) > 0)):
                    letter[k] = bool(_ANY_LETTER.search(texts[int(lo + k)].as_py()))
                best = np.full(hi - lo, len(model.languages))
                score = np.zeros(hi - lo)
                if model.languages:
                    cosine = model.vectors(gram_counts(own, at)) @ model.centroids.T
                    best = np.where(letter, cosine.argmax(1), best)
                    score = np.where(letter, np.clip(cosine.max(1), 0, 1), 0.0).astype(np.float64)
                rejected = ~letter | (score < np.append(model.floor, 2)[best])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid), rejected: a row for every row with a doc_id.

    A text that is null or has no letter is `und`, with score 0, and rejected; so is every text where no language
    could be learnt. Rows that repeat a doc_id are each predicted; ties between centroids go to the first language
    in order; other columns are not looked at.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return d.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def kept_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, that are not rejected (filter within the same pass; nothing is joined)."""
    names = docs.columns
    verdict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("text"))], ["doc_id", "text"])
            rejected = [x for out in verdict([pair]) for x in out.column(3).to_pylist()]
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)
