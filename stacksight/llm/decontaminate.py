"""Operator 2: benchmark items in documents, by CGK random walks and bit-sampling LSH over item-sized windows.

A document is words (A-Z lower-cased, ASCII punctuation left out). A window of an item's size at any word is embedded by random walks: at step
j a walk writes the word it stands on and moves on by a random bit of (j, word), so that few edits of words change few
letters of the embedding. Samples of a few letters are the LSH keys; windows and items that share one are compared by
exact edit distance. Before walking, windows are left out that cannot match: an edit breaks two word pairs at most, so
a match keeps a known number of an item's pairs, and the first of them lies at most two words an edit from where the match
starts. That loses nothing; the keys can (see SHARED).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

#: An item is found where a document has it with edits (words put in, left out or changed) of at most this part of its words.
EDITS = 0.2
#: Shorter items have too few words for walks. One of n words is cut into as many pieces as it may have edits and one more,
#: so one piece is whole wherever the item is found; pieces are looked up by their words, which loses nothing.
LEAST_WORDS = 8
#: Windows that are walked at once, and words of a long text that are looked at together.
AT_ONCE, WORDS_AT_ONCE = 1 << 13, 1 << 15
#: Walks, keys from each walk, letters in a key, and the keys that a window and an item must share to be compared: at EDITS,
#: 0.99 of randomly edited items share as many (tests/llm measures it).
WALKS, KEYS, LETTERS, SHARED = 16, 8, 2, 4
#: Items that one scan of the documents looks for; more take another scan.
ITEMS_IN_ONE_SCAN = 20_000
FOUND = "doc_id long, item_id long, start_word long, n_words long, edits long"

_BLANK = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _BLANK[_lo:_hi] = np.arange(_lo, _hi)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of each row (never 0), and the first word of each row."""
    starts, ends, first = common.word_spans(_BLANK[data], offsets)
    return np.maximum(common.word_hashes(data, starts, ends, lower=True), np.uint64(1)), first


def pairs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of each word with the next one of its row; 0 for the last word."""
    out = np.zeros(len(names), np.uint64)
    if len(names) > 1:
        out[:-1] = np.maximum(common.mixed(names[:-1] * np.uint64(0x9E3779B97F4A7C15) + names[1:]), np.uint64(1))
    out[first[1:][np.diff(first) > 0] - 1] = 0
    return out


def walk_keys(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, walks: int) -> np.ndarray:
    """KEYS keys of each walk over each of the strings symbols[start:end], from letters before `steps`; past its end a string is zeros."""
    r = np.random.default_rng(steps)
    factor = r.integers(1, 1 << 63, (walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    picked = np.array([np.sort(r.choice(steps, LETTERS, replace=False)) for _ in range(walks * KEYS)])
    at = np.tile(start, (walks, 1))
    padded = np.append(symbols, np.uint64(0))
    letters = np.zeros((LETTERS, walks * KEYS, len(start)), np.uint64)
    for j in range(steps):
        letter = padded[np.where(at < end, at, len(symbols))]
        for k, n in zip(*np.nonzero(picked == j), strict=True):
            letters[n, k] = letter[k // KEYS]
        at += ((letter * factor[:, j, None]) >> np.uint64(63)).astype(np.int64)
    out = common.mixed(np.arange(walks * KEYS, dtype=np.uint64))[:, None]
    for n in range(LETTERS):
        out = common.mixed(out ^ letters[n])
    return out


def fingerprints(names: np.ndarray, size: int) -> np.ndarray:
    """Of each `size` consecutive words."""
    at = np.arange(max(0, len(names) - size + 1))
    return common.POLY_B.of(common.POLY_B.prefix(names), at, at + size)


def edits_by_end(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row of text (padded with zeros) and each end, the fewest edits that make some stretch up to there the item."""
    column = np.arange(text.shape[1] + 1)
    row = np.zeros((len(text), text.shape[1] + 1), np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (text != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - column, axis=1) + column
    return row


def edit_distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row of text (padded with zeros), the fewest edits that make some stretch of it the item."""
    return edits_by_end(item, text).min(1)


def first_starts(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row of text, where the first stretch starts that fewest edits make the item."""
    return np.argmin(edits_by_end(item[::-1], text[:, ::-1])[:, ::-1], axis=1)


@dataclass
class Class:
    """Items of about one length."""

    shortest: int
    longest: int
    known: np.ndarray  # of each pair of the vocabulary: whether it occurs in an item of the class
    least: int  # pairs that a match keeps
    keys: np.ndarray  # sorted, and
    items: np.ndarray  # the item of each


class Index:
    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float = EDITS, walks: int = WALKS):
        self.items, self.edits, self.walks = items, edits, walks
        self.most_words = max(len(w) for _, w in items)
        self.pieces: dict[int, list[tuple[np.uint64, int, int]]] = {}  # by length: fingerprint, item, place in the item
        for k, (_, w) in enumerate(items):
            if len(w) < LEAST_WORDS:
                cuts = np.linspace(0, len(w), self.allowed(len(w)) + 2).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    self.pieces.setdefault(int(b - a), []).append((fingerprints(w, int(b - a))[a], k, int(a)))
        of_item = [pairs(w, np.array([0, len(w)])) for _, w in items]
        self.vocabulary = np.unique(np.concatenate(of_item))
        self.classes: list[Class] = []
        order = sorted((k for k in range(len(items)) if len(items[k][1]) >= LEAST_WORDS), key=lambda k: len(items[k][1]))
        while order:
            shortest = len(items[order[0]][1])
            own = [k for k in order if len(items[k][1]) <= shortest * 1.15]
            order = order[len(own) :]
            symbols = np.concatenate([items[k][1] for k in own])
            end = np.cumsum([len(items[k][1]) for k in own])
            start = end - [len(items[k][1]) for k in own]
            flat = walk_keys(symbols, start, end, self.steps(shortest), walks)
            by = np.argsort(flat, axis=None, kind="stable")
            known = np.isin(self.vocabulary, np.concatenate([of_item[k] for k in own])) & (self.vocabulary > 0)
            least = min(n - 1 - 2 * self.allowed(n) for n in (len(items[k][1]) for k in own))
            self.classes.append(Class(shortest, len(items[own[-1]][1]), np.append(known, False), least, flat.reshape(-1)[by], np.tile(np.array(own), len(flat))[by]))

    @staticmethod
    def steps(shortest: int) -> int:
        """A walk moves on by half a word a step, so these steps stay within the item."""
        return max(LETTERS + 1, int(1.8 * shortest))

    def allowed(self, n: int) -> int:
        return int(n * self.edits)

    def windows(self, place: np.ndarray, ends: np.ndarray, c: Class) -> np.ndarray:
        """Word positions at which an item of the class can start. place: of each word pair in the vocabulary; ends: of its document."""
        most = self.allowed(c.longest)
        count = np.concatenate(([0], np.cumsum(c.known[place])))
        at = np.arange(len(place))
        last = np.minimum(at + c.longest + most, ends)
        near = np.minimum(at + 2 * most + 2, ends)  # the first kept pair starts before here
        return np.flatnonzero((count[last] - count[at] >= c.least) & (count[near] > count[at]))

    def search(self, names: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, start word, edits) of the best window of each item in each row; a long row is looked at part by part."""
        if len(first) > 2 or len(names) <= 2 * WORDS_AT_ONCE:
            yield from self.search_block(names, first)
            return
        beyond = self.most_words + 2 * self.allowed(self.most_words) + 2
        for lo in range(0, len(names), WORDS_AT_ONCE):
            part = names[lo : lo + WORDS_AT_ONCE + 2 * beyond]
            for row, item, start, edits in self.search_block(part, np.array([0, len(part)])):
                yield row, item, start + lo, edits

    def search_block(self, names: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        yield from self.verified(names, first, row, *self.short(names, row))
        if not self.classes:
            return
        two = pairs(names, first)
        at = np.minimum(np.searchsorted(self.vocabulary, two), len(self.vocabulary) - 1)
        place = np.where(self.vocabulary[at] == two, at, len(self.vocabulary))
        ends = first[row + 1]
        for c in self.classes:
            starts = self.windows(place, ends, c)
            met = [self.meeting(names, ends, starts[lo : lo + AT_ONCE], c) for lo in range(0, len(starts), AT_ONCE)]
            if met:
                yield from self.verified(names, first, row, *np.concatenate(met, axis=1))

    def meeting(self, names: np.ndarray, ends: np.ndarray, start: np.ndarray, c: Class) -> np.ndarray:
        """Windows and items that share SHARED keys."""
        mine = walk_keys(names, start, np.minimum(start + c.longest, ends[start]), self.steps(c.shortest), self.walks).reshape(-1)
        lo, hi = np.searchsorted(c.keys, mine), np.searchsorted(c.keys, mine, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
        met, times = np.unique(np.repeat(start[hit % len(start)], n) * len(self.items) + c.items[which], return_counts=True)
        return np.stack(np.divmod(met[times >= SHARED], len(self.items)))

    def short(self, names: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Windows and short items of which a piece is there."""
        out = [np.zeros((2, 0), np.int64)]
        for size, pieces in self.pieces.items():
            if len(names) < size:
                continue
            own = fingerprints(names, size)
            own_at = np.flatnonzero(row[: len(own)] == row[size - 1 :])
            order = np.argsort(own[own_at], kind="stable")
            sorted_ = own[own_at][order]
            for name, k, a in pieces:
                lo, hi = np.searchsorted(sorted_, name), np.searchsorted(sorted_, name, "right")
                start = own_at[order[lo:hi]] - a
                start = np.where((start >= 0) & (row[np.maximum(start, 0)] == row[own_at[order[lo:hi]]]), start, own_at[order[lo:hi]])
                out.append(np.stack((start, np.full(len(start), k))))
        return np.concatenate(out, axis=1)

    def verified(self, names: np.ndarray, first: np.ndarray, row: np.ndarray, window: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Of the windows and items, those within the edits allowed, by exact edit distance."""
        padded = np.append(names, np.uint64(0))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        by = np.argsort(item, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(item[by])) + 1) if len(by) else ():
            k = int(item[part[0]])
            text = self.items[k][1]
            most = self.allowed(len(text))
            width = len(text) + 2 * most
            step = max(1, (1 << 18) // width)
            for lo in range(0, len(part), step):
                begin = window[part[lo : lo + step]]
                low = np.maximum(begin - most, first[row[begin]])
                reach = low[:, None] + np.arange(width)
                near = padded[np.where(reach < first[row[begin] + 1][:, None], reach, len(names))]
                d = edit_distances(text, near)
                close = np.flatnonzero(d <= most)
                for j, s in zip(close, low[close] + first_starts(text, near[close]), strict=True):
                    key = (int(row[begin[j]]), k)
                    best[key] = min(best.get(key, (1 << 60, 0)), (int(d[j]), int(s - first[row[begin[j]]])))
        for (r, k), (d, s) in best.items():
            yield r, k, s, d


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in repeats.blocks_of(batches, limit=4 * common.BLOCK_BYTES):
            ids = rows.column(0).to_pylist()
            names, first = words(data, offsets)
            out = [(ids[r], index.items[k][0], s, len(index.items[k][1]), d) for r, k, s, d in index.search(names, first)] if len(names) else []
            if out:
                yield repeats.arrow_rows(FOUND, [pa.array(c, pa.int64()) for c in zip(*out, strict=True)])

    return run


def item_words(rows) -> list[tuple[int, np.ndarray]]:
    out = {}
    for i, text in rows:
        raw = (text or "").encode()
        names, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if i is not None and len(names):
            out.setdefault(i, names)
    return sorted(out.items())


def leaks(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, walks: int = WALKS) -> DataFrame:
    """One row per document and item found: doc_id, item_id, start_word, n_words (of the item), edits.

    An item is found where a stretch of the document is within edits * n_words edits of words of it; the best stretch
    is told (the first, on a tie). Items that are null or have no words are not looked for; of
    rows that share an item_id one is (the smallest text). A null or empty text holds nothing; of rows that repeat a
    doc_id each is scanned and one row per item told; rows without doc_id are left out; other columns are not looked
    at. Documents are never shuffled: items come to them, ITEMS_IN_ONE_SCAN at a time, so the broadcast is bounded.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    scans = max(1, -(-items.count() // ITEMS_IN_ONE_SCAN))
    out = None
    for k in range(scans):
        own = item_words((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == k).toLocalIterator())
        if own:
            found = d.mapInArrow(_scan(Index(own, edits, walks)), FOUND)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id", "n_words").agg(F.min(F.struct("edits", "start_word")).alias("best")).select("doc_id", "item_id", F.col("best.start_word").alias("start_word"), "n_words", F.col("best.edits").alias("edits"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS) -> DataFrame:
    """The documents, all columns, in which no item is found; rows without doc_id are left out."""
    return docs.where("doc_id is not null").join(leaks(docs, benchmark, edits=edits).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
