"""Operator 8: repeated passages by recompression.

Words are symbols. In each round, runs of an equal symbol and then pairs (a left and a right symbol, by a hash bit
of their names) become new symbols named by a fingerprint of their content, so that every task names them alike and
equal passages have equal symbols inside.

Long repeats. The first rounds run inside the tasks until symbols have LONG words. From there each round is a Spark
step over all documents: names are counted, symbols whose name occurs once are left out, as no larger one that holds
them repeats, and the others that follow each other are named on. Words of a symbol whose name occurs in an earlier
document, at any level, are decided, however long the repeat is.

Edges. Windows that no such symbol holds are told by low symbols. A symbol's context is the stretch of words that
decides that it exists; wherever that stretch recurs, the symbol does too. Each window picks the highest symbol of
ROUNDS rounds whose context lies inside it, and windows that share such a symbol are compared: by their blocks where
those agree, else by fingerprints of the windows themselves. A decided window need not be looked at even as a first
occurrence: the first document that holds it has it undecided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

SPAN = 13
#: Words of the symbols that Spark rounds begin with, at least; and rounds in the tasks that make them.
LONG, FIRST_ROUNDS = 24, 16
#: Runs and pairs are named so many times between the first two counts, and twice as often between any later two.
STEPS = 4
#: Of the symbols that windows pick. More rounds name longer symbols, whose contexts leave a window of 13 words less choice; with one, runs of windows are longest.
ROUNDS = 1
SYMBOLS = "doc_id long, start long, end long, name long, check long"
WINDOWS = "akey long, bkey long, off int, h1 long, h2 long, n long, owner long"


def named_on(name: np.ndarray, start: np.ndarray, end: np.ndarray, after: np.ndarray, ready: np.ndarray, level: int):
    """One round: runs of an equal symbol become one, then pairs of a left symbol and the right one behind it.

    name has a row for each of one or more independent fingerprints. after tells whether a symbol begins where the one
    before ends; only those that are ready take part.
    """
    same = np.zeros(len(start), bool)
    same[1:] = (name[:, 1:] == name[:, :-1]).all(0) & after[1:] & ready[1:] & ready[:-1]
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(start)) - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, common.mixed(name[:, first] + length), name[:, first])
    start, end, after, ready = start[first], end[last], after[first], ready[first]
    right = (common.mixed(name[0] + np.uint64(level)) >> np.uint64(63)).astype(bool)
    head = np.zeros(len(start), bool)
    head[:-1] = ~right[:-1] & right[1:] & after[1:] & ready[:-1] & ready[1:]
    at = np.flatnonzero(~np.concatenate(([False], head[:-1])))
    paired, mate = head[at], np.minimum(at + 1, len(start) - 1)
    both = common.mixed(name[:, at] * np.uint64(0x9E3779B97F4A7C15) + common.mixed(name[:, mate] + np.uint64(level)))
    return np.where(paired, both, name[:, at]), start[at], np.where(paired, end[mate], end[at]), after[at], ready[at]


def long_symbols(names: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the symbols that FIRST_ROUNDS rounds make of the words of each row, naming on those below `least` words.

    Shorter ones that are left belong to the long one before them; those at a row's beginning are one symbol.
    """
    n = len(names)
    start = np.arange(n)
    end, after = start + 1, np.ones(n, bool)
    after[first[:-1][np.diff(first) > 0]] = False
    name = names[None, :]
    for level in range(1, FIRST_ROUNDS + 1):
        name, start, end, after, _ = named_on(name, start, end, after, end - start < least, level)
    begins = np.flatnonzero((end - start >= least) | ~after)
    return start[begins], end[np.append(begins[1:], len(start)) - 1] if n else end


def _symbols(span: int, least: int):
    limit = common.BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in repeats.blocks_of(batches):
            starts, ends, first, names = word_names(data, offsets)
            other = common.word_hashes(data, starts, ends, poly=common.POLY_B)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            step = limit if len(first) == 2 and len(names) > 2 * limit else max(len(names), 1)
            for lo in range(0, len(names), step):  # one long text part by part
                part, own = names[lo : lo + step], first if step != limit else np.array([0, len(names[lo : lo + step])])
                s, e = long_symbols(part, own, least)
                s, e = s[e - s >= span], e[e - s >= span]
                row = np.searchsorted(own, s, "right") - 1
                name, check = common.POLY_A.of(common.POLY_A.prefix(part), s, e), common.POLY_B.of(common.POLY_B.prefix(other[lo : lo + step]), s, e)
                base = lo - own[row]
                yield repeats.arrow_rows(SYMBOLS, [pa.array(ids[row]), pa.array(s + base), pa.array(e + base), common.signed(name), common.signed(check)])

    return run


def _grown(level: int):
    """mapInArrow body over symbols sorted by document and start: the larger ones that they are named to, and those left; `new` tells which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            doc = held.column(0).to_numpy()
            whole = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0  # the last document may go on
            if whole:
                yield grown(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield grown(held)

    def grown(rows: pa.Table) -> pa.RecordBatch:
        doc, start, end, name, check = (c.to_numpy() for c in rows.columns)
        names = np.stack((name, check)).view(np.uint64)
        after = np.zeros(len(doc), bool)
        after[1:] = (doc[1:] == doc[:-1]) & (start[1:] == end[:-1])
        known, first = end, np.arange(len(doc))
        for step in range(STEPS << level):
            names, first, end, after, _ = named_on(names, first, end, after, np.ones(len(first), bool), 1000 + (STEPS << level) + step)
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first]), pa.array(end), *(common.signed(np.ascontiguousarray(x)) for x in names), pa.array(end > known[first])], ["doc_id", "start", "end", "name", "check", "new"])

    return run


def long_repeats(docs: DataFrame, *, span: int = SPAN, least: int = LONG) -> DataFrame:
    """(doc_id, start, end, level): word ranges of symbols whose name, at that level, occurs in a document with a smaller doc_id."""
    symbols = common.stored(docs.select("doc_id", "text").mapInArrow(_symbols(span, least), SYMBOLS))
    found, level = [], 0
    while True:
        names = symbols.groupBy("name", "check").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
        live = common.stored(symbols.join(repeats.apart(names, "name", "check"), ["name", "check"]).select("doc_id", "start", "end", "name", "check", "first"))
        found.append(live.where("doc_id > first").select("doc_id", "start", "end", F.lit(level).alias("level")))
        grown = common.stored(live.drop("first").repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_grown(level), f"{SYMBOLS}, new boolean"))
        if grown.where("new").isEmpty():
            return reduce(DataFrame.unionByName, found)
        symbols, level = grown.drop("new"), level + 1


class Level:
    """Symbols of one level: names, word ranges and contexts."""

    def __init__(self, name, start, end, lo, hi):
        self.name, self.start, self.end, self.lo, self.hi = name, start, end, lo, hi

    def __len__(self) -> int:
        return len(self.name)

    def neighbours(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether a symbol has a left and a right neighbour in its document, and the context that knowing them takes."""
        doc = row[self.start]
        left = np.zeros(len(self), bool)
        left[1:] = doc[1:] == doc[:-1]
        right = np.append(left[1:], False)
        lo = np.where(left, np.concatenate(([0], self.lo[:-1])), self.start - 1)
        hi = np.where(right, np.concatenate((self.hi[1:], [0])), self.end + 1)
        return left, right, np.minimum(lo, self.lo), np.maximum(hi, self.hi)


def runs_named(x: Level, row: np.ndarray) -> Level:
    """Runs of an equal symbol become one symbol named by symbol and length; a lone symbol keeps its name."""
    left, _, lo, hi = x.neighbours(row)
    same = np.zeros(len(x), bool)
    same[1:] = left[1:] & (x.name[1:] == x.name[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(x)) - 1
    length = last - first + 1
    name = np.where(length > 1, common.mixed(x.name[first] + length.astype(np.uint64)), x.name[first])
    return Level(name, x.start[first], x.end[last], lo[first], hi[last])


def pairs_named(x: Level, row: np.ndarray, level: int) -> Level:
    """A left symbol and the right symbol behind it become one; which is which is a bit of a hash of the name."""
    left, _, lo, hi = x.neighbours(row)
    bit = (common.mixed(x.name + np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
    head = np.zeros(len(x), bool)
    head[:-1] = ~bit[:-1] & bit[1:] & left[1:]
    tail = np.concatenate(([False], head[:-1]))
    at = np.flatnonzero(~tail)
    paired = head[at]
    mate = np.minimum(at + 1, len(x) - 1)
    name = np.where(paired, common.mixed(x.name[at] * np.uint64(0x9E3779B97F4A7C15) + common.mixed(x.name[mate] + np.uint64(level))), x.name[at])
    return Level(name, x.start[at], np.where(paired, x.end[mate], x.end[at]), np.where(paired, x.lo[at], lo[at]), np.where(paired, x.hi[mate], hi[at]))


def anchors(names: np.ndarray, first: np.ndarray, span: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Valid window starts, their rows, and the picked symbol's first word and context of each."""
    n = len(names)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    x = Level(names, at, at + 1, at, at + 1)
    exact = np.zeros((span + 1, n), np.uint64)  # by context length and first word: level, hash and place of the best symbol
    context = {}
    place = np.uint64(0xFFFFFF)
    for level in range(rounds + 1):
        if level:
            x = pairs_named(runs_named(x, row), row, level)
        size = x.hi - x.lo
        ok = np.flatnonzero((size <= span) & (x.lo >= 0))
        score = (np.uint64(level + 1) << np.uint64(61)) | ((common.mixed(x.name[ok] ^ np.uint64(0x5BD1E995)) >> np.uint64(27)) << np.uint64(24)) | (place - x.start[ok].astype(np.uint64))
        flat = size[ok] * n + x.lo[ok]
        exact.reshape(-1)[flat] = np.maximum(exact.reshape(-1)[flat], score)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lo[x.start[ok]], hi[x.start[ok]] = x.lo[ok], x.hi[ok]
        context[level] = (lo, hi)
    best = exact[1]
    for size in range(2, span + 1):
        wider = best.copy()
        wider[:-1] = np.maximum(wider[:-1], best[1:])
        best = np.maximum(wider, exact[size])
    windows = np.flatnonzero(at + span <= first[row + 1]) if n else np.zeros(0, np.int64)
    picked = best[windows]
    level = (picked >> np.uint64(61)).astype(np.int64) - 1
    start = (place - (picked & place)).astype(np.int64)
    lo, hi = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for k, (a, b) in context.items():
        own = level == k
        lo[own], hi[own] = a[start[own]], b[start[own]]
    return windows, row, start * (rounds + 1) + level, lo, hi


def word_names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = common.word_spans(data, offsets)
    return starts, ends, first, common.word_hashes(data, starts, ends)


def undecided(windows: np.ndarray, span: int, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of `span` words do not lie in one of the ranges."""
    return ~repeats.merged(lo, np.maximum(hi - span + 1, lo), n)[windows]


def _runs(span: int, rounds: int):
    """mapInArrow body over (doc_id, packed, spans): the runs of windows that no span holds."""
    limit = common.BLOCK_BYTES

    def of(doc_ids, names, first, begin, end) -> pa.RecordBatch | None:
        if len(names) < span:
            return None
        windows, row, symbol, lo, hi = anchors(names, first, span, rounds)
        keep = undecided(windows, span, begin, end, len(names))
        windows, symbol, lo, hi = windows[keep], symbol[keep], lo[keep], hi[keep]
        place = np.searchsorted(windows, np.arange(len(names)))  # of a window start among those left
        a, b = common.POLY_A.prefix(names), common.POLY_B.prefix(names)

        def keys(s, e, sym):
            w = place[s]
            return common.POLY_A.of(a, lo[w], hi[w]) ^ common.mixed((sym % (rounds + 1)).astype(np.uint64)), common.POLY_B.of(b, s, e + span) ^ common.mixed((sym // (rounds + 1) - s).astype(np.uint64))

        return repeats.run_rows(doc_ids, windows, symbol, row[windows], first, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.squeezed_blocks(batches):
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            _, _, first, names = word_names(data, offsets)
            cut, begin, end = repeats.unpacked(rows.column(2))
            base = np.repeat(first[:-1], np.diff(cut))
            begin, end = begin + base, end + base
            step = limit if len(first) == 2 and len(names) > 2 * limit else max(len(names), 1)
            for lo in range(0, len(names), step):
                part = names[lo : lo + step + span - 1] if step == limit else names
                inside = lambda x: np.clip(x - lo, 0, len(part))  # noqa: B023, E731
                out = of(ids, part, first if step != limit else np.array([0, len(part)]), inside(begin), inside(end))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.compute.add(out.column(3), pa.scalar(lo << 24, pa.int64()))], out.schema.names)

    return run


def _windows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.squeezed_blocks(batches):
            starts, ends, first, names = word_names(data, offsets)
            other = common.word_hashes(data, starts, ends, poly=common.POLY_B)
            row, x = repeats.flat_lists(rows, ["akey", "bkey", "n", "s", "e"])
            count = (x["e"] - x["s"] + 1).astype(np.int64)
            which = np.repeat(np.arange(len(count)), count)
            off = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = first[row[which]] + x["s"][which] + off
            h1, h2 = common.POLY_A.of(common.POLY_A.prefix(names), at, at + span), common.POLY_B.of(common.POLY_B.prefix(other), at, at + span)
            doc = rows.column(0).to_numpy(zero_copy_only=False)
            yield repeats.arrow_rows(WINDOWS, [pa.array(x["akey"][which]), pa.array(x["bkey"][which]), pa.array(off.astype(np.int32)), common.signed(h1), common.signed(h2), pa.array(x["n"][which]), pa.array(doc[row[which]])])

    return run


def repeated_words(docs: DataFrame, *, span: int = SPAN, rounds: int = ROUNDS, least: int = LONG) -> DataFrame:
    """(doc_id, spans): packed word ranges covered by windows that also start in a document with a smaller doc_id."""
    texts = common.squeezed(docs)
    decided = common.outcome(lambda: long_repeats(docs, span=span, least=least).groupBy("doc_id").agg(F.collect_set(repeats.packed("start", "end")).alias("spans")))
    runs = texts.join(decided, "doc_id", "left").select("doc_id", "packed", "spans").mapInArrow(_runs(span, rounds), repeats.RUNS)

    def marks(texts: DataFrame, blocks: DataFrame) -> DataFrame:
        windows = repeats.with_representatives(texts, blocks).mapInArrow(_windows(span), WINDOWS)
        return repeats.marks_of_windows(windows, earlier_only=True)

    rest = repeats.covers(texts, runs, span, marks, earlier_only=True)
    return decided.unionByName(rest).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.squeezed_blocks(batches):
            cut, lo, hi = repeats.unpacked(rows.column(2))
            starts, ends, first = common.word_spans(data, offsets)
            length = ends - starts
            # all words of the block, each with one blank behind it: kept words are then slices of it
            squeezed = np.full(int(length.sum()) + len(length), 32, np.uint8)
            to = np.cumsum(length + 1) - length - 1
            inside = np.repeat(to - starts, length)
            source = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts, length)
            squeezed[source + inside] = data[source]
            out: list[list] = [[] for _ in range(4)]
            for k in range(rows.num_rows):
                a, b = int(first[k]), int(first[k + 1])
                begin = int(to[a]) if a < len(to) else len(squeezed)
                end = int(to[b]) if b < len(to) else len(squeezed)
                part, removed = squeezed[begin:end], 0
                if cut[k + 1] > cut[k]:
                    gone = repeats.merged(lo[cut[k] : cut[k + 1]], hi[cut[k] : cut[k + 1]], b - a)
                    removed = int(gone.sum())
                    part = part[np.repeat(~gone, length[a:b] + 1)]
                kept = part[:-1].tobytes()
                for column, value in zip(out, (b - a, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield repeats.arrow_rows(DIGEST, [rows.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))])

    return run


def deduplicate(docs: DataFrame, *, span: int = SPAN, rounds: int = ROUNDS, least: int = LONG, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words joined by one space.

    Each word covered by a window of `span` words that also starts in a document with a smaller doc_id is removed;
    windows are judged on the input. A null or empty text has no words. Of rows that repeat a doc_id one stays (the
    smallest text); rows without doc_id are left out; other columns are not looked at. An empty table gives no rows.
    """
    d = common.unique_documents(docs)
    spans = common.outcome(lambda: repeated_words(d, span=span, rounds=rounds, least=least))
    out = common.squeezed(d).join(spans, "doc_id", "left").select("doc_id", "packed", "spans").mapInArrow(_remove(with_text), DIGEST)
    return out if with_text else out.drop("kept")
