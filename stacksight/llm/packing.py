"""Operator 4: bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes to the open window in which it leaves the
least room; where none has room, its head tops up the fullest, which is emitted, and the rest is placed anew.
At the end of a partition the fullest windows are topped up from the emptiest until one is left, and those ones are
packed on over ever fewer partitions. What the last round leaves goes out in sequences of different powers of two,
so no sequence needs padding.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
#: Open windows of one partition.
OPEN = 128
#: Partitions whose last open windows meet in one task of the merge.
FAN_IN = 64
#: Entries that a worker's word cache may hold before it starts anew.
CACHE_WORDS = 700_000
#: Bytes of text whose different words are looked up together: more mean fewer look-ups, but workers hold on to what a block took.
BLOCK_BYTES = 1 << 22
TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 2

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, used long, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Ids of whole texts from cached ids of their words.

    The vocabulary's own rules never join across white space, so a text's ids are its words' ids in turn. A block of
    texts is cut at ASCII white space and each of its different words is looked up once; other white space stays within
    a word, which is then encoded as it is. Texts with a word to which that may not apply (special-token strings,
    control characters that only some white-space rules split on, not in NFC) are encoded whole.
    """

    #: ASCII signs that form one token group behind letters; an apostrophe may begin a contraction.
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    whole = re.compile(r"<\||[\x1c-\x1f\x85\u180e\u200b\ufeff]")

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes | None] = {}
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.symbols = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block, given as the bytes of all and where each begins (with the end last)."""
        starts, ends, first = common.word_spans(data, offsets)
        lengths = ends - starts
        # the words' bytes alone, one behind the other: what no word covers is white space
        packed = pa.py_buffer(data[~common.is_space(data)])
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), packed]).dictionary_encode()
        code = words.indices.to_numpy()
        each = self.ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        odd = [k for k, x in enumerate(each) if x is None]
        for k in odd:
            each[k] = b""
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        # a token's place among the ids of the different words is its word's first place there and its own place in the word
        count = size[code]
        upto = np.append(0, np.cumsum(count))
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - upto[:-1], count) + np.arange(upto[-1])]
        bounds = upto[first]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if odd:
            for row in np.unique(np.searchsorted(first, np.flatnonzero(np.isin(code, odd)), "right") - 1).tolist():
                text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                out[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out

    def ids(self, words: list[str]) -> list[bytes | None]:
        """The ids of different words; None for those whose texts are encoded whole."""
        each = list(map(self.words.get, words))
        new = [w for w, x in zip(words, each, strict=True) if x is None]
        if not new:
            return each
        learnt = self.learn(new)
        each = [learnt[w] if x is None else x for w, x in zip(words, each, strict=True)]
        if len(self.words) + len(new) <= self.limit:
            self.words.update(learnt)
        else:
            self.words = dict(zip(words, each, strict=True)) if len(words) <= self.limit else {}
        return each

    def learn(self, new: list[str]) -> dict[str, bytes | None]:
        """The ids of words: of plain letters with marks behind from the cached parts, of others by encoding them."""
        out: dict[str, bytes | None] = {}
        odd, text = [], " ".join(new)
        if self.whole.search(text) or not unicodedata.is_normalized("NFC", text):
            out = dict.fromkeys(w for w in new if self.whole.search(w) or not unicodedata.is_normalized("NFC", w))
            new = [w for w in new if w not in out]
        if len(self.cores) > self.limit:
            self.cores = {}
        if len(self.tails) > self.limit:
            self.tails = {}
        cores, tails, marks = self.cores, self.tails, self.marks
        for word in new:
            core = word.rstrip(marks)
            low = core.lower()
            if not low.isalpha() or "Σ" in core or not core.isalpha():
                odd.append(word)
                continue
            ids = cores.get(low)
            if ids is None:
                ids = cores[low] = self.core(low)
            if len(core) < len(word):
                tail = word[len(core) :]
                if tail not in tails:
                    tails[tail] = self.core(tail)
                ids += tails[tail]
            out[word] = ids
        for k in range(0, len(odd), 20_000):
            part = odd[k : k + 20_000]
            out.update(zip(part, self.many(part), strict=True))
        return out

    def core(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if not piece.isascii():
            piece = "".join(map(self.symbols.__getitem__, piece.encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def many(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one text; a token belongs to the word its offset lies in."""
        if not words:
            return []
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        at = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        cut = np.searchsorted(at, np.append(starts, 1 << 60))
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


_CACHES: dict[tuple[str, int], WordCache] = {}


def cache(path: str, limit: int = CACHE_WORDS) -> WordCache:
    if (path, limit) not in _CACHES:
        _CACHES[path, limit] = WordCache(path, limit)
    return _CACHES[path, limit]


class Piece(NamedTuple):
    """A run of one document's ids, as little-endian unsigned 32-bit values."""

    doc_id: int
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        """The first `length` ids and the others."""
        return self._replace(ids=self.ids[: 4 * length]), self._replace(start=self.start + length, ids=self.ids[4 * length :])


class Open:
    """The open windows of one partition: best fit, and the fullest goes first.

    A piece that no window can take tops up the fullest one, so that whatever is emitted is full.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.used, self.pieces = size, limit, [], []

    def place(self, piece: Piece) -> list[list[Piece]]:
        """Puts a piece away and gives the windows that it fills."""
        full, length = [], len(piece.ids) // 4
        best = max((u for u in self.used if u + length <= self.size), default=-1)
        if best < 0 and len(self.used) >= self.limit:
            k = self.used.index(max(self.used))
            head, piece = piece.cut(self.size - self.used[k])
            full.append([*self.close(k), head])
            return full + self.place(piece)
        if best < 0:
            self.used.append(0)
            self.pieces.append([])
        k = self.used.index(best) if best >= 0 else len(self.used) - 1
        self.used[k] += length
        self.pieces[k].append(piece)
        if self.used[k] == self.size:
            full.append(self.close(k))
        return full

    def close(self, k: int) -> list[Piece]:
        self.used.pop(k)
        return self.pieces.pop(k)

    def drain(self) -> Iterator[list[Piece]]:
        """Full windows, each the fullest topped up from the emptiest, until at most one is open."""
        while len(self.used) > 1:
            k = self.used.index(max(self.used))
            room, rows = self.size - self.used[k], self.close(k)
            while room and self.used:
                k = self.used.index(min(self.used))
                piece = self.pieces[k].pop()
                head, rest = piece.cut(min(room, len(piece.ids) // 4))
                rows.append(head)
                room -= len(head.ids) // 4
                self.used[k] -= len(head.ids) // 4
                if rest.ids:
                    self.pieces[k].append(rest)
                elif not self.pieces[k]:
                    self.close(k)
            if room:
                self.used.append(self.size - room)
                self.pieces.append(rows)
            else:
                yield rows

    def powers(self) -> Iterator[list[Piece]]:
        """What is still open after drain(), in sequences whose lengths are different powers of two."""
        pieces = [p for rows in self.pieces for p in rows]
        total = sum(self.used)
        for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
            rows, room = [], size
            while room:
                piece = pieces.pop(0)
                head, rest = piece.cut(min(room, len(piece.ids) // 4))
                rows.append(head)
                room -= len(head.ids) // 4
                if rest.ids:
                    pieces.insert(0, rest)
            yield rows


def _rows(windows: list[tuple[int, list[Piece]]], part: int, left: bool = False) -> pa.RecordBatch:
    """The pieces of numbered windows as PIECES; only those of a window that is left open carry their ids on."""
    columns: list[list] = [[] for _ in PIECES.split(", ")]
    for number, pieces in windows:
        offset, used = 0, sum(len(p.ids) for p in pieces) // 4
        for p in pieces:
            n = len(p.ids) // 4
            for column, value in zip(columns, (p.doc_id, p.start, n, zlib.crc32(p.ids), p.doc_tokens, part, number, offset, used, p.ids if left else None), strict=True):
                column.append(value)
            offset += n
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in PIECES.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _packed(pieces: Iterator[Piece], window: int, open_windows: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pieces placed in turn; the windows emitted, and at the end the one that is left (in powers of two in the last round)."""
    from pyspark import TaskContext

    part, space, number = TaskContext.get().partitionId(), Open(window, open_windows), 0
    done: list[tuple[int, list[Piece]]] = []

    def numbered(windows) -> None:
        nonlocal number
        for rows in windows:
            number += 1
            done.append((number, rows))

    for piece in pieces:
        numbered(space.place(piece) if len(piece.ids) < 4 * window else [[piece]])
        if len(done) >= 256:
            yield _rows(done, part)
            done.clear()
    numbered(space.drain())
    if last:
        numbered(space.powers())
    yield _rows(done, part)
    if not last:
        yield _rows([(0, rows) for rows in space.pieces], part, left=True)


def _token_pieces(path: str, window: int, separator: int, open_windows: int, cache_words: int, block_bytes: int = BLOCK_BYTES):
    """mapInArrow body: documents to packed pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        words = cache(path, cache_words)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            data, offsets = common.text_buffer(texts)
            for lo, hi in common.row_blocks(offsets, block_bytes):
                encoded = words.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for doc, tokens in zip(ids[lo:hi], encoded, strict=True):
                    raw = tokens.tobytes() + separator.to_bytes(4, "little")
                    for at in range(0, len(raw), 4 * window):
                        yield Piece(doc, at // 4, raw[at : at + 4 * window], len(raw) // 4)

    return lambda batches: _packed(pieces(batches), window, open_windows, False)


def _left_pieces(window: int, open_windows: int, last: bool):
    """mapInArrow body: pieces left open by several partitions, packed on."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            yield from map(Piece, *(c.to_pylist() for c in batch.columns))

    return lambda batches: _packed(pieces(batches), window, open_windows, last)


def pack(docs: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, open_windows: int = OPEN, cache_words: int = CACHE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    A null or empty text is a document of the separator alone. Rows that repeat a doc_id are packed each for
    itself; rows without doc_id are left out. Of windows that are equally full the one opened first is taken. A text of
    any length is cut at every `window` ids; a task holds the ids of its open windows and of one block of texts. All
    sequences hold `window` ids but a dozen at most, whose lengths are different powers of two. cache_words bounds what a
    worker remembers, block_bytes the texts it works on at a time (one text at least); neither changes a result. Other columns are not looked at. An empty table gives no rows.
    """
    import public_tokenizers  # noqa: F401  a missing tokenizer package shows here, not in a task

    path = tokenizer or tokenizer_path()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    pieces = common.checkpointed(d.mapInArrow(_token_pieces(path, window, separator, open_windows, cache_words, block_bytes), PIECES))
    rounds, tasks = [pieces], max(1, d.rdd.getNumPartitions())
    while True:
        tasks = -(-tasks // FAN_IN)
        left = rounds[-1].where("ids is not null")
        dealt = left.repartition(tasks, F.floor(F.col("part") / FAN_IN)) if tasks > 1 else left.coalesce(1)
        ordered = dealt.sortWithinPartitions(F.desc("used"), "part", "offset").select("doc_id", "start", "ids", "doc_tokens")
        rounds.append(common.checkpointed(ordered.mapInArrow(_left_pieces(window, open_windows, tasks == 1), PIECES)))
        if tasks == 1:
            break
    rows = reduce(DataFrame.unionByName, (r.where("ids is null").withColumn("round", F.lit(k)) for k, r in enumerate(rounds)))
    # the round, the partition (25 bits) and its window number (34 bits) name a sequence
    sequence = F.shiftleft(F.col("round").cast("long"), 59) + F.shiftleft("part", 34) + F.col("window")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset", F.col("used").alias("sequence_tokens"))
