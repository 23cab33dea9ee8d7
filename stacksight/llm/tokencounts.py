"""Operator 9: token counts by section from one encoding of each whole document.

A document is encoded once with a byte-level vocabulary, whose tokens cover its bytes without gap. The running
sum of their byte lengths gives the spans; they are joined to the spans of the sections by position, and a token
that crosses a boundary is allocated by a stated rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: first: the section of a token's first byte. most: the one with most of its bytes, the earlier on a tie.
RULES = ("first", "most")
CACHE_WORDS = 700_000
#: Sections: runs of lines between blank lines would be rare in scraped prose, so each line with its break is one.
SCHEMA = "doc_id long, section_id int, kind string, start_byte long, end_byte long, n_tokens long, n_crossing long"

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class SpanCache:
    """Byte lengths of the tokens of a text, by cached pre-token groups."""

    # a group: an optional space and what follows to the next white space, or white space as the vocabulary's own pattern splits it
    group = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def lengths(self, text: str) -> np.ndarray:
        groups = self.group.findall(text)
        new = {g for g in groups if g not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, set(groups)
        for g in new:
            self.known[g] = self.size[self.encoding.encode_ordinary(g)].tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, groups)), np.int32)


_CACHES: dict[str, SpanCache] = {}


def spans(path: str) -> SpanCache:
    if path not in _CACHES:
        _CACHES[path] = SpanCache(path)
    return _CACHES[path]


def _attribute(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = spans(path)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            data, offsets = common.text_buffer(texts)
            for lo, hi in common.row_blocks(offsets):
                parts = [[] for _ in range(6)]
                for row in range(lo, hi):
                    raw = data[offsets[row] : offsets[row + 1]]
                    breaks = np.flatnonzero(raw == 10) + 1
                    edges = np.unique(np.concatenate(([0], breaks, [len(raw)])))
                    if len(edges) == 1:
                        edges = np.array([0, 0])
                    length = cache.lengths(texts[row].as_py() or "")
                    end = np.cumsum(length, dtype=np.int64)
                    start = end - length
                    section = np.searchsorted(edges, start, "right") - 1
                    last = np.searchsorted(edges, end, "left") - 1
                    crossing = last > section
                    if rule == "most" and crossing.any():
                        for k in np.flatnonzero(crossing):
                            cut = np.clip(edges[section[k] : last[k] + 2], start[k], end[k])
                            section[k] += int(np.argmax(np.diff(cut)))
                    n = len(edges) - 1
                    for part, value in zip(parts, (np.full(n, ids[row]), np.arange(n), edges[:-1], edges[1:], np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)), strict=True):
                        part.append(value.astype(np.int64))
                doc, k, a, b, tokens, cross = (np.concatenate(p) for p in parts)
                kind = pa.array(np.where(k == 0, "title", "body"))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(k.astype(np.int32)), kind, pa.array(a), pa.array(b), pa.array(tokens), pa.array(cross)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def section_tokens(docs: DataFrame, *, vocabulary: str | None = None, rule: str = "first") -> DataFrame:
    """One row per document and section (line): doc_id, section_id, kind, start_byte, end_byte, n_tokens, n_crossing.

    The first line is the title, the others are the body. Every token is counted in one section, so a document's
    counts sum to its tokens. A null or empty text is one section without tokens. Rows that repeat a doc_id are
    counted each for itself; rows without doc_id are left out; other columns are not looked at.
    """
    import public_tokenizers

    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return d.mapInArrow(_attribute(path, rule), SCHEMA)
