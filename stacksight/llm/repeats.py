"""Repeated windows of documents, found by anchors: what the two substring operators share.

Every window of a document picks one anchor inside it by a rule that looks at the window's own content only, so
equal windows pick the same anchor at the same place. Consecutive windows with one anchor are a run. A run whose
anchor occurs once in the corpus holds no repeated window and is dropped after one count. Runs with equal content
(blocks) are repeated as a whole; only blocks that share an anchor but differ, which lie at the edges of repeated
passages, need to be compared window by window. All keys are 64-bit fingerprints, and a block is named by two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: at: the first window start s, counted from the document's first symbol, in the upper 40 bits, then e - s and a - s in
#: 12 bits each, for the last window start e and the anchor a. Neither is longer than a window.
RUNS = "doc_id long, akey long, bkey long, at long"
MARKS = "akey long, bkey long, lo int, hi int"


def first_start(at: str) -> F.Column:
    return F.shiftright(F.col(at), 24)


def last_start(at: str) -> F.Column:
    return first_start(at) + F.shiftright(F.col(at), 12).bitwiseAND(F.lit(4095))


def anchor(at: str) -> F.Column:
    return first_start(at) + F.col(at).bitwiseAND(F.lit(4095))


def packed(lo, hi) -> F.Column:
    return F.shiftleft(F.col(lo) if isinstance(lo, str) else lo, 32).bitwiseOR(F.col(hi) if isinstance(hi, str) else hi)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets and both halves of a list column of packed pairs; null lists are empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(counts))), flat >> 32, flat & 0xFFFFFFFF


def run_rows(doc_ids: np.ndarray, windows: np.ndarray, anchors: np.ndarray, row: np.ndarray, base: np.ndarray, keys: Callable) -> pa.RecordBatch:
    """The runs of a block: windows are valid window starts in order, anchors and row belong to them; base is each row's first symbol."""
    if not len(windows):
        first = last = np.zeros(0, np.int64)
    else:
        new = np.ones(len(windows), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(windows)) - 1
    s, e, a, r = windows[first], windows[last], anchors[first], row[first]
    akey, bkey = keys(s, e, a)
    at = ((s - base[r]) << 24) | ((e - s) << 12) | np.clip(a - s, 0, 4095)
    return arrow_rows(RUNS, [pa.array(doc_ids[r]), common.signed(akey), common.signed(bkey), pa.array(at)])


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by something else than its keys, so that a join on them has to exchange it.

    Spark splits the hot keys of a join only where both sides are exchanges; the result of an aggregate or join on the
    same keys is none.
    """
    return df.repartition(F.xxhash64(F.lit("apart"), *keys))


def covers(texts: DataFrame, runs: DataFrame, span: int, marks: Callable[[DataFrame, DataFrame], DataFrame], *, earlier_only: bool) -> DataFrame:
    """(doc_id, spans): packed [lo, hi) symbol ranges covered by repeated windows.

    A window counts as repeated if it starts anywhere else or, with earlier_only, in a document with a smaller id.
    marks(texts, blocks) gives, for blocks that share an anchor but differ, the offsets lo..hi of window starts that
    are repeated in another block (with earlier_only: in one whose smallest document comes before).
    """
    often = runs.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("akey")
    hits = common.stored(runs.join(apart(often, "akey"), "akey", "left_semi"))
    blocks = hits.groupBy("akey", "bkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("rep"), F.max("doc_id").alias("last"))
    blocks = common.stored(blocks)
    shared = blocks.groupBy("akey").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    found = marks(texts, blocks.join(apart(shared, "akey"), "akey")).groupBy("akey", "bkey").agg(F.collect_list(packed(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("marks"))
    whole = F.col("last") > F.col("rep.doc_id") if earlier_only else F.col("n") > 1
    useful = blocks.join(found, ["akey", "bkey"], "left").where(whole | F.col("marks").isNotNull()).select("akey", "bkey", F.col("rep.doc_id").alias("owner"), whole.alias("whole"), "marks")
    full = F.col("whole") & (F.col("doc_id") > F.col("owner")) if earlier_only else F.col("whole")
    s, e = first_start("at"), last_start("at")
    of_marks = F.transform("marks", lambda m: F.shiftleft(s + F.shiftright(m, 32), 32).bitwiseOR(s + m.bitwiseAND(F.lit(0xFFFFFFFF)) + span))
    spans = hits.join(apart(useful, "akey", "bkey"), ["akey", "bkey"]).select("doc_id", F.when(full, F.array(packed(s, e + span))).otherwise(of_marks).alias("some")).where("some is not null")
    return spans.groupBy("doc_id").agg(F.flatten(F.collect_list("some")).alias("spans"))


def with_representatives(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents that hold the representative of a block: doc_id, the packed text, and the blocks as parallel lists in one order."""
    wanted = blocks.groupBy(F.col("rep.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("akey", "bkey", "variants", "n", first_start("rep.at").alias("s"), last_start("rep.at").alias("e"), anchor("rep.at").alias("a"))).alias("wanted"))
    parts = [F.col(f"wanted.{c}").alias(c) for c in ("akey", "bkey", "variants", "n", "s", "e", "a")]
    return texts.join(wanted, "doc_id").select("doc_id", "packed", *parts)


def flat_lists(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each list element, and the elements of the named list columns."""
    columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
    sizes = pa.compute.list_value_length(columns[names[0]]).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), sizes), {n: c.flatten().to_numpy(zero_copy_only=False) for n, c in columns.items()}


def merged(lo: np.ndarray, hi: np.ndarray, limit: int) -> np.ndarray:
    """Which of limit symbols the ranges cover."""
    edge = np.bincount(np.minimum(lo, limit), minlength=limit + 1) - np.bincount(np.minimum(hi, limit), minlength=limit + 1)
    return np.cumsum(edge[:limit]) > 0


def marks_of_windows(windows: DataFrame, *, earlier_only: bool) -> DataFrame:
    """MARKS from rows (akey, bkey, off, h1, h2, n, owner): windows equal by both fingerprints, whatever their number."""
    same = windows.groupBy("h1", "h2").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("times"), F.min("owner").alias("first")).where("times > 1")
    rule = F.col("first") < F.col("owner") if earlier_only else F.col("all") > 1
    return windows.join(apart(same, "h1", "h2"), ["h1", "h2"]).where(rule).select("akey", "bkey", F.col("off").alias("lo"), F.col("off").alias("hi"))


def arrow_rows(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def blocks_of(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = common.BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut to blocks of about limit bytes of text: the rows, their bytes and offsets."""
    for batch in batches:
        data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in common.row_blocks(offsets, limit):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by integer keys, each once and whole."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        key = np.stack([held.column(k).to_numpy() for k in keys])
        cut = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield held.slice(lo, hi - lo)
        held = held.slice(int(cut[-1]))
    if held is not None and held.num_rows:
        yield held
