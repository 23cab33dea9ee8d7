"""What the operators share: unique documents, byte blocks of Arrow batches, vectorised hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is there only once it is imported
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; it bounds a task's memory.
BLOCK_BYTES = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local session (tests) takes a temporary folder; on a cluster that is an error, as executors
    do not share one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/spark-shared-{uuid.uuid4().hex}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of the Arrow batches between the JVM and Python while a step is stored; whole texts of both sides of a pair are in such rows.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, steps that run have batches of BATCH_ROWS at most; the session's own number is put back."""
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(held), BATCH_ROWS) if int(held) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, held)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), one row per doc_id.

    Rows without doc_id are left out, as no result can name them. Of rows that share a doc_id the one with
    the smallest text (nulls last) stays; that shuffle runs only where ids do repeat.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    repeats = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    return d if repeats.isEmpty() else d.groupBy("doc_id").agg(F.min("text").alias("text"))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Poly:
    """Polynomial fingerprints of slices of a byte or symbol array, modulo 2**64, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        if self.n <= len(symbols):
            self.n = max(2 * self.n, len(symbols) + 1, 1 << 16)
            self.up, self.down = powers(self.base, self.n), powers(self.inverse, self.n)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[: len(symbols)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Two independent odd bases (fixed values).
POLY_A, POLY_B = Poly(0x9E3779B97F4A7C15), Poly(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space [\\x20\\x09-\\x0D]."""
    return _SPACE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data, and the first word of each row (with the total last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, poly: Poly = POLY_A) -> np.ndarray:
    """64-bit fingerprints of words."""
    prefix = poly.prefix(_LOWER[data] if lower else data)
    return poly.of(prefix, starts, ends)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        raw = data.tobytes()
        packed = [tool.compress(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): each text compressed, for where texts must be shuffled; a null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(_squeeze, "doc_id long, packed binary")


def squeezed_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches whose second column is compressed text, cut to blocks of about limit bytes of text: the rows, their bytes and offsets."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for batch in batches:
        held, size, lo = [], 0, 0
        for k, x in enumerate(batch.column(1)):
            held.append(tool.decompress(x.as_py()))
            size += len(held[-1])
            if size >= limit or k + 1 == batch.num_rows:
                yield batch.slice(lo, len(held)), np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
                held, size, lo = [], 0, k + 1


#: Folders of the steps stored while an outcome is made.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df written as compressed Parquet to the shared folder and read back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Delete a stored step that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def outcome(make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; the steps that it stored on the way are then deleted, as nothing reads them any more."""
    steps: list[str] = []
    held = _PASSING.set(steps)
    try:
        out = make()
        spark, last = out.sparkSession, len(steps)
        out = stored(out)
    finally:
        _PASSING.reset(held)
    if (passing := _PASSING.get()) is not None:
        passing += steps[last:]
    for path in steps[:last]:
        forgotten(spark, path)
    return out
