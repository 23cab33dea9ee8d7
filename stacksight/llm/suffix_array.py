"""Operator 1: exact substring deduplication by a common-prefix interval tree over enhanced suffix arrays.

Anchors (minimisers of byte n-grams) find the stretches of text that can hold a repeat at all. The stretches of
one anchor are sorted by their suffixes, and a stack scan over the common-prefix array walks the tree of its
intervals; an interval whose suffixes differ in the byte on their left is a maximal repeat, and all of its
occurrences are put out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

SPAN = 200
GRAM = 32
#: Anchors with more different stretches than this are compared chunk by chunk, by fingerprints that are counted without gathering them.
VARIANTS_IN_ONE_ARRAY = 128
CHUNK = 16
ARRAY_BYTES = 1 << 19

#: Stretches of anchors with few variants have starts and segment, the chunks of the others the rest.
PARTS = "akey long, bkey long, n long, starts int, segment binary, lo int, hi int, core long, union long, h1 array<long>, h2 array<long>"
GROUPS = "akey long, bkey long, lo int, length int, occurrences int"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _runs(span: int, gram: int):
    chunk = common.BLOCK_BYTES

    def of(doc_ids, data, offsets) -> pa.RecordBatch | None:
        if len(data) < span:
            return None
        prefix = common.POLY_A.prefix(data)
        at = np.arange(len(data) - gram + 1)
        order = common.POLY_A.of(prefix, at, at + gram)
        best = sliding_min((order & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64), span - gram + 1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
        windows = np.flatnonzero(np.arange(len(best)) + span <= offsets[row + 1])
        anchors = (best[windows] & np.uint64(0xFFFFFF)).astype(np.int64)
        keys = lambda s, e, a: (order[a], common.POLY_B.of(common.POLY_B.prefix(data), s, e + span) ^ common.mixed((a - s).astype(np.uint64)))
        return repeats.run_rows(doc_ids, windows, anchors, row[windows], offsets, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in repeats.blocks_of(batches):
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            if len(data) <= 2 * chunk:
                out = of(ids, data, offsets)
                if out is not None:
                    yield out
                continue
            for lo in range(0, len(data), chunk):  # one long text: window starts chunk by chunk
                part = data[lo : lo + chunk + span - 1]
                out = of(ids, part, np.array([0, len(part)]))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.compute.add(out.column(3), pa.scalar(lo << 24, pa.int64()))], out.schema.names)

    return run


def _parts(span: int, limit: int):
    """mapInArrow body: the text of stretches of anchors with few variants; those of others in chunks of CHUNK window starts, counted from the anchor.

    The core is what every window of a chunk holds, whichever part of the chunk a stretch has; the union is what its
    own windows cover together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.squeezed_blocks(batches):
            row, x = repeats.flat_lists(rows, ["akey", "bkey", "variants", "n", "s", "e", "a"])
            few = np.flatnonzero(x["variants"] <= limit)
            raw, begin, end = data.tobytes(), offsets[row[few]] + x["s"][few], offsets[row[few]] + x["e"][few] + span
            yield part_rows(len(few), akey=pa.array(x["akey"][few]), bkey=pa.array(x["bkey"][few]), n=pa.array(x["n"][few]), starts=pa.array((x["e"] - x["s"] + 1)[few].astype(np.int32)), segment=pa.array([raw[i:j] for i, j in zip(begin, end, strict=True)], pa.binary()))
            keep = np.flatnonzero(x["variants"] > limit)
            s, e, a = (x[k][keep].astype(np.int64) for k in "sea")
            low = (s - a) // CHUNK
            count = (e - a) // CHUNK - low + 1
            which = np.repeat(np.arange(len(keep)), count)
            chunk = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            begin = a[which] + chunk * CHUNK
            lo, hi = np.maximum(begin, s[which]), np.minimum(begin + CHUNK - 1, e[which])
            base, k = offsets[row[keep[which]]], keep[which]
            one, two = common.POLY_A.prefix(data), common.POLY_B.prefix(data)
            core = common.POLY_A.of(one, base + begin + CHUNK - 1, base + begin + span) ^ common.mixed(chunk.astype(np.uint64))
            union = common.POLY_B.of(two, base + lo, base + hi + span) ^ common.mixed((lo - begin).astype(np.uint64))
            size = hi - lo + 1
            at = np.repeat(base + lo, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            cuts = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            h1, h2 = (pa.ListArray.from_arrays(cuts, common.signed(p.of(f, at, at + span))) for p, f in ((common.POLY_A, one), (common.POLY_B, two)))
            yield part_rows(len(k), akey=pa.array(x["akey"][k]), bkey=pa.array(x["bkey"][k]), n=pa.array(x["n"][k]), lo=pa.array((lo - s[which]).astype(np.int32)), hi=pa.array((hi - s[which]).astype(np.int32)), core=common.signed(core), union=common.signed(union), h1=h1, h2=h2)

    return run


def part_rows(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"akey": pa.int64(), "bkey": pa.int64(), "n": pa.int64(), "starts": pa.int32(), "segment": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "core": pa.int64(), "union": pa.int64(), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()], list(kinds))


def crowded_marks(chunks: DataFrame) -> DataFrame:
    """MARKS of anchors with very many variants, however many: nothing is gathered, and of equal chunks one is looked at.

    A chunk whose core occurs once holds no repeat. Equal chunks are repeated as a whole. Only where different
    chunks share a core are their windows counted, one of each kind.
    """
    kinds = chunks.groupBy("core", "union").agg(F.sum("n").alias("times"), F.first(F.struct("h1", "h2")).alias("w"))
    mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    windows = kinds.join(repeats.apart(mixed, "core"), "core").select("core", "union", "times", F.posexplode(F.arrays_zip("w.h1", "w.h2")).alias("at", "h")).select("core", "union", "times", "at", "h.h1", "h.h2")
    same = windows.groupBy("core", "h1", "h2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    parts = windows.where("times = 1").join(repeats.apart(same, "core", "h1", "h2"), ["core", "h1", "h2"]).groupBy("core", "union").agg(F.collect_list("at").alias("parts"))
    known = kinds.join(parts, ["core", "union"], "left").where("times > 1 or parts is not null").select("core", "union", F.when(F.col("times") == 1, F.col("parts")).alias("parts"))
    marked = chunks.select("akey", "bkey", "lo", "hi", "core", "union").join(repeats.apart(known, "core", "union"), ["core", "union"])
    whole = marked.where("parts is null").select("akey", "bkey", "lo", "hi")
    return whole.unionByName(marked.where("parts is not null").select("akey", "bkey", F.explode("parts").alias("at"), "lo").select("akey", "bkey", (F.col("lo") + F.col("at")).alias("lo"), (F.col("lo") + F.col("at")).alias("hi")))


def suffix_ranks(data: np.ndarray, ends: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Ranks of the prefixes of 4, 8, ... upto bytes of every suffix, cut at its segment's end, by prefix doubling."""
    n, at = len(data), np.arange(len(data))
    key = np.zeros(n, np.int64)
    for k in range(4):
        inside = at + k < ends
        key = key * 257 + np.where(inside, data[np.minimum(at + k, n - 1)].astype(np.int64) + 1, 0)
    rank = {4: np.unique(key, return_inverse=True)[1] + 1}
    size = 4
    while size < upto:
        inside = at + size < ends
        key = rank[size] * (n + 2) + np.where(inside, rank[size][np.minimum(at + size, n - 1)], 0)
        size *= 2
        rank[size] = np.unique(key, return_inverse=True)[1] + 1
    return rank


def common_prefixes(rank: dict[int, np.ndarray], data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, longest steps first."""
    out, n = np.zeros(len(a), np.int64), len(data)
    room = np.minimum(ends[a] - a, ends[b] - b)
    for size in sorted(rank, reverse=True):
        for _ in range(2 if size == max(rank) else 1):
            step = (out + size <= room) & (rank[size][np.minimum(a + out, n - 1)] == rank[size][np.minimum(b + out, n - 1)])
            out += size * step
    for _ in range(3):
        out += (out < room) & (data[np.minimum(a + out, n - 1)] == data[np.minimum(b + out, n - 1)])
    return out


def maximal_repeats(segments: list[bytes], starts: np.ndarray, least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(segment, offset), ...]) of every maximal repeat of `least` bytes or more, with all occurrences.

    Of each segment the first `starts` suffixes take part. The stack holds the open intervals of the common-prefix
    array; a closed interval is put out if its suffixes have different bytes on their left (a segment's first
    suffix differs from all).
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    # prefixes of `size` bytes have ranks; two of them in a row reach the end of the longest segment, so the order is that of whole suffixes
    size = 4
    while 2 * size < sizes.max(initial=0):
        size *= 2
    rank = suffix_ranks(data, ends, size)
    which = np.repeat(np.arange(len(segments)), starts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts) + first[which]
    rest = np.where(at + size < ends[at], rank[size][np.minimum(at + size, len(data) - 1)], 0)
    order = np.argsort(rank[size][at] * (len(data) + 2) + rest, kind="stable")
    sa, seg = at[order], which[order]
    lcp = common_prefixes(rank, data, ends, sa[:-1], sa[1:])
    near = np.concatenate(([False], lcp >= least, [False]))
    left = np.where(sa > first[seg], data[np.maximum(sa - 1, 0)].astype(np.int64), -1 - np.arange(len(sa)))
    for lo, hi in zip(np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(near[:-1] & ~near[1:]), strict=True):
        # suffixes lo..hi share `least` bytes with their neighbours
        depth, stack = lcp[lo:hi].tolist(), [(least, 0)]
        for i, value in enumerate([*depth, 0]):
            begin = i
            while stack and stack[-1][0] > max(value, least if i < len(depth) else 0):
                length, begin = stack.pop()
                yield from _interval(length, lo + begin, lo + i + 1, sa, seg, first, left)
            if value > least and (not stack or stack[-1][0] < value):
                stack.append((value, begin))


def _interval(length: int, lo: int, hi: int, sa, seg, first, left) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    if hi - lo > 1 and (left[lo:hi] != left[lo]).any():
        yield length, list(zip(seg[lo:hi].tolist(), (sa[lo:hi] - first[seg[lo:hi]]).tolist(), strict=True))


def _groups(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def scan() -> pa.RecordBatch:
            out: dict[tuple[int, int], tuple[int, int]] = {}
            for length, occurrences in maximal_repeats([h[4] for h in held], np.array([h[3] for h in held], np.int64), span):
                for k, off in occurrences:
                    if (k, off) not in out or out[k, off][0] < length:
                        out[k, off] = (length, len(occurrences))
            rows = [(held[k][0], held[k][1], off, *v) for (k, off), v in out.items()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return repeats.arrow_rows(GROUPS, [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > ARRAY_BYTES and item[0] != held[-1][0]:
                    yield scan()
                    held.clear()
                    size = 0
                held.append(item)
                size += len(item[4])
        if held:
            yield scan()

    return run


def repeat_groups(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """akey, bkey, lo, length, occurrences: where, in the stretch of each block, a maximal repeat starts, how long the longest there is and how often it occurs."""
    rows = segments.select("akey", "bkey", "n", "starts", "segment")
    return rows.repartition("akey").sortWithinPartitions("akey", "bkey").mapInArrow(_groups(span), GROUPS)


def repeated_spans(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): packed byte ranges that strings of `span` bytes cover which also start elsewhere."""
    runs = docs.select("doc_id", "text").mapInArrow(_runs(span, gram), repeats.RUNS)

    def marks(texts: DataFrame, blocks: DataFrame) -> DataFrame:
        parts = common.stored(repeats.with_representatives(texts, blocks).mapInArrow(_parts(span, VARIANTS_IN_ONE_ARRAY), PARTS))
        small = repeat_groups(parts.where("segment is not null"), span).select("akey", "bkey", "lo", (F.col("lo") + F.col("length") - span).alias("hi"))
        return small.unionByName(crowded_marks(parts.where("segment is null")))

    return repeats.covers(common.squeezed(docs), runs, span, marks, earlier_only=False)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.squeezed_blocks(batches):
            cut, lo, hi = repeats.unpacked(rows.column(2))
            out: list[list] = [[] for _ in range(5)]
            for k in range(rows.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                removed = n_spans = 0
                if cut[k + 1] > cut[k]:
                    gone = repeats.merged(lo[cut[k] : cut[k + 1]], hi[cut[k] : cut[k + 1]], len(raw))
                    removed = int(gone.sum())
                    n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                    kept = raw[~gone].tobytes()
                else:
                    kept = raw.tobytes()
                for column, value in zip(out, (len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield repeats.arrow_rows(DIGEST, [rows.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))])

    return run


def deduplicate(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes.

    Each byte covered by a `span`-byte string that also starts anywhere else, in the same document included, is
    removed; strings are judged on the input. A null text is empty: n_bytes 0, nothing removed. Texts shorter than
    `span` are kept. Of rows that repeat a doc_id one stays (the smallest text); rows without doc_id are left out;
    other columns are not looked at. An empty table gives no rows.
    """
    d = common.unique_documents(docs)
    found = common.outcome(lambda: repeated_spans(d, span=span, gram=gram))
    out = common.squeezed(d).join(found, "doc_id", "left").select("doc_id", "packed", "spans").mapInArrow(_remove(with_text), DIGEST)
    return out if with_text else out.drop("kept")


def _cut_rows(names: list[str]):
    text, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in repeats.blocks_of(iter([batch])):
                cut, lo, hi = repeats.unpacked(rows.column(len(names)))
                columns = list(rows.columns[:-1])
                if len(lo):
                    texts = columns[text].to_pylist()
                    for k in np.flatnonzero(np.diff(cut)):
                        raw = data[offsets[k] : offsets[k + 1]]
                        kept = raw[~repeats.merged(lo[cut[k] : cut[k + 1]], hi[cut[k] : cut[k + 1]], len(raw))]
                        texts[k] = kept.tobytes().decode("utf-8", "ignore")
                    columns[text] = pa.array(texts, columns[text].type)
                    if size >= 0:
                        counts = columns[size].to_pylist()
                        for k in np.flatnonzero(np.diff(cut)):
                            counts[k] = len(texts[k])
                        columns[size] = pa.array(counts, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def shortened_documents(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, with the repeated bytes cut from text and, where there is such a column, n_chars counted anew.

    A character of which only some bytes are cut goes whole. Rows that repeat a doc_id are each cut by what the one
    with the smallest text shows; rows without doc_id are left out.
    """
    found = common.outcome(lambda: repeated_spans(common.unique_documents(docs), span=span, gram=gram))
    found = found.select(F.col("doc_id").alias("__doc_id"), F.col("spans").alias("__spans"))
    rows = docs.where("doc_id is not null").join(found, F.col("doc_id").cast("long") == F.col("__doc_id"), "left")
    return rows.select(*docs.columns, "__spans").mapInArrow(_cut_rows(docs.columns), docs.schema)
