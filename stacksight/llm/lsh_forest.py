"""Operator 6: near-duplicates by an LSH forest of MinHash signatures.

Every distinct shingle set has a MinHash signature. The forest holds it in several trees; a tree orders the
signatures by a row of their values of its own. The first DEPTH values open a region: at the similarity asked for,
two sets share a region of some tree but for a chance of (1 - s**DEPTH)**TREES, 1e-6 at 0.8. Within a region, where
longer common prefixes lie side by side, neighbours in the order are compared first and joined to components. Only
regions that still hold several components are looked at again, cell by cell, all of their rows against those outside
their largest component; so an ample region costs a few comparisons a row, and no pair is left out. Before texts are
read, a bitmap of each set bounds the intersection from above, which drops most pairs below the limit for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats
from .components import components

#: Trees, and the values that open a region.
TREES, DEPTH = 48, 6
HASHES = TREES * DEPTH
#: Bits of the map of a set's shingles.
MAP_BITS = 4096
#: Rows on a side of the cells that large regions are cut into.
CELL = 256

SIGNATURES = "doc_id long, n long, f1 long, f2 long, sig binary"
KEYS = "prefix long, tail long, doc long"
NEIGHBOURS = "prefix long, a long, b long, part long, edge int"

_RANDOM = np.random.default_rng(20240229)
_FACTOR = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the word shingles of each row, sorted and distinct by row, and the first of each row.

    Words are lower-cased in A-Z. A row with fewer words than size has one shingle of them all, one without words none.
    """
    starts, ends, first = common.word_spans(data, offsets)
    names = common.word_hashes(data, starts, ends, lower=True)
    prefix = common.POLY_B.prefix(names)
    count = np.diff(first)
    shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[row]
    h = common.POLY_B.of(prefix, at, np.minimum(at + size, first[row + 1]))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def minhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits for each row; a row without shingles has zeros."""
    rows = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    if len(rows):
        x = np.empty_like(h)
        for k in range(HASHES):
            np.multiply(h, _FACTOR[k], out=x)
            x += _SHIFT[k]
            least = np.minimum.reduceat(x, first[rows])
            out[rows, k] = (common.mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def bitmaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bit for each shingle of each row, by the shingle's hash."""
    out = np.zeros((len(first) - 1, MAP_BITS // 8), np.uint8)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    bit = (common.mixed(h) & np.uint64(MAP_BITS - 1)).astype(np.int64)
    np.bitwise_or.at(out, (row, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in repeats.blocks_of(batches):
            h, first = shingle_hashes(data, offsets, size)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mixed(h ^ np.uint64(seed)), dtype=np.uint64))) for seed in (0x1234567, 0x89ABCDEF)]
            f1, f2 = (common.signed(s[first[1:]] - s[first[:-1]]) for s in sums)
            sig = np.concatenate((minhashes(h, first).view(np.uint8), bitmaps(h, first)), 1)
            yield repeats.arrow_rows(SIGNATURES, [rows.column(0), pa.array(np.diff(first).astype(np.int64)), f1, f2, pa.array([r.tobytes() for r in sig], pa.binary())])

    return run


def signature_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values and bitmaps."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * HASHES + MAP_BITS // 8)
    return both[:, : 2 * HASHES].copy().view(np.uint16), both[:, 2 * HASHES :].copy().view(np.uint64)


def possible(size_a, size_b, map_a: np.ndarray, map_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and maps can be as similar as asked for: a bit that one map lacks is a shingle that its set lacks."""
    shared = np.bitwise_count(map_a & map_b).sum(-1, dtype=np.int64)
    both = np.minimum(size_a - np.bitwise_count(map_a).sum(-1, dtype=np.int64), size_b - np.bitwise_count(map_b).sum(-1, dtype=np.int64)) + shared
    return 100 * both >= percent * (size_a + size_b - both)


def regions(sig: np.ndarray) -> np.ndarray:
    """The region of each row in each tree."""
    sig = sig.astype(np.uint64).reshape(-1, TREES, DEPTH)
    prefix = np.zeros(sig.shape[:2], np.uint64) + common.mixed(np.arange(TREES, dtype=np.uint64))[None, :]
    for k in range(DEPTH):
        prefix = common.mixed(prefix ^ (sig[:, :, k] + np.uint64(k << 20)))
    return prefix


def _tree_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the region, the next values that order it, and the document."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            sig = signature_rows(part.column(1))[0]
            prefix = regions(sig)
            after = np.roll(sig.astype(np.uint64).reshape(-1, TREES, DEPTH), -1, axis=1)
            tail = (after[:, :, 0] << np.uint64(47)) | (after[:, :, 1] << np.uint64(31)) | (after[:, :, 2] << np.uint64(15)) | (after[:, :, 3] >> np.uint64(1))
            doc = np.repeat(part.column(0).to_numpy(zero_copy_only=False), TREES)
            yield repeats.arrow_rows(KEYS, [common.signed(prefix.reshape(-1)), common.signed(tail.reshape(-1)), pa.array(doc)])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with one region in a sorted partition; the rows at its two ends come as edges 0 and 1."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None

    def row(prefix: int, doc: int, edge: int) -> pa.RecordBatch:
        return repeats.arrow_rows(NEIGHBOURS, [pa.array([x], t) for x, t in ((prefix, pa.int64()), (doc, pa.int64()), (doc, pa.int64()), (part, pa.int64()), (edge, pa.int32()))])

    for batch in batches:
        if not batch.num_rows:
            continue
        prefix, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        if last is None:
            yield row(prefix[0], doc[0], 0)
        else:
            prefix, doc = np.append(last[0], prefix), np.append(last[1], doc)
        last = prefix[-1:], doc[-1:]
        at = np.flatnonzero(prefix[1:] == prefix[:-1])
        a, b = doc[at], doc[at + 1]
        yield repeats.arrow_rows(NEIGHBOURS, [pa.array(prefix[at]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(at), part, np.int64)), pa.array(np.full(len(at), -1, np.int32))])
    if last is not None:
        yield row(last[0][0], last[1][0], 1)


def neighbours(sets: DataFrame) -> DataFrame:
    """(prefix, a, b): neighbours of one region in the order of a tree, a < b. sets: doc, sig."""
    keys = sets.mapInArrow(_tree_keys, KEYS).repartitionByRange("prefix", "tail", "doc").sortWithinPartitions("prefix", "tail", "doc")
    found = common.stored(keys.mapInArrow(_neighbours, NEIGHBOURS))
    # two rows a partition at most; a region that goes on in the next one is joined there
    from pyspark.sql import Window

    order = Window.partitionBy("prefix").orderBy("part", "edge")
    across = found.where("edge >= 0").withColumn("before", F.lag("a").over(order)).where("edge = 0 and before is not null")
    return found.where("edge < 0").select("prefix", "a", "b").unionByName(across.select("prefix", F.least("a", "before").alias("a"), F.greatest("a", "before").alias("b")).where("a <> b"))


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                (sa, ma), (sb, mb) = signature_rows(part.column(4)), signature_rows(part.column(5))
                near = (sa == sb).mean(1)
                good = possible(part.column(2).to_numpy(), part.column(3).to_numpy(), ma, mb, percent)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(near[good])], ["a", "b", "near"])

    return run


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near): the pairs that bitmaps leave possible, and the share of values in which the signatures agree."""
    first, second = (sets.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_alike(percent), "a long, b long, near double")


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def shingles(ids: pa.Array, texts: pa.Array) -> None:
            new = {}
            for k, i in enumerate(ids.to_pylist()):
                if i not in held and i not in new:
                    new[i] = k
            if new:
                own = texts.take(pa.array(list(new.values())))
                data, offsets = common.text_buffer(own)
                for lo, hi in common.row_blocks(offsets):
                    h, first = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                    for k, i in enumerate(list(new)[lo:hi]):
                        held[i] = h[first[k] : first[k + 1]]

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if len(held) > 512:
                    held.clear()
                shingles(part.column(0), part.column(2))
                shingles(part.column(1), part.column(3))
                linked = []
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x, y = held[a], held[b]
                    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    linked.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked): whether the full shingle sets of each pair are as similar as asked for."""
    first, second = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return common.checkpointed(both.mapInArrow(_confirm(size, percent), "a long, b long, linked boolean"))


def _across(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs between different components."""
    first, second = of.select(F.col("doc").alias("a"), F.col("component").alias("ca")), of.select(F.col("doc").alias("b"), F.col("component").alias("cb"))
    return pairs.join(first, "a", "left").join(second, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _linked(pairs: DataFrame, links: DataFrame | None, of: DataFrame | None, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and components with the pairs (a, b, near): each document's nearest is read first, then the pairs that still lie between components."""
    both = pairs.select(F.col("a").alias("doc"), F.struct("near", F.col("b").alias("to")).alias("x")).unionByName(pairs.select(F.col("b").alias("doc"), F.struct("near", F.col("a").alias("to")).alias("x")))
    nearest = both.groupBy("doc").agg(F.max("x").alias("x")).select(F.least("doc", "x.to").alias("a"), F.greatest("doc", "x.to").alias("b")).distinct()
    seen = confirmed(nearest, texts, size, percent)
    for step in range(2):
        new = seen.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        of = common.checkpointed(components(links if of is None else new.unionByName(of.select(F.col("doc").alias("a"), F.col("component").alias("b")))))
        rest = common.checkpointed(_across(pairs.select("a", "b").join(seen, ["a", "b"], "left_anti"), of)) if step == 0 else None
        if rest is None or rest.isEmpty():
            break
        seen = confirmed(rest, texts, size, percent)
    return links, of


def _cells(percent: int):
    """mapInArrow body over rows sorted by cell: the possible pairs of a row (role 0) and one outside the largest component (role 1).

    A pair that meets in several trees is put out in the first only.
    """

    def pairs(g: pa.Table) -> pa.RecordBatch:
        role, doc, comp, n, outside = (g.column(k).to_numpy() for k in ("role", "doc", "comp", "n", "outside"))
        sig, bits = signature_rows(g.column("sig"))
        own, trees = np.flatnonzero(role == 0), sig.reshape(len(sig), TREES, DEPTH)
        region, here = regions(sig), np.uint64(g.column("prefix")[0].as_py() & ((1 << 64) - 1))
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for m in np.flatnonzero(role == 1):
            at = own[(comp[own] != comp[m]) & (~outside[own] | (doc[own] < doc[m]))]
            at = at[possible(n[at], n[m], bits[at], bits[m], percent)]
            near = (sig[at] == sig[m]).mean(1)
            first = region[m][(trees[at] == trees[m]).all(2).argmax(1)] == here
            at, near = at[first], near[first]
            for column, x in zip(out, (np.minimum(doc[at], doc[m]), np.maximum(doc[at], doc[m]), near), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in repeats.groups_of(batches, ["prefix", "i", "j"]):
            yield pairs(g)

    return run


def _left_over(near: DataFrame, of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near): in regions with several components, the possible pairs between components."""
    members = near.select("prefix", F.col("a").alias("doc")).unionByName(near.select("prefix", F.col("b").alias("doc"))).distinct()
    members = members.join(of, "doc", "left").select("prefix", "doc", F.coalesce("component", "doc").alias("comp"))
    parts = members.groupBy("prefix", "comp").agg(F.count(F.lit(1)).alias("rows"))
    several = parts.groupBy("prefix").agg(F.max(F.struct("rows", "comp")).alias("most"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and rows > 2")
    rows = members.join(several, "prefix").select(
        "prefix", "doc", "comp", (F.col("comp") != F.col("most.comp")).alias("outside"),
        F.ceil(F.col("rows") / CELL).cast("int").alias("wide"), F.ceil((F.col("rows") - F.col("most.rows")) / CELL).cast("int").alias("high"),
    )
    dealt = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    side = rows.select("prefix", "doc", "comp", "outside", F.lit(0).alias("role"), (dealt % F.col("wide")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("j"))
    top = rows.where("outside").select("prefix", "doc", "comp", "outside", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("i"), (dealt % F.col("high")).cast("int").alias("j"))
    cells = side.unionByName(top).join(sets, "doc")
    found = cells.repartition("prefix", "i", "j").sortWithinPartitions("prefix", "i", "j").mapInArrow(_cells(percent), "a long, b long, near double")
    return found.groupBy("a", "b").agg(F.max("near").alias("near"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of `size`-word shingles (A-Z lower-cased; with fewer words the whole sequence)
    have 100 * intersection >= percent * union, confirmed on the full sets. component_id is the smallest doc_id that
    links reach. A null, empty or blank text has no shingles and is linked with nothing. Of rows that repeat a doc_id
    one stays (the smallest text); rows without doc_id are left out; other columns are not looked at. An empty table
    gives no rows. Equal sets are one class from the start, so copies, however many, cost one row each.
    """
    d = common.unique_documents(docs)
    signed = common.stored(d.mapInArrow(_signatures(size), SIGNATURES))
    classes = common.stored(signed.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    sets = classes.select("doc", "n", "sig")
    near = common.stored(neighbours(classes.select("doc", "sig")))
    wanted = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
    texts = common.stored(d.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text"))
    links, of = _linked(common.checkpointed(alike(near.select("a", "b").distinct(), sets, percent)), None, None, texts, size, percent)
    more = common.checkpointed(_left_over(near, of, sets, percent))
    if not more.isEmpty():
        _, of = _linked(more, links, of, texts, size, percent)
    named = classes.join(of, "doc", "left").select("f1", "f2", F.coalesce("component", "doc").alias("component"))
    key = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)  # noqa: E731  a document without shingles joins nothing
    out = signed.select("doc_id", "n", key("f1"), key("f2")).join(named, ["f1", "f2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def kept_documents(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, of which one of each group of near-duplicates stays: that with the smallest doc_id.

    Of rows that repeat a doc_id one stays (the smallest text, nulls last; among equal texts the smallest row, written
    as JSON); rows without doc_id are left out.
    """
    kept = near_duplicates(docs, size=size, percent=percent).where("kept").select("doc_id")
    rows = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty():
        return rows
    whole = F.struct(*docs.columns)  # may hold maps, which have no order
    first = F.struct(F.col("text").isNull(), "text", F.to_json(whole))
    return rows.groupBy("doc_id").agg(F.min_by(whole, first).alias("one")).select("one.*")
