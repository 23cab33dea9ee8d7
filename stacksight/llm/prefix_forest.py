"""Operator 5: approximate nearest neighbours by a forest of sorted hash strings.

A tree gives every vector a string of SYMBOLS symbols: a symbol is the axis on which the vector, turned by random
projections, lies farthest out, and its sign. A tree is those strings in order, so the vectors that share a prefix of
any length (a node) lie side by side. A query descends in all trees at once to the longest prefixes at which the trees
together offer k candidates for certain. The k-th distance among those tells with what probability vectors at that
distance share a prefix of what length in some tree. Where it is below RECALL at the length reached, all trees ascend
together to the longest prefixes where it is not; every vector of the nodes reached is a candidate. Distances are
computed on the original vectors. Equal vectors are one entry.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, repeats

TREES, SYMBOLS, AXES = 320, 5, 64
#: Bits of a symbol: its axis, then its sign; and of a string.
SYMBOL_BITS = 7
BITS = SYMBOLS * SYMBOL_BITS
#: Probability with which a vector as far away as the k-th found is to be met in some tree; nearer ones are met with more.
RECALL = 0.85
#: Places of a tree in a block of the interval join, and queries whose vectors travel together.
BLOCK, TOGETHER = 256, 512
NEIGHBOURS = 10

KEYS = "key long, entry long"
PLACES = "part int, place long, id long, tree int, level int, upper boolean, entries array<long>"
HITS = "query long, entry long, score double, cosine double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


@functools.cache
def projections(size: int, trees: int) -> list[np.ndarray]:
    """Random directions: for each symbol, AXES for each tree."""
    r = np.random.default_rng(81)
    return [r.standard_normal((size, trees * AXES), dtype=np.float32) for _ in range(SYMBOLS)]


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """The string of each row in each tree."""
    out = np.zeros((len(x), trees), np.int64)
    for p in projections(x.shape[1], trees):
        y = (x.astype(np.float32) @ p).reshape(len(x), trees, AXES)
        axis = np.abs(y).argmax(2)
        sign = np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] > 0
        out = (out << SYMBOL_BITS) | (axis << 1) | sign
    return out


def met_at(cosine: np.ndarray, samples: int = 1 << 14) -> np.ndarray:
    """P(two strings agree in their first 0, 1, ... BITS bits) for vectors at these cosines, a row each.

    Random projections of two vectors depend on their angle only, so a symbol's share is drawn once and the
    symbols of a string are independent.
    """
    r = np.random.default_rng(82)
    a, b = r.standard_normal((2, samples, AXES))
    best = np.abs(a).argmax(1)
    one = best * 2 + (a[np.arange(samples), best] > 0)
    symbol = np.zeros((len(cosine), SYMBOL_BITS + 1))
    for k, c in enumerate(cosine):
        y = c * a + np.sqrt(max(0.0, 1 - c * c)) * b
        best = np.abs(y).argmax(1)
        other = best * 2 + (y[np.arange(samples), best] > 0)
        differ = np.frexp((one ^ other).astype(float))[1]  # bits from the first difference on
        symbol[k] = [(SYMBOL_BITS - differ >= j).mean() for j in range(SYMBOL_BITS + 1)]
    level = np.arange(BITS + 1)
    return symbol[:, -1:] ** (level // SYMBOL_BITS) * symbol[:, level % SYMBOL_BITS]


def least_cosines(trees: int, recall: float) -> list[float]:
    """For each prefix length from 1: the least cosine at which some tree has the two vectors in one node with this probability (2 if none has)."""
    grid = np.linspace(-1, 1, 101)
    met = np.maximum.accumulate(1 - (1 - met_at(grid)) ** trees, axis=0)[:, 1:] >= recall
    return [float(grid[column.argmax()]) if column.any() else 2.0 for column in met.T]


def _keys(centre: np.ndarray, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                key = strings(matrix(part.column(1)) - centre, trees) | (np.arange(trees, dtype=np.int64) << BITS)
                entry = part.column(0).to_numpy(zero_copy_only=False)
                yield repeats.arrow_rows(KEYS, [pa.array(key.reshape(-1)), pa.array(np.repeat(entry, trees))])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and role: a bound's place is the number of entries before it in the partition; the entries go out in blocks of BLOCK, a row each."""
    from pyspark import TaskContext

    part, n, waiting = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

    def blocks(ids: np.ndarray, first: int) -> pa.RecordBatch:
        starts = np.arange(0, len(ids), BLOCK)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids))
        none = pa.array(np.full(len(starts), -1, np.int32))
        return repeats.arrow_rows(PLACES, [pa.array(np.full(len(starts), part, np.int32)), pa.array(first + starts), pa.array(np.full(len(starts), -1)), none, none, pa.array(np.zeros(len(starts), bool)), lists])

    for batch in batches:
        role = batch.column(1).to_numpy(zero_copy_only=False)
        entry = role == 1
        place = n + np.cumsum(entry)
        bound = pa.array(~entry)
        own = [c.filter(bound) for c in batch.columns[2:]]
        at = place[~entry]
        yield repeats.arrow_rows(PLACES, [pa.array(np.full(len(at), part, np.int32)), pa.array(at), *own, pa.nulls(len(at), pa.list_(pa.int64()))])
        ids = np.append(waiting, batch.column(2).to_numpy(zero_copy_only=False)[entry])
        first, whole = n - len(waiting), len(ids) // BLOCK * BLOCK
        n += int(entry.sum())
        if whole:
            yield blocks(ids[:whole], first)
        waiting = ids[whole:]
    if len(waiting):
        yield blocks(waiting, n - len(waiting))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(0)).sum(0)
            total, n = x if total is None else total + x, n + batch.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["x", "n"])


def centre_of(entries: DataFrame) -> np.ndarray:
    """The mean of all vectors: one partial sum for each task, added up by component."""
    sums = entries.select("vector").mapInArrow(_sums, "x array<double>, n long")
    rows = sums.select("n", F.posexplode("x").alias("at", "x")).groupBy("at").agg((F.sum("x") / F.sum("n")).alias("mean")).orderBy("at").collect()
    return np.array([r["mean"] for r in rows])


def _distances(centre: np.ndarray, keep: int):
    """mapInArrow body over rows sorted by (block, role): the vectors of a block's queries (role 0), then entries with the queries that they are candidates of.

    Of each query the `keep` nearest of a batch are put out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mine, names = None, np.zeros((0, len(centre))), np.zeros(0, np.int64)
        for batch in batches:
            blocks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            cut = np.concatenate(([0], np.flatnonzero((blocks[:, 1:] != blocks[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                g = batch.slice(lo, hi - lo)
                if (here := tuple(blocks[:, lo])) != block:
                    block, mine, names = here, np.zeros((0, len(centre))), np.zeros(0, np.int64)
                role, ids, x = g.column(2).to_numpy(zero_copy_only=False), g.column(3).to_numpy(zero_copy_only=False), matrix(g.column(4))
                own = role == 0
                if own.any():
                    names, mine = np.append(names, ids[own]), np.concatenate((mine, x[own]))
                    order = np.argsort(names)
                    names, mine = names[order], mine[order]
                if own.all():
                    continue
                asked = g.column(5).take(pa.array(np.flatnonzero(~own)))
                row = np.repeat(np.flatnonzero(~own), np.diff(asked.offsets.to_numpy()))
                query = np.searchsorted(names, asked.flatten().to_numpy())
                score, cosine = np.empty(len(row)), np.empty(len(row))
                for a in range(0, len(row), 1 << 14):
                    p, q = x[row[a : a + (1 << 14)]], mine[query[a : a + (1 << 14)]]
                    score[a : a + (1 << 14)] = np.sqrt(((p - q) ** 2).sum(1))
                    p, q = p - centre, q - centre
                    cosine[a : a + (1 << 14)] = (p * q).sum(1) / np.maximum(np.sqrt((p * p).sum(1) * (q * q).sum(1)), 1e-300)
                by = np.lexsort((ids[row], score, query))
                nth = np.arange(len(by)) - np.searchsorted(query[by], query[by])
                by = by[nth < keep]
                yield repeats.arrow_rows(HITS, [pa.array(names[query[by]]), pa.array(ids[row[by]]), pa.array(score[by]), pa.array(cosine[by])])

    return run


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): vectors that take part, one for each id (the smallest, where an id repeats)."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = d.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    # the size that most vectors have; no distance is defined to others
    sizes = d.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(2).collect()
    if len(sizes) > 1:
        d = d.where(F.size("vector") == sizes[0]["size"])
    repeated = d.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    return d if repeated.isEmpty() else d.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nodes(entries: DataFrame, centre: np.ndarray, trees: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The sorted arrays of all trees, one behind the other, in blocks (part, block, entries) and the number of entries in each part; and (query, tree, level, upper, at, part, place): the first place of each node of each query, and the first behind it, counted from the start (at) and within its part.

    The bounds of a node are strings themselves, so they are sorted in among the strings, and the number of strings
    before one is its place. A node of level 0 is a whole tree; only the first tree's is told.
    """
    keys = entries.select("entry", "vector").mapInArrow(_keys(centre, trees), KEYS)
    strings_ = keys.select("key", F.lit(1).alias("role"), F.col("entry").alias("id"), F.lit(-1).alias("tree"), F.lit(-1).alias("level"), F.lit(False).alias("upper"))
    asking = entries.where("asked").select("entry", "vector").mapInArrow(_keys(centre, trees), KEYS)
    level = F.explode(F.when(F.col("tree") == 0, F.sequence(F.lit(0), F.lit(BITS))).otherwise(F.sequence(F.lit(1), F.lit(BITS)))).alias("level")
    each = asking.withColumn("tree", F.shiftright("key", BITS).cast("int")).select("key", F.col("entry").alias("id"), "tree", level)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(BITS) - F.col("level"))
    low, upper = F.col("key") - F.pmod("key", width), F.explode(F.array(F.lit(False), F.lit(True))).alias("upper")
    bounds = each.select("id", "tree", "level", low.alias("low"), width.alias("width"), upper)
    bounds = bounds.select((F.col("low") + F.when(F.col("upper"), F.col("width")).otherwise(0)).alias("key"), F.lit(0).alias("role"), "id", "tree", "level", "upper")
    both = strings_.unionByName(bounds)
    placed = common.stored(both.repartitionByRange("key", "role", "id").sortWithinPartitions("key", "role", "id").mapInArrow(_places, PLACES))
    # one number for each partition
    counts = {r["part"]: r["n"] for r in placed.where("level < 0").groupBy("part").agg(F.sum(F.size("entries")).alias("n")).collect()}
    last = placed.agg(F.max("part").alias("p")).first()["p"]
    starts, total = [], 0
    for p in range(last + 1):
        starts.append(total)
        total += counts.get(p, 0)
    at = (F.element_at(F.array(*map(F.lit, starts)), F.col("part") + 1) + F.col("place")).cast("long").alias("at")
    array = placed.where("level < 0").select("part", F.floor(F.col("place") / BLOCK).cast("long").alias("block"), "entries")
    return array, placed.where("level >= 0").select(F.col("id").alias("query"), "tree", "level", "upper", at, "part", "place"), [counts.get(p, 0) for p in range(last + 1)]


def _ranges(bounds: DataFrame, levels: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(query, tree, lo, hi): the nodes of the queries at their levels (query, level), as (at, part, place) of their ends."""
    end = F.struct("at", "part", "place")
    return bounds.join(levels, ["query", "level"]).groupBy("query", "tree").agg(F.min(end).alias(names[0]), F.max(end).alias(names[1])).where(f"{names[1]}.at > {names[0]}.at")


def _offered(array: DataFrame, bounds: DataFrame, sizes: list[int], levels: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """(query, entry): what the nodes of the queries at their levels hold, in all trees, without what their nodes at the inner levels held; an entry comes once for each tree that offers it."""
    node = _ranges(bounds, levels, ("lo", "hi"))
    if inner is None:
        node = node.select("query", "lo", "hi")
    else:
        within = _ranges(bounds, inner.join(levels.select("query"), "query", "left_semi"), ("a", "b"))
        sides = F.when(F.col("a").isNull(), F.array(F.struct("lo", "hi"))).otherwise(F.array(F.struct("lo", F.col("a").alias("hi")), F.struct(F.col("b").alias("lo"), "hi")))
        node = node.join(within, ["query", "tree"], "left").select("query", F.explode(sides).alias("side")).select("query", "side.lo", "side.hi").where("hi.at > lo.at")
    # a node that goes over the end of a part goes on at the start of the next
    parts = node.select("query", "lo", "hi", F.explode(F.sequence("lo.part", "hi.part")).alias("part"))
    size = F.element_at(F.array(*(F.lit(n).cast("long") for n in sizes)), F.col("part") + 1)
    own = parts.select("query", "part", F.when(F.col("part") == F.col("lo.part"), F.col("lo.place")).otherwise(0).alias("lo"), F.when(F.col("part") == F.col("hi.part"), F.col("hi.place")).otherwise(size).alias("hi")).where("hi > lo")
    asked = own.select("query", "part", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))).alias("block"))
    first = F.greatest(F.col("lo") - F.col("block") * BLOCK, F.lit(0))
    count = F.least(F.col("hi") - F.col("block") * BLOCK, F.lit(BLOCK)) - first
    met = asked.join(array, ["part", "block"]).select("query", F.explode(F.slice("entries", (first + 1).cast("int"), count.cast("int"))).alias("entry"))
    return met.where("entry <> query")


def _nearest(pairs: DataFrame, entries: DataFrame, centre: np.ndarray, asked: int, keep: int) -> DataFrame:
    """HITS of the pairs (query, entry), which may repeat, the `keep` nearest of each query.

    An entry's vector travels once for all queries of a block that it is a candidate of, and meets their vectors there.
    """
    blocks, slices = max(1, -(-asked // TOGETHER)), 8
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    slice_ = F.pmod(F.xxhash64(F.lit("slice"), "entry"), F.lit(slices)).cast("int").alias("slice")
    wanted = pairs.groupBy(block("query"), "entry").agg(F.collect_set("query").alias("queries"))
    offered = wanted.join(entries.select("entry", "vector"), "entry").select("block", slice_, F.lit(1).alias("role"), F.col("entry").alias("id"), "vector", "queries")
    mine = entries.where("asked").select(block("entry"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("role"), F.col("entry").alias("id"), "vector", F.array().cast("array<long>").alias("queries"))
    rows = mine.unionByName(offered).repartition("block", "slice").sortWithinPartitions("block", "slice", "role")
    hits = rows.mapInArrow(_distances(centre, keep), HITS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))
    return common.stored(hits.withColumn("nth", rank).where(F.col("nth") <= keep))


def search(rows: DataFrame, *, is_query: F.Column | None = None, k: int = NEIGHBOURS, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query among all other rows, by Euclidean distance.

    rows has vec_id and embedding, other columns are not looked at; is_query tells the queries by vec_id, by default
    those divisible by 100. Vectors that are null, zero or hold null or non-finite components take no part; nor do
    such of another size than most. Of rows that repeat a vec_id the smallest vector stays; rows without vec_id are
    left out. Ties go to the smaller vec_id. Equal vectors, however many, are one entry of the forest with its k + 1
    smallest ids, which is all that any query can take of them. An empty table gives no rows.

    `recall` is kept for vectors of about one length (from the centre), as a prefix speaks of angles. Work follows the
    data: where nearest vectors are much nearer than others a query meets few; where they are hardly nearer, prefixes
    must be short and a query meets a share of all.
    """
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    return common.outcome(lambda: _search(rows, is_query, k, trees, recall))


def _search(rows: DataFrame, is_query: F.Column, k: int, trees: int, recall: float) -> DataFrame:
    d = common.stored(usable(rows).withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit("second"), "vector")}))
    queries = d.where(is_query).select(F.col("vec_id").alias("query_id"), "v1", "v2")
    place = F.row_number().over(Window.partitionBy("v1", "v2").orderBy("vec_id"))
    some = d.withColumn("nth", place).where(F.col("nth") <= k + 1)
    asked = queries.groupBy("v1", "v2").agg(F.lit(1).alias("asked"))
    entries = some.groupBy("v1", "v2").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    entries = common.stored(entries.join(asked, ["v1", "v2"], "left").withColumn("asked", F.col("asked").isNotNull()))
    n = entries.where("asked").count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre = centre_of(entries)
    array, bounds, counts = nodes(entries, centre, trees)

    signed = F.when(F.col("upper"), F.col("at")).otherwise(-F.col("at"))
    sizes = bounds.groupBy("query", "level").agg((F.sum(signed) - F.count_if("upper")).alias("others"))  # but for the query itself
    # trees * k others are k different ones for certain, as one may be met in every tree
    down = common.stored(sizes.where((F.col("others") >= trees * k) | (F.col("level") == 0)).groupBy("query").agg(F.max("level").alias("level")))
    near = _nearest(_offered(array, bounds, counts, down), entries, centre, n, k + 1)
    # what the first candidates say of how far all trees must ascend together; fewer than k are all that there are
    least = F.array(*map(F.lit, least_cosines(trees, recall)))
    kth = near.where(F.col("nth") <= k).groupBy("query").agg(F.min("cosine").alias("cosine"))
    enough = F.size(F.filter(least, lambda c: c <= F.col("cosine")))
    up = common.stored(kth.select("query", enough.alias("to")).join(down, "query").where("to < level").select("query", F.col("to").alias("level")))
    if not up.isEmpty():
        # what the first nodes held has been compared
        near = near.unionByName(_nearest(_offered(array, bounds, counts, up, down), entries, centre, n, k + 1))

    own = entries.where("asked").select(F.col("entry").alias("query"), "entry", F.lit(0.0).alias("score"))
    found = near.groupBy("query", "entry").agg(F.min("score").alias("score")).unionByName(own)
    nearest = found.join(entries.select("entry", "ids"), "entry").select("query", F.explode("ids").alias("vec_id"), "score")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    nearest = nearest.withColumn("nth", best).where(F.col("nth") <= k + 1)
    each = queries.join(entries.where("asked").select("v1", "v2", F.col("entry").alias("query")), ["v1", "v2"]).select("query_id", "query")
    hits = each.join(nearest, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
