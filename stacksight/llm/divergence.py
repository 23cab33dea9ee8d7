"""Operator 11: how the sources of a language differ in their words, by exact integer shares.

Terms are counted once. The `pair` part comes from postings: a term's sources meet in the task that holds the term, and
what they share is summed there pair by pair; terms that only one side of a pair has come from the histogram of that
side's counts, as the other side's share of them is one number; terms that neither has are a product. The `term` part
is a search with upper bounds: the terms of a group lie in buckets by count, whose highest share and lowest share in the
language bound what any of them can reach; buckets are opened in order of their bounds, and a group is done once the
bound of the next one is strictly below its tenth value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, repeats

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Buckets for each doubling of a count.
STEPS = 4
#: Rows of postings that one numpy step works on, and pairs that a task holds before it puts them out.
ROWS, PAIRS = 1 << 16, 1 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
SHARED = "lang string, source string, other string, value long"

#: Bytes of terms, A-Z in lower case; all others end a term.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a batch by lang and source; the term '' stands for the group itself."""
    for batch in batches:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            terms = text.as_py().encode().translate(_TERM).split()
            n.update(terms)
            docs.update(set(terms))
            docs[b""] += 1
        for (lang, source), (n, docs) in groups.items():
            names, rows = list(docs), len(docs)
            yield repeats.arrow_rows(COUNTS, [pa.array([lang] * rows), pa.array([source] * rows), pa.array(names, pa.binary()).cast(pa.string()), pa.array([n[t] for t in names], pa.int64()), pa.array(list(docs.values()), pa.int64())])


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), three decimals at a time, so that no product leaves a long below 9e15 occurrences."""
    whole, rest, out = total + 2 * terms, n + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of all documents, stored; every row of docs is a document."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(_counted, COUNTS)
    return common.stored(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, n_lang, leads): the terms in `least` documents of the language or more; one row of each term of a language leads. A window holds a row for each source."""
    w = Window.partitionBy("lang", "term")
    rows = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("n").over(w).alias("n_lang"), F.sum("docs").over(w).alias("docs"), (F.min("source").over(w) == F.col("source")).alias("leads"))
    return common.stored(rows.where(F.col("docs") >= least).drop("docs"))


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, terms, own, total, total_lang, zero): kept terms of the language and of the group, occurrences, and the share of a term that the group lacks; every group has a row."""
    groups = counts.where("term = ''").select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"), F.count_if("leads").alias("led"))
    rows = groups.join(own, ["lang", "source"], "left").na.fill(0, ["total", "own", "led"])
    langs = rows.groupBy("lang").agg(F.sum("led").alias("terms"), F.sum("total").alias("total_lang"))
    rows = rows.drop("led").join(langs, "lang")
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))
    return common.stored(rows.withColumn("zero", zero))


def rated(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, term, n, p, q, zero): shares in the group and in the language."""
    rows = kept.join(totals, ["lang", "source"])
    return rows.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q"), "zero")


def _ranked(rows: DataFrame, value: str, item: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc(value), item)))


def top_terms(rows: DataFrame, top: int) -> DataFrame:
    """(lang, source, term, value, rank): of each group's terms whose share is above the language's, the `top` that lie farthest from it.

    value rises with p and falls with q where p > q, so a bucket's highest p and lowest q bound it. Each round opens
    twice as many buckets a group as the last; the first opens as many as hold `top` terms.
    """
    key = ["lang", "source", "bucket"]
    rows = common.stored(rows.withColumn("bucket", F.floor(F.log2("n") * STEPS).cast("int")))
    per = rows.groupBy(*key).agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count(F.lit(1)).alias("n")).where("p > q").withColumn("bound", distance(F.col("p"), F.col("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = common.stored(per.select(*key, "bound", F.row_number().over(order).alias("place"), before.alias("before")))
    opened, best, wide = buckets.where(F.col("before") < top), None, 1
    while True:
        opened = common.stored(opened.select(*key, "place"))
        hits = rows.join(opened.drop("place"), key).where("p > q").select("lang", "source", "term", distance(F.col("p"), F.col("q")).alias("value"))
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best = common.stored(_ranked(hits, "value", "term").where(F.col("rank") <= top))
        reach = opened.groupBy("lang", "source").agg(F.max("place").alias("reach"))
        least = best.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("least"))
        rest = buckets.join(reach, ["lang", "source"]).join(least, ["lang", "source"], "left").where("place > reach and bound >= coalesce(least, 0)")
        wide *= 2
        opened = common.stored(rest.where(F.col("place") <= F.col("reach") + wide).select(*key, "place"))
        if opened.isEmpty():
            return best


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over postings (lang, term, source, p, zero) in order of lang, term and source.

    Of two sources that both have a term: how far the true distance is from what the two histograms and the product
    count for it. Sums by pair are put out when PAIRS of them are held.
    """
    names: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        value = np.zeros(len(pair), np.int64)
        np.add.at(value, at, np.concatenate([x for _, x in held]))
        return pair, value

    def out(pair: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        known = list(names)
        a, b = [known[k] for k in pair >> 32], [known[k] for k in pair & 0xFFFFFFFF]
        return repeats.arrow_rows(SHARED, [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(value)])

    def postings(rows: pa.Table) -> None:
        lang, term, source = (rows.column(k).combine_chunks().dictionary_encode() for k in range(3))
        l, s = lang.indices.to_numpy(), source.indices.to_numpy()
        both = np.unique(l.astype(np.int64) << 32 | s, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        code = np.array([names.setdefault((langs[x >> 32], sources[x & 0xFFFFFFFF]), len(names)) for x in both[0].tolist()], np.int64)[both[1]]
        group = l.astype(np.int64) << 32 | term.indices.to_numpy()
        p, zero = (rows.column(k).to_numpy() for k in (3, 4))
        step, at = 1, np.flatnonzero(group[:-1] == group[1:])
        while len(at):
            b = at + step
            value = _apart(p[at], p[b]) - _apart(p[at], zero[b]) - _apart(zero[at], p[b]) + _apart(zero[at], zero[b])
            held.append((code[at] << 32 | code[b], value))
            if sum(len(x) for x, _ in held) > 4 * PAIRS:
                held[:] = [summed()]
            step += 1
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]

    def whole(tables: list[pa.RecordBatch], last: bool) -> tuple[pa.Table, pa.Table]:
        """The rows of whole terms, and those of the term that may go on."""
        rows = pa.Table.from_batches(tables)
        n = rows.num_rows
        if last or not n:
            return rows, rows.slice(n)
        end = (rows.column(0)[n - 1].as_py(), rows.column(1)[n - 1].as_py())
        cut = n
        while cut and rows.column(1)[cut - 1].as_py() == end[1] and rows.column(0)[cut - 1].as_py() == end[0]:
            cut -= 1
        return rows.slice(0, cut), rows.slice(cut)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= ROWS:
            done, rest = whole(waiting, False)
            waiting = rest.combine_chunks().to_batches()
            if done.num_rows:
                postings(done)
                if held:
                    held[:] = [summed()]
                    if len(held[0][0]) > PAIRS:
                        yield out(*held.pop())
    if waiting:
        done, _ = whole(waiting, True)
        postings(done)
    if held:
        yield out(*summed())


def pair_values(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every two sources of a language, by how far their shares of all kept terms lie apart."""
    order = ("lang", "term", "source")
    postings = rows.select(*order, "p", "zero").repartition("lang", "term").sortWithinPartitions(*order)
    one = common.stored(postings.mapInArrow(_shared, SHARED).groupBy("lang", "source", "other").agg(F.sum("value").alias("shared")))
    shared = one.unionByName(one.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "shared"))
    zeros = totals.groupBy("lang").agg(F.collect_set("zero").alias("zeros"))
    histogram = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    alone = histogram.join(zeros, "lang").select("lang", "source", "p", "m", F.explode("zeros").alias("zero"))
    alone = common.stored(alone.groupBy("lang", "source", "zero").agg(F.sum(distance(F.col("p"), F.col("zero")) * F.col("m")).alias("alone")))
    a = totals.select("lang", "source", "terms", F.col("own").alias("own_a"), F.col("zero").alias("zero_a"))
    b = totals.select("lang", F.col("source").alias("other"), F.col("own").alias("own_b"), F.col("zero").alias("zero_b"))
    pairs = a.join(b, "lang").where("source <> other")
    pairs = pairs.join(alone.select("lang", "source", F.col("zero").alias("zero_b"), F.col("alone").alias("of_a")), ["lang", "source", "zero_b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_a"), F.col("alone").alias("of_b")), ["lang", "other", "zero_a"], "left")
    pairs = pairs.join(shared, ["lang", "source", "other"], "left")
    neither = (F.col("terms") - F.col("own_a") - F.col("own_b")) * distance(F.col("zero_a"), F.col("zero_b"))
    value = reduce(lambda x, c: x + F.coalesce(c, F.lit(0)), ("of_a", "of_b", "shared"), F.coalesce(neither, F.lit(0)))
    return _ranked(pairs.select("lang", "source", F.col("other").alias("item"), value.alias("value")), "value", "item")


def audit(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows tell how far each other source of the language lies away, `term` rows the terms that a source has more of than its language.

    docs has text, lang and source; null is '' in each, other columns are not looked at. Every row is a document, so
    repeated rows count each time. A language without a term in `least` documents has pair rows of value 0 and no term
    rows; a group without terms has pair rows. Equal values are in order of the item's UTF-8 bytes. A text is counted
    whole, however long. An empty table gives no rows.
    """

    def make() -> DataFrame:
        counts = term_counts(docs)
        kept = kept_terms(counts, least)
        totals = group_totals(counts, kept)
        rows = rated(kept, totals)
        terms = top_terms(rows, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
        pairs = pair_values(rows, totals).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        return pairs.unionByName(terms)

    return common.outcome(make)
