"""Connected components of an edge list, by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of one partition that are contracted together before the first round. What is left, if it is no more, is contracted in one task.
LOCAL_EDGES = 1 << 18
SCHEMA = "u long, v long"


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        node, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        far = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["u", "v"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if rows:
        node, root = roots(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["doc", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc, component) of every node that has an edge; the component is its smallest node.

    Edges are contracted within their partitions. Up to LOCAL_EDGES that remain, a few megabytes, are finished in one
    task; more go through rounds over all partitions. There, minima are aggregated before they are shuffled and joined back, so that a node with very many edges is no
    group in one task. Each round is checkpointed in the shared folder.
    """
    e = common.checkpointed(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(_contract, SCHEMA))
    if e.count() <= LOCAL_EDGES:
        return e.coalesce(1).mapInArrow(_named, "doc long, component long")
    e = e.distinct()
    while True:
        # a forest of stars: every node has one parent, and no parent has one
        unfinished = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").unionByName(e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi"))
        if unfinished.isEmpty():
            return e.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        e = common.checkpointed(small.where("u <> v").distinct())
