"""Operator 13: clustering around centroids by Lloyd rounds that only look at what changed.

Assignments and the global sums of each cluster persist between rounds. A vector whose own centroid stands still is
compared with the centroids that moved and no others: its stored distance holds, and those that stood still were no
nearer before. Only vectors whose own centroid moved are compared with all. The vectors whose owner changed give what
they take from one cluster and bring to another as signed integers; those transfers, not the whole table, are added to
the sums. All numbers are integers, so the sums are exact however the tasks are dealt.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

CLUSTERS, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
#: Components of points are at most so large: a squared distance of 64 components then fits a long, and so does every step towards it.
LARGEST = 1 << 27
#: Rows that one numpy step works on.
ROWS = 1 << 13

STATE = "vec_id long, point array<long>, cluster int, distance long, before int, moved boolean"
TRANSFERS = "cluster int, n long, total array<long>"


def points(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): vectors with exactly `size` finite components, each turned into floor(scale * component); one for each id (the smallest, where an id repeats)."""
    d = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = d.where((F.size("vector") == size) & F.forall("vector", finite))
    repeated = d.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if not repeated.isEmpty():
        d = d.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < LARGEST, F.floor(scaled(x))).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more: squared distances may not fit a long")))
    return d.select("vec_id", F.transform("vector", whole).cast("array<long>").alias("point"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
    """Compare the rows of x with some centroids; cluster and distance hold the best so far, ties go to the smaller number."""
    for k in among:
        d = ((x - centroids[k]) ** 2).sum(1)
        better = (d < distance) | ((d == distance) & (k < cluster))
        cluster[better], distance[better] = k, d[better]


def _assigned(centroids: np.ndarray, moved: np.ndarray):
    """mapInArrow body: rows of STATE from (vec_id, point, cluster, distance); a cluster of -1 is none yet. `moved` tells the centroids that are others than at the last assignment."""
    everyone, some, far = np.arange(len(centroids)), np.flatnonzero(moved), np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x = _matrix(batch.column(1), centroids.shape[1])
                before = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, distance = before.copy(), batch.column(3).to_numpy(zero_copy_only=False).copy()
                lost = (before < 0) | moved[before]
                mine = np.flatnonzero(lost)
                c, d = np.full(len(mine), len(centroids)), np.full(len(mine), far)
                _nearest(x[mine], centroids, everyone, c, d)
                cluster[mine], distance[mine] = c, d
                held = np.flatnonzero(~lost)
                c, d = cluster[held], distance[held]
                _nearest(x[held], centroids, some, c, d)
                cluster[held], distance[held] = c, d
                yield repeats.arrow_rows(STATE, [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(before.astype(np.int32)), pa.array(cluster != before)])

    return run


def _transfers(clusters: int, size: int):
    """mapInArrow body over vectors whose owner changed: what each cluster gains and loses in this task, a row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(clusters, np.int64), np.zeros((clusters, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for sign, column in ((1, 1), (-1, 2)):
                owner = batch.column(column).to_numpy(zero_copy_only=False)
                for k in np.unique(owner[owner >= 0]):
                    rows = owner == k
                    n[k] += sign * rows.sum()
                    total[k] += sign * x[rows].sum(0)
        some = np.flatnonzero((n != 0) | (total != 0).any(1))
        yield repeats.arrow_rows(TRANSFERS, [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))])

    return run


def _stored(spark: SparkSession, state: DataFrame) -> tuple[str, DataFrame]:
    """The state in the shared folder, the vectors whose owner changed apart from the others."""
    path = f"{common.shared_folder(spark)}/lloyd-{uuid.uuid4().hex}"
    state.write.option("compression", "zstd").partitionBy("moved").parquet(path)
    return path, spark.read.schema(STATE).parquet(path)


def cluster(rows: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part.

    rows has vec_id and embedding, other columns are not looked at. Vectors that are null, of another size, or hold null
    or non-finite components take no part, nor do rows without vec_id; of rows that repeat a vec_id the smallest vector
    stays. The first centroids are the vectors whose `1:<vec_id>` has the smallest SHA-256, so fewer vectors than
    clusters make fewer clusters, and equal vectors may start as several: ties go to the smaller number, and a cluster
    that nothing is nearest to keeps its centroid. An empty table gives no rows. A component beyond LARGEST is an error,
    as its squared distance may not fit a long.

    The driver holds the sums and centroids only: `clusters` times `size` integers.
    """
    spark = rows.sparkSession
    d = points(rows, size=size, scale=scale)
    first = d.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["point"] for r in first], np.int64)
    n, sums = [0] * len(first), [[0] * size for _ in first]
    path, state = _stored(spark, d.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")}).mapInArrow(_assigned(centroids, np.ones(len(first), bool)), STATE))
    for _ in range(rounds):
        moves = state.where("moved").select("point", "cluster", "before").mapInArrow(_transfers(len(first), size), TRANSFERS)
        exact = moves.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        gained = exact.collect()  # clusters x size rows at most
        for r in gained:
            sums[r["cluster"]][r["at"]] += int(r["x"])
            n[r["cluster"]] += r["n"] if r["at"] == 0 else 0
        new = np.array([[s // n[k] for s in sums[k]] if n[k] else centroids[k] for k in range(len(first))], np.int64)
        moved = (new != centroids).any(1)
        if not moved.any():
            break
        centroids, before = new, path
        path, state = _stored(spark, state.select("vec_id", "point", "cluster", "distance").mapInArrow(_assigned(centroids, moved), STATE))
        common.forgotten(spark, before)
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v))), F.col("cluster"))
    named = {k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest() for k in inertia}
    return state.select("vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(named).alias("centroid_sha256"))
