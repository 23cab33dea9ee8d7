"""Counts of what a running plan passes on, by pass, without a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Passes:
    """Metrics that Spark collects while the watched plans run; they can be read once an action on them has ended.

    Each watched DataFrame counts once in a plan: a step that several later ones read is stored first, else its rows would
    be counted as often as they are computed.
    """

    def __init__(self) -> None:
        self.watched: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df, with metrics (aggregates over its rows) told under the name of a pass; a pass may be watched at several steps."""
        seen = Observation(f"{name}-{len(self.watched)}")
        self.watched.append((name, seen))
        return df.observe(seen, *(c.alias(k) for k, c in metrics.items()))

    def told(self) -> list[tuple[str, str, int]]:
        """(pass, metric, value); waits for watched plans that run."""
        return [(name, k, int(v or 0)) for name, seen in self.watched for k, v in seen.get.items()]

    def rollup(self, spark: SparkSession) -> DataFrame:
        """(pass, metric, value): sums by pass and metric, and over all passes under `total`."""
        events = spark.createDataFrame(self.told(), "pass string, metric string, value long")
        by_pass = events.groupBy("pass", "metric").agg(F.sum("value").alias("value"))
        return by_pass.unionByName(events.groupBy("metric").agg(F.sum("value").alias("value")).withColumn("pass", F.lit("total")))


def rows() -> Column:
    """The number of rows, as a metric."""
    return F.count(F.lit(1))
