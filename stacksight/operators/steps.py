"""Steps of a job that several later steps read: stored once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir: lineage is cut and nothing is computed twice, whatever executors are lost.

    Where neither the setting nor the session names a folder, a local session takes a temporary one; a cluster is
    refused, as its executors share none.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.gettempdir()}/spark-steps-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df with all rows of a key in one task, for a fold.

    Over a union whose sides are both shuffled by the key already, Spark takes repartition(key) for done, and then joins
    small partitions of each side on its own, as a fold states no requirement: rows of a key would come apart. By a hash
    of the key the exchange stays.
    """
    return df.repartition(F.xxhash64(key))
