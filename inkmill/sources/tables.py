"""Reading the tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``; a file and a folder of part files read alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows over at least as many partitions as the cluster has cores.

    A table of many files already has more splits than cores and passes unchanged, so at scale this adds no
    shuffle; a single small file would otherwise run in one task. What has been shuffled passes unchanged, too: counting
    its partitions would run it.
    """
    want = partitions or df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
