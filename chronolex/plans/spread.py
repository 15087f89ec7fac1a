"""Use all cores on inputs of fewer splits than cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, hashed by ``key`` if its scan has fewer partitions than the cluster has cores.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
