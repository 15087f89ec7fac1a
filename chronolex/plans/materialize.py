"""Cut lineage with written tables in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from chronolex.session import shared_dir

_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under ``spark.checkpoint.dir`` and read it back.

    The copy survives lost executors, is columnar (later readers prune columns)
    and gives the planner true sizes. It is removed when the driver ends or by
    :func:`drop_materialized`; loops drop the table of a round once the next is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronolex/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_materialized(table: DataFrame | None = None) -> None:
    """Delete a table that :func:`materialize` gave and nothing reads any more; without one, every table of this driver."""
    for path, spark in [(p, s) for p, s in _written.items() if table is None or p == getattr(table, "_written_at", None)]:
        try:
            remove_folder(spark, path)
        except Exception:  # the JVM may be gone already
            pass
        _written.pop(path, None)


atexit.register(drop_materialized)
