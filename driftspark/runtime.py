"""Small helpers every job shares: quoting, shared scratch folder, materializing."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its literal name; names such as ``3p_pct`` or ``a.b`` need quoting."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever the case of its letters."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or where that is unset a folder in the
    warehouse, which all executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared one; it goes when the driver ends or calls ``release``."""
    return f"{shared_dir(spark)}/driftspark-{spark.sparkContext.applicationId}"


_written: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that read them must be done."""
    remove(spark, scratch_dir(spark))


def _release_at_exit() -> None:
    if SparkContext._active_spark_context is None:  # stopped: its store can no longer be asked
        return
    spark = SparkSession.getActiveSession()
    if spark is not None and scratch_dir(spark) in _written:
        release(spark)


atexit.register(_release_at_exit)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and filter pushdown for the
    jobs that follow (a row checkpoint would not).
    """
    spark = df.sparkSession
    _written.add(scratch_dir(spark))
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks for work whose cost its input size does not show, such as rows that expand or name files.

    Given as a number to ``repartition``, it is not coalesced by adaptive execution.
    """
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
