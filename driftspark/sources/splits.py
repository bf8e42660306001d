"""Split tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.operators.split import SPLITS
from driftspark.sources.tables import CSV_QUOTING


def dataset_name(sport: str, target: str, drop: Sequence[str] = ()) -> str:
    """``{sport}_{target}`` with ``_drop_a_b`` for dropped features."""
    suffix = f"_drop_{'_'.join(drop)}" if drop else ""
    return f"{sport}_{target}{suffix}"


def write_splits(split_rows: DataFrame, path: str) -> None:
    """Parquet, one folder per split; a reader of one split touches no other."""
    split_rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """The season stays text, whatever it looks like. A missing table is an error."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ValueError(f"split table not found: {path}; build the dataset first") from error
        raise


def export_csv(split_rows: DataFrame, path: str, sport: str, target: str, drop: Sequence[str] = ()) -> dict:
    """CSV with header, one folder ``{sport}_{target}_{split}{_drop_a_b}`` per split; returns the paths."""
    written = {}
    for split in SPLITS:
        suffix = f"_drop_{'_'.join(drop)}" if drop else ""
        written[split] = f"{path}/{sport}_{target}_{split}{suffix}"
        (
            split_rows.where(F.col("split") == split)
            .drop("split")
            .write.mode("overwrite")
            .option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .options(**CSV_QUOTING)
            .csv(written[split])
        )
    return written


def read_csv_splits(spark: SparkSession, paths: dict, schema: T.StructType) -> DataFrame:
    """The exported splits as one DataFrame with ``split``, under an explicit schema."""
    result = None
    for split, path in paths.items():
        part = spark.read.schema(schema).option("header", True).option("multiLine", True).options(**CSV_QUOTING)
        part = part.csv(path).withColumn("split", F.lit(split))
        result = part if result is None else result.unionByName(part)
    return result
