"""Tables a run leaves behind, and the ledger a run starts from."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions.text import safe_name
from driftspark.sources.snapshots import read_snapshot

# Error conditions of a missing or corrupt table.
_UNREADABLE = (
    "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN", "CANNOT_READ_FILE_FOOTER",
    "FAILED_READ_FILE",
)

LEDGER_SCHEMA = "dest_path STRING, sha256 STRING, size_bytes BIGINT, mtime_utc STRING"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, or an empty one where there is none yet or it cannot be read; ``path`` may hold snapshots."""
    kept = read_snapshot(spark, path)
    if kept is not None:
        return kept
    try:
        return spark.read.parquet(path).select("dest_path", "sha256", "size_bytes", "mtime_utc")
    except Exception as error:
        # Any other failure, such as lost storage, must not pass for an empty ledger.
        if not any(sign in str(error) for sign in _UNREADABLE):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def require_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger for the gate: None where it is lost or corrupt, which an empty ledger is not."""
    kept = read_snapshot(spark, path)
    if kept is not None:
        return kept
    try:
        return spark.read.parquet(path).select("dest_path", "sha256", "size_bytes", "mtime_utc")
    except Exception as error:
        if not any(sign in str(error) for sign in _UNREADABLE):
            raise
        return None


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Write to a path other than the one the ledger was read from; Spark commits it as a whole.

    ``snapshots.upsert_snapshot`` writes where it reads, and only what changes.
    """
    ledger.write.mode("overwrite").parquet(path)


def run_folder(out: str, source: str, ref: str, fingerprint: str) -> str:
    """Folder of a run; characters of the reference that could leave or nest the folder become ``_``."""
    name = safe_name(ref)
    return f"{out}/{source}/{name if name.strip('.') else '_' * max(len(name), 1)}/{fingerprint}"


def write_artifacts(tables: Mapping[str, DataFrame], path: str, run_id: str) -> None:
    """Write each table under its name into the folder of its run, which prunes scans.

    A run that is repeated replaces what it wrote before; other runs stay.
    """
    for name, table in tables.items():
        (
            table.withColumn("run_id", F.lit(run_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(f"{path}/{name}")
        )


def read_artifact(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    table = spark.read.parquet(f"{path}/{name}")
    return table if run_id is None else table.where(F.col("run_id") == run_id)


def audit_line(base: Mapping[str, Column], extras: Column) -> Column:
    """One event as JSON with sorted keys: base fields, ``ts_utc, phase, msg, level`` and extras."""
    entries = [x for name, value in base.items() for x in (F.lit(name), value)]
    fields = F.map_filter(
        F.map_concat(F.map_filter(F.create_map(*entries), lambda k, _: ~F.map_contains_key(extras, k)), extras),
        lambda _, value: value.isNotNull(),
    )
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def write_audit(events: DataFrame, path: str) -> None:
    """Append JSON lines; ``events`` has the column ``line``."""
    events.select("line").write.mode("append").text(path)
