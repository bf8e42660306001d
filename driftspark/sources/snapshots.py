"""The checksum ledger as snapshots: buckets of Parquet files and numbered manifests that name them.

A manifest lists for each bucket the folder that holds its rows. An upsert writes the buckets it touches to new folders
and then puts a new manifest beside the old ones, by renaming a complete file to a name that must be free. Readers take
the manifest with the highest number, so they see the ledger before or after an upsert and nothing between; a writer
that dies leaves folders that no manifest names, and of two writers at once the later one fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.operators.ledger import ledger_upsert
from driftspark.runtime import materialize

SCHEMA = "dest_path STRING, sha256 STRING, size_bytes BIGINT, mtime_utc STRING"
# Buckets of a new ledger; an upsert of few rows rewrites as many buckets at most.
BUCKETS = 256
_MANIFESTS = "_manifests"


class LedgerConflict(RuntimeError):
    """Another writer has put a manifest under the same number."""


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("dest_path"), F.lit(buckets)).cast("int")


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the latest manifest; None where there is no ledger."""
    store, folder = _store(spark, f"{path}/{_MANIFESTS}")
    if not store.exists(folder):
        return None
    names = [str(status.getPath().getName()) for status in store.listStatus(folder)]
    return max((int(name[:-5]) for name in names if re.fullmatch(r"\d+\.json", name)), default=None)


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """``version``, ``buckets`` and ``folders``, the folder of each bucket that has rows."""
    version = current_version(spark, path) if version is None else version
    if version is None:
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/{_MANIFESTS}/{version:012d}.json").first()[0])


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/{folder}" for folder in folders])


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The ledger, now or at an earlier version whose folders are still there; None where there is none."""
    manifest = read_manifest(spark, path, version)
    return None if manifest is None else _rows(spark, path, sorted(set(manifest["folders"].values())))


def _put_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    store, folder = _store(spark, f"{path}/{_MANIFESTS}")
    store.mkdirs(folder)
    _, target = _store(spark, f"{path}/{_MANIFESTS}/{manifest['version']:012d}.json")
    _, waiting = _store(spark, f"{path}/{_MANIFESTS}/_{uuid.uuid4().hex}")
    out = store.create(waiting, False)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        out.close()
    # A name that is taken is never renamed onto.
    if store.exists(target) or not store.rename(waiting, target):
        store.delete(waiting, False)
        raise LedgerConflict(f"version {manifest['version']} of {path} is taken")


def upsert_snapshot(new: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Put ``new`` rows in place of those of the same paths; returns the version that has them.

    Only buckets that ``new`` touches are read and written. The number of buckets is fixed by the first version.
    """
    spark = new.sparkSession
    before = read_manifest(spark, path) or {"version": -1, "buckets": buckets, "folders": {}}
    own = _bucket(before["buckets"])
    new = materialize(new.select("dest_path", "sha256", "size_bytes", "mtime_utc"), "new-ledger-rows")
    # At most as many as there are buckets.
    touched = [str(row["bucket"]) for row in new.select(own.alias("bucket")).distinct().collect()]
    version = before["version"] + 1
    data = f"data/{version:012d}-{uuid.uuid4().hex}"
    if touched:
        folders = [before["folders"][b] for b in touched if b in before["folders"]]
        merged = ledger_upsert(_rows(spark, path, folders), new)
        merged.withColumn("bucket", own).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{data}")
    after = {
        "version": version,
        "buckets": before["buckets"],
        "folders": before["folders"] | {b: f"{data}/bucket={b}" for b in touched},
    }
    _put_manifest(spark, path, after)
    return version


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Remove folders that the latest manifest does not name; readers of older versions must be done, and no writer at
    work."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return
    kept = set(manifest["folders"].values())
    store, folder = _store(spark, f"{path}/data")
    if not store.exists(folder):
        return
    for written in store.listStatus(folder):
        name = f"data/{written.getPath().getName()}"
        for bucket in store.listStatus(written.getPath()):
            if f"{name}/{bucket.getPath().getName()}" not in kept:
                store.delete(bucket.getPath(), True)
        if not any(place.startswith(f"{name}/") for place in kept):
            store.delete(written.getPath(), True)
