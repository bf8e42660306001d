"""Inventory of stored files with content hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.text import is_safe_path
from driftspark.runtime import materialize, shuffle_tasks

# Fixed value: block size of the streamed hash.
HASH_BLOCK = 1024 * 1024
# What opening a file costs a task, in bytes it could read meanwhile.
FILE_COST = 64 * 1024
# Groups of files whose totals one window adds up.
GROUPS = 1024

INVENTORY_SCHEMA = "dest_path STRING, sha256 STRING, size_bytes BIGINT, mtime_utc STRING"

PLACE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?"
# Scheme names of the JVM that differ from those of the Python file systems.
_SCHEMES = {"s3a:": "s3:", "s3n:": "s3:"}


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def locate(root: str):
    """File system and base path of ``root``; only scheme and host form a URI."""
    from pyarrow import fs

    scheme, host = re.match(PLACE, root).groups()
    scheme = _SCHEMES.get(scheme, scheme or "file:")
    system, base = fs.FileSystem.from_uri(f"{scheme}{host or '//'}/")
    return system, base.rstrip("/") + re.sub(PLACE, "", root).rstrip("/") + "/"


def _stat_files(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = locate(root)
        for batch in batches:
            found = []
            for dest_path, info in zip(
                batch["dest_path"], system.get_file_info([base + p for p in batch["dest_path"]]), strict=True
            ):
                if info.type == fs.FileType.File:
                    stamp = info.mtime.strftime("%Y-%m-%dT%H:%M:%SZ") if info.mtime else None
                    found.append((dest_path, info.size, stamp))
            yield pd.DataFrame(found, columns=["dest_path", "size_bytes", "mtime_utc"])

    return run


def file_stats(paths: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``dest_path, size_bytes, mtime_utc`` of those ``paths`` that are files below ``root``; no file is opened.

    Only paths someone asks about are looked up, in the tasks, so no folder is listed on the driver. The number of
    tasks is given, because paths are a few bytes each and adaptive execution would put them all into one. Paths that
    leave ``root`` are never looked up.
    """
    wanted = paths.select("dest_path").where(is_safe_path(F.col("dest_path"))).distinct()
    spread = wanted.repartition(tasks or shuffle_tasks(paths.sparkSession), "dest_path")
    return spread.mapInPandas(_stat_files(root), "dest_path STRING, size_bytes BIGINT, mtime_utc STRING")


def dealt_by_bytes(stats: DataFrame, tasks: int) -> DataFrame:
    """``stats`` in ``tasks`` partitions of about equal bytes; ``stats`` is read twice, so it should be written.

    Files stand in a line of hash groups; a file goes to the task in whose equal share of all bytes its middle lies.
    The running sum is taken within a group and from the totals of the groups before, which are few.
    """
    weight = F.col("size_bytes") + FILE_COST
    grouped = stats.withColumn("_group", F.pmod(F.xxhash64("dest_path"), F.lit(GROUPS)).cast("int"))
    totals = grouped.groupBy("_group").agg(F.sum(weight).alias("_bytes"))
    # As many rows as groups.
    line = Window.orderBy("_group")
    before = totals.select(
        "_group",
        (F.sum("_bytes").over(line) - F.col("_bytes")).alias("_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    within = Window.partitionBy("_group").orderBy("dest_path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum(weight).over(within) - weight / 2
    task = F.least(F.floor(middle * tasks / F.col("_all")), F.lit(tasks - 1)).cast("int")
    placed = grouped.join(F.broadcast(before), "_group").withColumn("_task", task)
    return placed.repartitionById(tasks, "_task").select(*stats.columns)


def _hash_files(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(root)
        for batch in batches:
            hashes = []
            for dest_path in batch["dest_path"]:
                digest = hashlib.sha256()
                try:
                    with system.open_input_stream(base + dest_path) as stream:
                        while block := stream.read(HASH_BLOCK):
                            digest.update(block)
                except FileNotFoundError:
                    hashes.append(None)
                    continue
                hashes.append(digest.hexdigest())
            found = batch.assign(sha256=hashes)
            yield found.loc[found["sha256"].notna(), ["dest_path", "sha256", "size_bytes", "mtime_utc"]]

    return run


def hash_files(stats: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``dest_path, sha256, size_bytes, mtime_utc`` of the files of ``stats`` (see ``file_stats``).

    Files are read block by block, so their size does not matter to memory, and are dealt to the tasks by bytes. A file
    that is gone since has no row.
    """
    dealt = dealt_by_bytes(stats, tasks or shuffle_tasks(stats.sparkSession))
    return dealt.mapInPandas(_hash_files(root), INVENTORY_SCHEMA)


def file_inventory(paths: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """``dest_path, sha256, size_bytes, mtime_utc`` of those ``paths`` that are files below ``root``.

    Sizes come first, so that hashing can be dealt by them; see ``file_stats`` and ``hash_files``.
    """
    return hash_files(materialize(file_stats(paths, root, tasks), "stats"), root, tasks)


def _write_files(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(root)
        for batch in batches:
            for dest_path, content in zip(batch["dest_path"], batch["content"], strict=True):
                system.create_dir((base + dest_path).rpartition("/")[0], recursive=True)
                with system.open_output_stream(base + dest_path) as stream:
                    stream.write(content)
            yield batch[["dest_path"]]

    return run


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` (binary) to ``dest_path`` below ``root``, each in the task that has the row.

    Returns the paths; nothing is written before an action runs. A repeated task writes the same file again.
    Unsafe paths are left out. ``root`` must be a store that all executors share.
    """
    safe = rows.where(is_safe_path(F.col("dest_path"))).select("dest_path", "content")
    return safe.mapInPandas(_write_files(root), "dest_path STRING")
