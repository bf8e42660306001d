"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions, racks and shards. At each level every child draws
-ln(u) / weight with u from the hash of key, level and child; the smallest draw wins, so a child gets its share of
the weights. A child's draw depends on nothing but itself: when a weight changes, rows move only into or out of the
subtrees whose weights changed, and a region that is added takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.runtime import col, materialize

# Rows that are numbered together.
BLOCK_ROWS = 100_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def uniform_tree(shards: int, regions: int = 4, racks: int = 3, per_rack: int = 2) -> list[Shard]:
    """A tree of equal shards: first the full regions, then each further shard as a region of its own.

    So the tree of one more shard differs by a new region only. At least one full set of regions is needed.
    """
    base = regions * racks * per_rack
    if shards < base:
        raise ValueError(f"the tree has {base} shards at least")
    tree = [
        Shard(n, n // (racks * per_rack), n // per_rack % racks) for n in range(base)
    ]
    return tree + [Shard(n, regions + n - base, 0) for n in range(base, shards)]


def _draw(key: Column, level: str, path: Sequence[int], weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), *[F.lit(p) for p in path]), 11)
    unit = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / F.lit(float(weight))


def _choose(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; a tie goes to the smaller value."""
    if len(draws) == 1:
        return draws[0][1]
    structs = [F.struct(draw.alias("draw"), value.alias("value")) for draw, value in draws]
    return F.least(*structs)["value"]


def _descend(chosen: Column, values: dict[int, Column]) -> Column:
    branch = None
    for number, value in values.items():
        branch = F.when(chosen == number, value) if branch is None else branch.when(chosen == number, value)
    return branch


def place(key: Column, tree: Sequence[Shard]) -> tuple[Column, Column, Column]:
    """Region, rack and shard of a key. Shards of weight zero get nothing. A null key is a key."""
    used = [s for s in tree if s.weight > 0]

    def weight(shards: list[Shard]) -> float:
        return sum(s.weight for s in shards)

    regions: dict[int, list[Shard]] = {}
    racks: dict[int, dict[int, list[Shard]]] = {}
    for s in sorted(used, key=lambda s: (s.region, s.rack, s.number)):
        regions.setdefault(s.region, []).append(s)
        racks.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    region = _choose([(_draw(key, "region", [r], weight(own)), F.lit(r)) for r, own in regions.items()])
    rack = _descend(
        F.col("region"),
        {
            r: _choose([(_draw(key, "rack", [r, k], weight(s)), F.lit(k)) for k, s in own.items()])
            for r, own in racks.items()
        },
    )
    shard = _descend(
        F.col("region"),
        {
            r: _descend(
                F.col("rack"),
                {
                    k: _choose(
                        [(_draw(key, "shard", [r, k, s.number], s.weight), F.lit(s.number)) for s in shards]
                    )
                    for k, shards in own.items()
                },
            )
            for r, own in racks.items()
        },
    )
    return region, rack, shard


def _placed(rows: DataFrame, tree: Sequence[Shard], name: str) -> DataFrame:
    kept = rows.columns
    region, rack, shard = place(F.col("doc_id"), tree)
    rows = rows.withColumn("region", region).withColumn("rack", rack)
    return rows.select(*kept, shard.alias(name))


def assign(
    docs: DataFrame,
    shards: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    tree: Sequence[Shard] | None = None,
    grown: Sequence[Shard] | None = None,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row.

    The id alone decides (``law`` is ``key``); rows with one id, or none, share a shard, so equal rows stay
    together. A null text has no bytes and the checksum of the empty one. Slots number a shard's rows from 0
    without gaps: rows are counted by blocks of the written table, blocks are summed, and only within a block
    are rows ranked, so a shard that holds most rows is no single task's work. No rows give no rows.
    """
    text = col(text_column).cast("string")
    rows = docs.select(
        col(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = _placed(rows, tree or uniform_tree(shards), "shard")
    rows = _placed(rows, grown or uniform_tree(shards + 1), "grown_shard")
    rows = materialize(rows, "shards")
    blocked = rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("block"),
    )
    counts = blocked.groupBy("shard", "file", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = materialize(
        counts.selectExpr(
            "shard", "file", "block", "sum(n) over (partition by shard order by file, block) - n as first"
        ),
        "offsets",
    )
    within = "row_number() over (partition by shard, file, block order by row) - 1"
    ranked = blocked.selectExpr("*", f"{within} as place")
    return ranked.join(offsets, ["shard", "file", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).alias("slot"),
        "grown_shard",
    )
