"""Near duplicates by SimHash, found with the pigeonring filter.

The 64 bits of a fingerprint lie on a ring of ``distance + 1`` segments. If two fingerprints differ in at
most ``distance`` bits, some segment starts a chain in which, for every length, the first segments together
differ in at most their share of the bits (length * distance / segments, rounded down). With one segment more
than bits allowed to differ, a chain starts with an equal segment, and its second segment differs in at most
one bit. So the keys of a fingerprint are, for each segment and each part of the next one, the fingerprint
with everything masked out but the segment and the other parts of its neighbour: two fingerprints with such a
chain share a key, as one differing bit lies in one part only. Pairs that share a key run through the chain's
further budgets, and those left through the full count of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import extended, free_name, map_batches, sorted_runs, words_of
from driftspark.llm.graph import components
from driftspark.operators.lookup import join_lookup, key_counts
from driftspark.runtime import col, materialize

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
# Parts of a chain's second segment.
PARTS = 3
# Shingles whose bits are counted at once.
BLOCK = 1 << 15
# Fingerprints of one key that one task compares; larger keys are compared block by block.
KEY_BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of the whole text; 0 where it has no words."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits).view(">u8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` and the fingerprint as a signed long in column ``name``."""
    at = docs.columns.index(text)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(x, shingle, seed) for x in batch.column(at).to_pylist()]
        signed = np.array(values, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(signed)], [*batch.schema.names, name]
        )

    return map_batches(docs, add, extended(docs, **{name: "bigint"}))


def segment_masks(distance: int) -> list[int]:
    """Masks of the ring's segments, first segment in the lowest bits."""
    count = distance + 1
    bounds = [BITS * k // count for k in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:], strict=False)]


def chain_keys(distance: int) -> list[tuple[int, int]]:
    """Start segment and mask of each key. At distance 0 the one key is the whole fingerprint."""
    masks = segment_masks(distance)
    if distance == 0:
        return [(0, masks[0])]
    keys = []
    for start in range(len(masks)):
        following = masks[(start + 1) % len(masks)]
        low = (following & -following).bit_length() - 1
        width = following.bit_count()
        bounds = [low + width * k // PARTS for k in range(PARTS + 1)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            keys.append((start, (masks[start] | following) & ~((1 << b) - (1 << a))))
    return keys


def linked(a: np.ndarray, b: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Whether pairs keep the budgets of the chain from ``start``, and then the distance as a whole."""
    masks = segment_masks(distance)
    differing = a ^ b
    kept = np.ones(differing.shape, bool)
    total = np.zeros(differing.shape, np.uint8)
    for length in range(1, len(masks) + 1):
        mask = np.uint64(masks[(start + length - 1) % len(masks)])
        total = total + np.bitwise_count(differing & mask)
        kept &= total <= length * distance // len(masks)
    return kept & (np.bitwise_count(differing) <= distance)


def _spanning(values: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked in one key: at most one for each fingerprint.

    Breadth first: each fingerprint is compared once with those not reached yet.
    """
    left = np.arange(len(values))
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = linked(values[left], values[at], start, distance)
            found = left[hit]
            a.append(values[found])
            b.append(np.full(len(found), values[at]))
            queue.extend(found)
            left = left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(distance: int):
    starts = np.array([start for start, _ in chain_keys(distance)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["idx", "key", "block"]):
            idx = rows["idx"].to_numpy()
            key = rows["key"].to_numpy()
            block = rows["block"].to_numpy()
            value = rows["fp"].to_numpy().view(np.uint64)
            new = np.ones(len(idx), bool)
            new[1:] = (idx[1:] != idx[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(idx)))
            found = []
            # Most keys hold two fingerprints: compare those at once, the others key by key.
            two = first[size == 2]
            for start in np.unique(starts):
                own = two[starts[idx[two]] == start]
                hit = own[linked(value[own], value[own + 1], int(start), distance)]
                found.append((value[hit + 1], value[hit]))
            for at, count in zip(first[size > 2], size[size > 2], strict=True):
                found.append(_spanning(value[at : at + count], int(starts[idx[at]]), distance))
            a = np.concatenate([x for x, _ in found])
            b = np.concatenate([y for _, y in found])
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
                )

    return run


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, key_block: int = KEY_BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) that connect all within ``distance``.

    Not every pair is returned, but each two fingerprints within the distance are joined by a path of
    returned pairs that are all within it. A key with more than ``key_block`` fingerprints is cut into
    blocks, and each pair of blocks is compared in a task of its own.
    """
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("idx"),
                        F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key"),
                    )
                    for n, (_, mask) in enumerate(chain_keys(distance))
                ]
            )
        ).alias("k"),
    ).select("k.idx", "k.key", "fp")
    shared = keyed.groupBy("idx", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(key_block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A block meets each other block and itself: pair (i, j), i <= j, as i * blocks + j.
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda other: F.least(other, own).cast("long") * F.col("blocks") + F.greatest(other, own),
        )
    )
    rows = (
        keyed.join(shared, ["idx", "key"])
        .withColumn("blocks", blocks)
        .select("idx", "key", "fp", F.explode(pairs).alias("block"))
    )
    dealt = rows.repartition("idx", "key", "block").sortWithinPartitions("idx", "key", "block")
    return dealt.mapInArrow(_compare(distance), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``fp`` (long), ``root`` (fingerprint that names the group) and ``component_id`` per row.

    Rows with equal fingerprints, then fingerprints within ``distance`` bits, are linked; ``component_id`` is
    the smallest id of the rows that links reach. Texts that are null, empty or white space have fingerprint
    zero and are linked to each other. Texts of fewer words than ``shingle`` have their whole sequence as one
    shingle. Null ids take part but never name a group (a group of null ids only has a null name). Repeated
    rows each give a row. An empty table gives no rows; other columns are left out.
    """
    narrow = docs.select(
        docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")
    )
    rows = materialize(with_fingerprint(narrow, "text", "fp", shingle, seed).drop("text"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = components(fingerprint_links(nodes.select("fp"), distance))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    named = materialize(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # One row for each fingerprint, so hot fingerprints are split by adaptive execution from the other side.
    members = named.select("fp", "root")
    found = materialize(join_lookup(members, lowest, ["root"], key_counts(members, ["root"]), "fp"), "groups")
    return rows.join(found, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **rules
) -> DataFrame:
    """The rows of ``docs`` that name their group, with all their columns; see ``near_duplicates``.

    Of rows that repeat such an id within one group one is kept, and one of a group of null ids only.
    """
    found = materialize(near_duplicates(docs, id_column, text_column, **rules), "near-duplicates")
    fp, kept_fp, kept_id, group = (free_name(docs, name) for name in ("fp", "kept_fp", "kept_id", "group"))
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = chosen.groupBy(F.col("root").alias(group)).agg(
        F.min("fp").alias(kept_fp), F.first("doc_id").alias(kept_id), F.count(F.lit(1)).alias("rows")
    )
    one = materialize(one, "kept")
    shingle, seed = rules.get("shingle", SHINGLE), rules.get("seed", SEED)
    marked = with_fingerprint(docs, text_column, fp, shingle, seed)
    met = F.col(fp).eqNullSafe(F.col(kept_fp)) & col(id_column).cast("long").eqNullSafe(F.col(kept_id))
    kept = marked.join(one.drop("rows"), met)
    if not one.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates([group])
    return kept.select(*[col(c) for c in docs.columns])
