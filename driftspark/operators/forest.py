"""Random forests grown level by level from compact blocks of binned rows.

The forest is the one that Spark ML's trainer grows from the same partitions and settings: the same thresholds, the
same bootstrap (drawn by Spark itself), the same features tried at each node, the same choice among equal gains. What
differs is what it costs. Spark's trainer keeps for each row and tree a count and up to three generations of node ids,
four bytes each and spilled to disk where memory ends, and each of its tasks ships dense double statistics of all nodes.
Here a row keeps a byte per feature and per tree; its nodes are found again by walking the trees, a vector of rows at a
time; statistics travel tree by tree in the narrowest type that holds them exactly.

Sums of targets that are whole numbers, or halves or quarters of them, are exact. Others may differ in the last place, as
they do in Spark, whose order of summing follows its shuffles too, and with them the choice between splits that part the
rows of a node alike.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from driftspark.runtime import col

# Rows that a task gathers before it goes through the trees: bounds its memory, whatever the size of its partition.
BLOCK_ROWS = 262_144
# Rows that are looked at together: their arrays stay in the processor's cache.
CHUNK_ROWS = 32_768
# Rows that are worth a task of their own in a pass, and bytes of statistics that are worth one that chooses splits.
PASS_ROWS = 1_000
CHOOSING_BYTES = 4 << 20
# Tasks that add up statistics and choose splits, each for some of the trees, are no more than these.
CHOOSING_TASKS = 64
# Rows from which thresholds are taken, or the square of the number of bins if that is more: Spark's own number.
SPLIT_SAMPLE = 10_000

_INVALID = -np.finfo(float).max  # gain of a split that may not be made, as in Spark
_EPSILON = np.finfo(float).eps  # an impurity below is none, as in Spark


# --- random numbers as Spark draws them ----------------------------------------------------------


class JavaRandom:
    """``java.util.Random``, as far as it is needed here."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next32(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> 16
        return value - (1 << 32) if value >> 31 else value

    def next_long(self) -> int:
        value = ((self._next32() << 32) + self._next32()) & ((1 << 64) - 1)
        return value - (1 << 64) if value >> 63 else value


def _murmur3(longs: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Scala's hash of the eight bytes of each number, most significant first."""
    mask = np.uint64(0xFFFFFFFF)

    def times(a: np.ndarray, b: int) -> np.ndarray:
        return (a * np.uint64(b)) & mask

    def turned(a: np.ndarray, by: int) -> np.ndarray:
        return ((a << np.uint64(by)) | (a >> np.uint64(32 - by))) & mask

    words = longs.astype(">i8").view(np.uint8).reshape(-1, 2, 4).copy().view("<u4")[..., 0].astype(np.uint64)
    h = seed.astype(np.uint64)
    for i in range(2):
        k = times(turned(times(words[:, i], 0xCC9E2D51), 15), 0x1B873593)
        h = (times(turned(h ^ k, 13), 5) + np.uint64(0xE6546B64)) & mask
    h = h ^ np.uint64(8)
    h = times(h ^ (h >> np.uint64(16)), 0x85EBCA6B)
    h = times(h ^ (h >> np.uint64(13)), 0xC2B2AE35)
    return h ^ (h >> np.uint64(16))


def feature_subsets(seeds: Sequence[int], n_features: int, k: int) -> np.ndarray:
    """For each seed the ``k`` features that Spark's reservoir sample keeps, in its order."""
    longs = np.array(seeds, np.int64)
    low = _murmur3(longs, np.full(len(longs), 0x3C074A61, np.uint64))
    state = (_murmur3(longs, low) << np.uint64(32)) | low

    def bits(n: int) -> np.ndarray:
        nonlocal state
        state = state ^ (state << np.uint64(21))
        state = state ^ (state >> np.uint64(35))
        state = state ^ (state << np.uint64(4))
        return (state & np.uint64((1 << n) - 1)).astype(np.int64)

    kept = np.tile(np.arange(k), (len(longs), 1))
    for item in range(k, n_features):
        drawn = ((bits(26) << 27) + bits(27)) * 2.0**-53
        at = (drawn * (item + 1)).astype(np.int64)
        hit = at < k
        kept[hit, at[hit]] = item
    return kept


# --- thresholds and blocks -----------------------------------------------------------------------


def thresholds_of(values: np.ndarray, counts: np.ndarray, sampled: float, n_splits: int) -> list[float]:
    """Spark's thresholds of a feature from its values other than zero and their counts; the other rows of the expected
    ``sampled`` ones are zeros."""
    if not len(values):
        return []
    zeros = sampled - counts.sum()
    if zeros > _EPSILON * counts.sum() * 100:
        values, counts = np.append(values, 0.0), np.append(counts, zeros)
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= n_splits:
        return middles.tolist()
    stride = sampled / (n_splits + 1)
    found, seen, target = [], counts[0], stride
    for at, count in enumerate(counts[1:].tolist()):
        before, seen = seen, seen + count
        if abs(before - target) < abs(seen - target):
            found.append(float(middles[at]))
            target += stride
    return found


def _thresholds(rows: DataFrame, features: Sequence[str], n_rows: int, max_bins: int, seed: int) -> list[list[float]]:
    """Thresholds of each feature from the rows that Spark's trainer would sample; the driver sees only thresholds."""
    spark = rows.sparkSession
    jvm = spark._jvm
    max_bins = min(max_bins, n_rows)
    wanted = max(max_bins * max_bins, SPLIT_SAMPLE)
    fraction = wanted / n_rows if wanted < n_rows else 1.0
    n_splits = max_bins - 1
    plain = rows.select(*[col(name).cast("double").alias(f"f{i}") for i, name in enumerate(features)])
    if fraction < 1:
        drawn = jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sampled = plain._jdf.toJavaRDD().sample(False, fraction, drawn)
        plain = DataFrame(spark._jsparkSession.createDataFrame(sampled, plain._jdf.schema()), spark)
    values = plain.select(F.posexplode(F.array(*plain.columns)).alias("feature", "value"))
    counted = values.where("value != 0").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    expected = fraction * n_rows

    def choose(table: pa.Table) -> pa.Table:
        found = thresholds_of(table["value"].to_numpy(), table["n"].to_numpy().astype(float), expected, n_splits)
        return pa.table({"feature": pa.array([table["feature"][0].as_py()], pa.int32()), "thresholds": pa.array([found], pa.list_(pa.float64()))})

    chosen = counted.groupBy("feature").applyInArrow(choose, "feature int, thresholds array<double>").collect()
    found = {row["feature"]: row["thresholds"] for row in chosen}
    return [list(found.get(i, [])) for i in range(len(features))]


def _binned(thresholds: list[list[float]], n_classes: int) -> Callable:
    """Of each row its label and the bins of its features, as a binary value of fixed length."""
    cuts = [np.array(one) for one in thresholds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            if not np.isfinite(values).all():
                raise ValueError("features and target must be numbers")
            label = values[:, -1]
            if n_classes and not ((label == np.floor(label)) & (label >= 0) & (label < n_classes)).all():
                raise ValueError(f"classes must be whole numbers from 0 to {n_classes - 1}")
            packed = np.empty((len(values), 8 + len(cuts)), np.uint8)
            packed[:, :8] = label.astype("<f8").view(np.uint8).reshape(-1, 8)
            for i, cut in enumerate(cuts):
                packed[:, 8 + i] = np.searchsorted(cut, values[:, i], side="left")
            ends = np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([column], ["packed"])

    return run


def _java_bytes(jvm, value) -> bytes:
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.java.io.ObjectOutputStream(out)
    stream.writeObject(value)
    stream.flush()
    return bytes(out.toByteArray())


def _layout(spark, width: int, trees: int) -> tuple[int, int]:
    """Where a serialized bagged row holds its packed value and its counts: all such rows have one layout."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    marks = bytes((7 * i + 1) % 256 for i in range(width))
    counts = gateway.new_array(gateway.jvm.int, trees)
    for i in range(trees):
        counts[i] = 0x5A000000 + 31 * i
    sample = _java_bytes(jvm, jvm.org.apache.spark.ml.tree.impl.BaggedPoint(bytearray(marks), counts, 1.0))
    pattern = b"".join(struct.pack(">i", 0x5A000000 + 31 * i) for i in range(trees))
    if sample.count(marks) != 1 or sample.count(pattern) != 1:
        raise RuntimeError("unknown layout of Spark's bagged rows")
    return sample.index(marks), sample.index(pattern)


def _unpacked(width: int, trees: int, packed_at: int, counts_at: int) -> Callable:
    """Blocks of rows from serialized bagged rows: labels, bins by row, counts by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            length = int(ends[1] - ends[0])
            if (np.diff(ends) != length).any():
                raise RuntimeError("bagged rows differ in length")
            rows = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, length)
            # The last byte of each of four: Spark draws by a mean of one, far below 256.
            counts = np.ascontiguousarray(rows[:, counts_at + 3 : counts_at + 4 * trees : 4].T)
            label = rows[:, packed_at : packed_at + 8].tobytes()
            bins = rows[:, packed_at + 8 : packed_at + width].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([value], pa.binary()) for value in (label, bins, counts.tobytes())], ["label", "bins", "counts"]
            )

    return run


def _blocks(rows: DataFrame, features: Sequence[str], target: str, thresholds: list[list[float]], n_classes: int, trees: int, seed: int) -> DataFrame:
    """Rows with their bootstrap counts, drawn by Spark's own bagging from the partitions and the order of ``rows``."""
    spark = rows.sparkSession
    jvm = spark._jvm
    impl = jvm.org.apache.spark.ml.tree.impl
    columns = [col(name).cast("double") for name in [*features, target]]
    packed = rows.select(*columns).mapInArrow(_binned(thresholds, n_classes), "packed binary")
    values = getattr(packed._jdf, "as")(jvm.org.apache.spark.sql.Encoders.BINARY()).rdd()
    weight = getattr(impl.BaggedPoint, "convertToBaggedRDD$default$5")()
    bagged = impl.BaggedPoint.convertToBaggedRDD(values, 1.0, trees, True, weight, seed)
    kind = jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint", True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    encoder = jvm.org.apache.spark.sql.Encoders.javaSerialization(kind)
    serialized = DataFrame(spark._jsparkSession.createDataset(bagged, encoder).toDF(), spark)
    width = 8 + len(features)
    unpacked = _unpacked(width, trees, *_layout(spark, width, trees))
    return serialized.mapInArrow(unpacked, "label binary, bins binary, counts binary")


# --- statistics of nodes -------------------------------------------------------------------------


@dataclass(frozen=True)
class Walk:
    """What a task has to know of a tree: how to reach its nodes, and which of them are to be split now."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    slot: np.ndarray  # place among the nodes to split, or -1
    steps: int
    tried: np.ndarray  # features tried at each of these
    impurity: np.ndarray  # of each of these; NaN where it is not known yet


def _encoded(planes: np.ndarray) -> bytes:
    """Planes of statistics, each in the narrowest type that holds it exactly."""
    parts = []
    for plane in planes:
        kind = np.dtype("<f8")
        if (plane == np.rint(plane)).all():
            low, high = plane.min(), plane.max()
            for code in ("u1", "<i2", "<i4"):
                if np.iinfo(code).min <= low and high <= np.iinfo(code).max:
                    kind = np.dtype(code)
                    break
        parts.append(bytes([kind.itemsize]) + plane.astype(kind).tobytes())
    return b"".join(parts)


_KINDS = {1: np.dtype("u1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


def _add_encoded(total: np.ndarray, data: bytes) -> None:
    at, size = 0, total[0].size
    for plane in total:
        kind = _KINDS[data[at]]
        plane += np.frombuffer(data, kind, size, at + 1).reshape(plane.shape)
        at += 1 + size * kind.itemsize


def _tree_statistics(walk: Walk, label: np.ndarray, bins: np.ndarray, counts: np.ndarray, n_bins: int, n_classes: int) -> np.ndarray:
    """Statistics of a tree's nodes over a block: by plane, tried feature, node and bin. The planes are classes, or
    weight, weighted target and its square."""
    feature, left, slots = (a.astype(np.intp) for a in (walk.feature, walk.left, walk.slot))
    nodes, n_tried = walk.tried.shape
    n_features = bins.shape[1]
    flat = bins.ravel()
    same = bool((walk.tried == walk.tried[0]).all())
    tried = walk.tried.astype(np.intp)
    total = np.zeros((n_classes or 3, n_tried, nodes, n_bins))
    drawn = np.flatnonzero(counts)
    for start in range(0, len(drawn), CHUNK_ROWS):
        rows = drawn[start : start + CHUNK_ROWS]
        base = rows * n_features
        node = np.zeros(len(rows), np.intp)
        for _ in range(walk.steps):
            right = flat.take(base + feature.take(node)) > walk.bin.take(node)
            node = left.take(node)
            node += right
        slot = slots.take(node)
        if walk.steps and slot.min() < 0:
            inside = np.flatnonzero(slot >= 0)
            rows, base, slot = rows[inside], base[inside], slot[inside]
        if not len(rows):
            continue
        weight = counts.take(rows).astype(float)
        target = label.take(rows)
        if n_classes:
            cell = slot * n_bins + target.astype(np.intp) * (nodes * n_bins)
            planes = [weight]
        else:
            cell = slot * n_bins
            planes = [weight, weight * target, weight * target * target]
        for j in range(n_tried):
            at = base + (tried[0, j] if same else tried[:, j].take(slot))
            key = cell + flat.take(at)
            if n_classes:
                total[:, j] += np.bincount(key, weight, n_classes * nodes * n_bins).reshape(n_classes, nodes, n_bins)
            else:
                for i, plane in enumerate(planes):
                    total[i, j] += np.bincount(key, plane, nodes * n_bins).reshape(nodes, n_bins)
    return total


def _statistics(shared, n_features: int, trees: int, n_bins: int, n_classes: int) -> Callable:
    def of_block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        label, bins = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        counts = np.concatenate([p[2] for p in parts], axis=1)
        for tree, walk in shared.value.items():
            found = _tree_statistics(walk, label, bins, counts[tree], n_bins, n_classes)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([_encoded(found)], pa.binary())], ["tree", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                label = np.frombuffer(row["label"], "<f8")
                bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features)
                parts.append((label, bins, np.frombuffer(row["counts"], np.uint8).reshape(trees, -1)))
                n += len(label)
                if n >= BLOCK_ROWS:
                    yield from of_block(parts)
                    parts, n = [], 0
        if parts:
            yield from of_block(parts)

    return run


def _counted(stats: np.ndarray, n_classes: int) -> np.ndarray:
    return sum(stats[1:], stats[0].copy()) if n_classes else stats[0]


def _impurity(stats: np.ndarray, n_classes: int) -> np.ndarray:
    """Gini impurity or variance along the first axis, by Spark's operations in Spark's order; 0 of nothing."""
    n = _counted(stats, n_classes)
    some = np.where(n == 0, 1.0, n)
    if n_classes:
        found = np.ones(n.shape)
        for plane in stats:
            share = plane / some
            found = found - share * share
    else:
        found = (stats[2] - stats[1] * stats[1] / some) / some
    return np.where(n == 0, 0.0, found)


def best_splits(total: np.ndarray, walk: Walk, n_splits: np.ndarray, n_classes: int) -> np.ndarray:
    """A row for each node: feature, split, gain, impurity, statistics of the node, of its left and its right child."""
    planes, n_tried, nodes, n_bins = total.shape
    cumulated = np.cumsum(total, axis=3)
    left, whole = cumulated[..., :-1], cumulated[..., -1:]
    right = whole - left
    usable = n_splits[walk.tried.T]  # by tried feature and node
    first = np.argmax(usable > 0, axis=0)
    at = np.arange(nodes)
    own = whole[:, 0, :, 0]
    if n_bins > 1:
        own = np.where(usable[first, at] > 0, left[:, first, at, 0] + right[:, first, at, 0], own)
    impurity = np.where(np.isnan(walk.impurity), _impurity(own, n_classes), walk.impurity)
    result = np.full((nodes, 4 + 3 * planes), np.nan)
    result[:, 0], result[:, 1], result[:, 2], result[:, 3] = walk.tried[:, 0], 0, _INVALID, impurity
    result[:, 4 : 4 + planes] = own.T
    if n_bins == 1:
        return result
    n_left, n_right = _counted(left, n_classes), _counted(right, n_classes)
    n = n_left + n_right
    some = np.where(n == 0, 1.0, n)
    gain = impurity[None, :, None] - n_left / some * _impurity(left, n_classes) - n_right / some * _impurity(right, n_classes)
    gain = np.where((n_left >= 1) & (n_right >= 1) & (gain >= 0), gain, _INVALID)
    gain = np.where(np.arange(n_bins - 1) < usable[..., None], gain, -np.inf)
    split = gain.argmax(axis=2)  # the first of equal gains
    by_feature = np.take_along_axis(gain, split[..., None], axis=2)[..., 0]
    best = by_feature.argmax(axis=0)
    chosen = split[best, at]
    found = by_feature[best, at] > -np.inf
    result[found, 0] = walk.tried[at, best][found]
    result[found, 1] = chosen[found]
    result[found, 2] = by_feature[best, at][found]
    result[:, 4 + planes : 4 + 2 * planes] = left[:, best, at, chosen].T
    result[:, 4 + 2 * planes :] = right[:, best, at, chosen].T
    return result


def _choices(shared, n_splits: np.ndarray, n_bins: int, n_classes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if tree not in totals:
                    nodes, n_tried = shared.value[tree].tried.shape
                    totals[tree] = np.zeros((n_classes or 3, n_tried, nodes, n_bins))
                _add_encoded(totals[tree], memoryview(data.as_buffer()))
        for tree, total in totals.items():
            found = best_splits(total, shared.value[tree], n_splits, n_classes)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["tree", "data"])

    return run


# --- growing -------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made; the children of a node stand side by side."""

    planes: int
    depth: list[int] = field(default_factory=lambda: [0])
    feature: list[int] = field(default_factory=lambda: [0])
    split: list[int] = field(default_factory=lambda: [255])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    impurity: list[float] = field(default_factory=lambda: [math.nan])
    valid: list[bool] = field(default_factory=lambda: [True])
    stats: list[tuple] = field(default_factory=lambda: [()])

    def child(self, stats: tuple, impurity: float, depth: int) -> int:
        at = len(self.left)
        self.depth.append(depth)
        self.feature.append(0)
        self.split.append(255)  # no bin is above: rows stay
        self.left.append(at)
        self.gain.append(0.0)
        self.impurity.append(impurity)
        self.valid.append(True)
        self.stats.append(stats)
        return at

    def walk(self, nodes: list[int], tried: np.ndarray) -> Walk:
        slot = np.full(len(self.left), -1, np.int32)
        slot[nodes] = np.arange(len(nodes))
        return Walk(
            np.array(self.feature, np.int32), np.array(self.split, np.uint8), np.array(self.left, np.int32), slot,
            max(self.depth[node] for node in nodes), tried.astype(np.int32), np.array([self.impurity[node] for node in nodes]),
        )

    def apply(self, nodes: list[int], found: np.ndarray, max_depth: int, n_classes: int) -> list[int]:
        """Split ``nodes`` as found; the children that may be split further."""
        p = self.planes
        children = [_impurity(found[:, 4 + p * i : 4 + p * (i + 1)].T, n_classes).tolist() for i in (1, 2)]
        further = []
        for at, (node, row) in enumerate(zip(nodes, found.tolist())):
            gain = row[2]
            self.impurity[node], self.gain[node], self.valid[node] = row[3], gain, gain != _INVALID
            if not self.stats[node]:
                self.stats[node] = tuple(row[4 : 4 + p])
            if gain <= 0 or self.depth[node] == max_depth:
                continue
            self.feature[node], self.split[node] = int(row[0]), int(row[1])
            depth = self.depth[node] + 1
            for side in (0, 1):
                impurity = children[side][at]
                made = self.child(tuple(row[4 + p * (side + 1) : 4 + p * (side + 2)]), impurity, depth)
                if side == 0:
                    self.left[node] = made
                if depth < max_depth and not abs(impurity) < _EPSILON:
                    further.append(made)
        return further


def _map_order(jvm, keys: list[int]) -> list[int]:
    """The order in which Spark goes through the trees of a pass: that of a Scala map, which ``keys`` came into in this
    order. Which features the nodes of the next pass try depends on it."""
    first = jvm.scala.collection.mutable.HashMap()
    for key in keys:
        first.put(key, key)
    refl = getattr(getattr(jvm.scala, "$less$colon$less$"), "MODULE$").refl()
    return [int(key) for key in first.toMap(refl).keysIterator().mkString(",").split(",")]


def _next_group(
    stack: list[tuple[int, int]], rnd: JavaRandom, n_features: int, n_tried: int, n_bins: np.ndarray, planes: int, memory: int
) -> dict[int, tuple[list[int], np.ndarray]]:
    """Take from the stack what fits into the memory of a pass, with the features that each node tries."""
    if n_tried < n_features:
        seeds, states = [], []
        for _ in stack:
            seeds.append(rnd.next_long())
            states.append(rnd.state)
        tried = feature_subsets(seeds, n_features, n_tried)
    else:
        tried = np.broadcast_to(np.arange(n_features), (len(stack), n_features))
    used = np.cumsum(n_bins[tried].sum(axis=1) * planes * 8)
    over = np.flatnonzero(used > memory)
    over = over[over > 0]
    taken = int(over[0]) if len(over) else len(stack)
    if n_tried < n_features and taken < len(stack):
        rnd.state = states[taken]  # Spark draws once for the node that does not fit, and draws again for it later
    group: dict[int, tuple[list[int], list[int]]] = {}
    for at in range(taken):
        tree, node = stack.pop()
        nodes, places = group.setdefault(tree, ([], []))
        nodes.append(node)
        places.append(at)
    return {tree: (nodes, tried[places]) for tree, (nodes, places) in group.items()}


def _grow(blocks: DataFrame, settings: dict, n_features: int, n_splits: np.ndarray, n_classes: int) -> list[Tree]:
    spark = blocks.sparkSession
    planes = n_classes or 3
    trees = [Tree(planes) for _ in range(settings["trees"])]
    stack = [(tree, 0) for tree in range(len(trees))]
    rnd = JavaRandom(settings["seed"])
    n_bins = int(n_splits.max()) + 1
    orders: dict[tuple, list[int]] = {}
    while stack:
        group = _next_group(stack, rnd, n_features, settings["tried"], n_splits + 1, planes, settings["memory"])
        shared = spark.sparkContext.broadcast({tree: trees[tree].walk(*one) for tree, one in group.items()})
        try:
            parts = blocks.mapInArrow(_statistics(shared, n_features, len(trees), n_bins, n_classes), "tree int, data binary")
            size = sum(len(nodes) for nodes, _ in group.values()) * settings["tried"] * n_bins * planes * 8
            tasks = min(CHOOSING_TASKS, len(group), -(-size // CHOOSING_BYTES))
            chosen = parts.repartition(tasks, "tree").mapInArrow(
                _choices(shared, n_splits, n_bins, n_classes), "tree int, data binary"
            )
            found = {row["tree"]: np.frombuffer(row["data"]).reshape(-1, 4 + 3 * planes) for row in chosen.collect()}
        finally:
            shared.destroy()
        keys = tuple(group)
        if keys not in orders:
            orders[keys] = _map_order(spark._jvm, list(keys))
        for tree in orders[keys]:
            further = trees[tree].apply(group[tree][0], found[tree], settings["depth"], n_classes)
            stack += [(tree, node) for node in further]
    return trees


# --- the model -----------------------------------------------------------------------------------


class _JavaStream:
    """Nodes of a tree in Java's serialization format: one call hands a whole tree to the virtual machine."""

    def __init__(self, jvm, n_classes: int):
        self.n_classes = n_classes
        self.suid = {}
        package, mllib = "org.apache.spark.ml.tree.", "org.apache.spark.mllib.tree.impurity."
        self.node, self.inner, self.leaf = package + "Node", package + "InternalNode", package + "LeafNode"
        self.cut, self.split = package + "ContinuousSplit", package + "Split"
        self.calculator, self.own = mllib + "ImpurityCalculator", mllib + ("GiniCalculator" if n_classes else "VarianceCalculator")
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        for name in (self.node, self.inner, self.leaf, self.cut, self.calculator, self.own, "[D"):
            kind = jvm.java.lang.Class.forName(name, True, loader)
            self.suid[name] = jvm.java.io.ObjectStreamClass.lookup(kind).getSerialVersionUID()
        nodes = [("D", "impurity"), ("D", "prediction")]
        stats = ("L", "impurityStats", self.calculator)
        self.fields = {
            self.node: (None, []), self.calculator: (None, [("[", "stats", "[D")]), "[D": (None, []),
            self.leaf: (self.node, [*nodes, stats]),
            self.inner: (self.node, [("D", "gain"), *nodes, stats, ("L", "leftChild", self.node), ("L", "rightChild", self.node), ("L", "split", self.split)]),
            self.cut: (None, [("I", "featureIndex"), ("D", "threshold")]),
            self.own: (self.calculator, [("J", "rawCount")]),
        }

    def _text(self, value: str) -> bytes:
        return struct.pack(">H", len(value)) + value.encode()

    def _handle(self, key) -> None:
        self.handles[key] = 0x7E0000 + self.n_handles
        self.n_handles += 1

    def _kind(self, name: str | None) -> None:
        if name is None:
            self.out.append(b"\x70")
        elif ("kind", name) in self.handles:
            self.out.append(b"\x71" + struct.pack(">i", self.handles["kind", name]))
        else:
            above, fields = self.fields[name]
            self.out.append(b"\x72" + self._text(name) + struct.pack(">q", self.suid[name]))
            self._handle(("kind", name))
            self.out.append(b"\x02" + struct.pack(">H", len(fields)))
            for code, label, *of in fields:
                self.out.append(code.encode() + self._text(label))
                if of:
                    text = of[0] if code == "[" else "L" + of[0].replace(".", "/") + ";"
                    if ("text", text) in self.handles:
                        self.out.append(b"\x71" + struct.pack(">i", self.handles["text", text]))
                    else:
                        self._handle(("text", text))
                        self.out.append(b"\x74" + self._text(text))
            self.out.append(b"\x78")
            self._kind(above)

    def _start(self, name: str, mark: bytes = b"\x73") -> None:
        self.out.append(mark)
        self._kind(name)
        self.n_handles += 1

    def _stats(self, stats: tuple) -> None:
        self._start(self.own)
        self._start("[D", b"\x75")
        self.out.append(struct.pack(f">i{len(stats)}d", len(stats), *stats))
        self.out.append(struct.pack(">q", int(sum(stats) if self.n_classes else stats[0])))

    def _write(self, node: tuple) -> None:
        if len(node) == 3:
            self._start(self.leaf)
            self.out.append(struct.pack(">2d", node[1], node[0]))
            self._stats(node[2])
            return
        prediction, impurity, stats, gain, feature, threshold, left, right = node
        self._start(self.inner)
        self.out.append(struct.pack(">3d", gain, impurity, prediction))
        self._stats(stats)
        self._write(left)
        self._write(right)
        self._start(self.cut)
        self.out.append(struct.pack(">id", feature, threshold))

    def of(self, node: tuple) -> bytes:
        self.out, self.handles, self.n_handles = [b"\xac\xed\x00\x05"], {}, 0
        self._write(node)
        return b"".join(self.out)


def _pruned(tree: Tree, at: int, thresholds: list[list[float]], n_classes: int) -> tuple:
    """The node as nested tuples; children that are leaves of one prediction are merged, as Spark does."""
    stats, impurity = tree.stats[at], tree.impurity[at]
    if n_classes:
        prediction = float(max(range(n_classes), key=stats.__getitem__)) if sum(stats) else 0.0
    else:
        prediction = stats[1] / stats[0] if stats[0] else 0.0
    left = tree.left[at]
    if left == at:
        return prediction, impurity if tree.valid[at] else -1.0, stats
    a, b = (_pruned(tree, child, thresholds, n_classes) for child in (left, left + 1))
    if len(a) == len(b) == 3 and a[0] == b[0]:
        return a[0], impurity, stats
    return prediction, impurity, stats, tree.gain[at], tree.feature[at], thresholds[tree.feature[at]][tree.split[at]], a, b


def _model(spark, estimator: Estimator, trees: list[Tree], thresholds: list[list[float]], n_classes: int) -> Model:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    one, whole, n = (
        (ml.classification.DecisionTreeClassificationModel, ml.classification.RandomForestClassificationModel, [len(thresholds), n_classes])
        if n_classes else (ml.regression.DecisionTreeRegressionModel, ml.regression.RandomForestRegressionModel, [len(thresholds)])
    )
    java = estimator._java_obj
    extra = getattr(java, "copyValues$default$2")()
    stream = _JavaStream(jvm, n_classes)
    made = gateway.new_array(one, len(trees))
    for i, tree in enumerate(trees):
        data = jvm.java.io.ByteArrayInputStream(bytearray(stream.of(_pruned(tree, 0, thresholds, n_classes))))
        made[i] = one(jvm.java.io.ObjectInputStream(data).readObject(), *n)
        java.copyValues(made[i], extra)
    forest = whole(java.uid(), made, *n)
    java.copyValues(forest.setParent(java), extra)
    return estimator._copyValues(estimator._create_model(forest))


def _plain(rows: DataFrame, names: Sequence[str]) -> bool:
    """Whether all columns are numbers that nothing marks as categories."""
    fields = {f.name: f for f in rows.schema.fields}
    return all(
        isinstance(fields[name].dataType, (NumericType, BooleanType)) and "ml_attr" not in (fields[name].metadata or {}) for name in names
    )


def fit_forest(estimator: Estimator, rows: DataFrame, assembled: DataFrame, features: Sequence[str]) -> Model:
    """The forest that ``estimator.fit(assembled)`` grows; ``rows`` are those of ``assembled``, in its partitions, kept
    until there are blocks of them.

    It must draw with replacement at a rate of one and leave the least gain and leaf at Spark's defaults. Input that
    Spark's trainer treats in ways of its own (categories, vectors, a single class, no rows) is left to it.
    """
    target = estimator.getLabelCol()
    n_rows = rows.count()
    if not n_rows or not features or not _plain(rows, [*features, target]) or estimator.getMaxBins() > 256:
        return estimator.fit(assembled)
    spark = rows.sparkSession
    estimator._transfer_params_to_java()
    n_classes = 0
    if isinstance(estimator, RandomForestClassifier):
        java = estimator._java_obj
        n_classes = java.getNumClasses(assembled._jdf, getattr(java, "getNumClasses$default$2")())
        if n_classes < 2:
            return estimator.fit(assembled)
    all_tried = estimator.getFeatureSubsetStrategy() == "all"
    settings = dict(
        trees=estimator.getNumTrees(), depth=estimator.getMaxDepth(), seed=estimator.getSeed(), memory=estimator.getMaxMemoryInMB() << 20,
        tried=len(features) if all_tried else math.ceil(math.sqrt(len(features))),
    )
    thresholds = _thresholds(rows, features, n_rows, estimator.getMaxBins(), settings["seed"])
    blocks = _blocks(rows, features, target, thresholds, n_classes, settings["trees"], settings["seed"])
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks.count()
        rows.unpersist()  # the blocks hold all that is needed; lost ones are dealt again, the same
        n_splits = np.array([len(one) for one in thresholds])
        trees = _grow(blocks.coalesce(-(-n_rows // PASS_ROWS)), settings, len(features), n_splits, n_classes)
    finally:
        blocks.unpersist()
    return _model(spark, estimator, trees, thresholds, n_classes)
