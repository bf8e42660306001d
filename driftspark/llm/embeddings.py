"""Near duplicates of embedding vectors: exact threshold pairs by dual traversal of cover trees.

Unit vectors with cosine c lie sqrt(2 - 2 c) apart. A tree covers points by nested levels whose radii halve: each
node's centre is the centre of one of its children. A pair of nodes whose centres are farther apart than the
threshold distance and both covering radii holds no pair and is left; other pairs go on to their children, and the
leaves' cosines decide. Equal vectors are one point with a weight. A label's points are cut into chunks of bounded
size, each pair of chunks is one task's work, and a task returns counts and spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import sorted_runs
from driftspark.llm.graph import components
from driftspark.operators.lookup import join_lookup, key_counts
from driftspark.runtime import col, materialize

COSINE = 0.98
# Points of a chunk.
CHUNK = 2048
RADII = (1.0, 0.5, 0.25, 0.125)
# Distances are computed from cosines, so near zero they are only good to about 1e-7.
SLACK = 1e-6
# Rows of a distance block.
BLOCK = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class Node:
    """Points below a node, its centre (a point) and covering radius; children, or none for a leaf."""

    __slots__ = ("centre", "children", "points", "radius")

    def __init__(self, centre: int, points: np.ndarray, radius: float):
        self.centre, self.points, self.radius = centre, points, radius
        self.children: list[Node] = []


def cover_tree(x: np.ndarray) -> Node:
    """Tree over the rows of ``x``; on each level centres of one node are more than the level's radius apart."""
    root = Node(0, np.arange(len(x)), float(distance(x @ x[0]).max()))
    level = [root]
    for radius in RADII:
        below = []
        for node in level:
            if len(node.points) == 1 or node.radius == 0:
                continue
            left = node.points
            centre = node.centre
            while len(left):
                away = distance(x[left] @ x[centre])
                # The centre itself is covered whatever rounding says.
                near = (away <= radius) | (left == centre)
                node.children.append(Node(centre, left[near], float(away[near].max())))
                left = left[~near]
                if len(left):
                    centre = int(left[0])
            below += node.children
        level = below
    return root


def pair_blocks(
    x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x``, rows of ``y`` and whether they are linked, for all pairs of leaves left by the bounds."""
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            for at in range(0, len(a.points), BLOCK):
                rows = a.points[at : at + BLOCK]
                hit = x[rows] @ y[b.points].T >= cosine
                if hit.any():
                    yield rows, b.points, hit
            continue
        own, other = a.children or [a], b.children or [b]
        centres = y[[n.centre for n in other]]
        radii = np.array([n.radius for n in other])
        for at in range(0, len(own), BLOCK):
            part = own[at : at + BLOCK]
            apart = distance(x[[n.centre for n in part]] @ centres.T)
            near = apart <= reach + np.array([n.radius for n in part])[:, None] + radii[None, :]
            stack += [(part[i], other[j]) for i, j in zip(*np.nonzero(near), strict=True)]


def spanning(first: np.ndarray, second: np.ndarray, count: int) -> np.ndarray:
    """The smallest number that links reach, for 0 to ``count`` - 1."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[first], label[second])
        new = label.copy()
        np.minimum.at(new, first, low)
        np.minimum.at(new, second, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(cosine: float):
    def one(rep: np.ndarray, x: np.ndarray, weight: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        """Of one pair of chunks: a row (rep, null, links) for each linked point, and (rep, rep, 0) for links."""
        chunks = np.unique(chunk)
        sides = [np.flatnonzero(chunk == c) for c in (chunks[0], chunks[-1])]
        trees = [cover_tree(x[side]) for side in sides[: len(chunks)]]
        same = len(chunks) == 1
        links = np.zeros(len(rep), np.int64)
        label = np.arange(len(rep))
        for rows, columns, hit in pair_blocks(x[sides[0]], trees[0], x[sides[1]], trees[-1], cosine):
            i, j = sides[0][rows], sides[1][columns]
            if same:
                hit = hit & (i[:, None] != j[None, :])
            links[i] += hit @ weight[j]
            if not same:
                links[j] += weight[i] @ hit
            a, b = np.nonzero(hit)
            # The links so far and those of this block, by their smallest member.
            label = spanning(
                np.concatenate([np.arange(len(rep)), i[a]]), np.concatenate([label, j[b]]), len(rep)
            )
        linked, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rep[linked], rep[moved]])),
                pa.array(
                    np.concatenate([rep[linked], rep[label[moved]]]),
                    mask=np.concatenate([np.ones(len(linked), bool), np.zeros(len(moved), bool)]),
                ),
                pa.array(np.concatenate([links[linked], np.zeros(len(moved), np.int64)])),
            ],
            ["a", "b", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["space", "pair"]):
            rows = rows.combine_chunks()
            space, pair = rows["space"].to_numpy(), rows["pair"].to_numpy()
            new = np.ones(len(space), bool)
            new[1:] = (space[1:] != space[:-1]) | (pair[1:] != pair[:-1])
            bounds = np.append(np.flatnonzero(new), len(space))
            for a, b in zip(bounds, bounds[1:], strict=False):
                own = rows.slice(a, b - a)
                if b - a > 1:
                    vectors = own["embedding"].combine_chunks().flatten().to_numpy().reshape(b - a, -1)
                    yield one(
                        own["rep"].to_numpy(), unit(vectors), own["weight"].to_numpy(), own["chunk"].to_numpy()
                    )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    cosine: float = COSINE,
    chunk: int = CHUNK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row.

    Rows are linked if their labels are equal and not null, their vectors of one length, and the cosine in double
    precision reaches ``cosine``. Vectors that are null, empty, zero or hold a null or a non-finite component
    link with nothing and are components of their own. Rows with equal vectors are linked to each other. Null
    ids take part, but a component's id is the smallest that is not null. No rows give no rows.
    """
    rows = vectors.select(
        col(id_column).cast("long").alias("vec_id"),
        col(vector_column).cast("array<double>").alias("embedding"),
        col(label_column).alias("label"),
    )
    broken = F.exists(
        "embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    valid = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~broken
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = materialize(rows.withColumn("valid", F.coalesce(valid, F.lit(False))), "vectors")
    points = rows.where("valid").groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low")
    )
    # The numbers are written, so later reads agree on them.
    points = materialize(points.withColumn("rep", F.monotonically_increasing_id()), "points")
    spaces = points.groupBy("label", F.size("embedding").alias("size")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks")
    )
    spaces = materialize(spaces.withColumn("space", F.monotonically_increasing_id()), "spaces")
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(other, own).cast("long") * F.col("chunks") + F.greatest(other, own),
    )
    dealt = (
        points.withColumn("size", F.size("embedding"))
        .join(spaces, ["label", "size"])
        .select("space", "rep", "weight", "embedding", own.alias("chunk"), F.explode(pairs).alias("pair"))
        .repartition("space", "pair")
        .sortWithinPartitions("space", "pair")
    )
    found = materialize(dealt.mapInArrow(_compare(cosine), "a bigint, b bigint, n bigint"), "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = materialize(
        points.join(counts, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            "rep",
            "label",
            "embedding",
            "low",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("root"),
        ),
        "named-points",
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    met = join_lookup(named, lowest, ["root"], key_counts(named, ["root"]), "rep")
    named = materialize(met.select("label", "embedding", "n_links", "component_id"), "components")
    alone = rows.where("not valid").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = rows.where("valid").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
