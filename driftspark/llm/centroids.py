"""Centroid clustering of vectors on an integer grid, with an incremental distance matrix.

A vector's squared distance to a centroid is |x|^2 - 2 x.c + |c|^2. The dot products x.c, exact integers, are kept with
the vector in a written table. When centroids move, each dot product changes by the vector's components times the
centroid's changes, and only components that did change are read from the vector; then the nearest centroid is taken
anew. Sums of a cluster are added up in the tasks, so only centroids and their sums pass through the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.runtime import col, materialize, remove, scratch_dir

SIZE = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
# Vectors up to this length on the grid have distances that fit in 64 bits, to any centroid of such vectors.
LONGEST = 1 << 30


def on_grid(vectors: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """``vec_id, x`` with integer components floor(scale * x) of the vectors that can be clustered.

    Those that are null, of another length, or hold a null or a non-finite component are left out. ``x`` is null if
    the vector is longer than ``LONGEST`` on the grid.
    """
    rows = vectors.select(col(id_column).cast("long").alias("vec_id"), col(vector_column).cast("array<double>").alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = rows.where(F.col("v").isNotNull() & (F.size("v") == size)).where(~broken)
    whole = F.transform("v", lambda x: x * scale)
    square = F.aggregate(whole, F.lit(0.0), lambda total, x: total + x * x)
    grid = F.transform(whole, lambda x: F.floor(x))
    return kept.select("vec_id", F.when(square <= float(LONGEST) ** 2, grid).alias("x"))


def first_centroids(grid: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """Vectors with the smallest hashes of seed and id, in the order of the hashes; fewer if there are fewer vectors.
    Rows of one id come in the order of their components, rows without an id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = grid.where("x is not null").orderBy(digest.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _moved(change: np.ndarray, squares: np.ndarray):
    """Add the centroids' changes to the dot products and take the nearest centroid; ties go to the smaller number."""
    changed = [np.flatnonzero(row) for row in change]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), change.shape[1])
            square, dots = batch.column(2).to_numpy(), _matrix(batch.column(3), len(change)).copy()
            for k, places in enumerate(changed):
                if len(places):
                    dots[:, k] += x[:, places] @ change[k, places]
            apart = squares - 2 * dots
            nearest = apart.argmin(axis=1)
            distance = apart[np.arange(len(nearest)), nearest] + square
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    _lists(dots),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(distance),
                ],
                ["vec_id", "x", "square", "dots", "cluster", "distance"],
            )

    return run


def _summed(clusters: int, size: int):
    """Sums of the components and rows by cluster, one row for each component of each cluster a task has seen.

    A sum is given in two parts, its high one in units of 2^32, so that no number of rows overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((2, clusters, size), np.int64)
        count = np.zeros(clusters, np.int64)
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            for k in np.unique(cluster):
                own = x[cluster == k]
                high[k] += (own >> 32).sum(axis=0)
                low[k] += (own & 0xFFFFFFFF).sum(axis=0)
                count[k] += len(own)
            high += low >> 32
            low &= 0xFFFFFFFF
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(seen, size).astype(np.int32)),
                pa.array(np.tile(np.arange(size, dtype=np.int32), len(seen))),
                pa.array(high[seen].ravel()),
                pa.array(low[seen].ravel()),
                pa.array(np.repeat(count[seen], size)),
            ],
            ["cluster", "place", "high", "low", "n"],
        )

    return run


def _next_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; an empty cluster keeps its centroid."""
    k, size = centroids.shape
    parts = state.select("cluster", "x").mapInArrow(
        _summed(k, size), "cluster int, place int, high bigint, low bigint, n bigint"
    )
    sums = parts.groupBy("cluster", "place").agg(
        *[F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ("high", "low", "n")]
    )
    after = centroids.copy()
    # One row for each component of a centroid.
    for row in sums.collect():
        total = (int(row["high"]) << 32) + int(row["low"])
        after[row["cluster"], row["place"]] = total // int(row["n"])
    return after


def _per_centroid(values: list, kind: str) -> Column:
    """The value of a row's cluster."""
    table = F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")
    return F.get(table, F.col("cluster"))


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    size: int = SIZE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that can be clustered.

    Vectors that are null, of another length than ``size``, or that hold a null or a non-finite component give no row;
    a zero vector is one like others. A vector whose length exceeds 2^30 grid steps (2^20 at the scale of 1024) has
    no distance that surely fits in 64 bits: it moves no centroid and has nulls besides its id. Inertias beyond 64
    bits are null. Repeated rows and ids each give their row, ties go to the smaller cluster, a null id starts no
    centroid while others can, and no rows give no rows. Further columns of ``vectors`` are not read.

    A round reads and writes the vectors once, in map tasks; the table of the round before goes when the new one is
    whole. A lost executor repeats its tasks from the last written table.
    """
    spark = vectors.sparkSession
    # The numbers of the first dot products are all zero: centroids move from the origin.
    square = F.aggregate("x", F.lit(0).cast("long"), lambda total, x: total + x * x)
    grid = materialize(
        on_grid(vectors, id_column, vector_column, size, scale).select(
            "vec_id",
            "x",
            square.alias("square"),
            F.when(F.col("x").isNotNull(), F.array_repeat(F.lit(0).cast("long"), clusters)).alias("dots"),
        ),
        "grid",
    )
    centroids = first_centroids(grid, clusters, seed)
    if not len(centroids):
        state = grid.where("x is not null").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
        centroids = np.zeros((0, size), np.int64)
    else:
        k = len(centroids)
        start = grid.where("x is not null")
        if k < clusters:
            start = start.withColumn("dots", F.slice("dots", 1, k))
        schema = "vec_id bigint, x array<bigint>, square bigint, dots array<bigint>, cluster int, distance bigint"
        # The origin has zero dot products with everything.
        before, state, path = np.zeros_like(centroids), start, None
        for turn in range(rounds + 1):
            squares = (centroids * centroids).sum(axis=1)
            moved = state.select("vec_id", "x", "square", "dots").mapInArrow(
                _moved(centroids - before, squares), schema
            )
            old, path = path, f"{scratch_dir(spark)}/distances-{uuid.uuid4().hex}"
            moved.write.parquet(path)
            state = spark.read.schema(moved.schema).parquet(path)
            if old:
                remove(spark, old)
            if turn < rounds:
                before, centroids = centroids, _next_centroids(state, centroids)
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {row["cluster"]: int(row["total"]) for row in totals}
    fitting = [v if v < 1 << 63 else None for v in [*(inertia.get(k, 0) for k in range(len(centroids))), sum(inertia.values())]]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    placed = state.select(
        "vec_id",
        "cluster",
        "distance",
        _per_centroid(fitting[:-1], "bigint").alias("cluster_inertia"),
        F.lit(fitting[-1]).cast("bigint").alias("inertia"),
        _per_centroid(hashes, "string").alias("centroid_sha256"),
    )
    without = grid.where("x is null").select(
        "vec_id", *[F.lit(None).cast(t).alias(n) for n, t in placed.dtypes if n != "vec_id"]
    )
    return placed.union(without)
