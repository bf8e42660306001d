import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from driftspark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance int, x int, dots string"


def plain(rows, size, clusters, rounds, scale):
    """Whole distances in every round, in Python's integers."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(x)[1] for _, x in kept]
        for k in range(len(centres)):
            own = [x for (_, x), n in zip(kept, found) if n == k]
            if own:
                centres[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(x) for _, x in kept]
    inertia = [sum(d for d, n in found if n == k) for k in range(len(centres))]
    return [
        (i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
        for (i, _), (d, k) in zip(kept, found)
    ]


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, "d") for i, v in rows], SCHEMA)
    return centroids.cluster(df, **options)


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_like_whole_distances(spark, rounds):
    rnd = np.random.default_rng(4)
    rows = [(n, (rnd.normal(size=6) * rnd.choice([0.01, 1, 300])).tolist()) for n in range(300)]
    rows += [(1000 + n, rows[7][1]) for n in range(150)]  # a third are copies
    rows += [(7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (2000, [0.0] * 6), (2001, [-1e-9] * 6)]
    nan, inf = float("nan"), float("inf")
    broken = [None, [], [1.0] * 5, [1.0] * 7, [None] + [1.0] * 5, [nan] * 6, [inf] + [0.0] * 5, [-inf] * 6]
    rows += [(3000 + n, v) for n, v in enumerate(broken)]
    options = {"size": 6, "clusters": 5, "rounds": rounds}
    found = clustered(spark, rows, **options)
    assert found.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain(rows, 6, 5, rounds, 1024), key=repr)


def test_ties_and_empty_clusters(spark):
    # Two first centroids are equal: the smaller number takes all, the other stays empty and keeps its place.
    rows = [(n, [1.0, 2.0]) for n in range(6)] + [(n, [5.0, -3.0]) for n in range(6, 9)]
    found = clustered(spark, rows, size=2, clusters=6, rounds=3)
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows, 2, 6, 3, 1024))


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert sorted(map(tuple, clustered(spark, rows, size=2).collect())) == sorted(plain(rows, 2, 8, 10, 1024))
    for none in ([], [(1, None), (2, [1.0])]):
        assert clustered(spark, none, size=2).collect() == []


def test_vectors_without_a_64_bit_distance(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    found = clustered(spark, [*rows, (3, [1e300, 0.0]), (4, [1e7, 0.0])], size=2).collect()
    assert sorted(map(tuple, found))[:2] == sorted(plain(rows, 2, 8, 10, 1024))
    assert sorted(map(tuple, found))[2:] == [(3, *[None] * 5), (4, *[None] * 5)]
    near = [(1, [2.0**19, 2.0**19]), (2, [-(2.0**19), -(2.0**19)]), (3, [0.0, 1.0])]
    # Their inertia is over 64 bits only in sum, if at all; distances are exact.
    assert [tuple(r)[:3] for r in sorted(clustered(spark, near, size=2, clusters=1, rounds=1).collect())] == [
        r[:3] for r in sorted(plain(near, 2, 1, 1, 1024))
    ]


def test_only_changed_components_are_added():
    change = np.zeros((2, 4), np.int64)
    change[1, 2] = 3
    lists = lambda rows: pa.array(rows, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), lists([[1, 2, 5, 7]]), pa.array([79]), lists([[10, 20]])], ["vec_id", "x", "square", "dots"]
    )
    (out,) = centroids._moved(change, np.array([4, 9]))([batch])
    assert out.column(3).to_pylist() == [[10, 35]]
    assert out.column(4).to_pylist() == [1] and out.column(5).to_pylist() == [79 - 70 + 9]
