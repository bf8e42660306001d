import numpy as np
import pytest

from driftspark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, weight int, rep int"


def plain(rows):
    links, label = np.zeros(len(rows), int), list(range(len(rows)))
    vectors = [None if v is None or any(x is None for x in v) else np.array(v, np.float32).astype(float) for _, v, _ in rows]

    def usable(v):
        return v is not None and len(v) and np.isfinite(v).all() and v.any()

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if rows[i][2] is None or rows[i][2] != rows[j][2] or not usable(a) or not usable(b) or len(a) != len(b):
                continue
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    low = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(n)] = min(low.get(root(n), i), i)
    return [(i, int(links[n]), low.get(root(n)), i == low.get(root(n))) for n, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("chunk", [2048, 9])
def test_links_and_components(spark, chunk):
    rnd = np.random.default_rng(2)
    rows = []
    for _ in range(25):
        centre = rnd.normal(size=8)
        for _ in range(rnd.integers(1, 7)):
            rows.append((centre + rnd.normal(size=8) * rnd.choice([0.02, 0.1])).tolist())
    rows = [(n, v, n % 2) for n, v in enumerate(rows)]
    rows += [(500 + n, rows[3][1], 1) for n in range(5)] + [(600, [2 * x for x in rows[3][1]], 1), (None, rows[3][1], 1)]
    nan, inf = float("nan"), float("inf")
    rows += [(700, None, 1), (701, [0.0] * 8, 1), (702, [nan] * 8, 1), (703, [inf] * 8, 1), (704, [None] * 8, 1)]
    rows += [(705, rows[3][1], None), (706, rows[3][1][:7], 1), (707, [], 1), (3, rows[3][1], 1)]
    rows += [(708, [1e30] * 8, 1), (709, [1e-30] * 8, 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    found = embeddings.near_duplicates(table, chunk=chunk).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(rows), key=str)


def test_tree_covers_and_bounds_keep_every_pair():
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 6))
    x = embeddings.unit(np.concatenate([c + rnd.normal(size=(12, 6)) * 0.2 for c in centres]))
    root = embeddings.cover_tree(x)
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        assert embeddings.distance(x[node.points] @ x[node.centre]).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            assert any(c.centre == node.centre for c in node.children)
            assert all(c.radius <= embeddings.RADII[depth] for c in node.children)
        stack += [(c, depth + 1) for c in node.children]
    for cosine in (0.9, 0.98):
        got = np.zeros((len(x), len(x)), int)
        for i, j, hit in embeddings.pair_blocks(x, root, x, root, cosine):
            got[np.ix_(i, j)] += hit
        assert (got == (x @ x.T >= cosine)).all()


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
