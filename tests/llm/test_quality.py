import random

import numpy as np

from driftspark.llm import quality
from driftspark.llm.optimize import minimize


def test_minimum_of_a_quadratic():
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    x = minimize(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(2))
    assert np.allclose(a @ x, 1, atol=1e-4)


def test_gradient_and_order_of_thresholds():
    rnd = random.Random(2)
    index = np.array([rnd.randrange(6) for _ in range(90)])
    start, grade = np.arange(0, 91, 3), np.array([rnd.randrange(3) for _ in range(30)])
    weights, cuts = quality.ordinal_fit(start, index, grade, 6, 3, 0.5)
    assert cuts[0] < cuts[1]

    def loss(w, c):
        score = w[index].reshape(-1, 3).sum(axis=1)
        edges = np.concatenate([[-np.inf], c, [np.inf]])
        p = 1 / (1 + np.exp(score - edges[grade + 1])) - 1 / (1 + np.exp(score - edges[grade]))
        ends = 1 / (1 + np.exp(-np.concatenate([[-np.inf], c, [np.inf]])))
        return -np.log(p).sum() - 0.5 * np.log(np.diff(ends)).sum() + 0.25 * (w @ w)

    best = loss(weights, cuts)
    for n in range(6):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[n] += step
            assert loss(moved, cuts) >= best - 1e-6
    for n in range(2):
        for step in (-0.05, 0.05):
            moved = cuts.copy()
            moved[n] += step
            assert loss(weights, moved) >= best - 1e-6


def test_held_out_accuracy_and_edge_cases(spark, make_docs, words):
    rows, labels = [], []
    for n in range(400):
        text, kind = words(40, n), n % 4
        if kind == 0:
            text = text.replace(" ", " idiot ", 1).replace(" ", " worthless ", 2)
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((n, text))
        if n < 320:
            labels.append((n, int(kind > 1), int(kind == 0)))
    rows += [(None, None), (500, ""), (501, "x" * 200_000), (3, "again")]
    labels += [(None, 1, 0), (500, None, 0), (501, 1, None), (999, 1, 0), (7, 1, 0), (7, 0, 1)]
    docs = make_docs(rows, ["quality_keep", "quality_tail"])
    model = quality.fit(docs, quality.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    scored = quality.score(docs, model)
    keep = scored.columns[-1]
    found = scored.collect()
    assert len(found) == len(rows) and scored.columns[:7] == docs.columns
    hits = [r[keep] == (r.doc_id % 4 > 1) for r in found if r.doc_id is not None and 320 <= r.doc_id < 400]
    assert np.mean(hits) > 0.95
    for r in found:
        low, high = r[-2]
        assert 1 >= low >= high >= 0 and abs(r[-3] - low - high) < 1e-12
    ungraded = quality.fit(docs, quality.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert ungraded is None
    assert quality.score(docs, None).where(keep).count() == len(rows)
    assert quality.score(make_docs([]), model).count() == 0
