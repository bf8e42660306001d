import random
import zlib

import numpy as np
import pytest

from driftspark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def plain_buckets(text, bits):
    """Every n-gram by itself."""
    whole = f" {' '.join((text or '').lower().split())} "
    found = set()
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for at in range(len(whole) - n + 1):
            gram = whole[at : at + n]
            if " " in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * int(toxicity._STEP) + ord(c)) % (1 << 64)
            found.add((h ^ h >> 29) * int(toxicity._STEP) % (1 << 64) >> 64 - bits)
    return sorted(found)


@pytest.mark.parametrize("segment", [1 << 16, 7])
def test_buckets_of_whole_texts(monkeypatch, segment, words):
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    mark = np.zeros(1 << 12, bool)
    for text in [None, "", " ", "a", "ab", "Ünï — 漢字 \U0001f600 x", words(60, 1), "aaaa" * 30, "a b c d e f"]:
        assert toxicity.buckets(text, mark).tolist() == plain_buckets(text, 12)


def test_ratios_by_hand():
    p, q = np.array([3, 0, 1]), np.array([0, 5, 1])
    found = toxicity.log_count_ratios(p, q)
    assert found == pytest.approx([np.log(4 / 7) - np.log(1 / 9), np.log(1 / 7) - np.log(6 / 9), np.log(2 / 7) - np.log(2 / 9)])


def test_fit_is_the_optimum():
    rnd = np.random.default_rng(3)
    x = rnd.random((200, 12)) < 0.3
    y = (x[:, 0] | (rnd.random(200) < 0.2)).astype(int)
    scale = rnd.normal(size=12)
    start = np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    w, b = toxicity.logistic_fit(start, np.nonzero(x)[1].astype(np.int32), scale, y, 1.0)
    z = x * scale
    chance = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(z.T @ (chance - y) + w).max() < 1e-3
    ends = 1 / (1 + np.exp(-b))
    assert abs((chance - y).sum() + 0.5 * ends + 0.5 * (ends - 1)) < 1e-3


@pytest.fixture
def corpus(words):
    """Rude documents hold a few of the rude words, in forms of their own."""
    rnd = random.Random(8)
    rude = ["zzyxq", "qwzzyk", "xxqzzw"]
    rows, labels = [], []
    for n in range(600):
        toxic = n % 4 == 0
        text = words(40, n)
        if toxic:
            parts = text.split()
            for _ in range(2):
                parts.insert(rnd.randrange(40), rnd.choice(rude) + rnd.choice(["", "s", "er", "."]))
            text = " ".join(parts)
        rows.append((n, text))
        labels.append((n, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_scores(spark, make_docs, corpus):
    rows, labels = corpus
    docs = make_docs([*rows, (0, rows[5][1]), (None, rows[0][1]), (9000, None), (9001, "")], extra=("toxicity", "id", "target", "f"))
    kept = toxicity.training_labels(spark.createDataFrame(labels, LABELS))
    assert not {r["id"] for r in kept.collect()} & {n for n, _ in rows if zlib.crc32(str(n).encode()) % 5 == 0}
    model = toxicity.fit(docs, kept, bits=14)
    found = toxicity.score(docs, model)
    assert found.columns == [*docs.columns, "_toxicity"]
    scored = [(r["doc_id"], r["text"], r["_toxicity"]) for r in found.collect()]
    assert len(scored) == docs.count() and all(0 <= s <= 1 for *_, s in scored)
    # Scores by the sum over plain n-grams.
    for _, text, s in scored[::20]:
        raw = model.weights[plain_buckets(text, 14)].sum() + model.intercept
        assert s == pytest.approx(1 / (1 + np.exp(-raw)))
    toxic = {n for n, _, t in labels if t}
    out = [(i in toxic, s >= 0.5) for i, text, s in scored if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0 and text == dict(rows)[i]]
    assert len(out) > 90 and sum(a == b for a, b in out) / len(out) > 0.97
    empty = {s for i, _, s in scored if i in (9000, 9001)}
    assert len(empty) == 1 and empty.pop() < 0.5
    by_text = {}
    for _, text, s in scored:
        assert by_text.setdefault(text, s) == s


def test_both_joins_give_one_model(spark, make_docs, corpus):
    rows, labels = corpus
    docs, kept = make_docs(rows), toxicity.training_labels(spark.createDataFrame(labels, LABELS))
    a, b = (toxicity.fit(docs, kept, bits=12, broadcast_rows=n) for n in (10**6, 0))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()


def test_labels(spark):
    # Ids 1 and 2 are in training; several rows, nulls and a held-out id.
    held = next(n for n in range(100) if zlib.crc32(str(n).encode()) % 5 == 0)
    assert all(zlib.crc32(str(n).encode()) % 5 for n in (1, 2))
    rows = [(1, 1, 0), (1, 1, 1), (2, None, 0), (None, 1, 1), (3, 1, None), (held, 1, 1)]
    assert sorted(map(tuple, toxicity.training_labels(spark.createDataFrame(rows, LABELS)).collect())) == [(1, 1), (2, 0)]


def test_no_model(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    for labels in ([], [(1, 1, 1)], [(50, 1, 1), (51, 1, 0)]):
        assert toxicity.fit(docs, toxicity.training_labels(spark.createDataFrame(labels, LABELS))) is None
    assert [r["toxicity"] for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.score(make_docs([]), None).collect() == []
    full = toxicity.Model(np.zeros(1 << 8), -1.0)
    assert toxicity.score(make_docs([]), full).collect() == []
