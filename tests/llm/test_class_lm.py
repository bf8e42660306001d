import math
import zlib
from collections import Counter

import numpy as np
import pytest

from driftspark.llm import class_lm


def likelihood(bigrams, own, total):
    member = np.zeros((len(bigrams), total))
    member[np.arange(len(bigrams)), own] = 1
    m = member.T @ bigrams @ member

    def f(x):
        return (x * np.log(np.maximum(x, 1))).sum()

    return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rnd = np.random.default_rng(3)
    bigrams = rnd.integers(0, 9, (14, 14)).astype(float)
    own = class_lm.exchange(bigrams, 12, 4, sweeps=50)
    assert own[12:].tolist() == [4, 5]
    best = likelihood(bigrams, own, 6)
    assert best > likelihood(bigrams, np.concatenate([np.arange(12) % 4, [4, 5]]), 6)
    for w in range(12):
        for c in range(4):
            moved = own.copy()
            moved[w] = c
            assert likelihood(bigrams, moved, 6) <= best + 1e-6


def test_best_class_is_the_best_of_all(make_docs):
    rnd = np.random.default_rng(8)
    for trial in range(40):
        bigrams = rnd.poisson(0.6, (20, 20)).astype(float)
        # The last two are the class without classes and the end; some words have no class yet.
        own = np.concatenate([rnd.integers(0, 6 if trial % 2 else 5, 18), [5, 6]])
        member = np.eye(7)[own]
        matrix = member.T @ bigrams @ member
        for w in range(18):
            after, before = bigrams[w].copy(), bigrams[:, w].copy()
            after[w] = before[w] = 0
            kept = matrix.copy()
            found = class_lm.best_class(matrix, own[w], after @ member, before @ member, bigrams[w, w], 5)
            assert (matrix == kept).all()
            values = []
            for c in range(5):
                moved = own.copy()
                moved[w] = c
                values.append(likelihood(bigrams, moved, 7))
            assert values[found] >= max(values) - 1e-6


def test_neighbours_and_rounds_against_plain_counts(make_docs, words, monkeypatch):
    monkeypatch.setattr(class_lm, "COUNT_KEYS", 50)
    rows = [(n, words(60, n)) for n in range(40)] + [(50, "twice twice twice"), (51, None)]
    docs = make_docs(rows).select("doc_id", "text").repartition(3)
    counts = Counter(w for i, t in rows if not class_lm.held_out(i) for w in (t or "").encode().lower().split())
    names = [w for _, w in sorted((-c, w) for w, c in counts.items())]
    number = {w: n for n, w in enumerate(names)}
    known = sum(c >= 2 for c in counts.values())
    size = len(names) + 1
    bigrams = np.zeros((size, size))
    for i, t in rows:
        if not class_lm.held_out(i):
            chain = [size - 1, *(number[w] for w in (t or "").encode().lower().split()), size - 1]
            np.add.at(bigrams, (chain[:-1], chain[1:]), 1)
    shared = docs.sparkSession.sparkContext.broadcast(number)
    reached = []
    for rounds in range(4):
        own, matrix = class_lm.cluster(docs, shared, names, known, 4, 10, rounds)
        member = np.eye(6)[[*own, *[4] * (len(names) - known), 5]]
        assert (matrix == member.T @ bigrams @ member).all()
        reached.append(class_lm.likelihood(matrix))
        if rounds:
            assert own.max() < 4
        if rounds == 1:  # the words that were not in the core moved by the plain counts of the round before
            before, table = last
            for w in range(known):
                after, left = bigrams[w].copy(), bigrams[:, w].copy()
                after[w] = left[w] = 0
                assert own[w] == class_lm.best_class(table, before[w], after @ members, left @ members, bigrams[w, w], 4)
        last, members = (own, matrix), member
    assert reached == sorted(reached) and reached[1] > reached[0]


def plain_base(rows):
    counts = Counter()
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    return out


@pytest.mark.parametrize("share", [1e-6, 0.01])
def test_scores(make_docs, words, share):
    rows = [(n, words(80, n)) for n in range(60)]
    rows += [(None, "NO id"), (70, None), (71, ""), (72, "unseen é\x0btokens"), (5, words(80, 5)), (5, "other"), (73, "w " * 50_000)]
    docs = make_docs(rows, ["word", "score", "row"])
    found = class_lm.score(docs, core=20, classes=5, share=share).collect()

    def key(r):
        return str(r[0]), r[1], round(r[4], 3)

    expected = sorted(plain_base(rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert all(abs(g[4] - e[4]) <= 1e-9 * abs(e[4]) for g, e in zip(got, expected, strict=True))
    for r in found:
        assert r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity
        assert r.held_out == class_lm.held_out(r.doc_id)
    same = [r.score for r in found if r.doc_id == 5]
    assert len(same) == 3 and len({round(x, 9) for x in same}) == 2


@pytest.mark.parametrize("rounds", [0, 2])
def test_probabilities_of_the_next_token_sum_to_one(make_docs, words, rounds):
    docs = make_docs([(n, words(50, n)) for n in range(30)]).select("doc_id", "text")
    model, vocabulary = class_lm.fit(docs, core=15, classes=4, share=0.002, rounds=rounds)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    by_class = np.zeros(model.end + 1)
    np.add.at(by_class, model.classes, 10**model.emission)
    rare = [r.c for r in vocabulary.collect() if r.word is not None and bytes(r.word) not in model.words.value]
    by_class[model.rest] += sum((c + 1) / 10**model.rest_total for c in rare) + 1 / 10**model.rest_total
    assert np.allclose(by_class[: model.rest + 1], 1)


def test_no_training_rows(make_docs):
    held = next(n for n in range(100) if class_lm.held_out(n))
    r = class_lm.score(make_docs([(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0)
    assert class_lm.score(make_docs([])).count() == 0
