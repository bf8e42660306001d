import random
from collections import Counter

import numpy as np
import pytest

from driftspark.llm import suffixes


def plain_cover(texts, length):
    """Whether each byte lies in a string that starts at two places."""
    counts = Counter(t[n : n + length] for t in texts for n in range(len(t) - length + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for n in range(len(t) - length + 1):
            if counts[t[n : n + length]] > 1:
                on[n : n + length] = True
        out.append(on)
    return out


def random_texts(seed, count=14):
    rnd = random.Random(seed)
    base = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([60, 130, 350]))) for _ in range(6)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            if rnd.random() < 0.7:
                parts.append(rnd.choice(base)[rnd.randint(0, 30) : rnd.choice([None, -5, -40])])
            else:
                parts.append(bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(1, 60))))
        texts.append(b"".join(parts))
    return texts + [b"ab" * 150, b"q" * 333]


@pytest.mark.parametrize("segment", [1 << 15, 150])
def test_anchored_sorting_is_exact(monkeypatch, segment):
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    length = 100
    for seed in range(25):
        texts = random_texts(seed)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        place, h, first, last = suffixes.anchors(np.frombuffer(b"".join(texts), np.uint8), starts[1:], length)
        groups = {}
        for p, gram, a, b in zip(place.tolist(), h.tolist(), first.tolist(), last.tolist(), strict=True):
            n = int(np.searchsorted(starts, p, side="right")) - 1
            groups.setdefault(gram, []).append((n, p - int(starts[n]), p - a, b + length - p))
        got = [np.zeros(len(t), bool) for t in texts]
        for members in groups.values():
            before = [texts[n][p - u : p][::-1] for n, p, u, _ in members]
            after = [texts[n][p : p + v] for n, p, _, v in members]
            for (n, p, _, _), (u, v) in zip(members, suffixes.covered(before, after, length), strict=True):
                got[n][p - u : p + v] = True
        for a, b in zip(got, plain_cover(texts, length), strict=True):
            assert (a == b).all()


def test_sorting(words):
    rnd = random.Random(1)
    for shallow in (0, 8, 128):
        for _ in range(50):
            head = words(12, 1).encode()
            strings = [head[: rnd.randint(0, 60)] + bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 12))) for _ in range(30)]
            strings += strings[:5]
            order = suffixes.deep_shallow_sort(strings, shallow)
            assert sorted(order) == list(range(35))
            assert [strings[n] for n in order] == sorted(strings)


@pytest.mark.parametrize("in_task", [20_000, 3])
def test_documents(make_docs, words, in_task):
    shared = words(40, 1)
    rows = [(n, words(30, 100 + n) + " " + shared + " " + words(20, 200 + n)) for n in range(8)]
    rows += [(20, words(90, 300)), (21, words(90, 300)), (21, words(90, 300)), (22, "ab " * 200), (23, None), (24, "")]
    rows += [(None, "short"), (25, "short"), (26, words(60, 301) + " é " + words(60, 301)), (27, words(30_000, 302))]
    docs = make_docs(rows, ["spans", "digest", "gram", "n"])
    found = suffixes.remove_repeats(docs, length=130, in_task=in_task).collect()
    raw = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), t, on in zip(rows, raw, plain_cover(raw, 130), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
        expected.append((str(i), len(t), bytes(np.frombuffer(t, np.uint8)[~on]), edges.reshape(-1, 2).tolist()))
    got = [
        (str(r.doc_id), r.n_bytes, bytes(r.kept), [[s.start, s.end] for s in r.spans or []]) for r in found
    ]
    assert sorted(got) == sorted(expected)


def test_empty_table(make_docs):
    assert suffixes.remove_repeats(make_docs([])).count() == 0


def test_runs_of_a_periodic_text_are_one(spark):
    rows = [("a", n, n + 400) for n in range(30_000)] * 2 + [("a", 40_000, 40_400), ("b", 5, 405), ("b", 405, 900), ("b", 901, 1301), ("b", 5, 410)]
    spans = spark.createDataFrame(rows, "digest string, start bigint, end bigint")
    found = {r["digest"]: [tuple(x) for x in r["spans"]] for r in suffixes.merged_runs(spans).collect()}
    assert found == {"a": [(0, 30_399), (40_000, 40_400)], "b": [(5, 900), (901, 1301)]}
