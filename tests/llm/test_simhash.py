import random

import numpy as np
import pytest
import xxhash

from driftspark.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, distance):
    values = np.array(values, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \t\n", "One two", "A b c d", "É é Ab\x0bcd  e f g h i", "x " * 70_000])
def test_fingerprint_is_that_of_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_pair_within_the_distance_shares_a_key_and_passes_its_chain():
    rnd = random.Random(3)
    for distance in (0, 1, 3, 4, 7):
        keys = simhash.chain_keys(distance)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), rnd.randint(0, distance)):
                b ^= 1 << bit
            hits = [
                simhash.linked(np.array([a], np.uint64), np.array([b], np.uint64), start, distance)[0]
                for start, mask in keys
                if a & mask == b & mask
            ]
            assert any(hits)


@pytest.mark.parametrize("key_block", [4096, 7])
def test_links_connect_what_is_near(spark, key_block):
    rnd = random.Random(key_block)
    values = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(30):
            v = centre
            for bit in rnd.sample(range(64), rnd.randint(0, 5)):
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.fingerprint_links(nodes, key_block=key_block).collect()
    at = {v: n for n, v in enumerate(values)}
    label = list(range(len(values)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for r in links:
        a, b = (x % (1 << 64) for x in r)
        assert (a ^ b).bit_count() <= 4
        label[root(at[a])] = root(at[b])
    expected = plain_groups(values, 4)
    roots = [root(n) for n in range(len(values))]
    assert len(set(roots)) == len(set(expected))
    assert len(set(zip(roots, expected.tolist(), strict=True))) == len(set(roots))


def test_groups_and_kept_rows(make_docs, words):
    texts = [words(60, n) for n in range(25)]
    rows = list(enumerate(texts))
    rows += [(100 + n, texts[n]) for n in range(5)]
    rows += [(200, None), (201, ""), (202, " \n"), (3, texts[3]), (None, words(60, 99)), (7, words(60, 98))]
    rows += [(300, texts[0].upper()), (301, texts[1] + " tail"), (302, "one two"), (303, "ONE  two")]
    docs = make_docs(rows, ["fp", "group", "root", "kept_id", "n"])
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = plain_groups(prints, 4)
    low = {}
    for (i, _), g in zip(rows, expected, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == sorted(
        ((i, p, low.get(g)) for (i, _), p, g in zip(rows, prints, expected, strict=True)), key=str
    )
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    # One row of each group, with its smallest id.
    assert len(kept) == len(set(expected))
    assert sorted((r.doc_id for r in kept), key=str) == sorted((low.get(g) for g in set(expected)), key=str)


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([])).count() == 0
