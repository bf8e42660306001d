import random
import re
from itertools import permutations

import pytest

from driftspark.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Every order replayed on every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > first[text],
        }
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return sorted((*key, *v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items())


@pytest.fixture
def corpus(words):
    rnd = random.Random(3)
    texts = [None, "", "A", "a$", "A B C D", words(60, 1), words(60, 1) + " #", "x " * 60, "X y" * 70, "\x0b\x0c a b", "Ä" * 9]
    head = words(700, 9)  # texts that share some four thousand bytes
    texts += [head + end for end in ("", "a", "b", "ab", " a", " a" * 40)] + [head[:n] for n in (15, 16, 17, 64, 65, 1024)]
    rows = [(rnd.choice([None, *range(300)]), rnd.choice(texts), rnd.choice([None, "", "s", "t"])) for _ in range(400)]
    rows += [(1000 + n, words(55, 2), "s") for n in range(300)]  # copies
    rows += [(2000 + n, words(55, 100 + n), "t") for n in range(60)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [None, *range(0, 2060, 3), *range(0, 300, 5)]]
    return rows, labels


def documents(spark, rows):
    schema = "doc_id long, text string, source string, mask int, prefix string, n int, part int, id int, gram int, good int"
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4, 5, 6) for r in rows], schema).repartition(5)


def audited(spark, rows, labels, **options):
    found = audit.audit(documents(spark, rows), spark.createDataFrame(labels, LABELS), **options)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("size, limit", [(16 << 20, 10**6), (50, 0)])
def test_like_replay(spark, monkeypatch, corpus, size, limit):
    monkeypatch.setattr(audit, "TRIE_BYTES", size)
    rows, labels = corpus
    assert audited(spark, rows, labels, broadcast_rows=limit, tasks=6) == plain(rows, labels)


def test_empty_tables(spark, corpus):
    rows, labels = corpus
    assert audited(spark, [], labels) == []
    assert audited(spark, rows[:40], []) == plain(rows[:40], [])


def test_trie_keeps_every_text_and_its_smallest_id(words):
    rnd = random.Random(1)
    trie, wanted = audit.Trie(), {}
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(9))) for _ in range(500)]
    for text in texts:
        i = rnd.randrange(50)
        trie.insert(text, 0, i, [(("p", False, False, False), 1)])
        wanted.setdefault(text, []).append(i)
    found = {b"".join(path): terminal for path, terminal in trie.terminals()}
    assert set(found) == set(wanted)
    for text, ids in wanted.items():
        _, low, counts = found[text]
        assert low == min(ids)
        assert counts["p", False, False, False] == ids.count(low)
        assert counts["p", False, False, True] == len(ids) - ids.count(low)


def test_prefixes_grow_where_many_bytes_share_them(spark):
    head = b"h" * 300
    rows = [(head + bytes([65 + n % 26, n]),) for n in range(200)] + [(b"%d" % n + b"z" * 40,) for n in range(20)]
    df = spark.createDataFrame(rows, "text binary")
    dealt = df.select("text", audit.adaptive_prefix(df, 10).alias("prefix")).collect()
    assert all(bytes(r["text"]).startswith(bytes(r["prefix"])) for r in dealt)
    sizes = {len(r["prefix"]) for r in dealt if bytes(r["text"]).startswith(head)}
    assert min(sizes) > 300
    assert all(len(r["prefix"]) == 16 for r in dealt if not bytes(r["text"]).startswith(head))
