import re
from collections import Counter

from driftspark.llm import decontaminate


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words, k):
    return [tuple(words[n : n + k]) for n in range(len(words) - k + 1)]


def brute_force(rows, items):
    found = {}
    for i, text in rows:
        for item, item_text in items:
            own = tokens(item_text)
            if not own:
                continue
            k = min(5, len(own))
            theirs, doc = Counter(shingles(own, k)), shingles(tokens(text), k)
            n = sum(theirs.values())
            for start in range(max(1, len(doc) - n + 1)):
                window = Counter(doc[start : start + n])
                common = sum((window & theirs).values())
                similarity = common / (sum(window.values()) + n - common)
                if similarity >= 0.8:
                    found[i, item] = max(found.get((i, item), 0), similarity)
    return found


def test_windows_match_brute_force(spark, make_docs, words):
    item = words(40, 1)
    w = item.split()
    items = [
        (1, item), (2, words(60, 2)), (3, None), (4, ""), (5, "three little words"), (6, item),
        (7, " ".join(["again and again we repeat"] * 6)), (8, words(12, 3)), (None, words(30, 4)),
    ]
    rows = [
        (0, words(30, 10) + " " + item.upper().replace(" ", ",  ") + " " + words(20, 11)),
        (1, " ".join(w[:-2])),
        (2, " ".join(w[4:]) + " " + words(9, 12)),
        (3, " ".join(w[:20]) + " other " + " ".join(w[20:])),
        (4, " ".join(w[:17]) + " x y z " + " ".join(w[20:])),
        (5, words(500, 13)),
        (6, None), (7, ""), (8, "three"), (9, "so three little words here"),
        (10, " ".join(["again and again we repeat"] * 9)),
        (11, words(4000, 14) + " " + words(60, 2) + " " + words(4000, 15)),
        (11, words(25, 16)), (12, words(30, 4)), (None, item), (13, item), (13, item),
    ]
    docs = make_docs(rows, ["h", "n", "text_key"])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found}
    expected = brute_force(rows, items)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    dirty = {i for i, _ in expected}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for n, (i, _) in enumerate(rows) if i not in dirty or n == 12
    )


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.contaminated(make_docs([(1, "a b c d e f g")]), none).count() == 0
    assert decontaminate.contaminated(make_docs([]), some).count() == 0
    assert decontaminate.clean(make_docs([(1, "a b")]), none).count() == 1


def test_only_dataframe_operators(spark, make_docs, plan_text):
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = plan_text(decontaminate.clean(make_docs([(1, "a b c d e f g h")]), some))
    assert not re.search("EvalPython|MapInArrow|MapInPandas|InPandas", plan)
