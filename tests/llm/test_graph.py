import random

from driftspark.llm.graph import components


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    links = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(60)]
    links += [(rnd.randint(1000, 1400), rnd.randint(1000, 1400)) for _ in range(150)]
    links += [(5, 4), (7, 7), (None, 3), (3, None)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    label = {}

    def root(n):
        label.setdefault(n, n)
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    assert found == {n: root(n) for n in label}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
