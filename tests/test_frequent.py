import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftspark.operators import frequent, profile


def table(spark, columns, parts=8):
    rows = [(name, value) for name, values in columns.items() for value in values]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "column_name string, value string").repartition(parts)


def expected(values, k):
    digest = {v: hashlib.sha256(v.encode()).hexdigest() for v in set(values)}
    counts = collections.Counter(values)
    return [(v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], digest[x[0]]))[:k]]


def answer(df):
    found = collections.defaultdict(list)
    for row in df.orderBy("column_name", "position").collect():
        found[row["column_name"]].append((row["value"], row["n"]))
        assert row["position"] == len(found[row["column_name"]])
    return dict(found)


def skewed(rng, n, distinct):
    return [f"v{int(distinct * rng.random() ** 4)}" for _ in range(n)]


@pytest.mark.parametrize("k,tracked", [(1, 32), (3, 64), (10, 64), (10, 4096)])
def test_equals_counting_all_values(spark, k, tracked):
    rng = random.Random(k * tracked)
    columns = {
        "few": ["a"] * 500 + ["b"] * 500 + ["c"],
        "hot": ["hot"] * 4000 + [f"x{i}" for i in range(6000)],
        "skewed": skewed(rng, 8000, 3000),
        "unique": [f"u{i}" for i in range(5000)],
        "ties": [f"t{i % 50}" for i in range(1000)],
        "empty texts": ["", "", " "],
        "long": ["x" * 50000] * 3 + ["y" * 50000],
    }
    found = answer(frequent.top_values(table(spark, columns), k, tracked))
    assert found == {name: expected(values, k) for name, values in columns.items()}


def test_only_values_that_hardly_repeat_are_counted_fully(spark, monkeypatch):
    counted = []
    full = frequent.counted_fully

    def watched(values, k):
        counted.extend(r["column_name"] for r in values.select("column_name").distinct().collect())
        return full(values, k)

    monkeypatch.setattr(frequent, "counted_fully", watched)
    columns = {
        "heavy": [f"h{i % 5}" for i in range(20000)] + [f"x{i}" for i in range(5000)],
        "small": [f"s{i % 40}" for i in range(400)],
        "unique": [f"u{i}" for i in range(5000)],
    }
    found = answer(frequent.top_values(table(spark, columns), 5, 64))
    assert counted == ["unique"]
    assert found == {name: expected(values, 5) for name, values in columns.items()}


def test_no_value_outside_of_the_candidates_exceeds_the_bound(spark):
    rng = random.Random(3)
    for n, distinct, tracked, k in [(20000, 9000, 64, 5), (20000, 500, 128, 10), (5000, 5000, 32, 2)]:
        values = skewed(rng, n, distinct)
        df = table(spark, {"c": values}, 16)
        row = frequent.sketches(df, tracked).first()
        found = [(x["item"], x["count"]) for x in row["items"]]
        about = frequent._nominees("c", row["n"], bytes(row["head"]), found, k, tracked)
        assert about.n == n and frequent._error(bytes(row["head"]), n) is not None
        hashes = df.distinct().select("value", F.xxhash64("value").alias("h")).collect()
        counts = collections.Counter(values)
        most = dict(found)
        for value, h in hashes:
            if h in most:
                assert counts[value] <= most[h]
            if h not in about.hashes:
                assert counts[value] <= about.bound


def test_a_tie_with_the_bound_is_not_certified(spark):
    counts = spark.createDataFrame([("c", b"1", 9, "a"), ("c", b"2", 5, "b")], "column_name string, digest binary, n long, value string")
    for bound, certified in [(4, ["c"]), (5, []), (6, [])]:
        assert frequent._certified(counts, [frequent.Nominees("c", 100, [1, 2], bound, True)], 2) == certified
    # All values are known: no other can matter.
    assert frequent._certified(counts, [frequent.Nominees("c", 14, [1, 2], 9, True)], 2) == ["c"]
    # Fewer than k values, and others exist.
    assert frequent._certified(counts, [frequent.Nominees("c", 100, [1, 2], 4, True)], 3) == []


def test_a_head_that_says_something_else_is_not_believed(spark):
    head = bytes(frequent.sketches(table(spark, {"c": ["a", "b", "b"]})).first()["head"])
    assert frequent._error(head, 3) == 0
    assert frequent._error(head, 4) is None and frequent._error(head[:8], 3) is None and frequent._error(None, 3) is None
    assert not frequent._nominees("c", 4, head, [(1, 2), (2, 1)], 1, 64).hopeful


def test_distinct_values_are_not_shuffled(spark, plan_text):
    """Rows that leave the tasks are sketches and candidates, however many distinct values there are."""
    df = table(spark, {"c": ["hot"] * 3000 + [f"x{i}" for i in range(30000)]}, 4)
    row = frequent.sketches(df, 64).first()
    about = frequent._nominees("c", row["n"], bytes(row["head"]), [(x["item"], x["count"]) for x in row["items"]], 1, 64)
    assert len(about.hashes) == 1 and about.hopeful
    plan = plan_text(frequent.candidate_counts(df, [about]), "simple").splitlines()
    at = [i for i, line in enumerate(plan) if "hashpartitioning(column_name" in line]
    assert len(at) == 1  # the only shuffle, above the partial counts of what the semi join let through
    below = "\n".join(plan[at[0]:])
    assert "partial_count" in below and "BroadcastHashJoin" in below and "LeftSemi" in below
    sketch_plan = plan_text(frequent.sketches(df, 64), "simple")
    assert "approx_top_k_accumulate" in sketch_plan
    assert "hashpartitioning(column_name" in sketch_plan and "digest" not in sketch_plan


def test_full_count_is_limited_before_the_shuffle(spark, plan_text):
    plan = plan_text(frequent.counted_fully(table(spark, {"c": ["a", "b"]}), 3), "simple")
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limits) and "partial_count" in plan


def test_no_values_and_bad_k(spark):
    none = spark.createDataFrame([], "column_name string, value string")
    assert frequent.top_values(none, 3).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "s string")
    assert profile.topk_values(nulls).count() == 0
    with pytest.raises(ValueError, match="k must be"):
        frequent.top_values(none, 0)
