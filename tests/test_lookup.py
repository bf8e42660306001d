import random

import pytest
from pyspark.sql import functions as F

from driftspark.operators import drift, ledger, lookup


@pytest.fixture
def as_on_large_data(spark):
    """No broadcast by size and no coalescing of small partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("share", [0.001, 0.05, 0.5])
def test_left_join_with_hot_and_null_keys(spark, monkeypatch, share):
    monkeypatch.setattr(lookup, "HOT_SHARE", share)
    rng = random.Random(4)
    keys = ["hot"] * 40 + ["lost"] * 30 + list("abcdefgh") * 4 + [None] * 5
    rows = [(i, k, rng.choice([1, 2])) for i, k in enumerate(keys)]
    table = {(k, s): f"{k}{s}" for k in ["hot", "a", "b", "zz"] for s in (1, 2)}
    left = spark.createDataFrame(rows, "i INT, k STRING, s INT")
    right = spark.createDataFrame([(k, s, v) for (k, s), v in table.items()], "k STRING, s INT, v STRING")
    joined = lookup.join_lookup(left, right, ["k", "s"], lookup.key_counts(left, ["k", "s"]), "i")
    assert joined.columns == ["i", "k", "s", "v"]
    assert sorted(joined.collect()) == [(i, k, s, table.get((k, s))) for i, k, s in rows]


def largest_part(df):
    # The looked-up column is used, or the join would be optimized away.
    placed = df.select(F.spark_partition_id().alias("part"), "first_ordinal")
    used = [F.count(F.lit(1)).alias("n"), F.sum("first_ordinal")]
    counts = [r["n"] for r in placed.groupBy("part").agg(*used).collect()]
    return max(counts) / sum(counts)


@pytest.mark.parametrize("hot", ["hot", None])
def test_a_hot_key_is_spread_over_tasks(spark, as_on_large_data, hot):
    """Half of the rows have one key, or none; no task gets near half of them."""
    n = 80_000
    i = F.col("id")
    plan = spark.range(n).select(
        i.alias("ordinal"), i.cast("string").alias("logical_name"),
        F.when(i % 2 == 0, F.lit(hot)).otherwise(i.cast("string")).alias("dest_path"),
        F.lit("g").alias("group"), F.lit(False).alias("optional"),
    )
    firsts = ledger.first_per_path(plan)
    found = firsts.select("dest_path", "first_ordinal")
    counts = firsts.select("dest_path", F.col("n_items").alias("n"))
    plain = plan.join(found, "dest_path", "left")
    spread = lookup.join_lookup(plan, found, ["dest_path"], counts, "logical_name")
    assert largest_part(spread) < 0.2
    if hot is None:
        return
    assert largest_part(plain) > 0.5
    assert spread.exceptAll(plain.select(spread.columns)).count() == 0
    assert ledger.duplicate_paths(plan).count() == n // 2 - 1


def test_hot_group_in_the_drift_report(spark, as_on_large_data):
    i = F.col("id")
    entries = spark.range(3000).select(
        F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("group"), i.alias("ordinal"),
        F.concat(F.lit("t"), i.cast("string")).alias("table_name"),
        F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("columns"),
        F.lit("f").alias("schema_fingerprint"),
    )
    diffs = drift.column_diffs(entries).collect()
    assert len(diffs) == 500
    assert {(r["group"], r["from_table"], *r["added_columns"], *r["removed_columns"]) for r in diffs} == {("hot", "t0", "c", "a")}
