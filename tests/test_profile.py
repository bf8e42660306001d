import collections
import datetime
import decimal
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.functions.types import numeric_coerce, type_class
from driftspark.operators import drift, profile

ROWS = [
    (1, 1.5, "a", True, None, decimal.Decimal("1.0")),
    (2, float("nan"), None, False, datetime.date(2021, 1, 1), None),
    (None, None, "b", None, None, None),
    (4, 3.0, "a", True, None, None),
]
SCHEMA = "i INT, `f.x` DOUBLE, s STRING, b BOOLEAN, d DATE, m DECIMAL(5,1)"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_profile_columns(table):
    rows = {r["column_name"]: r for r in profile.profile_table(table, "t").collect()}
    assert [rows[c]["type_class"] for c in rows] == ["int", "float", "string", "bool", "object", "object"]
    assert [rows[c]["null_fraction"] for c in rows] == [0.25, 0.5, 0.25, 0.25, 0.75, 0.75]
    i = rows["i"]
    values = np.array([1, 2, 4.0])
    assert (i["min_value"], i["max_value"]) == (1.0, 4.0)
    assert i["mean_value"] == pytest.approx(values.mean()) and i["std_value"] == pytest.approx(values.std())
    assert rows["f.x"]["mean_value"] == 2.25 and rows["s"]["min_value"] is None


def test_null_sensitive_classes(table):
    rows = {r["column_name"]: r["type_class"] for r in profile.profile_table(table, "t", True).collect()}
    assert rows == {"i": "float", "f.x": "float", "s": "object", "b": "object", "d": "object", "m": "object"}


def test_single_value_has_zero_deviation_and_nulls_have_no_statistics(spark):
    df = spark.createDataFrame([(5, None), (None, None)], "a INT, n INT")
    rows = {r["column_name"]: r for r in profile.numeric_stats(df, "t").collect()}
    assert rows.keys() == {"a"} and rows["a"]["std_value"] == 0.0


def test_empty_table(spark):
    rows = profile.profile_table(spark.createDataFrame([], "a INT, s STRING"), "t").collect()
    assert {(r["n_rows"], r["null_fraction"]) for r in rows} == {(0, 0.0)}
    for schema in ("a INT, s STRING", "a INT"):
        assert profile.topk_values(spark.createDataFrame([], schema)).count() == 0


def test_profile_is_one_aggregation(table, plan_text, tmp_path, spark):
    path = str(tmp_path / "t")
    table.write.parquet(path)
    plan = plan_text(profile.profile_table(spark.read.parquet(path), "t"), "simple")
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def topk(values, k):
    counts = collections.Counter(v for v in values if v is not None)
    key = lambda item: (-item[1], hashlib.sha256(item[0].encode()).hexdigest())
    return [(v, n) for v, n in sorted(counts.items(), key=key)[:k]]


def test_topk_keeps_whole_long_values(spark):
    start = "x" * 300
    values = [start + "a"] * 3 + [start + "b"] * 2 + ["short"] * 2 + [start + str(i) for i in range(20)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "s STRING")
    found = [(r["value"], r["n"]) for r in profile.topk_values(df, 5).orderBy("position").collect()]
    assert found == topk(values, 5)


def test_ties_follow_one_rule_at_all_lengths(spark):
    for head in ("", "x" * 1000):
        values = [head + c for c in "abcdefgh"]
        df = spark.createDataFrame([(v,) for v in values], "s STRING")
        found = [(r["value"], r["n"]) for r in profile.topk_values(df, 4).orderBy("position").collect()]
        assert found == topk(values, 4)


def test_topk_of_truth_values_and_nulls(table):
    rows = profile.topk_values(table, columns=["b"], null_label="None").orderBy("position").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("True", 2), ("False", 1), ("None", 1)]


def test_fingerprint_bytes(spark, table):
    entry = profile.schema_entry(table, "t").first()
    columns, dtypes = profile.schema_of(table)
    payload = json.dumps({"columns": columns, "dtypes": dict(sorted(dtypes.items()))}, separators=(",", ":"))
    assert entry["schema_fingerprint"] == hashlib.sha256(payload.encode()).hexdigest()
    assert entry["schema_fingerprint"] == profile.fingerprint_of(columns, dtypes)
    assert entry["null_fraction"]["f.x"] == 0.5 and entry["basic_stats"].keys() == {"i", "f.x"}
    moved = profile.schema_entry(table.select("s", "i", "`f.x`", "b", "d", "m"), "t").first()
    assert moved["schema_fingerprint"] != entry["schema_fingerprint"]


def test_entry_without_columns(spark):
    entry = profile.schema_entry(spark.range(3).select(), "t").first()
    assert entry["columns"] == [] and entry["schema_fingerprint"] == profile.fingerprint_of([], {})


@pytest.mark.parametrize("data_type,kind", [
    (T.BooleanType(), "bool"), (T.ByteType(), "int"), (T.LongType(), "int"), (T.FloatType(), "float"),
    (T.StringType(), "string"), (T.TimestampNTZType(), "object"), (T.DecimalType(4, 1), "object"),
    (T.ArrayType(T.LongType()), "object"), (T.BinaryType(), "object"), (T.VariantType(), "object"),
])
def test_type_class(data_type, kind):
    assert type_class(data_type) == kind


def test_numeric_coercion(spark):
    texts = {" 1.5 ": 1.5, "-2": -2.0, "3e2": 300.0, ".5": 0.5, "1d": None, "0x1p3": None, "abc": None, "": None, "nan": None, None: None, "7.": 7.0}
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = {r["t"]: r["v"] for r in df.select("t", numeric_coerce(F.col("t")).alias("v")).collect()}
    assert found == texts


def entries(spark, rows):
    return spark.createDataFrame(rows, "group STRING, ordinal BIGINT, table_name STRING, columns ARRAY<STRING>, schema_fingerprint STRING")


def test_drift_against_the_first_table_in_plan_order(spark):
    df = entries(spark, [
        ("g", 2, "t2", ["a", "c", "d"], "f2"), ("g", 1, "t1", ["a", "b"], "f1"), ("g", 3, "t3", ["b", "a"], "f3"),
        (None, 1, "u", ["z"], "f1"), ("g", 4, "t4", ["a", "b"], "f1"),
    ])
    diffs = [tuple(r) for r in drift.column_diffs(df).collect()]
    assert diffs == [("g", "t1", "t2", ["c", "d"], ["b"])]
    counts = {(r["group"], r["schema_fingerprint"]): r["n_tables"] for r in drift.fingerprint_histogram(df).collect()}
    assert counts == {("g", "f1"): 2, ("g", "f2"): 1, ("g", "f3"): 1, ("default", "f1"): 1}
    report = [(r["group"], r["section"], r["n_tables"]) for r in drift.drift_report(df).collect()]
    assert report[:2] == [("default", "fingerprint", 1), ("default", "tables", 1)]
    assert ("g", "tables", 4) in report and len(report) == 7


def test_missing_group_is_default(spark):
    df = entries(spark, [("g", 1, "t", ["a"], "f")]).drop("group")
    assert drift.fingerprint_histogram(df).first()["group"] == "default"
