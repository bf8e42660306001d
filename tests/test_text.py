import hashlib
import json
import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftspark.functions import errors, text


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r["r"] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("value,kind", [
    ("A.PARQUET", "parquet"), ("a.csv", "csv"), ("a.json", "json"), ("a.zip", "zip"), ("a.tar", "tar"),
    ("a.tar.gz", "tar"), ("a.tgz", "tar"), ("a.gz", "unknown"), ("", "unknown"),
])
def test_expected_type(spark, value, kind):
    assert column(spark, [value], text.expected_type) == [kind]


def test_split_trim(spark):
    assert column(spark, ["a, b ,c", " x ", ""], text.split_trim) == [["a", "b", "c"], ["x"], [""]]


def test_sanitize_name(spark):
    values = ["  release/v1.0 beta ", "été-2021_x", "a" * 200, "²½漢", "\tv1\n"]
    expected = ["release_v1.0_beta", "été-2021_x", "a" * 128, "²½漢", "v1"]
    assert column(spark, values, text.sanitize_name) == expected


def test_commit_ids(spark):
    values = ["a" * 40, " " + "A1" * 20 + " ", "abcdef1", "abcdef12345", "abcdefg", "0x12345", "main", "1234567890"]
    assert column(spark, values, text.is_commit_id) == [True, True, True, False, False, False, False, True]
    assert column(spark, values, text.is_pinned_ref) == [True, True] + [False] * 6


def test_canonical_json(spark):
    values = ['{"b": 1, "a": [1, 2], "é": {"z": null, "y": true}}', "no json"]
    assert column(spark, values, text.canonical_json) == ['{"a":[1,2],"b":1,"é":{"y":true,"z":null}}', None]


def normalized(value):
    if isinstance(value, dict):
        return {k: normalized(v) for k, v in value.items()}
    if isinstance(value, list):
        return sorted((normalized(v) for v in value), key=dumped)
    return value


def dumped(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=5),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=3), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(json_values, min_size=20, max_size=40))
def test_scope_normalization_of_any_nesting(spark, values):
    texts = [json.dumps(v) for v in values]
    expected = [dumped(normalized(v)) for v in values]
    assert column(spark, texts, text.normalize_scope) == expected
    prints = column(spark, texts, text.scope_fingerprint)
    assert prints == [hashlib.sha256(e.encode()).hexdigest()[:16] for e in expected]


def test_scope_fingerprint_ignores_order_but_not_type(spark):
    scopes = [
        '{"datasets":["pbp_any"],"seasons":[2023,2022]}', '{"seasons":[2022,2023],"datasets":["pbp_any"]}',
        '{"datasets":["pbp_any"],"seasons":["2023",2022]}', '{"datasets":["pbp_any"],"seasons":[2023,2022,2022]}', "{",
    ]
    a, b, c, d, bad = column(spark, scopes, text.scope_fingerprint)
    assert a == b and len({a, c, d}) == 3 and bad is None


segments = st.sampled_from(["a", "b", "..", ".", ""])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(segments, min_size=1, max_size=6).map("/".join), min_size=30, max_size=60))
def test_safe_paths(spark, paths):
    def safe(path):
        if not path or path.startswith("/"):
            return False
        parts = path.split("/")
        # Every prefix stays at or below the base.
        return all(not posixpath.normpath("/".join(parts[:i])).startswith("..") for i in range(1, len(parts) + 1))

    assert column(spark, paths, text.is_safe_path) == [safe(p) for p in paths]


def test_known_paths(spark):
    paths = ["a/../b", "../escape.txt", "/etc/x", "", None, "a/../../b", "a..b/c"]
    assert column(spark, paths, text.is_safe_path) == [True, False, False, False, False, False, True]


def test_utc_stamp(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678' AS t")
    assert df.select(text.utc_stamp(F.col("t")).alias("s")).first()["s"] == "2024-01-02T03:04:05Z"


def test_error_record(spark):
    df = spark.createDataFrame([({"a": "1"}, "u", ""), ({"severity": "fatal"}, "", "p")], "d MAP<STRING,STRING>, u STRING, p STRING")
    record = errors.error_record(F.lit("E_IO"), F.lit("m"), F.col("d"), severity=F.lit("warn"), url=F.col("u"), path=F.col("p"))
    first, second = [r["r"] for r in df.select(record.alias("r")).collect()]
    assert first["detail"] == {"a": "1", "retryable": "false", "severity": "warn"}
    assert (first["url"], first["path"]) == ("u", None)
    assert second["detail"] == {"severity": "fatal", "retryable": "false"} and second["path"] == "p"
    wrapped = errors.error_record(F.lit("E_IO"), F.lit("m"), errors.wrap_detail(F.lit("text")), retryable=F.lit(True))
    detail = df.select(wrapped.alias("r")).first()["r"]["detail"]
    assert detail == {"detail": "text", "retryable": "true", "severity": "error"}


def test_codes():
    codes = [v for k, v in vars(errors).items() if k.isupper() and isinstance(v, str)]
    assert len(codes) == len(set(codes)) == 29 and all(c.startswith("E_") for c in codes)
