import pytest

from driftspark.operators import ledger, runs

PLAN = "ordinal INT, logical_name STRING, dest_path STRING, group STRING, optional BOOLEAN"
LEDGER = "dest_path STRING, sha256 STRING, size_bytes BIGINT, mtime_utc STRING"
STORED = "dest_path STRING, sha256 STRING, size_bytes BIGINT"


def frames(spark, plan, known, stored):
    return (
        spark.createDataFrame(plan, PLAN),
        spark.createDataFrame([(p, s, 1, "t") for p, s in known], LEDGER),
        spark.createDataFrame([(p, s, 1) for p, s in stored], STORED),
    )


def report(spark, plan, known, stored, require_360=False):
    rows = ledger.integrity_report(*frames(spark, plan, known, stored), require_360).collect()
    return [(r["code"], r["logical_name"], r["dest_path"]) for r in rows]


def test_three_sixty_is_required_on_request_only(spark):
    plan = [(1, "ok", "a", "events", False), (2, "opt", "b", "lineups", True), (3, "t", "c", "three-sixty", True)]
    known, stored = [("a", "h")], [("a", "h")]
    assert report(spark, plan, known, stored) == []
    assert report(spark, plan, known, stored, True) == [
        ("E_CHECKSUM_RECORD_MISSING", "t", "c"), ("E_REQUIRED_ASSET_MISSING", "t", "c"),
    ]


def test_missing_file_with_a_ledger_row_is_reported_by_both_checks(spark):
    plan = [(1, "x", "a", "g", False)]
    assert report(spark, plan, [("a", "h")], []) == [("E_FILE_MISSING", "x", "a"), ("E_REQUIRED_ASSET_MISSING", "x", "a")]


@pytest.mark.parametrize("recorded", ["other", "", None])
def test_mismatch_is_reported_once(spark, recorded):
    plan = [(1, "x", "a", "g", False), (2, "y", "b", "g", False)]
    found = report(spark, plan, [("a", recorded), ("b", "h")], [("a", "h"), ("b", "h")])
    assert found == [("E_CHECKSUM_MISMATCH", "x", "a")]


def test_optional_and_unplanned_files_are_swept(spark):
    plan = [(1, "x", "a", "g", True)]
    found = report(spark, plan, [("a", "1"), ("b", "2"), ("c", "3")], [("a", "0"), ("b", "0")])
    assert found == [("E_CHECKSUM_MISMATCH", None, "b"), ("E_CHECKSUM_MISMATCH", "x", "a"), ("E_FILE_MISSING", None, "c")]


def test_unsafe_paths(spark):
    plan = [(1, "x", "../a", "g", False), (2, "y", "/b", "g", True)]
    assert report(spark, plan, [("../a", "1")], []) == [("E_UNSAFE_DEST_PATH", "x", "../a")]
    unsafe = ledger.unsafe_paths(spark.createDataFrame(plan, PLAN)).collect()
    assert {r["logical_name"] for r in unsafe} == {"x", "y"}


def test_duplicates_keep_the_first(spark):
    plan = [(3, "c", "a", "g", False), (1, "first", "a", "g", True), (2, "b", "a", "g", False), (4, "none", "", "g", False)]
    rows = ledger.duplicate_paths(spark.createDataFrame(plan, PLAN)).collect()
    assert {(r["logical_name_a"], r["logical_name_b"], r["code"]) for r in rows} == {
        ("first", "b", "E_JSON_PARSE"), ("first", "c", "E_JSON_PARSE"),
    }
    # The first item is optional, so nothing is required at that path.
    assert [c for c, _, _ in report(spark, plan, [], [])] == ["E_JSON_PARSE", "E_JSON_PARSE"]


def test_paths_meet_without_ranking(spark, plan_text):
    plan = plan_text(ledger.duplicate_paths(spark.createDataFrame([(1, "x", "a", "g", False)], PLAN)), "simple")
    assert "Window" not in plan and "partial_min" in plan


def test_skip_needs_file_and_hash(spark):
    plan = [(i, p, p, "g", False) for i, p in enumerate("abcd")]
    known = ledger.skip_known(*frames(spark, plan, [("a", "h"), ("b", "h"), ("c", "")], [("a", "h"), ("c", "h"), ("d", "h")]))
    assert {r["dest_path"]: r["known"] for r in known.collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", 1, "t1"), ("b", "1", 1, "t1")], LEDGER)
    new = spark.createDataFrame([("b", "2", 2, "t2"), ("b", "3", 3, "t3"), ("c", "4", 4, "t2")], LEDGER)
    rows = {r["dest_path"]: (r["sha256"], r["mtime_utc"]) for r in ledger.ledger_upsert(old, new).collect()}
    assert rows == {"a": ("1", "t1"), "b": ("3", "t3"), "c": ("4", "t2")}


OUTCOMES = "run_id STRING, group STRING, optional BOOLEAN, error_code STRING, skipped BOOLEAN"


def counters(spark, rows, require_360=False):
    judged = runs.optional_policy(spark.createDataFrame(rows, OUTCOMES), require_360)
    row = runs.run_status(runs.run_counters(judged)).first()
    return (row["planned"], row["downloaded"], row["skipped"], row["failed"], row["optional_missing"], row["status"])


GOOD, SKIPPED = ("r", "events", False, None, False), ("r", "events", False, None, True)
OPTIONAL_404 = ("r", "three-sixty", True, "E_HTTP_404", False)
OPTIONAL_429, REQUIRED_404 = ("r", "lineups", True, "E_HTTP_429", False), ("r", "events", False, "E_HTTP_404", False)


@pytest.mark.parametrize("rows,require_360,expected", [
    ([GOOD, SKIPPED], False, (2, 1, 1, 0, 0, "success")),
    ([GOOD, OPTIONAL_404], False, (2, 1, 0, 0, 1, "partial")),
    ([GOOD, OPTIONAL_404], True, (2, 1, 0, 1, 0, "partial")),
    ([GOOD, OPTIONAL_429], False, (2, 1, 0, 1, 0, "partial")),
    ([SKIPPED, REQUIRED_404], False, (2, 0, 1, 1, 0, "failed")),
    ([SKIPPED, OPTIONAL_404], False, (2, 0, 1, 0, 1, "partial")),
])
def test_status(spark, rows, require_360, expected):
    assert counters(spark, rows, require_360) == expected


def test_pinned_gate(spark):
    rows = [("1", "statsbomb-open-data", "main"), ("2", "statsbomb-open-data", "a" * 40), ("3", "nflverse", "pbp"), ("4", "statsbomb-open-data", None)]
    df = spark.createDataFrame(rows, "run_id STRING, source STRING, source_ref STRING")
    assert {r["run_id"] for r in runs.pinned_gate(df).collect()} == {"1", "4"}
    assert runs.pinned_gate(df, allow_floating=True).count() == 0


def test_terms(spark):
    df = spark.createDataFrame([("1", "nflverse"), ("2", "other")], "run_id STRING, source STRING")
    rows = {r["run_id"]: r for r in runs.attribution_lookup(df, runs.terms_table(spark)).collect()}
    assert len(rows["1"]["requirements"]) == 1 and rows["1"]["links"][0]["name"] == "nflverse-data"
    assert rows["2"]["requirements"] == [] and rows["2"]["links"] == []


def test_audit_rollup(spark):
    rows = [("2", "resolve", "a", None), ("1", "resolve", "b", None), ("3", "download", "c", "error")]
    df = spark.createDataFrame(rows, "ts_utc STRING, phase STRING, msg STRING, level STRING")
    found = {tuple(r) for r in runs.audit_rollup(df).collect()}
    assert found == {("resolve", "info", 2, "1", "2"), ("download", "error", 1, "3", "3")}
