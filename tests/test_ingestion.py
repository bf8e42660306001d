import hashlib
import json

import pytest

from driftspark.operators import catalog, events, ledger
from driftspark.plans import ingestion
from driftspark.sources import artifacts
from driftspark.sources.files import file_inventory
from driftspark.streaming import audit

SHA = "a" * 40
LOCATION = dict(source="statsbomb-open-data", owner="o", repo="r", ref=SHA, base="https://raw")
FAILURES = "dest_path STRING, error_code STRING"


def request(**changes):
    fields = dict(
        run_id="run1", source="statsbomb-open-data", ref=SHA, resolved_ref=SHA,
        scope='{"season_ids":[2],"competition_ids":[1]}', started_at_utc="2024-01-01T00:00:00Z",
        finished_at_utc="2024-01-01T00:01:00Z",
    )
    return ingestion.RunRequest(**{**fields, **changes})


@pytest.fixture
def store(tmp_path):
    base = tmp_path / "down loads" / "statsbomb-open-data" / SHA
    contents = {
        "competitions.json": [{"competition_id": 1, "season_id": 2}],
        "matches/1/2.json": [{"match_id": 7}, {"match_id": 7}],
        "events/7.json": [{"id": 1, "type": "x"}, {"id": 2, "type": "y", "late": 1.5}],
        "lineups/7.json": [{"team_id": 1}],
    }
    for name, data in contents.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(json.dumps(data))
    return tmp_path / "down loads"


def tree(spark, store):
    """Catalog and match files are read from storage, as a second run would."""
    place = f"{store}/statsbomb-open-data/{SHA}"
    found = spark.read.option("multiLine", True).json(f"{place}/competitions.json")
    pairs = catalog.expand_pairs(found, [1], [2])
    matches = spark.read.option("multiLine", True).json(f"{place}/matches/1/2.json")
    return ingestion.plan_tree(pairs, matches, LOCATION)


def inventory_of(plan, known, store):
    return file_inventory(ledger.paths_to_check(plan, known), str(store))


def run(spark, store, failures=(), known=None, **changes):
    known = known if known is not None else artifacts.read_ledger(spark, f"{store}/no-ledger")
    return ingestion.ingest(
        spark, request(**changes), tree(spark, store), known,
        spark.createDataFrame(list(failures), FAILURES), str(store),
    )


def test_optional_miss_is_partial(spark, store):
    result = run(spark, store)
    row = result.record.first()
    assert (row["results"]["status"], row["results"]["downloaded_files"], row["results"]["failed_files"]) == ("partial", 4, 0)
    assert row["results"]["optional_missing_files"] == 1 and row["requested_scope"] == '{"competition_ids":[1],"season_ids":[2]}'
    assert row["requirements"] and row["config"]["require_360"] is False
    assert [(r["code"], r["logical_name"], r["optional"]) for r in result.errors.collect()] == [("E_HTTP_404", "three_sixty_7", True)]
    hashes = {r["dest_path"]: r["sha256"] for r in result.ledger.collect()}
    events = store / "statsbomb-open-data" / SHA / "events/7.json"
    assert hashes[f"statsbomb-open-data/{SHA}/events/7.json"] == hashlib.sha256(events.read_bytes()).hexdigest()
    schemas = {r["table_name"]: r for r in result.schemas.where("group IN ('events', 'competitions')").collect()}
    assert schemas["7.json"]["columns"] == ["id", "late", "type"] and schemas["7.json"]["n_rows"] == 2
    assert schemas["competitions.json"]["dtypes"] == {"competition_id": "int", "season_id": "int"}
    assert result.drift.where("section = 'tables'").count() == 4


def test_promoted_group_fails(spark, store):
    row = run(spark, store, require_360=True).record.first()
    assert (row["results"]["status"], row["results"]["failed_files"]) == ("partial", 1)


def test_second_run_skips_what_is_known(spark, store, tmp_path):
    first = run(spark, store)
    path = str(tmp_path / "ledger")
    artifacts.write_ledger(first.ledger, path)
    artifacts.write_artifacts(first.tables(), str(tmp_path / "out"), "run1")
    known = artifacts.read_ledger(spark, path)
    second = run(spark, store, known=known)
    results = second.record.first()["results"]
    assert (results["downloaded_files"], results["skipped_files"], results["status"]) == (0, 4, "partial")
    assert second.ledger.count() == 4
    plan = artifacts.read_artifact(spark, str(tmp_path / "out"), "plan", "run1")
    record = artifacts.read_artifact(spark, str(tmp_path / "out"), "runs", "run1")
    ok, found = ingestion.verify_run(record, plan, known, inventory_of(plan, known, store))
    assert ok and found.count() == 0


def test_known_files_are_not_hashed_again(spark, store):
    first = run(spark, store)
    known = spark.createDataFrame(first.ledger.collect(), first.ledger.schema)
    # Contents change under the same names: a run that read them would see other hashes.
    place = store / f"statsbomb-open-data/{SHA}"
    (place / "events/7.json").write_text("[]")
    (place / "lineups/7.json").write_text("[{}]")
    partly = known.where("dest_path NOT LIKE '%lineups%'")
    second = run(spark, store, known=partly)
    before, after = ({r["dest_path"]: r["sha256"] for r in x.collect()} for x in (known, second.ledger))
    changed = {p for p in before if before[p] != after[p]}
    assert changed == {f"statsbomb-open-data/{SHA}/lineups/7.json"} and before.keys() == after.keys()
    results = second.record.first()["results"]
    assert (results["downloaded_files"], results["skipped_files"]) == (1, 3)


def test_entries_of_a_run(spark, store):
    place = store / f"statsbomb-open-data/{SHA}"
    (place / "events/7.json").write_text('[{"id": NaN, "type": "x"}, {"id": 3, "type": "x"}, {"id": 5}]')
    (place / "lineups/7.json").write_text("[" * 1200 + "]" * 1200)
    result = run(spark, store)
    entry = result.schemas.where("group = 'events'").first()
    assert (entry["logical_name"], entry["n_rows"], entry["columns"]) == ("events_7", 3, ["id", "type"])
    assert entry["null_fraction"] == pytest.approx({"id": 1 / 3, "type": 1 / 3})
    assert entry["basic_stats"]["id"][:] == (3.0, 5.0, 4.0, 1.0) and entry["top_values"] == {"type": [("x", 2)]}
    found = {r["code"]: r for r in result.errors.collect()}
    assert set(found) == {"E_HTTP_404", "E_JSON_TOO_DEEP"}
    miss, deep = found["E_HTTP_404"], found["E_JSON_TOO_DEEP"]
    assert miss["detail"] == {"optional": "true", "retryable": "false", "severity": "error"} and miss["url"].startswith("https://raw/")
    assert (miss["message"], miss["path"]) == ("HTTP 404", miss["dest_path"])
    assert deep["detail"] == {"retryable": "false", "severity": "fatal"} and deep["message"] == "JSON nested too deep"
    # Events of the run, written as lines, taken in by a stream, and the last batch once more.
    rows = [(r["phase"], r["msg"], r["level"]) for r in result.events.collect()]
    assert sorted(rows, key=str) == sorted(
        [("resolve", "start_resolve", None), ("resolve", "resolve_ok", None), ("download", "download_start", None)]
        + [("download", "download_ok", None)] * 4
        + [("download", "optional_missing", "warn"), ("schema", "schema_failed", "warn"), ("finalize", "ingest_complete", None)],
        key=str,
    )
    log, state = str(store / "log"), str(store / "state")
    lines = events.event_lines(result.events)
    artifacts.write_audit(lines, log)
    assert any('"msg":"ingest_complete","phase":"finalize","run_id":"run1","skipped":"0","status":"partial"' in r["line"] for r in lines.collect())
    for _ in range(2):
        audit.roll_up_audit(spark, log, state, str(store / "checkpoint")).awaitTermination()
    audit.merge_batch(audit.parse_audit(spark.read.text(log)), 0, state)
    totals = {(r["phase"], r["level"]): r["n_events"] for r in audit.read_roll_up(spark, state).where("run_id = 'run1'").collect()}
    assert totals == {("resolve", "info"): 2, ("download", "info"): 5, ("download", "warn"): 1, ("schema", "warn"): 1, ("finalize", "info"): 1}
    artifacts.write_audit(events.event_lines(result.events.where("phase = 'schema'")), log)
    audit.roll_up_audit(spark, log, state, str(store / "checkpoint")).awaitTermination()
    assert audit.read_roll_up(spark, state).where("phase = 'schema'").first()["n_events"] == 2


def test_reported_failure(spark, store):
    target = f"statsbomb-open-data/{SHA}/lineups/7.json"
    (store / target).unlink()
    result = run(spark, store, failures=[(target, "E_HTTP_5XX")])
    assert result.record.first()["results"]["status"] == "partial"
    assert {r["code"] for r in result.errors.collect()} == {"E_HTTP_404", "E_HTTP_5XX"}


def test_bad_json_is_an_error_row_and_leaves_the_status(spark, store):
    (store / f"statsbomb-open-data/{SHA}/events/7.json").write_text("{not: valid json")
    result = run(spark, store)
    assert result.record.first()["results"]["status"] == "partial"
    codes = {(r["code"], r["dest_path"].rsplit("/", 2)[-2]) for r in result.errors.collect()}
    assert ("E_JSON_PARSE", "events") in codes
    assert result.drift.where("group = 'events'").count() == 0


def test_dry_run_records_the_plan_only(spark, store):
    result = run(spark, store, dry_run=True)
    assert result.plan.count() == 5 and result.ledger.count() == result.schemas.count() == result.drift.count() == 0
    results = result.record.first()["results"]
    assert results["status"] == "success" and results["downloaded_files"] == results["failed_files"] == 0
    assert [r["msg"] for r in result.events.orderBy("ts_utc", "msg").collect()] == ["resolve_ok", "start_resolve", "dry_run_complete"]


def test_unsafe_destination_stops_the_run(spark, store):
    plan = tree(spark, store).withColumn("dest_path", catalog.F.lit("../escape.txt"))
    with pytest.raises(ValueError, match="E_UNSAFE_DEST_PATH"):
        ingestion.ingest(
            spark, request(), plan, artifacts.read_ledger(spark, f"{store}/none"),
            spark.createDataFrame([], FAILURES), str(store),
        )


def test_gate(spark, store):
    result = run(spark, store)
    inventory = inventory_of(result.plan, result.ledger, store)
    ok, _ = ingestion.verify_run(result.record, result.plan, result.ledger, inventory)
    assert ok
    changed = store / f"statsbomb-open-data/{SHA}/events/7.json"
    changed.write_text("[]")
    ok, found = ingestion.verify_run(result.record, result.plan, result.ledger, inventory_of(result.plan, result.ledger, store))
    assert not ok and [r["code"] for r in found.collect()] == ["E_CHECKSUM_MISMATCH"]
    ok, found = ingestion.verify_run(result.record.where("false"), result.plan, result.ledger, inventory)
    assert not ok and found.first()["code"] == "E_MANIFEST_MISSING"


def test_gate_asks_for_a_pinned_reference(spark, store):
    result = run(spark, store, ref="main")
    inventory = inventory_of(result.plan, result.ledger, store)
    ok, found = ingestion.verify_run(result.record, result.plan, result.ledger, inventory)
    assert not ok and [r["code"] for r in found.collect()] == ["E_FLOATING_REF_DISALLOWED"]
    assert ingestion.verify_run(result.record, result.plan, result.ledger, inventory, allow_floating=True)[0]


def test_tables_of_a_release(spark, tmp_path):
    store = tmp_path / "store"
    folder = store / "nflverse/pbp/pbp"
    folder.mkdir(parents=True)
    spark.createDataFrame([(1, "a", 0.5)], "play INT, team STRING, epa DOUBLE").toPandas().to_parquet(folder / "play_by_play_2021.parquet")
    spark.createDataFrame([(1, "a")], "play INT, team STRING").toPandas().to_parquet(folder / "play_by_play_2022.parquet")
    (folder / "play_by_play_2023.parquet").write_bytes(b"broken")
    listing = spark.createDataFrame(
        [(f"play_by_play_{y}.parquet", f"https://x/{y}", 1) for y in (2021, 2022, 2023)], "name STRING, url STRING, size BIGINT"
    )
    scope = '{"datasets":["pbp"],"seasons":[2021,2022,2023]}'
    plan, problems = ingestion.plan_release(spark.createDataFrame([(1, scope)], "scope_id INT, scope STRING"), listing, "nflverse", "pbp")
    assert problems.count() == 0
    result = ingestion.ingest(
        spark, request(source="nflverse", ref="pbp", scope=scope), plan, artifacts.read_ledger(spark, f"{store}/none"),
        spark.createDataFrame([], FAILURES), str(store),
    )
    assert result.record.first()["results"]["status"] == "success"
    assert [r["code"] for r in result.errors.collect()] == ["E_SCHEMA_UNSUPPORTED"]
    diff = result.drift.where("section = 'diff'").first()
    assert (diff["from_table"], diff["to_table"], diff["removed_columns"]) == ("play_by_play_2021.parquet", "play_by_play_2022.parquet", ["epa"])
    entry = result.schemas.where("table_name = 'play_by_play_2021.parquet'").first()
    assert entry["basic_stats"]["epa"]["max"] == 0.5 and entry["note"] is None


def test_failed_expansion_counts(spark, store):
    frame = spark.createDataFrame([(1, 2)], "competition_id INT, season_id INT")
    assert [r["message"] for r in catalog.expansion_violations(catalog.expand_pairs(frame, [99])).collect()] == [
        "no competition and season match the request"
    ]
    asked = spark.createDataFrame([("x", "3"), ("1", "2")], "competition_id STRING, season_id STRING")
    broken = catalog.expansion_violations(catalog.expand_pairs(frame, pairs=asked), asked)
    none = artifacts.read_ledger(spark, f"{store}/none")
    result = ingestion.ingest(
        spark, request(), tree(spark, store), none, spark.createDataFrame([], FAILURES), str(store), broken
    )
    assert (result.record.first()["results"]["status"], result.record.first()["results"]["failed_files"]) == ("partial", 1)
    assert "E_SCOPE_INVALID" in {r["code"] for r in result.errors.collect()}
    result.errors.write.parquet(f"{store}/errors")


def test_a_lost_ledger_is_not_an_empty_one(spark, store):
    result = run(spark, store)
    known = artifacts.require_ledger(spark, f"{store}/nowhere")
    assert known is None
    ok, found = ingestion.verify_run(result.record, result.plan.where("optional"), known, result.ledger)
    assert not ok and [r["code"] for r in found.collect()] == ["E_CHECKSUMS_MISSING"]
