import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from driftspark.operators import profile, sides
from driftspark.plans import training
from driftspark.sources import artifacts, blocks, files, games, splits, tables
from driftspark.streaming import audit


def nba_game(season, i, **changes):
    game = {
        "game_id": f"{season}_{i:04d}", "season": season, "date": f"2021-{1 + i % 12:02d}-{1 + i % 28:02d}",
        "home_team": "AAA", "away_team": "BBB", "home_score": 100 + i % 7, "away_score": 100 + i % 5,
        "home_fg_pct": 0.45, "away_fg_pct": 0.44, "home_3p_pct": 0.35, "away_3p_pct": 0.36,
        "home_rebounds": 40 + i % 3, "away_rebounds": 41, "home_assists": 20, "away_assists": 21,
        "home_turnovers": 12, "away_turnovers": 13,
    }
    game.update(changes)
    return {k: v for k, v in game.items() if v is not None}


@pytest.fixture
def season_files(tmp_path):
    folder = tmp_path / "raw" / "nba"
    folder.mkdir(parents=True)
    for season, n in (("2020-21", 30), ("2021-22", 20)):
        data = [nba_game(season, i, home_assists=None if i == 3 else 20) for i in range(n)]
        (folder / f"{season}.json").write_text(json.dumps(data))
    (folder / "notes.txt").write_text("x")
    return str(tmp_path / "raw")


def test_season_files(spark, season_files):
    df = games.read_season_files(spark, season_files, "nba")
    assert df.count() == 50 and dict(df.dtypes)["home_assists"] == "bigint"
    assert {r["home_assists"] for r in df.where("game_id LIKE '%_0003'").collect()} == {0}


def test_missing_and_empty_folders(spark, season_files, tmp_path):
    with pytest.raises(ValueError, match="no data for sport"):
        games.read_season_files(spark, season_files, "nfl")
    (tmp_path / "raw" / "nfl").mkdir()
    with pytest.raises(ValueError, match="no games for sport"):
        games.read_season_files(spark, season_files, "nfl")


def test_landed_games_prune_by_season(spark, season_files, tmp_path, plan_text):
    path = str(tmp_path / "landed")
    df = games.read_season_files(spark, season_files, "nba").withColumn("season", F.replace("season", F.lit("-"), F.lit("/")))
    games.write_games(df, path, "nba")
    back = games.read_games(spark, path, "nba")
    assert sorted(back.columns) == sorted(df.columns)
    assert back.exceptAll(df.select(back.columns)).count() == 0 and back.count() == 50
    assert {p.name for p in (tmp_path / "landed" / "sport=nba").iterdir()} == {"season_dir=2020-21", "season_dir=2021-22"}
    one = spark.read.parquet(path).where("sport = 'nba' AND season_dir = '2020-21'")
    assert "PartitionFilters: [isnotnull(sport" in plan_text(one)


def test_sports_and_seasons_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "landed")
    nba = spark.createDataFrame([("a", "2020"), ("b", "2021")], "game_id STRING, season STRING")
    games.write_games(nba, path, "nba")
    games.write_games(nba.withColumn("yards", F.lit(3)), path, "nfl")
    games.write_games(spark.createDataFrame([("c", "2021")], nba.schema), path, "nba")
    assert sorted(games.read_games(spark, path, "nba").collect()) == [("a", "2020"), ("c", "2021")]
    assert sorted(games.read_games(spark, path, "nfl").collect()) == [("a", "2020", 3), ("b", "2021", 3)]


def test_a_repeated_run_replaces_its_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    for run, n in (("one", 3), ("two", 2), ("one", 3)):
        artifacts.write_artifacts({"plan": spark.range(n)}, path, run)
    assert artifacts.read_artifact(spark, path, "plan", "one").count() == 3
    assert artifacts.read_artifact(spark, path, "plan").count() == 5


def test_run_folders_stay_in_place():
    assert artifacts.run_folder("o", "s", "release/v1", "f") == "o/s/release_v1/f"
    assert artifacts.run_folder("o", "s", "../x", "f") == "o/s/.._x/f"
    assert artifacts.run_folder("o", "s", "..", "f") == "o/s/__/f"


def test_exported_splits_keep_quotes(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', " d ", "train"), ("two\nlines", "e", "val")], "s STRING, t STRING, split STRING")
    paths = splits.export_csv(rows, str(tmp_path), "nba", "win")
    back = splits.read_csv_splits(spark, paths, rows.drop("split").schema)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_from_files_to_shift(spark, season_files, tmp_path):
    df = games.read_season_files(spark, season_files, "nba")
    rows = training.build_dataset(df, "nba", "score_diff", ["3p_pct", "assists"])
    assert "assists" not in rows.columns and "opp_assists" in rows.columns
    splits.write_splits(rows, str(tmp_path / "splits"))
    stored = splits.read_splits(spark, str(tmp_path / "splits"))
    sizes = {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()}
    assert sizes == {"train": 60, "val": 20, "test": 20}
    result = training.train(stored, "score_diff", "linear", True, str(tmp_path / "model"))
    overall = result.shift.where("segment = 'overall' AND metric = 'mse'").first()["value"]
    assert overall >= 0 and result.trained.features[0] == "is_home" and "split" not in result.trained.features
    paths = splits.export_csv(stored, str(tmp_path / "csv"), "nba", "score_diff", ["3p_pct", "assists"])
    assert paths["val"].endswith("/nba_score_diff_val_drop_3p_pct_assists")
    again = splits.read_csv_splits(spark, paths, stored.drop("split").schema)
    assert again.exceptAll(stored.select(again.columns)).count() == 0 and again.count() == 100


def test_names_and_missing_tables(spark, tmp_path):
    assert splits.dataset_name("nba", "win") == "nba_win"
    assert splits.dataset_name("nba", "win", ["a", "b"]) == "nba_win_drop_a_b"
    with pytest.raises(ValueError, match="build the dataset first"):
        splits.read_splits(spark, str(tmp_path / "none"))


CSV = "id,share,flag,name,gap,day\n1,0.5,True,x,NA,2021-01-01\n2,nan,False,NULL,,2021-01-02\n3,1e3,True,\"a,b\",n/a,2021-01-03\n"


def test_csv_types_and_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = tables.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "share": "double", "flag": "boolean", "name": "string", "gap": "double", "day": "string"}
    assert [r["name"] for r in df.orderBy("id").collect()] == ["x", None, "a,b"]
    assert [r["share"] for r in df.orderBy("id").collect()] == [0.5, None, 1000.0]
    classes = profile.schema_of(df)[1]
    assert classes == {"id": "int", "share": "float", "flag": "bool", "name": "string", "gap": "float", "day": "string"}


def test_csv_cells_with_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,s\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,plain\n')
    df = tables.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("id", "bigint"), ("s", "string")]
    assert [r["s"] for r in df.orderBy("id").collect()] == ['say "hi", ok', "two\nlines", "plain"]


def test_whole_table_decides_the_type(spark, tmp_path):
    (tmp_path / "t.csv").write_text("v\n" + "\n".join(str(i) for i in range(100_000)) + "\nx\n")
    whole = tables.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert whole.count() == 100_001 and whole.dtypes == [("v", "string")]


def test_json_repeated_keys_empty_arrays_and_odd_names(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "a": 2, "OBJECT<k": 3}]')
    assert tables.read_json_table(spark, str(tmp_path / "t.json")).collect() == [(3, 2)]
    texts = spark.createDataFrame([("e", "[]"), ("f", '[{"a": 1, "a": "x"}, null]')], "p STRING, value STRING")
    found = {r["p"]: r for r in tables.json_file_schemas(texts, "value", "p").collect()}
    assert (found["e"]["n_rows"], found["e"]["columns"]) == (0, [])
    assert found["f"]["columns"] == ["a"] and found["f"]["dtypes"] == {"a": "string"}


def test_json_table(spark, tmp_path):
    data = [{"a": {"b": 1, "c": {"d": "x"}}, "list": [1, 2], "n": 1.5}, {"a": {"b": 2}, "n": 2, "z": None}]
    (tmp_path / "t.json").write_text(json.dumps(data))
    df = tables.read_json_table(spark, str(tmp_path / "t.json"))
    assert dict(df.dtypes) == {"a.b": "bigint", "a.c.d": "string", "list": "array<bigint>", "n": "double", "z": "string"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, "x", [1, 2], 1.5, None), (2, None, None, 2.0, None)]
    (tmp_path / "one.json").write_text('{"k": true}')
    assert tables.read_json_table(spark, str(tmp_path / "one.json")).collect() == [(True,)]
    (tmp_path / "plain.json").write_text("[3, 1, 2]")
    assert sorted(r["value"] for r in tables.read_json_table(spark, str(tmp_path / "plain.json")).collect()) == [1, 2, 3]


def test_format_dispatch(spark, tmp_path):
    (tmp_path / "t.CSV").write_text(CSV)
    (tmp_path / "bad.json").write_text("{not: valid json")
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    (tmp_path / "x.zip").write_bytes(b"")
    (tmp_path / "empty.csv").write_bytes(b"")
    spark.range(3).write.parquet(str(tmp_path / "ok.parquet"))

    def note(name):
        return tables.read_table(spark, str(tmp_path / name))[1]

    assert tables.read_table(spark, str(tmp_path / "t.CSV"))[0].count() == 3
    assert tables.read_table(spark, str(tmp_path / "ok.parquet"))[0].count() == 3
    assert note("bad.json").startswith("E_JSON_PARSE")
    assert note("bad.parquet").startswith("E_SCHEMA_UNSUPPORTED")
    assert note("x.zip") == "unsupported extension: .zip"
    empty, _ = tables.read_table(spark, str(tmp_path / "empty.csv"))
    assert empty is None or empty.count() == 0


def test_leaves_of_a_json_type():
    ddl = "OBJECT<a: OBJECT<o: ARRAY<OBJECT<k: BIGINT>>, w: OBJECT<q: STRING>, `x y`: ARRAY<VARIANT>, z: VOID>, b: DECIMAL(21,1), c: BOOLEAN, e: OBJECT<>, `odd:<``>`: DOUBLE>"
    assert [(x["name"], x["kind"]) for x in tables.json_leaves(ddl)] == [
        ("a.o", "object"), ("a.w.q", "string"), ("a.x y", "object"), ("a.z", "string"), ("b", "float"), ("c", "bool"),
        ("e", "object"), ("odd:<`>", "float"),
    ]
    assert tables.json_leaves("BIGINT") == [{"name": "value", "kind": "int"}]
    assert tables.json_leaves("ARRAY<BIGINT>") == [{"name": "value", "kind": "object"}]


def test_many_json_files_in_one_job_match_one_by_one(spark, tmp_path):
    texts = {"a": '[{"x": 1, "y": {"z": "s"}}, {"x": 2.5}]', "b": '{"only": [1]}', "c": "[1, 2]"}
    df = spark.createDataFrame(list(texts.items()), "file STRING, value STRING")
    rows = {r["file"]: r for r in tables.json_file_schemas(df, "value", "file").collect()}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        table = tables.read_json_table(spark, str(tmp_path / f"{name}.json"))
        columns, dtypes = profile.schema_of(table)
        assert (rows[name]["columns"], rows[name]["dtypes"]) == (columns, dtypes)
        assert rows[name]["schema_fingerprint"] == profile.fingerprint_of(columns, dtypes)
        assert rows[name]["n_rows"] == table.count()


def test_inventory_hashes_named_files_only(spark, tmp_path):
    contents = {"a.txt": b"x" * 10, "sub dir/b%20é+.bin": bytes(range(256)) * 9000, "sub dir/deep/c": b""}
    for name, data in contents.items():
        target = tmp_path / "root" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (tmp_path / "outside").write_text("x")
    (tmp_path / "root" / "unnamed").write_text("x")
    names = [*contents, "a.txt", "none", "sub dir", "../outside", str(tmp_path / "outside")]
    paths = spark.createDataFrame([(n,) for n in names], "dest_path STRING")
    for root in (str(tmp_path / "root"), f"file://{tmp_path}/root/", f"file:{tmp_path}/root"):
        rows = files.file_inventory(paths, root).collect()
        assert {r["dest_path"]: (r["sha256"], r["size_bytes"]) for r in rows} == {
            p: (hashlib.sha256(d).hexdigest(), len(d)) for p, d in contents.items()
        }
        assert len(rows) == 3 and all(r["mtime_utc"].endswith("Z") for r in rows)


def test_hashing_is_dealt_by_bytes_into_a_given_number_of_tasks(spark, tmp_path):
    paths = spark.createDataFrame([(f"p{i}",) for i in range(100)], "dest_path STRING")
    assert files.file_inventory(paths, "/nowhere").count() == 0
    assert files.file_stats(paths, "/nowhere", tasks=13).rdd.getNumPartitions() == 13
    # A third of the bytes in few files, the rest in many of all sizes.
    sizes = [(f"f{i}", (i % 97) * 50_000 + 7, None) for i in range(3000)] + [(f"g{i}", 3_000_000, None) for i in range(900)]
    stats = spark.createDataFrame(sizes, "dest_path STRING, size_bytes BIGINT, mtime_utc STRING")
    loads = files.dealt_by_bytes(stats, 40).groupBy(F.spark_partition_id()).agg(F.sum("size_bytes").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(loads) == 40 and sum(r["rows"] for r in loads) == 3900
    assert max(r["n"] for r in loads) < 2 * sum(r["n"] for r in loads) / 40


def test_ledger_and_artifacts(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert artifacts.read_ledger(spark, path).count() == 0
    artifacts.write_ledger(spark.createDataFrame([("a", "h", 1, "t")], artifacts.LEDGER_SCHEMA), path)
    assert artifacts.read_ledger(spark, path).count() == 1
    (tmp_path / "corrupt").write_text("{")
    assert artifacts.read_ledger(spark, str(tmp_path / "corrupt")).count() == 0
    for run in ("r1", "r2"):
        artifacts.write_artifacts({"plan": spark.range(3)}, str(tmp_path / "out"), run)
    assert artifacts.read_artifact(spark, str(tmp_path / "out"), "plan").count() == 6
    assert artifacts.read_artifact(spark, str(tmp_path / "out"), "plan", "r1").count() == 3
    assert artifacts.run_folder("o", "s", "r", "f") == "o/s/r/f"


def test_audit_lines_and_stream(spark, tmp_path):
    log, table, checkpoint = (str(tmp_path / n) for n in ("log", "table", "checkpoint"))
    rows = [("r1", "resolve", "start", None, {"planned": "3"}), ("r1", "download", "failed", "error", {"msg": "given"})]

    def append(part):
        df = spark.createDataFrame(part, "run_id STRING, phase STRING, msg STRING, level STRING, extras MAP<STRING,STRING>")
        base = {"run_id": F.col("run_id"), "ts_utc": F.lit("2024-01-01T00:00:00Z"), "phase": F.col("phase"), "msg": F.col("msg"), "level": F.col("level")}
        artifacts.write_audit(df.select(artifacts.audit_line(base, F.col("extras")).alias("line")), log)

    append(rows)
    lines = sorted(r["value"] for r in spark.read.text(log).collect())
    assert lines[1] == '{"msg":"start","phase":"resolve","planned":"3","run_id":"r1","ts_utc":"2024-01-01T00:00:00Z"}'
    assert '"msg":"given"' in lines[0]
    audit.stream_audit(spark, log, table, checkpoint).awaitTermination()
    append(rows[:1])
    audit.stream_audit(spark, log, table, checkpoint).awaitTermination()
    audit.stream_audit(spark, log, table, checkpoint).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == 3
    assert stored.where("level = 'error'").first()["phase"] == "download"


def test_unpivot_of_read_games_keeps_types(spark, season_files):
    rows = sides.two_sided_unpivot(games.read_season_files(spark, season_files, "nba"), sides.stats_of("nba"))
    kinds = dict(rows.dtypes)
    assert (kinds["fg_pct"], kinds["opp_turnovers"], kinds["target"]) == ("double", "bigint", "int")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_json_elements_block_by_block(block):
    def elements(text):
        stream = io.BytesIO(text.encode())
        return list(blocks.json_elements(stream.read, block))

    assert elements('[{"a": 1}, 12, "x,]", [1, 2] , null]') == ['{"a": 1}', "12", '"x,]"', "[1, 2]", "null"]
    assert elements(" [] ") == [] and elements('\ufeff{"é": [1]}') == ['{"é": [1]}'] and elements("12") == ["12"]
    for broken in ("", "[", "[1", "[1,", "[1 2]", "{not: json", "[1] x", "[1,]", '{"a":'):
        with pytest.raises(ValueError):
            elements(broken)


def test_only_planned_json_files_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1, "k": 2}, {"k": "x"}]')
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("[{}, {")
    (tmp_path / "lost").mkdir()
    asked = spark.createDataFrame([("a.json", 1), ("b.json", 2), ("c.json", 3)], "dest_path STRING, ordinal INT")
    found = blocks.planned_json(asked, str(tmp_path)).collect()
    assert sorted((r.ordinal, r.text or "", r.broken) for r in found) == [
        (1, "", False), (1, '{"k": "x"}', False), (1, '{"k": 1, "k": 2}', False), (2, "", False), (3, "", True), (3, "{}", False),
    ]


def test_a_json_file_beyond_one_value(spark, tmp_path):
    """150 MB, more than the engine takes as one value."""
    line = json.dumps({"n": 1, "text": "x" * 10_000})
    with (tmp_path / "big.json").open("w") as out:
        out.write("[" + ",".join([line] * 15_000) + "]")
    asked = spark.createDataFrame([("big.json",)], "dest_path STRING")
    items = blocks.planned_json(asked, str(tmp_path), tasks=1).withColumn("item", F.try_parse_json("text"))
    assert items.where("broken or (text is not null and item is null)").count() == 0
    assert tables.item_schemas(items, "dest_path").first()["n_rows"] == 15_000
