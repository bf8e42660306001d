import pytest
from pyspark.sql import functions as F

from driftspark.operators import catalog
from driftspark.plans import ingestion

LISTING = [
    ("play_by_play_2021.parquet", "https://x/p21", 10), ("play_by_play_2021.csv", "https://x/c21", 20),
    ("play_by_play_2022.parquet", "https://x/p22", 11), ("roster_2021.parquet", "https://x/r", 5),
    ("play_by_play_2021.parquet.md5", "https://x/m", 1), ("play_by_play_2024.parquet", None, 1),
]


@pytest.fixture
def listing(spark):
    return spark.createDataFrame(LISTING, "name STRING, url STRING, size BIGINT")


def scopes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "scope_id INT, scope STRING")


def resolve(spark, listing, scope):
    return catalog.resolve_assets(catalog.expand_scope(catalog.parse_scopes(scopes(spark, scope))), listing)


def test_parquet_by_default_and_csv_on_request(spark, listing):
    rows = resolve(spark, listing, '{"datasets":["pbp","pbp_csv"],"seasons":[2021]}').collect()
    assert {(r["dataset"], r["status"], r["name"]) for r in rows} == {
        ("pbp", "found", "play_by_play_2021.parquet"), ("pbp_csv", "found", "play_by_play_2021.csv"),
    }


def test_both_formats_are_ambiguous(spark, listing):
    resolved = resolve(spark, listing, '{"datasets":["pbp_any"],"seasons":["2021", 2022]}')
    assert {(r["season"], r["status"], r["n_assets"]) for r in resolved.collect()} == {(2021, "ambiguous", 2), (2022, "found", 1)}
    names = {r["name"] for r in catalog.ambiguous_candidates(resolved, listing).collect()}
    assert names == {"play_by_play_2021.parquet", "play_by_play_2021.csv"}
    assert [r["code"] for r in catalog.resolution_errors(resolved, True).collect()] == ["E_AMBIGUOUS_MATCH"]


def test_missing_and_unusable(spark, listing):
    resolved = resolve(spark, listing, '{"datasets":["play_by_play"],"seasons":[2023,2024]}')
    assert [(r["dataset"], r["season"]) for r in catalog.missing_assets(resolved).collect()] == [("play_by_play", 2023)]
    codes = {r["season"]: r["code"] for r in catalog.resolution_errors(resolved).collect()}
    assert codes == {2023: "E_ASSET_MISSING", 2024: "E_REF_NOT_FOUND"}
    allowed = {r["season"] for r in catalog.resolution_errors(resolved, allow_missing=True).collect()}
    assert allowed == {2024}


def test_plan_of_a_release(spark, listing):
    plan, problems = ingestion.plan_release(
        scopes(spark, '{"datasets":["pbp","pbp_csv"],"seasons":[2022,2021,2021]}'), listing, "nflverse", "pbp",
        allow_missing=True,
    )
    assert problems.count() == 0
    rows = plan.orderBy("ordinal").collect()
    assert [r["logical_name"] for r in rows] == ["pbp_2021", "pbp_2022", "pbp_csv_2021"]
    first = rows[0]
    assert first["dest_path"] == "nflverse/pbp/pbp/play_by_play_2021.parquet"
    assert (first["expected_type"], first["expected_size_bytes"], first["group"], first["season"]) == ("parquet", 10, "pbp", 2021)


def test_release_problems(spark, listing):
    _, problems = ingestion.plan_release(scopes(spark, '{"datasets":["pbp"],"seasons":[1999]}'), listing, "nflverse", "pbp")
    assert [tuple(r) for r in problems.collect()] == [("E_ASSET_MISSING", "pbp 1999")]


def test_scope_violations(spark):
    bad = scopes(
        spark, '{"seasons":[1]}', '{"datasets":[],"seasons":[]}', '{"datasets":["pbp"],"seasons":["x",2020]}',
        '{"datasets":["nope"],"seasons":[2020]}', '{"datasets":["pbp"],"seasons":[2020]}', "no json",
    )
    found = catalog.scope_violations(catalog.parse_scopes(bad), catalog.DATASET_PATTERNS).collect()
    by_scope = {}
    for r in found:
        by_scope.setdefault(r["scope_id"], []).append((r["message"], r["value"]))
    no_datasets, no_seasons = ("datasets list missing or empty", None), ("seasons list missing or empty", None)
    assert by_scope == {
        0: [no_datasets], 1: [no_datasets, no_seasons], 2: [("invalid season", "x")], 3: [("unknown dataset", "nope")],
        5: [no_datasets, no_seasons],
    }


CATALOG = [(1, 10), (1, 11), (2, 10), (2, 10), (None, 10), (3, None)]


@pytest.mark.parametrize("competitions,seasons,expected", [
    ([1], None, [(1, 10), (1, 11)]), (None, [10], [(1, 10), (2, 10)]), ([1, 2], [10], [(1, 10), (2, 10)]), ([9], [10], []),
])
def test_pairs_by_filter(spark, competitions, seasons, expected):
    frame = spark.createDataFrame(CATALOG, "competition_id INT, season_id INT")
    for as_frame in (False, True):
        def wrap(ids, name):
            return ids if ids is None or not as_frame else spark.createDataFrame([(i,) for i in ids], f"{name} INT")
        pairs = catalog.expand_pairs(frame, wrap(competitions, "competition_id"), wrap(seasons, "season_id"))
        assert [tuple(r) for r in catalog.sorted_distinct(pairs, "competition_id", "season_id").collect()] == expected


def test_explicit_pairs_skip_the_catalog(spark):
    frame = spark.createDataFrame(CATALOG, "competition_id INT, season_id INT")
    wanted = spark.createDataFrame([("7", "8"), ("7", "8"), ("1", None)], "competition_id STRING, season_id STRING")
    assert [tuple(r) for r in catalog.expand_pairs(frame, pairs=wanted).collect()] == [(7, 8)]
    assert [r["code"] for r in catalog.pair_violations(wanted).collect()] == ["E_SCOPE_INVALID"]
    with pytest.raises(ValueError, match="give pairs"):
        catalog.expand_pairs(frame)


def test_ids_from_either_field(spark):
    rows = spark.createDataFrame([(5, None), (None, 4), (5, 9), (None, None)], "match_id INT, id INT")
    assert sorted(r["match_id"] for r in catalog.extract_ids(rows).collect()) == [4, 5]
    assert sorted(r["match_id"] for r in catalog.extract_ids(rows.drop("match_id")).collect()) == [4, 9]


LOCATION = dict(source="src", owner="o", repo="r", ref="abc", base="https://raw")


def test_tree_plan_in_order(spark):
    pairs = spark.createDataFrame([(10, 1), (9, 2)], "competition_id BIGINT, season_id BIGINT")
    matches = spark.createDataFrame([(100,), (20,)], "id INT")
    rows = ingestion.plan_tree(pairs, matches, LOCATION).orderBy("ordinal").collect()
    assert [r["logical_name"] for r in rows] == [
        "competitions", "matches_9_2", "matches_10_1", "events_20", "lineups_20", "three_sixty_20", "events_100",
        "lineups_100", "three_sixty_100",
    ]
    by_name = {r["logical_name"]: r for r in rows}
    assert by_name["competitions"]["url"] == "https://raw/o/r/abc/data/competitions.json"
    assert by_name["matches_9_2"]["dest_path"] == "src/abc/matches/9/2.json"
    three = by_name["three_sixty_20"]
    assert (three["dest_path"], three["group"], three["optional"]) == ("src/abc/three-sixty/20.json", "three-sixty", True)
    assert not by_name["events_20"]["optional"]


def test_resolution_joins_on_equality(spark, listing, plan_text):
    plan = plan_text(resolve(spark, listing, '{"datasets":["pbp"],"seasons":[2021]}'), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_seasons_of_scopes(spark):
    df = spark.createDataFrame([("2023",), ("2023.0",), (" 7 ",), ("-3",), ("2023.5",), ("x",), (None,)], "s STRING")
    assert [r[0] for r in df.select(catalog.season_number(F.col("s"))).collect()] == [2023, 2023, 7, None, None, None, None]
