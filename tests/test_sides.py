import pytest
from pyspark.sql import functions as F

from driftspark.operators import sides

GAMES = [
    ("g1", "2021", "2021-01-01", "A", "B", 100, 90, 0.5, None, 7, 8),
    ("g2", "2021", "2021-01-02", "B", "A", 80, 80, 0.4, 0.3, 5, 6),
]
SCHEMA = (
    "game_id STRING, season STRING, date STRING, home_team STRING, away_team STRING, home_score INT, away_score INT, "
    "home_3p_pct DOUBLE, away_3p_pct DOUBLE, home_assists INT, away_assists INT"
)


@pytest.fixture
def games(spark):
    return spark.createDataFrame(GAMES, SCHEMA)


def by_side(df):
    return {(r["game_id"], r["is_home"]): r for r in df.collect()}


def test_two_rows_per_game_with_swapped_statistics(games):
    rows = by_side(sides.two_sided_unpivot(games, ["3p_pct", "assists"]))
    assert len(rows) == 4
    home, away = rows["g1", 1], rows["g1", 0]
    assert (home["team"], home["opponent"], away["team"], away["opponent"]) == ("A", "B", "B", "A")
    assert (home["3p_pct"], home["opp_3p_pct"]) == (0.5, None)
    assert (away["3p_pct"], away["opp_3p_pct"]) == (None, 0.5)


def test_columns_come_in_order(games):
    assert sides.two_sided_unpivot(games, ["3p_pct", "assists"]).columns == [
        "game_id", "season", "date", "team", "opponent", "is_home", "3p_pct", "assists", "opp_3p_pct",
        "opp_assists", "target",
    ]


def test_tie_wins_for_nobody_and_differences_cancel(games):
    wins = by_side(sides.two_sided_unpivot(games, []))
    assert [wins[k]["target"] for k in [("g1", 1), ("g1", 0), ("g2", 1), ("g2", 0)]] == [1, 0, 0, 0]
    sums = sides.two_sided_unpivot(games, [], "score_diff").groupBy("game_id").agg(F.sum("target").alias("s"))
    assert {r["s"] for r in sums.collect()} == {0}


def test_unknown_target(games):
    with pytest.raises(ValueError, match="unknown target"):
        sides.two_sided_unpivot(games, [], "points")


def test_absent_statistic_is_zero_and_null_stays_null(games):
    rows = by_side(sides.two_sided_unpivot(games, ["rebounds", "3p_pct"]))
    assert rows["g1", 1]["rebounds"] == rows["g1", 1]["opp_rebounds"] == 0
    assert rows["g1", 0]["3p_pct"] is None
    filled = by_side(sides.two_sided_unpivot(sides.default_fill(games, ["3p_pct"]), ["3p_pct"]))
    assert filled["g1", 0]["3p_pct"] == 0


def test_unknown_sport_has_metadata_and_target_only(games):
    rows = sides.two_sided_unpivot(games, sides.stats_of("curling"))
    assert sides.feature_columns(rows) == ["is_home"]


def test_drop_ignores_unknown_names_and_keeps_the_twin(games):
    rows = sides.two_sided_unpivot(games, ["3p_pct", "assists"])
    dropped = sides.feature_drop(rows, ["3p_pct", "nothing"])
    assert sides.feature_columns(dropped) == ["is_home", "assists", "opp_3p_pct", "opp_assists"]
    with pytest.raises(ValueError, match="not features"):
        sides.feature_drop(rows, ["date"])


def test_scan_reads_only_the_statistics_in_use(spark, games, tmp_path, plan_text):
    path = str(tmp_path / "games")
    games.write.parquet(path)
    rows = sides.two_sided_unpivot(spark.read.parquet(path), ["3p_pct", "assists"])
    used = rows.where("date > '2021-01-01'").select("game_id", "assists", "target")
    plan = plan_text(used)
    assert "ReadSchema: struct<game_id:string,date:string,home_score:int,away_score:int,home_assists:int,away_assists:int>" in plan
    assert "GreaterThan(date,2021-01-01)" in plan
    assert "Exchange" not in plan


def test_drop_of_both_sides(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4, 5)], "game_id INT, a INT, opp_a INT, b INT, opp_b INT")
    assert sides.feature_drop(rows, ["opp_a"], both_sides=True).columns == ["game_id", "b", "opp_b"]
    assert sides.feature_drop(rows, ["opp_a"]).columns == ["game_id", "a", "b", "opp_b"]
