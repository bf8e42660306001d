import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftspark.operators import split
from driftspark.plans.training import build_dataset


def frame(spark, rows):
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["game_id", "date", "is_home", "x"]),
        "game_id STRING, date STRING, is_home INT, x INT",
    )


def expected(rows, train=0.6, val=0.2):
    ordered = sorted(rows, key=lambda r: (r[1], r[0], -r[2], r[3]))
    first, second = int(len(rows) * train), int(len(rows) * (train + val))
    return sorted(
        (*row, "train" if i < first else "val" if i < second else "test") for i, row in enumerate(ordered)
    )


def actual(df):
    return sorted((r["game_id"], r["date"], r["is_home"], r["x"], r["split"]) for r in df.collect())


def both_sides(days, games_per_day, seed=0):
    rng = random.Random(seed)
    rows = [
        (f"2021_{rng.randrange(10**6):06d}_{d}_{g}", f"2021-01-{d + 1:02d}", side, rng.randrange(100))
        for d in range(days)
        for g in range(games_per_day(d))
        for side in (1, 0)
    ]
    rng.shuffle(rows)
    return rows


def test_same_as_a_global_sort(spark):
    rows = both_sides(20, lambda d: 13 + d % 3)
    assert actual(split.time_split(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("limit", [1, 3, 10, 200])
def test_one_day_holds_most_rows(spark, monkeypatch, limit):
    """A low rank limit sends every cut through the prefix counts."""
    monkeypatch.setattr(split, "RANK_LIMIT", limit)
    rows = both_sides(5, lambda d: 150 if d == 2 else 10)
    assert actual(split.time_split(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("limit", [2, 1000])
def test_one_game_id_on_many_rows(spark, monkeypatch, limit):
    """Rows that share date, game and side are told apart by their content."""
    monkeypatch.setattr(split, "RANK_LIMIT", limit)
    rows = [("g", "2021-01-01", 1, x) for x in range(50)]
    result = split.time_split(frame(spark, rows)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in result} == {"train": 30, "val": 10, "test": 10}


@pytest.mark.parametrize("limit,chunk", [(1000, 100_000), (5, 7)])
def test_cut_inside_a_run_of_copies(spark, monkeypatch, limit, chunk):
    """A group of copies is divided by number, none is lost, and pieces stay small."""
    monkeypatch.setattr(split, "RANK_LIMIT", limit)
    monkeypatch.setattr(split, "COPY_CHUNK", chunk)
    rows = both_sides(3, lambda d: 5) + [("2021_5", "2021-01-02", 1, 7)] * 70
    assert actual(split.time_split(frame(spark, rows))) == expected(rows)


def test_cuts_truncate_double_products(spark):
    rows = [(f"g{i}", f"2021-01-{i + 1:02d}", 1, 0) for i in range(10)]
    sizes = {r["split"]: r["count"] for r in split.time_split(frame(spark, rows), 0.7, 0.1).groupBy("split").count().collect()}
    assert 10 * (0.7 + 0.1) < 8
    assert sizes == {"train": 7, "test": 3}


@pytest.mark.parametrize("train,val", [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.9, 0.5)])
def test_extreme_ratios(spark, train, val):
    rows = both_sides(4, lambda d: 3)
    assert actual(split.time_split(frame(spark, rows), train, val)) == expected(rows, train, val)


def test_empty_and_tiny(spark):
    assert split.time_split(frame(spark, []).where("false")).count() == 0
    rows = [("g", "2021-01-01", 1, 0)]
    assert actual(split.time_split(frame(spark, rows))) == expected(rows)


def test_null_dates_come_last(spark):
    rows = [(f"g{i}", None if i < 3 else "2021-01-01", 1, 0) for i in range(10)]
    result = split.time_split(frame(spark, rows), 0.7, 0.3)
    assert {r["split"] for r in result.where("date IS NULL").collect()} == {"val"}


def test_dates_do_not_overlap_but_on_a_cut(spark):
    rows = both_sides(30, lambda d: 4)
    bounds = {
        r["split"]: (r["low"], r["high"])
        for r in split.time_split(frame(spark, rows)).groupBy("split")
        .agg(F.min("date").alias("low"), F.max("date").alias("high")).collect()
    }
    assert bounds["train"][1] <= bounds["val"][0] and bounds["val"][1] <= bounds["test"][0]


def test_rows_are_neither_shuffled_nor_ranked(spark, tmp_path, plan_text):
    path = str(tmp_path / "rows")
    frame(spark, both_sides(10, lambda d: 5)).write.parquet(path)
    plan = plan_text(split.time_split(spark.read.parquet(path)))
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_counting_window_runs_over_buckets_only(spark, plan_text):
    rows = frame(spark, both_sides(10, lambda d: 5))
    plan = plan_text(split._ranges(rows, F.col("date")), "simple")
    # The single-partition exchange lies above the per-day aggregation.
    assert plan.rindex("SinglePartition") < plan.index("partial_count")


def test_a_drop_moves_no_row(spark):
    """A cut between the two sides of a game stays where it is without ``is_home``."""
    games = spark.createDataFrame(
        [(f"g{i}", "2021", f"2021-01-{i + 1:02d}", "A", "B", i, 3, i, 2 * i) for i in range(13)],
        "game_id STRING, season STRING, date STRING, home_team STRING, away_team STRING, home_score INT, "
        "away_score INT, home_x INT, away_x INT",
    )
    whole = build_dataset(games, ["x"])
    dropped = build_dataset(games, ["x"], drop=["is_home", "x"])
    assert dropped.columns == [c for c in whole.columns if c not in ("is_home", "x")]
    pick = ["game_id", "team", "split"]
    assert whole.select(pick).exceptAll(dropped.select(pick)).count() == 0
    straddling = whole.groupBy("game_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    assert straddling.count() > 0


def test_sizes(spark):
    rows = split.time_split(frame(spark, both_sides(10, lambda d: 5)))
    sizes = {r["split"]: (r["n_rows"], r["n_features"]) for r in split.split_sizes(rows, 2).collect()}
    assert sizes == {"train": (60, 2), "val": (20, 2), "test": (20, 2)}


def grouped_plain(rows, train, val):
    """Labels by the position of each group's first row; rows without a group stand together by date."""
    last = "\U0010ffff"
    keys = [(r[1] if r[1] is not None else last, r[0] if r[0] is not None else None) for r in rows]
    groups = {}
    for date, game in keys:
        groups.setdefault((game, None) if game is not None else (None, date), []).append(date)
    order = sorted(groups, key=lambda g: (min(groups[g]), g[0] if g[0] is not None else last))
    labels, at, n = {}, 0, len(rows)
    for g in order:
        labels[g] = "train" if at < int(n * train) else "val" if at < int(n * (train + val)) else "test"
        at += len(groups[g])
    return sorted((str(r), labels[(k[1], None) if k[1] is not None else (None, k[0])]) for r, k in zip(rows, keys))


@pytest.mark.parametrize("limit", [100_000, 3])
@pytest.mark.parametrize("ratios", [(0.6, 0.2), (0.5, 0.5), (0.0, 0.3), (0.33, 0.1)])
def test_groups_stay_together(spark, monkeypatch, ratios, limit):
    monkeypatch.setattr(split, "RANK_LIMIT", limit)
    rnd = random.Random(limit + int(ratios[0] * 10))
    rows = []
    for n in range(40):
        game, day = f"g{n:03d}", rnd.randrange(1, 9)
        # Some groups span days; one holds a third of all rows.
        for _ in range(60 if n == 20 else rnd.randrange(1, 5)):
            rows.append((game, f"2024-01-{day + rnd.choice([0, 0, 0, n % 2]):02d}", rnd.randrange(2)))
    rows += [(None, "2024-01-03", 1)] * 5 + [(None, None, 0), ("g999", None, 1)]
    df = spark.createDataFrame(rows, "game_id STRING, date STRING, is_home INT")
    found = split.time_split(df, *ratios, keep_together="game_id")
    assert found.columns == ["game_id", "date", "is_home", "split"]
    assert sorted((str(tuple(r)[:3]), r["split"]) for r in found.collect()) == grouped_plain(rows, *ratios)


def test_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], "game_id STRING, date STRING, is_home INT")
    assert split.time_split(df, keep_together="game_id").collect() == []
