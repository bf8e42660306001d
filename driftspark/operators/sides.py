"""One row per game -> one supervised row per side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.runtime import col

# Paired statistics per sport and their types, in column order.
SPORT_STATS = {
    "nba": {
        "fg_pct": "double",
        "3p_pct": "double",
        "rebounds": "bigint",
        "assists": "bigint",
        "turnovers": "bigint",
    },
    "nfl": {
        "total_yards": "bigint",
        "passing_yards": "bigint",
        "rushing_yards": "bigint",
        "turnovers": "bigint",
    },
}

# Columns that identify a row and are never features.
METADATA = ["game_id", "season", "date", "team", "opponent"]
TARGET = "target"
TARGETS = ("win", "score_diff")


def stats_of(sport: str) -> list[str]:
    """Statistics of a sport; an unknown sport has none and yields metadata and target only."""
    return list(SPORT_STATS.get(sport.lower(), {}))


def target_win(own: Column, other: Column) -> Column:
    """1 only for the higher score, so a tie is 0 on both sides."""
    return (own > other).cast("int")


def target_score_diff(own: Column, other: Column) -> Column:
    return own - other


def check_target(target: str) -> None:
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}; expected one of {', '.join(TARGETS)}")


def two_sided_unpivot(
    games: DataFrame, stats: Sequence[str], target: str = "win"
) -> DataFrame:
    """Each game becomes a home row (``is_home`` 1) and an away row (0).

    Only the two-valued flag is exploded and every column is picked by ``when``: one narrow pass with
    no union and no shuffle, and the scan still reads only the statistics that are used later.
    A statistic absent from the schema is 0; an explicit null stays null.
    """
    check_target(target)
    sides = games.withColumn("is_home", F.explode(F.array(F.lit(1), F.lit(0))))
    at_home = F.col("is_home") == 1
    present = set(games.columns)

    def pick(name: str) -> tuple[Column, Column]:
        home, away = (
            col(f"{side}_{name}") if f"{side}_{name}" in present else F.lit(0)
            for side in ("home", "away")
        )
        return (
            F.when(at_home, home).otherwise(away),
            F.when(at_home, away).otherwise(home),
        )

    team, opponent = pick("team")
    own_score, opp_score = pick("score")
    make_target = {"win": target_win, "score_diff": target_score_diff}[target]
    pairs = [(name, *pick(name)) for name in stats]
    return sides.select(
        "game_id",
        "season",
        "date",
        team.alias("team"),
        opponent.alias("opponent"),
        "is_home",
        *[own.alias(name) for name, own, _ in pairs],
        *[opp.alias(f"opp_{name}") for name, _, opp in pairs],
        make_target(own_score, opp_score).alias(TARGET),
    )


def default_fill(games: DataFrame, stats: Sequence[str]) -> DataFrame:
    """0 for every paired statistic that is null or absent.

    For rows that come from JSON, where a missing key and an explicit null read the same.
    """
    filled = {}
    for name in (f"{side}_{stat}" for stat in stats for side in ("home", "away")):
        filled[name] = (
            F.coalesce(col(name), F.lit(0)) if name in games.columns else F.lit(0)
        )
    return games.withColumns(filled)


def feature_drop(rows: DataFrame, names: Sequence[str], both_sides: bool = False) -> DataFrame:
    """Drop the named features that exist; unknown names are ignored.

    ``opp_`` twins stay unless ``both_sides``, which drops a feature of either side with its twin.

    Metadata and target are refused: later steps need them.
    """
    refused = sorted(set(names) & {*METADATA, TARGET})
    if refused:
        raise ValueError(f"not features: {', '.join(refused)}")
    gone = set(names)
    if both_sides:
        own = {name.removeprefix("opp_") for name in names} - {*METADATA, TARGET}
        gone |= own | {f"opp_{name}" for name in own}
    keep = [name for name in rows.columns if name not in gone]
    return rows.select(*[col(name) for name in keep])


def feature_columns(rows: DataFrame, extra_metadata: Sequence[str] = ()) -> list[str]:
    """Every column but metadata and target, in order; ``is_home`` is a feature."""
    excluded = {*METADATA, TARGET, *extra_metadata}
    return [name for name in rows.columns if name not in excluded]


def feature_list(rows: DataFrame, extra_metadata: Sequence[str] = ()) -> DataFrame:
    """One row per feature: ``position, feature, n_values`` (rows that hold a value)."""
    names = feature_columns(rows, extra_metadata)
    counted = rows.agg(*[F.count(col(name)).alias(f"c{i}") for i, name in enumerate(names)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("feature"),
            F.col(f"c{i}").alias("n_values"),
        )
        for i, name in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*entries)))
