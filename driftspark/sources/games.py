"""Season files of games: read, land, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.operators.sides import SPORT_STATS, default_fill, stats_of

_TEXTS = ["game_id", "season", "date", "home_team", "away_team"]


def game_schema(sport: str) -> str:
    """Explicit schema: text metadata, whole scores, the sport's statistics with their types."""
    columns = [(name, "string") for name in _TEXTS]
    columns += [(f"{side}_score", "bigint") for side in ("home", "away")]
    columns += [
        (f"{side}_{stat}", kind)
        for stat, kind in SPORT_STATS.get(sport.lower(), {}).items()
        for side in ("home", "away")
    ]
    return ", ".join(f"`{name}` {kind}" for name, kind in columns)


def read_season_files(spark: SparkSession, folder: str, sport: str) -> DataFrame:
    """Every ``*.json`` file (one array of games) in ``folder/sport``.

    A file that holds one array cannot be split, so read it once and land it with ``write_games``.
    A missing folder or one without games is an error.
    """
    path = f"{folder}/{sport}"
    try:
        games = (
            spark.read.schema(game_schema(sport))
            .option("multiLine", True)
            .option("pathGlobFilter", "*.json")
            .json(path)
        )
        empty = games.isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ValueError(f"no data for sport {sport!r} in {path}") from error
        raise
    if empty:
        raise ValueError(f"no games for sport {sport!r} in {path}")
    return default_fill(games, stats_of(sport))


def season_folder_name(season: Column) -> Column:
    return F.replace(season, F.lit("/"), F.lit("-"))


def write_games(games: DataFrame, path: str, sport: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by sport and season, so one season is one folder.

    Overwriting replaces the seasons that ``games`` has and leaves all others, and other sports, as they are.
    ``rebalance`` gathers each season into few files and splits a season that holds very many rows.
    """
    keyed = games.withColumns(
        {"sport": F.lit(sport), "season_dir": season_folder_name(F.col("season"))}
    )
    (
        keyed.hint("rebalance", "season_dir")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sport", "season_dir")
        .parquet(path)
    )


def read_games(spark: SparkSession, path: str, sport: str) -> DataFrame:
    """Games of one sport; sports have different statistics, so only its folder is read."""
    return spark.read.parquet(f"{path}/sport={sport}").drop("season_dir")
