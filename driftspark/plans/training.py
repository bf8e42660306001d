"""From games to shift metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.operators import metrics, models
from driftspark.operators.sides import feature_drop, stats_of, two_sided_unpivot
from driftspark.operators.split import time_split
from driftspark.runtime import materialize


def build_dataset(
    games: DataFrame, sport_or_stats: str | Sequence[str], target: str = "win",
    drop: Sequence[str] = (), train_ratio: float = 0.6, val_ratio: float = 0.2, landed: bool = False,
) -> DataFrame:
    """Team rows with ``split``, without the dropped features.

    Rows are split before features are dropped, so a drop never moves a row to another split.
    The games are written once (half as many rows as the team rows), unless they are ``landed``, that
    is read straight from a table; the counting passes of the split and everything after read that
    table, column by column, instead of repeating the plan behind it.
    """
    stats = stats_of(sport_or_stats) if isinstance(sport_or_stats, str) else sport_or_stats
    stored = games if landed else materialize(games, "games")
    rows = two_sided_unpivot(stored, stats, target)
    return feature_drop(time_split(rows, train_ratio, val_ratio), drop)


def rule_shift(split_rows: DataFrame, prediction: Column, task: str = "classification") -> DataFrame:
    """Shift metrics of the test rows for a prediction that is an expression, not a fitted model."""
    test = split_rows.where(F.col("split") == "test").withColumn("prediction", prediction)
    return metrics.season_shift(test, task)


@dataclass(frozen=True)
class TrainingResult:
    trained: models.TrainedModel
    metrics: DataFrame
    shift: DataFrame | None


def train(
    split_rows: DataFrame, target: str, model_type: str = "rf", evaluate_shift: bool = False,
    model_path: str | None = None,
) -> TrainingResult:
    """Fit, evaluate on train and val, optionally on test per season, optionally save."""
    task = models.task_of(target)
    trained, scores = models.train_eval(split_rows, task, model_type)
    if model_path is not None:
        models.save_model(trained, model_path)
    shift = None
    if evaluate_shift:
        test = split_rows.where(F.col("split") == "test")
        shift = metrics.shift_long(models.evaluate_season_shift(trained, test), task)
    return TrainingResult(trained, scores, shift)


def one_feature_predictor(split_rows: DataFrame, feature: str) -> DataFrame:
    """``prediction`` from the least-squares line of the target on one feature over the train rows.

    The line is two numbers from one aggregation, so it is read to the driver and used as literals.
    """
    line = (
        split_rows.where(F.col("split") == "train")
        .agg(
            F.regr_slope("target", feature).alias("slope"),
            F.regr_intercept("target", feature).alias("intercept"),
        )
        .first()
    )
    return split_rows.withColumn(
        "prediction", F.lit(line["slope"]) * F.col(feature) + F.lit(line["intercept"])
    )

