"""Metrics overall and per segment, every segment in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY_METRICS = ["accuracy", "precision", "recall", "f1"]
REGRESSION_METRICS = ["mse", "mae", "r2"]


def metrics_of(task: str) -> list[str]:
    return BINARY_METRICS if task == "classification" else REGRESSION_METRICS


def _ratio(part: Column, whole: Column) -> Column:
    """0 for 0/0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _confusion(label: str, prediction: str) -> list[Column]:
    actual, guess = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual & guess).alias("tp"),
        F.count_if(~actual & guess).alias("fp"),
        F.count_if(actual & ~guess).alias("fn"),
        F.count_if(~actual & ~guess).alias("tn"),
    ]


def _binary_ratios() -> list[Column]:
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    return [
        F.try_divide((tp + tn).cast("double"), n.cast("double")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _error_sums(label: str, prediction: str) -> list[Column]:
    actual = F.col(label).cast("double")
    error = actual - F.col(prediction).cast("double")
    return [
        F.count(error).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(actual).alias("variance"),
    ]


def _regression_scores() -> list[Column]:
    mse, variance = F.col("mse"), F.col("variance")
    r2 = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(variance > 0, 1 - mse / variance)
        .when(mse == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return [mse, F.col("mae"), r2.alias("r2")]


def binary_metrics(
    rows: DataFrame, by: Sequence[str] = (), label: str = "target", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy; precision, recall and F1 of class 1; 0/0 is 0."""
    counts = rows.groupBy(*by).agg(*_confusion(label, prediction))
    return counts.select(*by, "n", *_binary_ratios())


def regression_metrics(
    rows: DataFrame, by: Sequence[str] = (), label: str = "target", prediction: str = "prediction"
) -> DataFrame:
    """MSE, MAE and R2; constant labels give R2 1 for a perfect fit, else 0; null below two rows."""
    sums = rows.groupBy(*by).agg(*_error_sums(label, prediction))
    return sums.select(*by, "n", *_regression_scores())


def evaluate(
    rows: DataFrame, task: str, by: Sequence[str] = (), label: str = "target",
    prediction: str = "prediction",
) -> DataFrame:
    chosen = binary_metrics if task == "classification" else regression_metrics
    return chosen(rows, by, label, prediction)


def season_shift(
    rows: DataFrame, task: str = "classification", season: str = "season", label: str = "target",
    prediction: str = "prediction", by: Sequence[str] = (),
) -> DataFrame:
    """Metrics of all rows and of each season: ``segment_kind, segment, n`` and the metrics.

    One shuffle serves all segments, and all groups of ``by``. Rows without a season count only in
    the overall segment.
    """
    sets = [[*by, season], list(by)]
    keys = [*by, season]
    if task == "classification":
        # Counts add up, so the overall rows are built from the few per-season rows.
        counts = rows.groupBy(*keys).agg(*_confusion(label, prediction))
        sums = counts.groupingSets(sets, *keys).agg(
            F.grouping(season).alias("is_overall"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "tp", "fp", "fn", "tn")],
        )
        scores = _binary_ratios()
    else:
        sums = rows.groupingSets(sets, *keys).agg(
            F.grouping(season).alias("is_overall"), *_error_sums(label, prediction)
        )
        scores = _regression_scores()
    overall = F.col("is_overall") == 1
    return sums.where(overall | F.col(season).isNotNull()).select(
        *by,
        F.when(overall, "overall").otherwise("season").alias("segment_kind"),
        F.when(overall, "overall").otherwise(F.col(season)).alias("segment"),
        "n",
        *scores,
    )


def shift_long(shift: DataFrame, task: str = "classification", by: Sequence[str] = ()) -> DataFrame:
    """``segment_kind, segment, metric, value``: the metric name holds no season."""
    return shift.unpivot(
        [*by, "segment_kind", "segment"], metrics_of(task), "metric", "value"
    )
