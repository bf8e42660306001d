"""Baseline models on Spark ML: fit on train, evaluate per split, per season and per dropped feature."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.operators import metrics
from driftspark.operators.forest import fit_forest
from driftspark.operators.sides import TARGET, feature_columns, feature_drop
from driftspark.runtime import col

# Model settings.
SEED = 42
TREES = 100
DEPTH = 10
LOGISTIC_ITERATIONS = 1000
LOGISTIC_C = 1.0
RIDGE_ALPHA = 1.0

# Statistics of the tree nodes grown in one pass over the data; more memory means fewer passes.
FOREST_MEMORY_MB = 1024

# Partitions of the training rows, whatever the machine: one for so many rows, and no fewer than these.
ROWS_PER_TASK = 250_000
FIT_TASKS = 32

TASKS = ("classification", "regression")
MODEL_TYPES = ("rf", "linear")

_VECTOR = "feature_vector"


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    features: list[str]
    task: str
    model_type: str


def task_of(target: str) -> str:
    return "classification" if target == "win" else "regression"


def _forest(task: str, seed: int) -> Estimator:
    shared = dict(
        featuresCol=_VECTOR, labelCol=TARGET, numTrees=TREES, maxDepth=DEPTH, seed=seed,
        maxMemoryInMB=FOREST_MEMORY_MB,
        # For rows that Spark's own trainer is left with (see ``forest.fit_forest``): they remember their node in each
        # tree instead of walking down the trees on every pass.
        cacheNodeIds=True,
        # A pass grows a level where the memory suffices; the remembered nodes are written to the shared folder only if
        # there are more passes than levels. At ten, Spark's default, they were written after the last one, for nobody.
        checkpointInterval=DEPTH + 1,
    )
    if task == "classification":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", **shared)
    return RandomForestRegressor(featureSubsetStrategy="all", **shared)


def _linear(task: str, train: DataFrame) -> Estimator:
    """Spark minimizes a mean loss (of a unit-variance label for least squares), so the penalty of the
    summed objective is rescaled by the row count (and the label's deviation)."""
    facts = train.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(col(TARGET)).alias("deviation")
    ).first()
    shared = dict(
        featuresCol=_VECTOR, labelCol=TARGET, standardization=False, elasticNetParam=0.0
    )
    if task == "classification":
        return LogisticRegression(
            maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / (LOGISTIC_C * max(facts["n"], 1)), **shared
        )
    penalty = RIDGE_ALPHA * (facts["deviation"] or 0.0) / max(facts["n"], 1)
    return LinearRegression(solver="normal", regParam=penalty, **shared)


def make_estimator(task: str, model_type: str, train: DataFrame, seed: int = SEED) -> Estimator:
    """Any task but classification is regression; an unknown model type is an error."""
    if model_type == "rf":
        return _forest(task, seed)
    if model_type == "linear":
        return _linear(task, train)
    raise ValueError(f"unknown model type {model_type!r}; expected one of {', '.join(MODEL_TYPES)}")


def _dealt(rows: DataFrame, features: Sequence[str], tasks: int) -> DataFrame:
    """Rows in a fixed number of partitions and a fixed order within them, both decided by their content.

    Bagging draws by partition and order, so the same rows give the same model on any number of cores.
    Metadata takes part in the key: rows with equal features do not meet in one partition.
    """
    key = F.xxhash64(*[col(name) for name in rows.columns])
    narrow = rows.select(*[col(name) for name in features], TARGET, key.alias("_key"))
    return narrow.repartition(tasks, "_key").sortWithinPartitions("_key", *[col(f) for f in features]).drop("_key")


def fit_tasks(rows: int) -> int:
    """Partitions that so many training rows are dealt into."""
    return max(FIT_TASKS, -(-rows // ROWS_PER_TASK))


def fit(
    train: DataFrame, task: str, model_type: str = "rf", seed: int = SEED,
    extra_metadata: Sequence[str] = ("split",), tasks: int | None = None,
) -> TrainedModel:
    """A model of the rows, dealt into ``tasks`` partitions; by default their number follows that of the rows, so a
    forest depends on its data and on no property of the machine.

    The rows, or blocks made of them, are kept while the model is fitted, so iterations do not read the table again.
    """
    features = feature_columns(train, extra_metadata)
    tasks = tasks or fit_tasks(train.count())
    narrow = _dealt(train, features, tasks).persist(StorageLevel.MEMORY_AND_DISK)
    assembler = VectorAssembler(inputCols=features, outputCol=_VECTOR, handleInvalid="error")
    try:
        estimator = make_estimator(task, model_type, narrow, seed)
        if model_type == "rf":
            forest = fit_forest(estimator, narrow, assembler.transform(narrow), features)
            model = PipelineModel([assembler, forest])
        else:
            model = Pipeline(stages=[assembler, estimator]).fit(narrow)
    finally:
        narrow.unpersist()
    return TrainedModel(model, features, task, model_type)


def predict(trained: TrainedModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``; the features are those the model was fitted on."""
    return trained.model.transform(rows).drop(_VECTOR, "rawPrediction", "probability")


def train_eval(
    split_rows: DataFrame, task: str, model_type: str = "rf", seed: int = SEED, tasks: int | None = None
) -> tuple[TrainedModel, DataFrame]:
    """Fit on train; one row of metrics for train and one for val, from one pass over both."""
    trained = fit(split_rows.where(F.col("split") == "train"), task, model_type, seed, tasks=tasks)
    seen = predict(trained, split_rows.where(F.col("split").isin("train", "val")))
    result = metrics.evaluate(seen, task, by=["split"]).select(
        F.lit(model_type).alias("model_type"),
        F.lit(task).alias("task"),
        F.lit(len(trained.features)).alias("n_features"),
        F.array(*[F.lit(name) for name in trained.features]).alias("features"),
        "*",
    )
    return trained, result


def evaluate_season_shift(trained: TrainedModel | None, test_rows: DataFrame) -> DataFrame:
    if trained is None:
        raise ValueError("no model: fit one first")
    return metrics.season_shift(predict(trained, test_rows), trained.task)


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: the matrix of products of a constant, the features and the target, summed over its rows."""
    total = None
    for batch in batches:
        values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        if not np.isfinite(values).all():
            raise ValueError("features and target must be numbers")
        z = np.column_stack([np.ones(len(values)), values])
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        width = len(total)
        at = np.arange(width * width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width), pa.array(total.ravel())], ["i", "j", "total"])


def cross_products(train: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Products of a constant, the features and the target in this order, summed over all rows in one pass.

    Only the matrix, a number for each pair of columns, reaches the driver.
    """
    rows = train.select(*[col(name).cast("double") for name in [*features, TARGET]])
    parts = rows.mapInArrow(_cross_products, "i int, j int, total double")
    matrix = np.zeros((len(features) + 2,) * 2)
    for row in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        matrix[row["i"], row["j"]] = row["total"]
    return matrix


def ridge_of(matrix: np.ndarray, kept: Sequence[int], alpha: float = RIDGE_ALPHA) -> tuple[np.ndarray, float]:
    """Weights of the features at the places ``kept`` and the intercept, which is not penalized.

    Everything a model of some of the features needs is in the cross products of all of them.
    """
    n = matrix[0, 0]
    if not n:
        raise ValueError("no training rows")
    centred = matrix[1:, 1:] - np.outer(matrix[0, 1:], matrix[0, 1:]) / n
    kept = list(kept)
    own = centred[np.ix_(kept, kept)] + alpha * np.eye(len(kept))
    weights = np.linalg.solve(own, centred[kept, -1]) if kept else np.zeros(0)
    means = matrix[0, 1:] / n
    return weights, float(means[-1] - means[kept] @ weights)


def _ridge_predictions(
    train: DataFrame, scored: DataFrame, drops: Sequence[Sequence[str]], extra_metadata: Sequence[str] = ("split",)
) -> DataFrame:
    """``scored`` with a column for each list, by ridge regressions that share one pass over ``train``."""
    features = feature_columns(train, extra_metadata)
    matrix = cross_products(train, features)
    columns = {}
    for i, drop in enumerate(drops):
        left = feature_columns(feature_drop(train, drop), extra_metadata)
        weights, intercept = ridge_of(matrix, [features.index(name) for name in left])
        terms = [col(name).cast("double") * F.lit(float(w)) for name, w in zip(left, weights, strict=True)]
        columns[f"prediction{i}"] = reduce(Column.__add__, terms, F.lit(intercept))
    return scored.withColumns(columns)


def drop_ablation(
    split_rows: DataFrame, task: str, drops: Sequence[Sequence[str]], model_type: str = "rf",
    seed: int = SEED, tasks: int | None = None,
) -> DataFrame:
    """Shift metrics of test rows per drop list, next to those of the model that drops nothing.

    The split is computed once: dropping a feature does not move a row to another split. All models
    score the test rows in one pass and share one aggregation. Ridge regressions of all lists come from one pass over
    the training rows; other models are fitted list by list.
    """
    train = split_rows.where(F.col("split") == "train")
    scored = split_rows.where(F.col("split") == "test")
    variants = [[], *drops]
    if model_type == "linear" and task != "classification":
        scored = _ridge_predictions(train, scored, variants)
    else:
        tasks = tasks or fit_tasks(train.count())
        for i, drop in enumerate(variants):
            trained = fit(feature_drop(train, drop), task, model_type, seed, tasks=tasks)
            scored = predict(trained, scored).withColumnRenamed("prediction", f"prediction{i}")
    each = F.array(
        *[
            F.struct(F.lit(i).alias("variant"), F.col(f"prediction{i}").alias("prediction"))
            for i in range(len(variants))
        ]
    )
    rows = scored.select("season", TARGET, F.inline(each))
    shift = metrics.season_shift(rows, task, by=["variant"])
    values = metrics.shift_long(shift, task, by=["variant"])
    # One row per segment and metric, so this second grouping is over metric rows only.
    keys = ["segment_kind", "segment", "metric"]
    wide = values.groupBy(*keys).pivot("variant", list(range(len(variants)))).agg(F.first("value"))
    compared = F.array(
        *[
            F.struct(
                F.lit(",".join(drop)).alias("dropped"),
                F.col(str(i)).alias("value"),
                F.col("0").alias("baseline"),
                (F.col(str(i)) - F.col("0")).alias("delta"),
            )
            for i, drop in enumerate(variants)
            if i
        ]
    )
    return wide.select(*keys, F.inline(compared)).select("dropped", *keys, "value", "baseline", "delta")


def save_model(trained: TrainedModel | None, path: str) -> None:
    if trained is None:
        raise ValueError("no model to save: fit one first")
    trained.model.write().overwrite().save(f"{path}/model")
    about = {"features": trained.features, "task": trained.task, "model_type": trained.model_type}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        model = PipelineModel.load(f"{path}/model")
    except Exception as error:
        raise ValueError(f"model not found: {path}") from error
    return TrainedModel(model, about["features"], about["task"], about["model_type"])
