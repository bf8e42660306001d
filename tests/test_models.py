import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from driftspark.operators import models


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 900
    frame = pd.DataFrame({
        "game_id": [str(i) for i in range(n)], "season": [str(2020 + i % 3) for i in range(n)], "date": "2021-01-01",
        "team": "A", "opponent": "B", "is_home": rng.integers(0, 2, n), "a": rng.normal(5, 2, n), "b": rng.normal(0, 1, n),
    })
    frame["score_diff"] = 3 * frame.is_home + 2 * frame.a - frame.b + rng.normal(0, 2, n)
    frame["win"] = (frame.score_diff > 11).astype(int)
    frame["split"] = np.where(np.arange(n) < 600, "train", np.where(np.arange(n) < 750, "val", "test"))
    return frame


FEATURES = ["is_home", "a", "b"]


def with_target(spark, rows, target):
    frame = rows.rename(columns={target: "target"}).drop(columns=[{"win": "score_diff"}.get(target, "win")])
    order = [c for c in frame.columns if c not in ("target", "split")] + ["target", "split"]
    return spark.createDataFrame(frame[order])


def weights(trained):
    last = trained.model.stages[-1]
    return np.append(last.coefficients.toArray(), last.intercept)


def test_ridge_is_the_closed_form(spark, rows):
    train = rows[rows.split == "train"]
    x, y = train[FEATURES].to_numpy(float), train.score_diff.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    trained, _ = models.train_eval(with_target(spark, rows, "score_diff"), "regression", "linear")
    np.testing.assert_allclose(weights(trained), np.append(w, y.mean() - x.mean(0) @ w), rtol=1e-8)


def test_logistic_is_the_penalized_optimum(spark, rows):
    train = rows[rows.split == "train"]
    x = np.column_stack([train[FEATURES].to_numpy(float), np.ones(len(train))])
    y, penalty, w = train.win.to_numpy(float), np.diag([1.0, 1, 1, 0]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
    trained, _ = models.train_eval(with_target(spark, rows, "win"), "classification", "linear")
    np.testing.assert_allclose(weights(trained), w, rtol=2e-4)


def test_train_metrics_rows(spark, rows):
    trained, result = models.train_eval(with_target(spark, rows, "win"), "classification", "linear")
    found = {r["split"]: r for r in result.collect()}
    assert found.keys() == {"train", "val"}
    assert found["val"]["n"] == 150 and found["val"]["n_features"] == 3
    assert found["val"]["features"] == trained.features == FEATURES
    assert found["train"]["accuracy"] > 0.8


@pytest.mark.parametrize("task,target,floor", [("classification", "win", 0.8), ("regression", "score_diff", 0.5)])
def test_forest(spark, rows, task, target, floor):
    data = with_target(spark, rows, target)
    trained, _ = models.train_eval(data, task)
    again, _ = models.train_eval(data, task)
    test = data.where("split = 'test'")
    shift = models.evaluate_season_shift(trained, test)
    name = "accuracy" if task == "classification" else "r2"
    found = {r["segment"]: r[name] for r in shift.collect()}
    assert found.keys() == {"overall", "2020", "2021", "2022"} and found["overall"] > floor
    assert trained.model.stages[-1].getNumTrees == 100
    same = [r["prediction"] for r in models.predict(again, test).orderBy("game_id").collect()]
    assert same == [r["prediction"] for r in models.predict(trained, test).orderBy("game_id").collect()]


@pytest.mark.parametrize("task,target", [("classification", "win"), ("regression", "score_diff")])
def test_a_forest_writes_nothing_to_the_shared_folder(spark, rows, task, target):
    """The nodes that rows remember stay with the executors, also when the trees are as deep as they may be."""
    train = with_target(spark, rows, target).where("split = 'train'")

    def written():
        found = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(one.getBytesWritten() for one in found if one.getScheme() == "file")

    before = written()
    trained = models.fit(train, task)
    assert max(tree.depth for tree in trained.model.stages[-1].trees) == models.DEPTH
    assert written() == before


def test_settings_and_unknown_type(spark, rows):
    data = with_target(spark, rows, "score_diff")
    forest = models.make_estimator("anything", "rf", data)
    assert isinstance(forest, RandomForestRegressor)
    assert (forest.getMaxDepth(), forest.getSeed(), forest.getFeatureSubsetStrategy()) == (10, 42, "all")
    with pytest.raises(ValueError, match="unknown model type"):
        models.make_estimator("classification", "svm", data)
    assert [models.task_of(t) for t in ("win", "score_diff")] == ["classification", "regression"]


def test_save_and_load(spark, rows, tmp_path):
    data = with_target(spark, rows, "score_diff")
    trained, _ = models.train_eval(data, "regression", "linear")
    models.save_model(trained, str(tmp_path / "m"))
    loaded = models.load_model(spark, str(tmp_path / "m"))
    assert (loaded.features, loaded.task, loaded.model_type) == (FEATURES, "regression", "linear")
    np.testing.assert_allclose(weights(loaded), weights(trained))


def test_errors_without_a_model(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="no model"):
        models.save_model(None, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="no model"):
        models.evaluate_season_shift(None, with_target(spark, rows, "win"))
    with pytest.raises(ValueError, match="not found"):
        models.load_model(spark, str(tmp_path / "none"))


def test_ablation_equals_models_fitted_one_by_one(spark, rows):
    data = with_target(spark, rows, "score_diff")
    found = models.drop_ablation(data, "regression", [["a"], ["a", "nothing"]], "linear").collect()
    table = {(r["dropped"], r["segment"], r["metric"]): r for r in found}
    trained = models.fit(data.where("split = 'train'").drop("a"), "regression", "linear")
    alone = models.evaluate_season_shift(trained, data.where("split = 'test'")).where("segment = '2021'").first()
    assert table["a", "2021", "mse"]["value"] == pytest.approx(alone["mse"])
    assert table["a", "2021", "mse"]["delta"] > 0
    assert table["a,nothing", "2021", "mse"]["value"] == pytest.approx(alone["mse"])
    assert len(table) == 2 * 4 * 3


def test_nan_feature_is_an_error(spark, rows):
    data = with_target(spark, rows, "score_diff").withColumn("a", F.when(F.col("a") > 5, F.lit(float("nan"))).otherwise(F.col("a")))
    with pytest.raises(Exception):
        models.fit(data.where("split = 'train'"), "regression", "linear")


FOREST = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from driftspark.operators import models
spark = SparkSession.builder.master(f"local[{sys.argv[1]}]").config("spark.ui.enabled", "false").getOrCreate()
i = F.col("id")
rows = spark.range(400).select(
    i.cast("string").alias("game_id"), (i * 7919 % 101).cast("double").alias("x"), (i * 104729 % 89).cast("double").alias("y"),
    (i * 31 % 3 == 0).cast("int").alias("target"),
).repartition(int(sys.argv[1]))
print("FOREST", hash(models.fit(rows, "classification").model.stages[-1].toDebugString.split("\\n", 1)[1]))
"""


def test_the_same_forest_on_any_number_of_cores():
    root = Path(__file__).resolve().parent.parent
    found = [
        subprocess.run(
            [sys.executable, "-c", FOREST, cores], cwd=root, capture_output=True, text=True, timeout=300,
            env=os.environ | {"PYTHONPATH": str(root), "PYTHONHASHSEED": "0"},
        ).stdout.split("FOREST")[1]
        for cores in ("2", "4")
    ]
    assert found[0] == found[1]


def test_partitions_follow_the_rows():
    assert models.fit_tasks(0) == models.fit_tasks(8_000_000) == 32
    assert models.fit_tasks(250_000 * 1000 + 1) == 1001


def test_all_ridge_drop_lists_from_one_pass(spark):
    """One job reads the training rows, however many lists there are, and its models are those of separate fits."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 4)) * [1, 5, 0.1, 2] + [0, 100, 3, -7]
    y = x @ [1.0, -0.5, 4.0, 0.0] + rnd.normal(size=300)
    rows = [(f"s{i % 3}", ["train", "train", "test"][i % 3], *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "season STRING, split STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, target DOUBLE")
    train = df.where("split = 'train'")
    matrix = models.cross_products(train, ["a", "b", "c", "d"])
    for drop in ([], ["b"], ["a", "c"], ["a", "b", "c", "d"]):
        kept = [i for i, name in enumerate("abcd") if name not in drop]
        weights, intercept = models.ridge_of(matrix, kept)
        own, goal = x[[i for i in range(300) if i % 3 < 2]][:, kept], y[[i for i in range(300) if i % 3 < 2]]
        centred = own - own.mean(axis=0)
        wanted = np.linalg.solve(centred.T @ centred + np.eye(len(kept)), centred.T @ (goal - goal.mean())) if kept else np.zeros(0)
        assert weights == pytest.approx(wanted, rel=1e-8)
        assert intercept == pytest.approx(goal.mean() - own.mean(axis=0) @ wanted, rel=1e-8)
    calls = []
    own = models.cross_products
    models.cross_products = lambda *a: calls.append(1) or own(*a)
    try:
        found = models.drop_ablation(df, "regression", [["a"], ["b"], ["a", "b"]], "linear").collect()
    finally:
        models.cross_products = own
    assert calls == [1] and {r["dropped"] for r in found} == {"a", "b", "a,b"}
    with pytest.raises(Exception, match="must be numbers"):
        models.cross_products(train.withColumn("a", F.lit(None).cast("double")), ["a"])
