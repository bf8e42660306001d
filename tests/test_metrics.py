import math
import random

import pytest

from driftspark.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "season STRING, target DOUBLE, prediction DOUBLE")


def binary(rows):
    tp = sum(y == 1 and p == 1 for _, y, p in rows)
    fp = sum(y == 0 and p == 1 for _, y, p in rows)
    fn = sum(y == 1 and p == 0 for _, y, p in rows)
    tn = len(rows) - tp - fp - fn
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return [(tp + tn) / len(rows), precision, recall, f1]


def regression(rows):
    n, mean = len(rows), sum(y for _, y, _ in rows) / len(rows)
    sse = sum((y - p) ** 2 for _, y, p in rows)
    total = sum((y - mean) ** 2 for _, y, _ in rows)
    r2 = None if n < 2 else (1 - sse / total if total else float(sse == 0))
    return [sse / n, sum(abs(y - p) for _, y, p in rows) / n, r2]


def segments(rows):
    parts = {("overall", "overall"): rows}
    for season in {r[0] for r in rows if r[0] is not None}:
        parts["season", season] = [r for r in rows if r[0] == season]
    return parts


def compare(df, names, wanted):
    found = {(r["segment_kind"], r["segment"]): [r[n] for n in names] for r in df.collect()}
    assert found.keys() == wanted.keys()
    for key, values in wanted.items():
        for a, b in zip(found[key], values):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), key


def test_season_shift_counts_every_segment(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["2020", "2021", None, "overall"]), float(rng.random() < 0.4), float(rng.random() < 0.5)) for _ in range(500)]
    shift = metrics.season_shift(frame(spark, rows))
    compare(shift, metrics.BINARY_METRICS, {k: binary(v) for k, v in segments(rows).items()})


def test_zero_over_zero_is_zero(spark):
    rows = [("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0)]
    shift = metrics.season_shift(frame(spark, rows))
    compare(shift, metrics.BINARY_METRICS, {k: binary(v) for k, v in segments(rows).items()})


def test_regression_segments(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.gauss(1000, 3), rng.gauss(1000, 3)) for _ in range(300)]
    rows += [("one", 1.0, 2.0), ("flat", 5.0, 5.0), ("flat", 5.0, 5.0), ("missed", 5.0, 4.0), ("missed", 5.0, 5.0)]
    shift = metrics.season_shift(frame(spark, rows), "regression")
    compare(shift, metrics.REGRESSION_METRICS, {k: regression(v) for k, v in segments(rows).items()})


def test_long_form(spark):
    shift = metrics.season_shift(frame(spark, [("a", 1.0, 1.0)]))
    rows = {(r["segment"], r["metric"]): r["value"] for r in metrics.shift_long(shift).collect()}
    assert rows["a", "f1"] == rows["overall", "accuracy"] == 1.0 and len(rows) == 8


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_one_scan_for_all_segments(spark, plan_text, tmp_path, task):
    path = str(tmp_path / "rows")
    frame(spark, [("a", 1.0, 1.0)]).write.parquet(path)
    plan = plan_text(metrics.season_shift(spark.read.parquet(path), task), "simple")
    assert plan.count("FileScan") == 1
    # Partial aggregation comes before the first exchange.
    assert "partial_" in plan[plan.rindex("Exchange"):]


def test_extra_grouping(spark):
    rows = [(m, s, 1.0, float(m == "x")) for m in "xy" for s in ("1", "2")]
    df = spark.createDataFrame(rows, "m STRING, season STRING, target DOUBLE, prediction DOUBLE")
    found = {(r["m"], r["segment"]): r["accuracy"] for r in metrics.season_shift(df, by=["m"]).collect()}
    assert found == {(m, s): float(m == "x") for m in "xy" for s in ("1", "2", "overall")}
