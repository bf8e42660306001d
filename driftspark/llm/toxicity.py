"""Toxicity classifier: a linear model over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams within words, the spaces around a word included, hashed into buckets. For
each bucket the labelled texts of both classes that have it are counted, all of them, by Spark. The log of the ratio of
the two smoothed shares scales the bucket's feature: an n-gram that says nothing about the class has a feature near
zero, which a penalized linear model cannot lean on. The weights of the scaled features are fitted by logistic
regression on the driver over a bounded sample of the labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import extended, free_name, map_batches
from driftspark.llm.optimize import minimize
from driftspark.runtime import col, materialize

SHORTEST, LONGEST = 3, 6
# Buckets of n-grams, a power of two: the size of the counts and of the model, however many texts there are.
BITS = 18
# Labelled rows of the fit at most, chosen by the hash of their id; the ratios come from all labelled rows.
FIT_ROWS = 10_000
# Rows of labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SMOOTHING = 1.0
# A bucket has a feature if its log-count ratio is so many standard errors from zero, and so many rows have it.
ERRORS, MIN_ROWS = 3.0, 5
PENALTY = 1.0
# Characters that are hashed at once.
SEGMENT = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = ord(" ")


def buckets(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets of a whole text, null being the empty one; ``mark`` is scratch, a flag for each bucket."""
    mark[:] = False
    shift = np.uint64(65 - len(mark).bit_length())
    whole = f" {' '.join((text or '').lower().split())} "
    for start in range(0, len(whole), SEGMENT):
        part = whole[start : start + SEGMENT + LONGEST - 1]
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        spaces = np.cumsum(chars == _SPACE)
        chars = chars.astype(np.uint64)
        h = chars.copy()
        for n in range(2, min(LONGEST, len(chars)) + 1):
            h = h[:-1] * _STEP + chars[n - 1 :]
            if n >= SHORTEST:
                # A space may be the first or the last character, not one between.
                within = spaces[n - 2 : len(spaces) - 1] == spaces[: len(spaces) - n + 1]
                kept = h[within]
                mark[((kept ^ (kept >> np.uint64(29))) * _STEP >> shift).astype(np.int64)] = True
    return np.flatnonzero(mark)


@dataclass(frozen=True)
class Model:
    """A weight for each bucket (the fitted weight times the log-count ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        mark = np.zeros(len(self.weights), bool)
        raw = np.array([self.weights[buckets(x, mark)].sum() for x in texts], float) + self.intercept
        return 1 / (1 + np.exp(np.clip(-raw, -500, 500)))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training; a null id never is held out, nor can it have a label."""
    return F.coalesce(F.crc32(col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) by bucket, of the smoothed numbers p and q of positive and of other rows."""
    p, q = positive + smoothing, negative + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def logistic_fit(
    start: np.ndarray, index: np.ndarray, scale: np.ndarray, target: np.ndarray, penalty: float = PENALTY
) -> tuple[np.ndarray, float]:
    """Weights and intercept by penalized likelihood; row r has the features ``index[start[r]:start[r + 1]]``, whose
    values are those of ``scale``. Half a row of each class without features keeps the intercept finite."""
    width, size = len(scale), np.diff(start)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    target = np.concatenate([target, [0, 1]])
    counts = np.concatenate([np.ones(len(size)), [0.5, 0.5]])
    value = scale[index]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        raw = np.full(len(target), x[width])
        raw[: len(size)] += np.bincount(row, weights=value * x[index], minlength=len(size))
        cost = (counts * np.logaddexp(0, np.where(target == 1, -raw, raw))).sum() + penalty / 2 * (x[:width] @ x[:width])
        slope = counts * (1 / (1 + np.exp(np.clip(-raw, -500, 500))) - target)
        own = np.bincount(index, weights=value * slope[row], minlength=width) + penalty * x[:width]
        return float(cost), np.append(own, slope.sum())

    x = minimize(loss, np.zeros(width + 1))
    return x[:width], float(x[width])


def training_labels(labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic") -> DataFrame:
    """``id, target`` of the labelled rows that are not held out. Nulls give no label; of several rows for one id the
    positive one counts."""
    return (
        labels.where(col(id_column).isNotNull() & col(label_column).isNotNull() & ~held_out(id_column))
        .groupBy(col(id_column).cast("long").alias("id"))
        .agg(F.max((col(label_column) > 0).cast("int")).alias("target"))
    )


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one task: rows by bucket and class, and under bucket -1 all rows."""
        found = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        mark = np.zeros(1 << bits, bool)
        for batch in batches:
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[target, buckets(text, mark)] += 1
                rows[target] += 1
        on = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(on, -1).astype(np.int32)),
                pa.array(np.append(found[1, on], rows[1])),
                pa.array(np.append(found[0, on], rows[0])),
            ],
            ["bucket", "positive", "negative"],
        )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bits: int = BITS,
    fit_rows: int = FIT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    errors: float = ERRORS,
    penalty: float = PENALTY,
) -> Model | None:
    """A model from ``id, target`` rows (see ``training_labels``); None unless both classes have a text.

    ``labels`` are broadcast if they are at most ``broadcast_rows``, else both sides are shuffled by id.
    """
    labels = materialize(labels, "toxic-labels")
    small = labels.count() <= broadcast_rows
    texts = docs.select(col(id_column).cast("long").alias("id"), col(text_column).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(labels) if small else labels, "id")
    counts = labelled.select("text", "target").mapInArrow(
        _counted(bits), "bucket int, positive bigint, negative bigint"
    )
    # As many rows as there are buckets, at most.
    table = counts.groupBy("bucket").agg(F.sum("positive").alias("p"), F.sum("negative").alias("q")).toArrow()
    at, p, q = (table[name].to_numpy() for name in ("bucket", "p", "q"))
    totals = [int(x[at == -1].sum()) for x in (p, q)]
    if not all(totals):
        return None
    positive, negative = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    positive[at[at >= 0]], negative[at[at >= 0]] = p[at >= 0], q[at >= 0]
    ratio = log_count_ratios(positive, negative)
    error = np.sqrt(1 / (positive + SMOOTHING) + 1 / (negative + SMOOTHING))
    used = np.flatnonzero((np.abs(ratio) >= errors * error) & (positive + negative >= MIN_ROWS))
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        mark = np.zeros(1 << bits, bool)
        found = [shared.value[buckets(x, mark)] for x in batch.column(1).to_pylist()]
        lists = pa.array([x[x >= 0] for x in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["id", "target", "f"])

    chosen = F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    sample = map_batches(texts.join(chosen, "id"), listed, "id bigint, target int, f array<int>")
    # An id of many rows counts once in the sample, by its smallest list, so its size is bounded.
    sample = sample.groupBy("id").agg(F.max("target").alias("target"), F.min("f").alias("f")).orderBy("id").toArrow()
    lists = sample["f"].combine_chunks()
    start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    target = sample["target"].to_numpy().astype(np.int64)
    fitted, intercept = logistic_fit(start, lists.flatten().to_numpy(), ratio[used], target, penalty)
    weights = np.zeros(1 << bits)
    weights[used] = fitted * ratio[used]
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` and, as its last column, ``toxicity`` from 0 to 1; a name that ``docs`` has already gets a leading
    underscore.

    Each row gets its score from its whole text alone, null being the empty one, so repeated rows score alike and ties
    need no rule. No rows give no rows. Without a model (labels of one class only, or none) every score is zero.
    """
    name = free_name(docs, "toxicity")
    if model is None:
        return docs.select("*", F.lit(0.0).alias(name))
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    return map_batches(docs, add, extended(docs, **{name: "double"}))
