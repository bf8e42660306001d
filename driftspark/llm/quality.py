"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is the set of its hashed words and shape marks. One weight vector, shared by all grades, gives a score;
ordered thresholds cut the score into grades: P(grade <= k) = sigmoid(threshold_k - score). The fit runs on the
driver over a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import extended, free_name, map_batches
from driftspark.llm.optimize import minimize
from driftspark.runtime import col, materialize

GRADES = 3
# Labelled rows of the fit at most, chosen by the hash of their id.
FIT_ROWS = 10_000
# A hashed feature counts if as many rows of the fit have it.
MIN_ROWS = 5
PENALTY = 0.3
# A row is selected if the probability of the highest grade reaches this.
SELECT = 0.5

_EDGES = string.punctuation.encode()
_UPPER = string.ascii_uppercase.encode()


def _share(part: int, whole: int) -> int:
    """Share in twentieths; small shares are told from none."""
    return -1 if not part else 20 * part // max(whole, 1)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit features of a whole text; null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    distinct = set(words)
    found = {zlib.crc32(b"w" + w.strip(_EDGES)) for w in distinct}
    marks = {w[len(w.rstrip(_EDGES)) :] for w in distinct}
    found.update(zlib.crc32(b"m" + m[:8]) for m in marks if m)
    size = len(raw)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    shape = (
        b"u%d" % _share(size - len(raw.translate(None, _UPPER)), size),
        b"p%d" % _share(size - len(raw.translate(None, _EDGES)), size),
        b"r%d" % _share(repeats, len(words)),
        b"d%d" % _share(len(distinct), len(words)),
        b"n%d" % len(words).bit_length(),
    )
    found.update(zlib.crc32(b"s" + s) for s in shape)
    return np.fromiter(sorted(found), np.uint32, len(found))


@dataclass(frozen=True)
class Model:
    """Hashed features in ascending order, their weights, and the ascending thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        if not len(self.keys):
            return 0.0
        own = features(text)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return float(self.weights[at[self.keys[at] == own]].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by column."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``grade`` from 0/1 labels: toxic 0, else poor 1, else good 2. Rows with a null in a label or
    id are left out; of several rows for one id the lowest grade counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )


def ordinal_fit(
    start: np.ndarray,
    index: np.ndarray,
    grade: np.ndarray,
    width: int,
    grades: int,
    penalty: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by penalized likelihood.

    Row r has the features ``index[start[r]:start[r + 1]]``. The thresholds are the first one and the logarithms
    of the gaps, so their order holds at every step. Half a row of each grade, with no features, keeps them finite
    where a grade is missing.
    """
    size = np.diff(start)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    grade = np.concatenate([grade, np.arange(grades)])
    counts = np.concatenate([np.ones(len(size)), np.full(grades, 0.5)])
    rows = len(grade)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, first, gaps = x[:width], x[width], np.exp(np.clip(x[width + 1 :], -20, 20))
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.zeros(rows)
        score[: len(size)] = np.bincount(row, weights=w[index], minlength=len(size))
        high = 1 / (1 + np.exp(-np.clip(cuts[grade + 1] - score, -500, 500)))
        low = 1 / (1 + np.exp(-np.clip(cuts[grade] - score, -500, 500)))
        high[grade == grades - 1], low[grade == 0] = 1.0, 0.0
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = counts * high * (1 - high) / chance, counts * low * (1 - low) / chance
        value = -(counts * np.log(chance)).sum() + penalty / 2 * (w @ w)
        per_row = d_high - d_low
        d_w = np.bincount(index, weights=per_row[row], minlength=width) + penalty * w
        d_cuts = np.bincount(grade, weights=-d_high, minlength=grades)[: grades - 1]
        d_cuts += np.bincount(grade, weights=d_low, minlength=grades)[1:]
        after = np.cumsum(d_cuts[::-1])[::-1]
        return float(value), np.concatenate([d_w, [after[0]], after[1:] * gaps])

    x = minimize(loss, np.zeros(width + grades - 1))
    gaps = np.exp(np.clip(x[width + 1 :], -20, 20))
    return x[:width], x[width] + np.concatenate([[0], np.cumsum(gaps)])


def fit(
    docs: DataFrame,
    grades: DataFrame,
    text_column: str = "text",
    levels: int = GRADES,
    fit_rows: int = FIT_ROWS,
    min_rows: int = MIN_ROWS,
    penalty: float = PENALTY,
) -> Model | None:
    """A model from at most ``fit_rows`` graded ids; None if no document has a grade."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x).view(np.int32) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "f"]
        )

    sample = docs.select(col("doc_id").cast("long").alias("doc_id"), col(text_column).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    rows = map_batches(sample, hashed, "doc_id bigint, grade int, f array<int>")
    pairs = materialize(rows.select("doc_id", "grade", F.explode("f").alias("f")).distinct(), "fit")
    often = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    # One short list for each row of the bounded sample.
    table = pairs.join(often.select("f"), "f").groupBy("doc_id", "grade").agg(F.collect_list("f").alias("f"))
    table = table.orderBy("doc_id").toArrow()
    if not table.num_rows:
        return None
    lists = table["f"].combine_chunks()
    start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    keys, index = np.unique(lists.flatten().to_numpy().view(np.uint32), return_inverse=True)
    grade = table["grade"].to_numpy().astype(np.int64)
    weights, thresholds = ordinal_fit(start, index.astype(np.int32), grade, len(keys), levels, penalty)
    return Model(keys, weights, thresholds)


def score(docs: DataFrame, model: Model | None, text_column: str = "text", select: float = SELECT) -> DataFrame:
    """``docs`` and, as its last three columns, ``quality_grade`` (expected), ``quality_tail`` (array:
    P(grade >= 1), ...) and ``quality_keep``; a name that ``docs`` has already gets a leading underscore.

    Each row gets its result from its whole text, null being the empty one. Without a model (no labelled
    document) the first two are null and every row is kept.
    """
    grade, tail, keep = (free_name(docs, "quality_" + name) for name in ("grade", "tail", "keep"))
    if model is None:
        return docs.select(
            "*",
            F.lit(None).cast("double").alias(grade),
            F.lit(None).cast("array<double>").alias(tail),
            F.lit(True).alias(keep),
        )
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        tails = own.tails(np.array([own.score(x) for x in batch.column(at).to_pylist()], float))
        new = [
            pa.array(tails.sum(axis=1)),
            pa.array(list(tails), pa.list_(pa.float64())),
            pa.array(tails[:, -1] >= select),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, grade, tail, keep])

    return map_batches(docs, add, extended(docs, **{grade: "double", tail: "array<double>", keep: "boolean"}))
