"""Language-model scores by Brown class-based n-grams.

Word counts and neighbour counts come from all training texts. Exchange clustering assigns words to classes, whose
number grows with the vocabulary: a word moves to the class that raises the class bigrams' likelihood most. The most
frequent words, whose table of bigrams is small, are exchanged one after the other until none moves. All other
frequent words then join, and the whole vocabulary is exchanged in rounds: the tasks count each word's neighbours by
class, and each word is judged from its own row of counts and the class bigrams of the round before. Words of a
round move together, which is the same on any cluster; a round that lowers the likelihood is taken back.
A token's probability is that of its class after the class before it, times that of the word in its class; both are
smoothed. Words that occur once or not at all share one class, and the end of a text is a class of its own.

Frequent words, whose number is bounded by their share of all tokens, are looked up by broadcast. Rare ones are
only needed for their counts, and meet those in a join; they are in the class of the words that occur once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import sorted_runs, words_of
from driftspark.runtime import col, materialize

# Words that are exchanged one after the other before the others join.
CORE = 1024
SWEEPS = 10
# Words of the frequent ones that occur at least so often get a class.
MIN_COUNT = 2
# Classes grow with this power of the number of words that get one: 16 for a thousand, 252 for a million.
CLASS_POWER = 0.4
# Exchanges of the whole vocabulary.
ROUNDS = 2
# Neighbour counts that a task gathers before it hands them on.
COUNT_KEYS = 2_000_000
# A word is frequent if its share of the training tokens reaches this, so there are a million at most.
FREQUENT_SHARE = 1e-6
# Class transitions are smoothed by so many counts of the class alone.
PRIOR = 1.0
# Distinct words that a task counts before it hands them on.
COUNT_WORDS = 300_000
HELD_OUT = (7, 2)


def held_out(doc_id: int | None) -> bool:
    """Whether a text is kept from training; a null id has the empty text's checksum."""
    modulus, remainder = HELD_OUT
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    ends = 0

    def out() -> pa.RecordBatch:
        words, n = list(counts.keys()), list(counts.values())
        if ends:
            words.append(None)
            n.append(ends)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held_out(doc_id):
                continue
            counts.update(words_of(text))
            ends += 1
            if len(counts) > COUNT_WORDS:
                yield out()
                counts.clear()
                ends = 0
    if counts or ends:
        yield out()


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of the first ``words`` rows of a square count matrix; the other rows are classes of their own.

    Words start in the classes by rank in turn. A word is taken out, and put where the likelihood of the class
    bigrams becomes largest; ties go to the lowest class. A sweep without a move ends it.
    """
    size = len(bigrams)
    own = np.concatenate([np.arange(words) % classes, classes + np.arange(size - words)])
    total = classes + size - words
    member = np.zeros((size, total))
    member[np.arange(size), own] = 1
    matrix = member.T @ bigrams @ member
    left, right = bigrams.sum(axis=1).astype(float), bigrams.sum(axis=0).astype(float)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own_class = own[w]
            member[w] = 0
            row, column, self_count = bigrams[w] @ member, bigrams[:, w] @ member, float(bigrams[w, w])
            matrix[own_class] -= row
            matrix[:, own_class] -= column
            matrix[own_class, own_class] -= self_count
            m = matrix[:classes]
            # Margins count the neighbours' bigrams with the word, wherever it goes.
            n_left = matrix.sum(axis=1)[:classes] + column[:classes]
            n_right = matrix.sum(axis=0)[:classes] + row[:classes]
            # The diagonal changes by row, column and self count together.
            d = np.arange(classes)
            rows = f(m + row) - f(m)
            columns = f(matrix[:, :classes] + column[:, None]) - f(matrix[:, :classes])
            diagonal = m[d, d]
            gain = rows.sum(axis=1) - rows[d, d] + columns.sum(axis=0) - columns[d, d]
            gain += f(diagonal + row[:classes] + column[:classes] + self_count) - f(diagonal)
            gain -= f(n_left + left[w]) - f(n_left) + f(n_right + right[w]) - f(n_right)
            best = int(gain.argmax())
            if gain[best] <= gain[own_class]:
                best = int(own_class)
            moved += best != own_class
            own[w] = best
            member[w, best] = 1
            matrix[best] += row
            matrix[:, best] += column
            matrix[best, best] += self_count
        if not moved:
            break
    return own


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for a term that does not depend on the classes."""
    return float(_f(matrix).sum() - _f(matrix.sum(axis=0)).sum() - _f(matrix.sum(axis=1)).sum())


def best_class(
    matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, alone: float, classes: int
) -> int:
    """Class, of the first ``classes``, where a word of class ``own`` makes the likelihood largest.

    ``matrix`` holds all class bigrams, those of the word included; ``after`` and ``before`` count its neighbours by
    class and ``alone`` how often it follows itself. It stays unless another class is better; ties go to the lowest.
    """
    right, left, d = np.flatnonzero(after), np.flatnonzero(before), np.arange(classes)
    rows, columns, diagonal = matrix[:classes, right], matrix[left, :classes].T, matrix[d, d]
    # Take the word out: its bigrams leave the row and the column of its class.
    rows[:, right == own] -= before[:classes, None]
    columns[:, left == own] -= after[:classes, None]
    if own < classes:
        rows[own] -= after[right]
        columns[own] -= before[left]
        # The cell of the class with itself lost either side above only where it is in ``right`` or ``left``.
        diagonal[own] -= after[own] + before[own] + alone
        rows[own, right == own] = diagonal[own]
        columns[own, left == own] = diagonal[own]
    # Margins keep the neighbours' bigrams with the word, wherever it goes.
    n_left, n_right = matrix.sum(axis=1)[:classes], matrix.sum(axis=0)[:classes]
    n, m = after.sum() + alone, before.sum() + alone
    if own < classes:
        n_left[own] -= n
        n_right[own] -= m
    gain = (_f(rows + after[right]) - _f(rows)).sum(axis=1) + (_f(columns + before[left]) - _f(columns)).sum(axis=1)
    x, y = after[:classes], before[:classes]
    gain += _f(diagonal + x + y + alone) - _f(diagonal + x) - _f(diagonal + y) + _f(diagonal)
    gain -= _f(n_left + n) - _f(n_left) + _f(n_right + m) - _f(n_right)
    best = int(gain.argmax())
    return own if own < classes and gain[best] <= gain[own] else best


@dataclass(frozen=True)
class Model:
    """Frequent words, with class, known count and emission; transitions by class; totals of the training text."""

    words: Broadcast | None
    classes: np.ndarray
    emission: np.ndarray
    log_count: np.ndarray
    transition: np.ndarray
    rest: int
    end: int
    rest_total: float
    base_total: float
    end_log_count: float
    train_tokens: int
    trained: bool
    classed_share: float


def _symbols(index: dict[bytes, int], text: str | None, end: int) -> np.ndarray:
    """Numbers of the words of a text between two ends; ``end - 1`` is any word without a number."""
    words = words_of(text)
    ids = np.full(len(words) + 2, end, np.int64)
    ids[1:-1] = np.fromiter(map(index.get, words, repeat(end - 1)), np.int64, len(words))
    return ids


def _bigram_counter(names: list[bytes]):
    end = len(names) + 1
    size = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: n for n, w in enumerate(names)}
        counts = np.zeros(size * size, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held_out(doc_id):
                    continue
                ids = _symbols(index, text, end)
                pairs, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
                counts[pairs] += n
        pairs = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts[pairs])], ["pair", "n"])

    return run


# Codes of neighbour counts, per word: classes after it, classes before it, and the word itself after it.
_MATRIX = -1


def _neighbour_counter(shared: Broadcast, known: int, own: np.ndarray, total: int, wanted: bool):
    """Counts of class bigrams (``word`` is -1) and, if ``wanted``, of each word's neighbours by class."""
    words = len(own)
    width = 2 * total + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        # Words without a class share one, whether they have a number or not.
        classes = np.concatenate([own, np.full(known + 1 - words, total - 2), [total - 1]])
        matrix = np.zeros(total * total, np.int64)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        cells: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

        def out(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(word.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["word", "code", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held_out(doc_id):
                    continue
                ids = _symbols(index, text, known + 1)
                chain = classes[ids]
                cells.append(chain[:-1] * total + chain[1:])
                if not wanted:
                    continue
                a, b = ids[:-1], ids[1:]
                same = a == b
                first, second = (a < words) & ~same, (b < words) & ~same
                waiting += [
                    a[first] * width + chain[1:][first],
                    b[second] * width + total + chain[:-1][second],
                    a[same & (a < words)] * width + 2 * total,
                ]
                size += 2 * len(ids)
                if size >= COUNT_KEYS:
                    keys, counts = merged()
                    waiting, size = [], 0
                    if len(keys) >= COUNT_KEYS:
                        yield out(keys // width, keys % width, counts)
                        keys, counts = keys[:0], counts[:0]
            if cells:
                matrix += np.bincount(np.concatenate(cells), minlength=total * total)
                cells = []
        if waiting:
            keys, counts = merged()
        yield out(keys // width, keys % width, counts)
        filled = np.flatnonzero(matrix)
        yield out(np.full(len(filled), _MATRIX), filled, matrix[filled])

    return run


def _movers(own: np.ndarray, matrix: np.ndarray, classes: int):
    total = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["word"]):
            word, code, n = (rows[c].to_numpy() for c in ("word", "code", "n"))
            bounds = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(word))
            moved: list[tuple[int, int]] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                near = np.zeros(2 * total + 1)
                near[code[a:b]] = n[a:b]
                now = int(own[word[a]])
                best = best_class(matrix, now, near[:total], near[total:-1], near[-1], classes)
                if best != now:
                    moved.append((int(word[a]), best))
            if moved:
                names, found = zip(*moved, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(found, pa.int32())], ["word", "class"])

    return run


def cluster(
    texts: DataFrame, shared: Broadcast, names: list[bytes], words: int, classes: int, core: int, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the first ``words`` of ``names``, the most frequent first, and the counts of class bigrams.

    Two classes follow those of the words: one of words that have none, and the end of a text. The driver sees the
    bigrams of the ``core`` and of classes, and the words that move, which are in the dictionary anyway.
    """
    core = min(core, words)
    size, total = core + 2, classes + 2
    pairs = (
        texts.mapInArrow(_bigram_counter(names[:core]), "pair bigint, n bigint")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most size * size rows
    )
    bigrams = np.zeros(size * size, np.int64)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    own = np.full(words, classes, np.int64)
    own[:core] = exchange(bigrams.reshape(size, size), core, classes)[:core]
    kept: tuple[np.ndarray, np.ndarray, float] | None = None
    for n in range(rounds + 1):
        counter = _neighbour_counter(shared, len(names), own, total, n < rounds)
        near = texts.mapInArrow(counter, "word int, code int, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))
        near = materialize(near, "neighbours")
        cells = near.where(F.col("word") == _MATRIX).toArrow()  # at most total * total rows
        matrix = np.zeros(total * total)
        matrix[cells["code"].to_numpy()] = cells["n"].to_numpy()
        matrix = matrix.reshape(total, total)
        reached = likelihood(matrix)
        if kept is not None and reached <= kept[2]:
            break
        kept = own, matrix, reached
        if n == rounds:
            break
        rows = near.where(F.col("word") != _MATRIX).repartition("word").sortWithinPartitions("word")
        moved = rows.mapInArrow(_movers(own, matrix, classes), "word int, class int").toArrow()
        if not len(moved):
            break
        own = own.copy()
        own[moved["word"].to_numpy()] = moved["class"].to_numpy()
    return kept[0], kept[1]


def fit(
    texts: DataFrame,
    core: int = CORE,
    classes: int | None = None,
    share: float = FREQUENT_SHARE,
    min_count: int = MIN_COUNT,
    rounds: int = ROUNDS,
) -> tuple[Model, DataFrame]:
    """A model of the training rows of ``texts`` (``doc_id``, ``text``), and all words with their counts."""
    counted = texts.mapInArrow(_count_words, "word binary, n bigint")
    vocabulary = materialize(counted.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    tokens, distinct, ends = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0))
    ).first()
    frequent = vocabulary.where(F.col("word").isNotNull() & (F.col("c") >= max(1.0, tokens * share))).toArrow()
    order = sorted(zip((-frequent["c"].to_numpy()).tolist(), frequent["word"].to_pylist(), strict=True))
    names, counts = [w for _, w in order], np.array([-c for c, _ in order], np.int64)
    words = int((counts >= min_count).sum())
    classes = max(1, min(classes or math.ceil(words**CLASS_POWER), min(core, words)))
    shared = texts.sparkSession.sparkContext.broadcast({w: n for n, w in enumerate(names)})
    own, matrix = cluster(texts, shared, names, words, classes, core, rounds)
    total = classes + 2
    rest, end = classes, classes + 1
    alone = (matrix.sum(axis=0) + 1) / (matrix.sum() + total)
    transition = (matrix + PRIOR * alone) / (matrix.sum(axis=1, keepdims=True) + PRIOR)
    # Without a round of exchanges the words that are not in the core have no class of their own.
    own = np.concatenate([own, np.full(len(names) - words, rest)])
    in_class = np.bincount(own, weights=counts, minlength=total)
    in_classes = int(counts[own < rest].sum())
    rest_total = float(tokens - ends - in_classes + (distinct - bool(ends) - int((own < rest).sum())) + 1)
    model = Model(
        shared,
        own,
        np.where(own < rest, np.log10(counts / np.maximum(in_class[own], 1)), np.log10((counts + 1) / rest_total)),
        np.log10(counts + 1),
        np.log10(transition),
        rest,
        end,
        float(np.log10(rest_total)),
        float(np.log10(tokens + distinct + 1)),
        float(np.log10(ends + 1)),
        int(tokens),
        bool(ends),
        in_classes / max(1, tokens - ends),
    )
    return model, vocabulary


def _score(dictionary: Broadcast, shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = shared.value, dictionary.value
        unknown = len(index)
        classes = np.append(model.classes, model.rest)
        emission = np.append(model.emission, -model.rest_total)
        log_count = np.append(model.log_count, 0.0)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(index.get, words, repeat(unknown)), np.int64, len(words))
                chain = np.full(len(words) + 2, model.end, np.int64)
                chain[1:-1] = classes[ids]
                rare = Counter(words[n] for n in np.flatnonzero(ids == unknown).tolist())
                n_tokens = len(words) + 1
                score = model.transition[chain[:-1], chain[1:]].sum() + emission[ids].sum()
                base = log_count[ids].sum() + model.end_log_count - n_tokens * model.base_total
                known = int((ids != unknown).sum()) + model.trained
                rows.append((number, None, n_tokens, known, float(base), float(score), doc_id, held_out(doc_id)))
                rows += [(number, w, n, None, None, None, None, None) for w, n in rare.items()]
                number += 1
            names = ["row", "word", "n", "known", "base", "score", "doc_id", "held_out"]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def score(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    core: int = CORE,
    classes: int | None = None,
    share: float = FREQUENT_SHARE,
    min_count: int = MIN_COUNT,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``perplexity`` per row; scores are sums of log10 probabilities over the words and the end of a text.

    Null texts are empty: their one token is the end. Every row is scored, those with repeated or null ids too;
    which rows train is decided by the id. Without training rows every word is unknown. No rows give no rows.
    """
    texts = docs.select(
        col(id_column).cast("long").alias("doc_id"), col(text_column).cast("string").alias("text")
    )
    model, vocabulary = fit(texts, core, classes, share, min_count, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, words=None))
    schema = (
        "row bigint, word binary, n bigint, known bigint, base double, score double, doc_id bigint, held_out boolean"
    )
    found = materialize(texts.mapInArrow(_score(model.words, shared), schema), "scores")
    more = F.log10(F.coalesce("c", F.lit(0)) + 1) * F.col("n")
    rare = (
        found.where("word is not null")
        .select("row", "word", "n")
        .join(vocabulary.where("word is not null"), "word", "left")
        .groupBy("row")
        .agg(F.sum(more).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    )
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return (
        found.where("word is null")
        .drop("word")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(model.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            total.alias("score"),
            F.pow(F.lit(10.0), -total / F.col("n")).alias("perplexity"),
        )
    )
