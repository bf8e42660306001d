"""Interaction of document filters: what each of them removes in every order of them, by part of the corpus.

A document fails some of five filters; the set of those it fails is a mask, and counts of masks by part answer every
order. Four filters look at one text. The fifth asks for copies of a text with a smaller id, table-wide: texts whose
first characters nobody shares are alone, and the others are dealt by ranges of prefixes, each long enough that not too
many bytes share it, and inserted whole into compressed tries. A terminal holds the smallest id of its text, so a
traversal knows which of its documents are copies. Copies within a task are joined before they are shuffled, so a text
that many rows share is a few rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import sorted_runs, text_or_empty
from driftspark.llm.suffixes import common_prefix, gram_filter
from driftspark.runtime import col, materialize, shuffle_tasks

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # per cent
MOST_CAPITALS = 5  # per cent
# Characters that tell most texts apart; texts that share them go through the tries.
FIRST = 64
# Lengths of prefixes in bytes: a prefix that too many bytes share is cut at the next one.
PREFIXES = tuple(16 << (2 * n) for n in range(12))
# Bytes of texts that a task joins before it hands them on, and that one trie of a range holds, give or take a group.
TRIE_BYTES = 16 << 20
# Rows of labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_CAPITALS = re.compile(r"[A-Z]+")
_MARKS = re.compile(r"[#$%&*|]")

_GROUP = "struct<part:string,good:boolean,toxic:boolean,copy:boolean,n:bigint>"
_JOINED = f"text binary, mask int, low bigint, groups array<{_GROUP}>"
_COUNTS = "part string, mask int, good boolean, toxic boolean, n bigint"


def own_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.encode("utf-8", "surrogatepass").split()
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * sum(map(len, _CAPITALS.findall(text))) > MOST_CAPITALS * len(text)) << 2
        | (_MARKS.search(text) is not None) << 3
    )


class Trie:
    """Compressed trie of byte strings; a terminal holds its mask, its smallest id and the counts of its documents.

    Counts have the key (part, good, toxic, copy): ``copy`` is true for documents known to have a larger id than the
    smallest, false for those that have the smallest, and null for those without an id, which are no copies.
    """

    __slots__ = ("held", "root")

    def __init__(self) -> None:
        # A node is its label, its children by their first byte, and its terminal or None.
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, text: bytes, mask: int) -> list:
        """The terminal of a whole text: mask, smallest id and counts."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                node, at = child, len(text)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, text[at : at + len(label)])
            upper = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][text[at]] = upper
            node, at = upper, at + shared
        if node[2] is None:
            node[2] = [mask, None, Counter()]
            self.held += len(text)
        return node[2]

    def insert(self, text: bytes, mask: int, low: int | None, groups: list[tuple[tuple, int]]) -> None:
        """Add documents of one text whose smallest id is ``low`` (None: none has an id)."""
        found = self.terminal(text, mask)
        if low is not None and (found[1] is None or low < found[1]):
            # What had the smallest id so far are copies now.
            for key in [k for k in found[2] if k[3] is False]:
                found[2][(*key[:3], True)] += found[2].pop(key)
            found[1] = low
        later = low is not None and low > found[1]
        for key, n in groups:
            found[2][(*key[:3], True) if later and key[3] is False else key] += n

    def terminals(self) -> Iterator[tuple[list[bytes], list]]:
        """The labels that make up each text, in a list that is used again, and its terminal."""
        path: list[bytes] = []
        stack = [(0, self.root)]
        while stack:
            depth, (label, children, found) = stack.pop()
            path[depth:] = [label]
            if found is not None:
                yield path, found
            stack += [(depth + 1, child) for child in children.values()]


def _joined(shared):
    """Of documents: one row for each text of a task that may have copies elsewhere, and counts of the others."""

    def row(text: bytes | None, mask: int, low: int | None, counts: Counter) -> tuple:
        return text, mask, low, [dict(zip(("part", "good", "toxic", "copy", "n"), (*k, n), strict=True)) for k, n in counts.items()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        group = pa.struct([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("copy", pa.bool_()), ("n", pa.int64())])
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.list_(group))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["text", "mask", "low", "groups"]
        )

    def whole(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, (mask, low, counts) in trie.terminals():
            text = b"".join(path)
            rows.append(row(text, mask, low, counts))
            size += len(text)
            if size > TRIE_BYTES // 4:
                yield table(rows)
                rows, size = [], 0
        yield table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, alone = Trie(), {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            met = shared.value.has(batch.column(5).to_numpy().view("uint64"))
            for doc_id, text, part, good, toxic, again in zip(*columns, met, strict=True):
                mask = own_mask(text)
                key = (part, good, toxic, None if doc_id is None else False)
                if again:
                    trie.insert(text.encode("utf-8", "surrogatepass"), mask, doc_id, [(key, 1)])
                else:
                    alone.setdefault(mask, Counter())[key] += 1
            if trie.held > TRIE_BYTES:
                yield from whole(trie)
                trie = Trie()
            if sum(map(len, alone.values())) > 100_000:
                yield table([row(None, mask, None, counts) for mask, counts in alone.items()])
                alone = {}
        yield from whole(trie)
        yield table([row(None, mask, None, counts) for mask, counts in alone.items()])

    return run


def _traversed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of masks of texts that come in runs of one prefix; texts of different prefixes differ."""

    def counted(trie: Trie) -> Counter:
        found: Counter = Counter()
        for _, (mask, _, counts) in trie.terminals():
            for (part, good, toxic, copy), n in counts.items():
                found[part, mask | COPY if copy else mask, good, toxic] += n
        return found

    def table(found: Counter) -> pa.RecordBatch:
        columns = list(zip(*((*k, n) for k, n in found.items()), strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "mask", "good", "toxic", "n"]
        )

    found: Counter = Counter()
    trie = Trie()
    for runs in sorted_runs(batches, ["prefix"]):
        for row in runs.select(["text", "mask", "low", "groups"]).to_pylist():
            groups = [((g["part"], g["good"], g["toxic"], g["copy"]), g["n"]) for g in row["groups"]]
            trie.insert(row["text"], row["mask"], row["low"], groups)
        # The last prefix of the runs is whole too, so the trie may go.
        if trie.held > TRIE_BYTES:
            found.update(counted(trie))
            trie = Trie()
            if len(found) > 100_000:
                yield table(found)
                found = Counter()
    found.update(counted(trie))
    yield table(found)


def adaptive_prefix(texts: DataFrame, tasks: int, lengths: tuple[int, ...] = PREFIXES) -> Column:
    """Prefix of the column ``text`` (binary) that a row is dealt by, shorter where few bytes share it.

    A prefix is cut at the next of ``lengths`` if the texts that have it hold over one task's share of all bytes; there
    are fewer than ``tasks`` such prefixes of one length, so their list is bounded.
    """
    size = F.octet_length("text").cast("long")
    total, longest = texts.agg(F.sum(size), F.max(size)).first()
    within, levels = F.lit(True), []
    for length, longer in zip(lengths, lengths[1:], strict=False):
        if not total or longest <= length:
            break
        prefix = F.substring("text", 1, length)
        shared = texts.where(within).select(prefix.alias("prefix"), size.alias("size"))
        heavy = shared.groupBy("prefix").agg(F.sum("size").alias("size")).where(F.col("size") > total / tasks)
        found = [bytes(row["prefix"]) for row in heavy.select("prefix").collect()]
        if not found:
            break
        within = prefix.isin(found)
        levels.append((within, F.substring("text", 1, longer)))
    cut = F.substring("text", 1, lengths[0])
    for shared, longer in levels:
        cut = F.when(shared, longer).otherwise(cut)
    return cut


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
    broadcast_rows: int = BROADCAST_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by part, filters they fail (bit 0 for A) and labels."""
    spark = docs.sparkSession
    marks = materialize(
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")),
        "marks",
    )
    small = marks.count() <= broadcast_rows
    texts = docs.select(
        col(id_column).cast("long").alias("id"),
        text_or_empty(text_column).alias("text"),
        F.coalesce(col(part_column).cast("string"), F.lit("")).alias("part"),
    )
    first = F.xxhash64(F.substring("text", 1, FIRST)).alias("gram")
    again = texts.select(first).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = spark.sparkContext.broadcast(gram_filter(materialize(again, "shared-prefixes")))
    marked = texts.join(F.broadcast(marks) if small else marks, "id", "left").select(
        "id", "text", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), first
    )
    joined = materialize(marked.mapInArrow(_joined(shared), _JOINED), "joined-texts")
    met = joined.where("text is not null")
    tasks = tasks or shuffle_tasks(spark)
    dealt = (
        met.withColumn("prefix", adaptive_prefix(met, tasks))
        .repartitionByRange(tasks, "prefix")
        .sortWithinPartitions("prefix")
    )
    alone = joined.where("text is null").select("mask", F.inline("groups"))
    counts = dealt.mapInArrow(_traversed, _COUNTS).union(alone.select("part", "mask", "good", "toxic", "n"))
    return counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _sum_of(counts: Column, masks: list[int]) -> Column:
    return reduce(Column.__add__, [F.get(counts, F.lit(m)) for m in masks])


def order_report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from ``mask_counts``.

    What a set of filters keeps is the number of documents that fail none of them; each step is a difference of two
    such numbers, so a part's 32 numbers answer all orders.
    """
    size = 1 << len(filters)

    def by_mask(condition: Column | None, name: str) -> list[Column]:
        n = F.col("n") if condition is None else F.when(condition, F.col("n"))
        return [F.coalesce(F.sum(F.when(F.col("mask") == m, n)), F.lit(0)).alias(f"{name}{m}") for m in range(size)]

    names = {"all": None, "good": F.col("good"), "toxic": F.col("toxic")}
    wide = counts.groupBy("part").agg(*[c for name, condition in names.items() for c in by_mask(condition, name)])
    rows = wide.select("part", *[F.array(*[F.col(f"{name}{m}") for m in range(size)]).alias(f"n_{name}") for name in names])
    kept = rows.select(
        "part",
        "n_all",
        *[
            F.array(*[_sum_of(F.col(f"n_{name}"), [m for m in range(size) if not m & s]) for s in range(size)]).alias(f"k_{name}")
            for name in names
        ],
    )

    def shapley(at: int) -> Column:
        """Documents that one filter removes, over all orders: each set before it comes in so many of them."""
        bit = 1 << at
        terms = [
            (F.get("k_all", F.lit(s)) - F.get("k_all", F.lit(s | bit)))
            * factorial(s.bit_count())
            * factorial(len(filters) - 1 - s.bit_count())
            for s in range(size)
            if not s & bit
        ]
        return reduce(Column.__add__, terms)

    failing = [_sum_of(F.col("n_all"), [m for m in range(size) if m >> at & 1]) for at in range(len(filters))]
    kept = kept.select(
        "*",
        F.array(*failing).alias("failing"),
        F.array(*[shapley(at) for at in range(len(filters))]).alias("shapley"),
    )
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, at in enumerate(order, 1):
            after = before | 1 << at
            steps.append([("".join(filters[x] for x in order)), step, at, 1 << at, before, after])
            before = after
    names = ("filter_order", "step", "at", "alone", "before", "after")
    kind = "array<struct<filter_order:string,step:int,at:int,alone:int,before:int,after:int>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in steps])), kind)
    exploded = kept.select("*", F.inline(table))

    def lost(name: str) -> Column:
        return F.get(f"k_{name}", F.col("before")) - F.get(f"k_{name}", F.col("after"))

    return exploded.select(
        "part",
        "filter_order",
        "step",
        F.get("k_all", F.col("after")).alias("kept"),
        lost("all").alias("removed"),
        (F.get("failing", F.col("at")) - lost("all")).alias("redundant"),
        F.get("n_all", F.col("alone")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("at")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Parts are the values of ``source`` (null: the empty string), with 600 rows each: 120 orders of five steps. A null
    text is the empty one, which fails filter A and is a copy of other empty texts. Rows of one id are documents of
    their own and no copies of each other, since neither id is smaller; a row without an id is never a copy and makes
    none. Of several label rows for an id, any that says good or toxic counts; nulls say neither. No documents give no
    rows. ``docs`` may have further columns of any name.
    """
    return order_report(mask_counts(docs, labels, **options))
