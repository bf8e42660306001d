"""Exact chronological split without a global sort.

A position-based cut only needs the sort key of the row that sits at the cut. That key is found by
counting: rows per calendar day first, then, inside the one day that holds the cut, rows per ever
longer prefix of the key, until few enough rows are left to rank. After that the split of a row is
a comparison of its own key with two literals: no shuffle, no window, no sort over the rows, however
many of them share a day.
"""

from __future__ import annotations

import os.path
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.operators.lookup import join_lookup
from driftspark.runtime import col, free_names, materialize, shuffle_tasks

SPLITS = ("train", "val", "test")

# Rows that one task may rank to settle a cut.
RANK_LIMIT = 100_000
# Copies that one task emits when a cut falls inside a run of identical rows.
COPY_CHUNK = 100_000
# A day is the first ten characters of an ISO date: bounded by the calendar.
DAY_LENGTH = 10
# Characters by which a prefix grows per counting pass.
PREFIX_STEP = 2

_LAST = "\U0010ffff"


@dataclass(frozen=True)
class Boundary:
    """Key of the row at the cut, and how many rows with that same key lie before the cut."""

    key: tuple[str, ...]
    copies_before: int


def check_ratios(train_ratio: float, val_ratio: float) -> None:
    if train_ratio < 0 or val_ratio < 0:
        raise ValueError("split ratios cannot be negative")


def _row_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[col(name) for name in rows.columns])), 256)


def _order_keys(rows: DataFrame) -> list[Column]:
    """Ascending text keys: date, game, home side first. Nulls come last, as a sort puts them."""
    keys = [
        F.coalesce(col(name).cast("string"), F.lit(_LAST))
        for name in ("date", "game_id")
        if name in rows.columns
    ]
    if "is_home" in rows.columns:
        keys.append(F.when(F.col("is_home") == 1, "0").otherwise("1"))
    return keys


def _ranges(rows: DataFrame, bucket: Column, weight: Column | None = None) -> DataFrame:
    """Rows (or their ``weight``) per bucket with the position range ``[start, stop)`` each bucket covers.

    The window runs over one row per bucket, never over ``rows``.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(bucket.alias("bucket")).agg(size.alias("n"))
    stop = F.sum("n").over(Window.orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("bucket", "n", stop.alias("stop"), total.alias("total")).withColumn(
        "start", F.col("stop") - F.col("n")
    )


def _holding(ranges: DataFrame, position: Column) -> Column:
    return (F.col("start") <= position) & (position < F.col("stop"))


def _settle(
    rows: DataFrame, keys: list[Column], inside: Column, n: int, position: int, weight: Column | None = None
) -> Boundary:
    """Boundary for ``position`` among the ``n`` rows where ``inside`` holds.

    With ``weight`` each row of ``rows`` stands for so many, and ``copies_before`` are those of the row at the cut.
    """
    fixed = 0
    while n > RANK_LIMIT and fixed < len(keys):
        key = keys[fixed]
        low, high = (
            rows.where(inside).agg(F.min(key), F.max(key)).first()
        )
        if low == high:
            inside = inside & (key == low)
            fixed += 1
            continue
        shared = len(os.path.commonprefix([low, high]))
        prefix = F.left(key, F.lit(shared + PREFIX_STEP))
        ranges = _ranges(rows.where(inside), prefix, weight)
        hit = ranges.where(_holding(ranges, F.lit(position))).first()
        inside = inside & (prefix == hit["bucket"])
        n, position = hit["n"], position - hit["start"]
    names = [f"k{i}" for i in range(len(keys))]
    if weight is not None:
        # Rows with equal keys do not occur here, so every key being settled leaves one row.
        line = F.sum("w").over(Window.orderBy(*names))
        groups = rows.where(inside).select(*[k.alias(name) for k, name in zip(keys, names)], weight.alias("w"))
        hit = groups.withColumn("start", line - F.col("w")).where(
            (F.col("start") <= position) & (F.col("start") + F.col("w") > position)
        ).first()
        return Boundary(tuple(hit[name] for name in names), position - hit["start"])
    found = rows.where(inside).select(*[k.alias(name) for k, name in zip(keys, names)])
    if n > RANK_LIMIT:
        # Every key is the same for all that is left.
        return Boundary(tuple(found.first()), position)
    order = Window.orderBy(*names)
    hit = (
        found.select(*names, F.row_number().over(order).alias("at"), F.rank().over(order).alias("first"))
        .where(F.col("at") == position + 1)
        .first()
    )
    return Boundary(tuple(hit[name] for name in names), hit["at"] - hit["first"])


def _located(
    rows: DataFrame, day: Column, train_ratio: float, val_ratio: float, weight: Column | None = None
) -> list[tuple[Column, int, int] | None]:
    """For each cut the day that holds it, rows of that day and the position within; None if all rows lie before.

    The cuts are ``n * ratio`` truncated in double arithmetic.
    """
    check_ratios(train_ratio, val_ratio)
    ranges = _ranges(rows, day, weight)
    cuts = [
        (F.col("total") * F.lit(ratio)).cast("long")
        for ratio in (float(train_ratio), float(train_ratio + val_ratio))
    ]
    # At most two rows: the days that hold a cut.
    days = (
        ranges.select("bucket", "n", "start", "stop", *[c.alias(f"cut{i}") for i, c in enumerate(cuts)])
        .where(_holding(ranges, F.col("cut0")) | _holding(ranges, F.col("cut1")))
        .collect()
    )
    located: list[tuple[Column, int, int] | None] = []
    for i in range(2):
        hit = next((d for d in days if d["start"] <= d[f"cut{i}"] < d["stop"]), None)
        located.append(
            None if hit is None
            else (day == hit["bucket"], hit["n"], hit[f"cut{i}"] - hit["start"])
        )
    return located


def split_boundaries(
    rows: DataFrame, train_ratio: float = 0.6, val_ratio: float = 0.2
) -> tuple[list[Boundary | None], list[Column]]:
    """Boundaries of the two cuts and the keys they compare with; ``None`` puts all rows before a cut."""
    keys = _order_keys(rows)
    located = _located(rows, F.left(keys[0], F.lit(DAY_LENGTH)), train_ratio, val_ratio)
    boundaries = [None if spot is None else _settle(rows, keys, *spot) for spot in located]
    if any(b is not None and b.copies_before for b in boundaries):
        # A cut falls among rows with one key: let the whole row decide, through its digest.
        keys = [*keys, _row_digest(rows)]
        boundaries = [None if spot is None else _settle(rows, keys, *spot) for spot in located]
    return boundaries, keys


def _before(keys: Sequence[Column], boundary: Boundary) -> Column:
    result = F.lit(False)
    for key, value in reversed(list(zip(keys, boundary.key))):
        result = (key < value) | ((key == value) & result)
    return result


def _equal(keys: Sequence[Column], boundary: Boundary) -> Column:
    return reduce(lambda a, b: a & b, [k == v for k, v in zip(keys, boundary.key)])


def _label(before_first: Column, before_second: Column) -> Column:
    return (
        F.when(before_first, SPLITS[0]).when(before_second, SPLITS[1]).otherwise(SPLITS[2])
    )


def _spread_copies(copies: DataFrame, columns: Sequence[str], firsts: list[Column]) -> DataFrame:
    """Re-emit ``n`` identical rows with the first ones before each cut, a bounded number per row."""
    first, second = firsts
    second = F.greatest(first, second)
    shares = F.array(
        F.struct(F.lit(SPLITS[0]).alias("split"), first.alias("copies")),
        F.struct(F.lit(SPLITS[1]).alias("split"), (second - first).alias("copies")),
        F.struct(F.lit(SPLITS[2]).alias("split"), (F.col("n") - second).alias("copies")),
    )
    quoted = [col(name) for name in columns]
    pieces = (
        copies.select(*quoted, F.inline(shares))
        .where("copies > 0")
        .select(
            *quoted, "split", "copies",
            F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPY_CHUNK})")).alias("piece"),
        )
        .repartition(shuffle_tasks(copies.sparkSession), "split", "piece")
    )
    size = F.least(F.lit(COPY_CHUNK), F.col("copies") - F.col("piece") * COPY_CHUNK)
    return (
        pieces.withColumn("copy", F.explode(F.sequence(F.lit(1), size.cast("int"))))
        .select(*quoted, "split")
    )


def _split_together(rows: DataFrame, train_ratio: float, val_ratio: float, group: str) -> DataFrame:
    """``time_split`` by groups; see there."""
    date = F.coalesce(col("date").cast("string"), F.lit(_LAST))
    name = F.coalesce(col(group).cast("string"), F.lit(_LAST))
    # Rows without a group stand together by date only.
    alone = F.when(col(group).isNull(), date)
    counted = rows.groupBy(name.alias("name"), alone.alias("alone")).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n")
    )
    groups = materialize(counted, "groups")
    keys, weight = [F.col("first"), F.col("name")], F.col("n")
    located = _located(groups, F.left("first", F.lit(DAY_LENGTH)), train_ratio, val_ratio, weight)
    boundaries = [None if spot is None else _settle(groups, keys, *spot, weight) for spot in located]
    # Only groups of several dates have to be told when they start.
    spread = groups.where("first < last").select("name", "first")
    if spread.isEmpty():
        placed, keys = rows, [date, name]
    else:
        free = free_names(rows, "name", "first", "spread")
        named = rows.withColumns({free[0]: name, free[2]: F.xxhash64(*[col(c) for c in rows.columns])})
        counts = groups.groupBy(F.col("name").alias(free[0])).agg(F.sum("n").alias("n"))
        lookup = spread.select(F.col("name").alias(free[0]), F.col("first").alias(free[1]))
        placed = join_lookup(named, lookup, [free[0]], counts, free[2])
        keys = [F.coalesce(F.col(free[1]), date), F.col(free[0])]

    def before(boundary: Boundary | None) -> Column:
        if boundary is None:
            return F.lit(True)
        # A group that starts before the cut is before it as a whole.
        held = _equal(keys, boundary) if boundary.copies_before else F.lit(False)
        return _before(keys, boundary) | held

    label = _label(*[before(b) for b in boundaries])
    return placed.select(*[col(c) for c in rows.columns], label.alias("split"))


def time_split(
    rows: DataFrame, train_ratio: float = 0.6, val_ratio: float = 0.2, keep_together: str | None = None
) -> DataFrame:
    """Add ``split``: the first ``int(n*train)`` rows by time, up to ``int(n*(train+val))``, the rest.

    Order is made total: date, game, home side first, then row content. ``rows`` is read once per
    counting pass (two or three as a rule), so it should be a table, not a long unmaterialized plan.

    With ``keep_together``, a column such as ``game_id``, all rows of one value are in one split: that of the group's
    first row, if groups stand in the order of their first dates and then of their values. Only group totals are
    counted, so sizes differ from the exact ones by less than the group at the cut. Rows without a value stand
    together by date.
    """
    if keep_together is not None:
        return _split_together(rows, train_ratio, val_ratio, keep_together)
    boundaries, keys = split_boundaries(rows, train_ratio, val_ratio)

    def before(boundary: Boundary | None) -> Column:
        return F.lit(True) if boundary is None else _before(keys, boundary)

    labelled = rows.withColumn("split", _label(*[before(b) for b in boundaries]))
    inner = [b for b in boundaries if b is not None and b.copies_before]
    if not inner:
        return labelled
    tied = reduce(lambda a, b: a | b, [_equal(keys, b) for b in inner])
    copies = (
        rows.where(tied)
        .groupBy(*[col(name) for name in rows.columns])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    firsts = []
    for boundary in boundaries:
        if boundary is None:
            firsts.append(F.col("n"))
        else:
            firsts.append(
                F.when(_before(keys, boundary), F.col("n"))
                .when(_equal(keys, boundary), F.lit(boundary.copies_before))
                .otherwise(F.lit(0))
                .cast("long")
            )
    others = rows.where(~tied).withColumn("split", _label(*[before(b) for b in boundaries]))
    return others.unionByName(_spread_copies(copies, rows.columns, firsts))


def split_sizes(split_rows: DataFrame, n_features: int) -> DataFrame:
    return split_rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(n_features).alias("n_features")
    )
