"""Benchmark decontamination: SimHash of item-sized windows, verified by exact weighted-shingle similarity.

All of it is DataFrame functions. For an item of n shingles the windows of a document are its runs of n shingles
(a document with fewer is one window). Windows get a 64-bit SimHash in which each shingle weighs as often as it
occurs. A multi-index over blocks of the items' fingerprints finds all within the radius: of ``BLOCKS`` blocks at
least one differs in at most radius / blocks bits, and the index lists each block with all changes of so many bits.
What is found is verified by the exact similarity: sum of the smaller over sum of the larger shingle counts.

Fingerprints are computed only where they can matter. A window at the similarity s shares at least
2 s / (1 + s) of its shingles with the item, so it starts at most the rest before a shingle of that item. All such
starts are taken: the filter loses nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import free_name
from driftspark.runtime import materialize

SHINGLE = 5
SIMILARITY = 0.8
# At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9; 23 bits leave two in a
# million out.
RADIUS = 23
BLOCKS = 8
# Distinct shingles of a benchmark that are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
# A long holds three counters of so many bits, so an item may have two million shingles.
LANE = 21


def word_hashes(text: Column) -> Column:
    """Hashes of the words, runs of letters and digits in lower case, so marks and spacing do not matter."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle(hashes: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(k)])


def _simhash(shingles: Column) -> Column:
    mask = F.lit(1 | 1 << LANE | 1 << 2 * LANE)
    size = F.size(shingles)

    def lane(shift: int) -> Column:
        return F.aggregate(
            shingles,
            F.lit(0).cast("long"),
            lambda total, x: total + F.shiftrightunsigned(x, shift).bitwiseAND(mask),
        )

    lanes = F.array(*[lane(shift) for shift in range(LANE)])
    last = F.size(F.filter(shingles, lambda x: x < 0))

    def bits(sums: Column) -> Column:
        fingerprint = F.when(2 * last > size, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
        for b in range(63):
            count = F.shiftrightunsigned(sums[b % LANE], LANE * (b // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))
            fingerprint = fingerprint.bitwiseOR(F.when(2 * count > size, F.lit(1 << b)).otherwise(F.lit(0)))
        return fingerprint

    # The sums are named by a lambda, so each is computed once.
    return F.get(F.transform(F.array(lanes), bits), F.lit(0))


def _block(fingerprint: Column, n: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned(fingerprint, width * n).bitwiseAND(F.lit((1 << width) - 1))


def _changes(radius: int) -> list[int]:
    """All masks over one block with at most the bits that the best block may differ in."""
    width = 64 // BLOCKS
    return [sum(1 << b for b in bits) for r in range(radius // BLOCKS + 1) for bits in combinations(range(width), r)]


def _blocks(fingerprint: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("block"), _block(fingerprint, n).alias("value")) for n in range(BLOCKS)]
    )


def _changed_blocks(fingerprint: Column, radius: int) -> Column:
    changes = F.array(*[F.lit(c).cast("long") for c in _changes(radius)])
    return F.flatten(
        F.transform(
            _blocks(fingerprint),
            lambda b: F.transform(
                changes,
                lambda c: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(c).alias("value")),
            ),
        )
    )


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of two arrays of shingles."""
    distinct = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        distinct,
        F.lit(0),
        lambda total, x: total
        + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    common = F.when(plain, F.size(distinct)).otherwise(counted)
    return common / (F.size(a) + F.size(b) - common)


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    hashed = benchmark.select(
        F.col(id_column).alias("item_id"), word_hashes(F.col(text_column)).alias("h")
    ).where(F.size("h") > 0)
    return hashed.select("item_id", "h", F.least(F.size("h"), F.lit(SHINGLE)).alias("k")).distinct()


def _with_shingles(rows: DataFrame, k: int, first: Column, count: Column, name: str) -> DataFrame:
    return rows.withColumn(
        name, F.transform(F.sequence(first, first + count - 1), lambda p: _shingle(F.col("h"), p, k))
    )


def _matches(
    docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int
) -> DataFrame:
    own = _with_shingles(items.where(F.col("k") == k), k, F.lit(0), F.size("h") - (k - 1), "shingles")
    own = own.select("item_id", "shingles", F.size("shingles").alias("n"), _simhash(F.col("shingles")).alias("fp"))
    own = materialize(own, "items")
    wanted = own.select("n", F.explode("shingles").alias("shingle")).distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    total = F.size("h") - (k - 1)
    hits = (
        docs.where(total > 0)
        .select("doc_id", "text_key", "h", F.explode(F.sequence(F.lit(0), total - 1)).alias("at"))
        .withColumn("shingle", _shingle(F.col("h"), F.col("at"), k))
        .join(wanted, "shingle")
    )
    length = F.least(F.col("n"), total)
    # Shingles of the window that need not be the item's; a window starts at most so far before its first hit.
    slack = F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-9).cast("int")
    starts = F.transform(
        F.sequence(F.lit(0), slack),
        lambda j: F.greatest(F.least(F.col("at") - j, total - length), F.lit(0)),
    )
    windows = (
        hits.select("doc_id", "text_key", "n", "h", length.alias("length"), F.explode(F.array_distinct(starts)).alias("start"))
        .select(
            "doc_id", "text_key", "n", "length", "start", F.slice("h", F.col("start") + 1, F.col("length") + (k - 1)).alias("h")
        )
        .dropDuplicates(["doc_id", "text_key", "n", "start"])
    )
    windows = _with_shingles(windows, k, F.lit(0), F.col("length"), "shingles")
    windows = windows.select(
        "doc_id", "text_key", "n", "start", "shingles", _simhash(F.col("shingles")).alias("fp")
    )
    windows = materialize(windows, "windows")
    index = own.select(
        "n", F.col("fp").alias("item_fp"), F.explode(_changed_blocks(F.col("fp"), radius)).alias("b")
    ).select("n", "item_fp", "b.block", "b.value").distinct()
    probes = (
        windows.select("n", "fp")
        .distinct()
        .select(
            "n",
            "fp",
            F.explode(_blocks(F.col("fp"))).alias("b"),
        )
        .select("n", "fp", "b.block", "b.value")
    )
    near = (
        probes.join(index, ["n", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("n", "fp", "item_fp")
        .distinct()
    )
    named = near.join(own.select("n", F.col("fp").alias("item_fp"), "item_id", F.col("shingles").alias("item")), ["n", "item_fp"])
    return (
        windows.join(named, ["n", "fp"])
        .select("doc_id", "text_key", "item_id", "start", weighted_jaccard(F.col("shingles"), F.col("item")).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id``, ``text_key``, ``item_id``, ``similarity`` (of the best window), ``start`` (its first word) and
    ``windows`` (how many reach the similarity), one row per document text and item.

    ``text_key`` is the hash of the text, so rows that repeat an id are told apart; rows that repeat id and text
    are one. Null and empty texts match nothing, nor do items without words. Items of fewer than five words are
    one shingle and must occur as they are. Null ids stay null. Equal items under several ids give a row each.
    """
    items = materialize(_items(benchmark, item_id_column, item_text_column), "benchmark")
    hashed = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        word_hashes(F.col(text_column)).alias("h"),
    )
    sizes = sorted(row.k for row in items.select("k").distinct().toLocalIterator())  # at most five
    found = None
    for k in sizes:
        one = _matches(hashed, items, k, similarity, radius)
        found = one if found is None else found.union(one)
    if found is None:
        found = docs.sparkSession.createDataFrame(
            [], "doc_id long, text_key long, item_id long, start int, similarity double"
        ).select("doc_id", "text_key", "item_id", "start", "similarity")
    return found.groupBy("doc_id", "text_key", "item_id").agg(
        F.max("similarity").alias("similarity"),
        F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).alias("start"),
        F.count(F.lit(1)).alias("windows"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **rules) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = contaminated(docs, benchmark, id_column, text_column, **rules)
    found = materialize(found.select("doc_id", "text_key").distinct(), "contaminated")
    key = free_name(docs, "text_key")
    marked = docs.withColumn(key, F.xxhash64(text_column))
    met = marked[id_column].eqNullSafe(found["doc_id"]) & (marked[key] == found["text_key"])
    return marked.join(found, met, "left_anti").drop(key)
