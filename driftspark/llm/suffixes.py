"""Removal of long repeated byte strings, by sorting a sparse set of suffixes deep-shallow.

Every string of ``length`` bytes holds an anchor: the first of its 64-byte grams with the smallest hash. Equal
strings have their anchors at the same place, so only suffixes that start at anchors need sorting, and only those
whose gram occurs again. Suffixes of one gram are sorted by multikey quicksort to a shallow depth, and groups that
share more by blind tries. Runs of the sorted suffixes with a common prefix are then compared backwards from the
anchor in the same way: a suffix that shares v bytes from the anchor and u bytes before it with another one is
covered there if u + v reaches the length. This is exact for every string, as each holds an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import sorted_runs
from driftspark.runtime import col, materialize

LENGTH = 400
GRAM = 64
# Windows whose minima are taken at once; their places fit in PLACE_BITS.
SEGMENT = 1 << 15
PLACE_BITS = 20
# Depth at which multikey quicksort hands over to blind tries.
SHALLOW = 128
WORD = 8
# Occurrences of one gram that one task sorts, some 60 MB; the windows of more frequent grams are counted by hash.
SORTED = 100_000
# Windows of frequent grams that are handed on at once.
WINDOW_ROWS = 50_000
# Bits of the filter for grams that occur again; a fuller filter only lets more through.
MOST_BITS = 28

_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(8).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place, by doubling: a hash of 2 k bytes combines two of k."""
    h = _TABLE[data]
    width, step = 1, 0
    while width < GRAM:
        h = h[:-width] * _ODD[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(31)
    h *= _ODD[7]
    h ^= h >> np.uint64(29)
    return h


def anchors(
    data: np.ndarray, ends: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie within one of the texts ending at ``ends``: places, gram hashes, and the
    starts of the first and of the last window that each anchor belongs to."""
    span = length - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for start in range(0, len(data) - length + 1, SEGMENT):
        part = data[start : start + SEGMENT + length - 1]
        h = gram_hashes(part)
        windows = len(h) - span + 1
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        # Minima of all windows from minima towards both ends of blocks as long as a window.
        padded = np.full(-(-len(h) // span) * span, np.uint64((1 << 64) - 1))
        padded[: len(h)] = key
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
        at = np.arange(start, start + windows)
        # The last window of each text starts ``length`` before its end.
        inside = np.ones(windows, bool)
        for end in ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, start + windows + length)]:
            inside[max(end - length + 1 - start, 0) : max(end - start, 0)] = False
        at = at[inside]
        if not len(at):
            continue
        place = (low[inside] & mask).astype(np.int64)
        # Places never decrease from window to window.
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        found.append((place[first] + start, h[place[first]], at[first], at[last]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    place, h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # An anchor may have windows in two segments.
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[new], h[new], first[new], last[np.append(new[1:], len(place)) - 1]


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differing = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differing.bit_length() + 7) // 8


def blind_sort(strings: list[bytes], members: list[int]) -> list[int]:
    """Members in the order of their strings, by a blind trie.

    A node is the depth at which its strings differ, and its children by their byte there (-1: the end). A string
    goes down by its bytes at these depths alone, is compared once with the leaf it ends at, and enters where it
    differs. Equal strings share a leaf.
    """

    def byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root: list = [None, [members[0]]]  # a leaf
    for new in members[1:]:
        s = strings[new]
        node = root
        while node[0] is not None:
            children = node[1]
            node = children.get(byte(s, node[0])) or next(iter(children.values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(new)
            continue
        depth = common_prefix(s, other)
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][byte(s, node[0])]
        leaf = [None, [new]]
        if node[0] == depth:
            node[1][byte(s, depth)] = leaf
        else:
            below = list(node)
            node[0], node[1] = depth, {byte(other, depth): below, byte(s, depth): leaf}
    out: list[int] = []
    stack = [root]
    while stack:
        depth, children = stack.pop()
        if depth is None:
            out += children
        else:
            stack += [children[b] for b in sorted(children, reverse=True)]
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of the strings: multikey quicksort by words of eight bytes, blind tries from ``shallow`` on."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1:
            out += members
        elif depth >= shallow:
            out += blind_sort(strings, members)
        else:
            keys = [strings[n][depth : depth + WORD] for n in members]
            pivot = keys[len(keys) // 2]
            less = [n for n, k in zip(members, keys, strict=True) if k < pivot]
            more = [n for n, k in zip(members, keys, strict=True) if k > pivot]
            same = [n for n, k in zip(members, keys, strict=True) if k == pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) < WORD:  # they end here, so they are equal
                stack.append((same, shallow))
            else:
                stack.append((same, depth + WORD))
            if less:
                stack.append((less, depth))
    return out


def covered(
    before: list[bytes], after: list[bytes], length: int = LENGTH, owners: list | None = None
) -> list[tuple[int, int]]:
    """For each occurrence of one gram the bytes before and from its anchor that repeated strings cover.

    ``before`` holds the bytes before the anchor, nearest first; both reach as far as the windows of the anchor.
    With ``owners``, a string only counts as repeated if another owner has it. (0, 0) where nothing is covered.
    """
    groups: dict[tuple, list[int]] = {}
    for n, context in enumerate(zip(before, after, owners or repeat(None), strict=False)):
        groups.setdefault(context, []).append(n)
    contexts = list(groups)
    reach = [
        (len(b), len(a)) if owners is None and len(own) > 1 and len(b) + len(a) >= length else (0, 0)
        for (b, a, _), own in groups.items()
    ]

    def cover(n: int, u: int, v: int) -> None:
        if u + v >= length:
            reach[n] = max(reach[n][0], u), max(reach[n][1], v)

    def neighbours(run: list[int]) -> None:
        """Shares of bytes before the anchor with the nearest of another owner on either side, by left context."""
        by_left = sorted(run, key=lambda n: contexts[n][0])
        for line in (by_left, by_left[::-1]):
            last, other = line[0], None
            for n in line[1:]:
                if owners is None or contexts[n][2] != contexts[last][2]:
                    other = last
                if other is not None:
                    cover(n, common_prefix(contexts[n][0], contexts[other][0]), v)
                last = n

    order = deep_shallow_sort([a for _, a, _ in contexts])
    shared = [common_prefix(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:], strict=False)]
    # From long common prefixes to short ones; runs that have not grown were dealt with before.
    for v in sorted(set(shared), reverse=True):
        at = 0
        while at < len(shared):
            if shared[at] < v:
                at += 1
                continue
            end = at
            while end < len(shared) and shared[end] >= v:
                end += 1
            if v in shared[at:end]:
                neighbours(order[at : end + 1])
            at = end
    out = [(0, 0)] * len(before)
    for n, members in enumerate(groups.values()):
        for member in members:
            out[member] = reach[n]
    return out


def _texts(batch: pa.RecordBatch, length: int, seen: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
    """Digests and bytes of a batch's texts that are long enough. Of equal texts two in a task are enough: each is
    another place for all strings of the other."""
    digests, texts = [], []
    for text in batch.column(0).to_pylist():
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) < length:
            continue
        digest = xxhash.xxh128_digest(raw)
        seen[digest] = seen.get(digest, 0) + 1
        if seen[digest] <= 2:
            digests.append(digest)
            texts.append(raw)
    return digests, texts


def _batch_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, int, tuple]]:
    """Anchors of a batch, some megabytes of text at a time: first and next text, and what ``anchors`` returns."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= 1 << 22):
            size += len(texts[last])
            last += 1
        ends = np.cumsum([len(t) for t in texts[first:last]])
        yield first, last, anchors(np.frombuffer(b"".join(texts[first:last]), np.uint8), ends, length)
        first = last


def _gram_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            _, texts = _texts(batch, length, seen)
            for _, _, (_, h, _, _) in _batch_anchors(texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["gram"])

    return run


class GramFilter(NamedTuple):
    """Bits of a set of gram hashes. Others may pass: that costs time, but changes no result."""

    words: np.ndarray
    bits: int

    def has(self, h: np.ndarray) -> np.ndarray:
        index = h & np.uint64((1 << self.bits) - 1)
        word = self.words[(index >> np.uint64(6)).astype(np.int64)]
        return (word >> (index & np.uint64(63))) & np.uint64(1) == 1


class Selection(NamedTuple):
    """Grams that occur again, and those among them that are too frequent to be sorted."""

    again: GramFilter
    frequent: GramFilter | None

    def usual(self, h: np.ndarray) -> np.ndarray:
        on = self.again.has(h)
        return on if self.frequent is None else on & ~self.frequent.has(h)

    def hot(self, h: np.ndarray) -> np.ndarray:
        return self.again.has(h) & self.frequent.has(h)


def select_grams(grams: DataFrame, in_task: int) -> Selection:
    """Filters of the repeated grams (``gram``, ``n``)."""
    often = grams.where(F.col("n") > in_task)
    return Selection(gram_filter(grams), None if often.isEmpty() else gram_filter(often))


def _cuts(length: int, batches: Iterator[pa.RecordBatch], select) -> Iterator[tuple[list, list, list, list, np.ndarray]]:
    """Digests, places, bytes before and from the anchor, and grams of the selected anchors of some texts."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        digests, texts = _texts(batch, length, seen)
        for first, last, (place, h, start, end) in _batch_anchors(texts, length):
            on = select(h)
            place, h = place[on], h[on]
            left, right = (place - start[on]).tolist(), (end[on] - place + length).tolist()
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[first:last]])])
            own = np.searchsorted(starts, place, side="right") - 1
            local = (place - starts[own]).tolist()
            own = (own + first).tolist()
            before = [texts[n][at - u : at] for n, at, u in zip(own, local, left, strict=True)]
            after = [texts[n][at : at + v] for n, at, v in zip(own, local, right, strict=True)]
            yield [digests[n] for n in own], local, before, after, h


def _occurrences(length: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digest, place, before, after, h in _cuts(length, batches, shared.value.usual):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(digest, pa.binary()),
                    pa.array(place, pa.int64()),
                    pa.array([b[::-1] for b in before], pa.binary()),
                    pa.array(after, pa.binary()),
                ],
                ["gram", "digest", "place", "before", "after"],
            )

    return run


def window_batches(rows: Iterator[tuple[bytes, object, int]], owner: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """Windows (hash, owner, start) as batches of bounded size."""
    while part := list(islice(rows, WINDOW_ROWS)):
        window, own, start = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(window, pa.binary()), pa.array(own, owner), pa.array(start, pa.int64())], ["window", name, "start"]
        )


def _windows(length: int, shared):
    """Each window belongs to one anchor, so it comes once from each place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, int]]:
        for found in _cuts(length, batches, shared.value.hot):
            for digest, place, before, after in zip(*found[:4], strict=True):
                text = before + after
                for n in range(len(text) - length + 1):
                    yield xxhash.xxh128_digest(text[n : n + length]), digest, place - len(before) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from window_batches(rows(batches), pa.binary(), "digest")

    return run


def _span_rows(digest: list, place: list, reach: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(d, p - u, p + v) for d, p, (u, v) in zip(digest, place, reach, strict=True) if v]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "start", "end"]
    )


def _sorted_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["gram"]):
            gram = rows["gram"].to_numpy()
            digest, place = rows["digest"].to_pylist(), rows["place"].to_pylist()
            before, after = rows["before"].to_pylist(), rows["after"].to_pylist()
            reach: list[tuple[int, int]] = []
            bounds = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                reach += covered(before[a:b], after[a:b], length) if b - a > 1 else [(0, 0)]
            yield _span_rows(digest, place, reach)

    return run


def gram_filter(grams: DataFrame) -> GramFilter:
    """Bits of the hashes in ``grams``, of a size bounded by ``MOST_BITS``."""
    count = grams.count()
    bits = min(max(16, (8 * count).bit_length()), MOST_BITS)
    index = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    rows = grams.groupBy(F.shiftright(index, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(gram & {(1 << min(6, bits)) - 1} as int))")).alias("bits")
    ).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return GramFilter(words, bits)


def merged_spans() -> Column:
    """Maximal runs of a group's ``start`` and ``end``; runs that touch are one."""
    return F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def merged_runs(spans: DataFrame, by: str = "digest") -> DataFrame:
    """``by`` and ``spans``: the maximal runs of the rows ``start``, ``end`` of each group; runs that touch are one.

    Rows are merged in the order of their starts, which a window streams, so only maximal runs are ever in one array:
    a periodic text has a row for each byte and one run. Rows that copies of a text repeat go before the shuffle.
    """
    unique = spans.groupBy(by, "start").agg(F.max("end").alias("end"))
    line = Window.partitionBy(by).orderBy("start")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = unique.withColumn("new", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int"))
    runs = apart.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = runs.groupBy(by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(
    docs: DataFrame, text_column: str = "text", length: int = LENGTH, in_task: int = SORTED
) -> DataFrame:
    """``digest`` of a text and ``spans``, its maximal covered runs (start, end in bytes), for texts that have any.

    A byte is covered if it lies in a string of ``length`` bytes that also starts at another place of any row,
    the same one included. ``digest`` is the 128-bit hash of the text's UTF-8 bytes.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    texts = docs.select(col(text_column).cast("string").alias("text"))
    grams = texts.mapInArrow(_gram_rows(length), "gram bigint")
    again = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    selection = select_grams(again, in_task)
    shared = spark.sparkContext.broadcast(selection)
    schema = "gram bigint, digest binary, place bigint, before binary, after binary"
    spans = (
        texts.mapInArrow(_occurrences(length, shared), schema)
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_sorted_spans(length), "digest binary, start bigint, end bigint")
    )
    if selection.frequent is not None:
        windows = texts.mapInArrow(_windows(length, shared), "window binary, digest binary, start bigint")
        windows = materialize(windows, "windows")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
        twice = materialize(twice, "repeated-windows")
        more = windows.join(twice, "window", "left_semi")
        spans = spans.union(more.select("digest", "start", (F.col("start") + length).alias("end")))
    return materialize(merged_runs(spans), "spans")


def _digests(shared, repeated: bool):
    """Rows whose digest the filter has, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            digest = [xxhash.xxh128_digest(t) for t in raw]
            h = np.array([xxhash.xxh64_intdigest(d, 42) for d in digest], np.uint64)
            on = np.flatnonzero(shared.value.has(h) == repeated)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(on)),
                    pa.array([raw[n] for n in on], pa.binary()),
                    pa.array([digest[n] for n in on], pa.binary()),
                ],
                ["doc_id", "raw", "digest"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, parts = 0, []
            for span in spans or []:
                parts.append(raw[at : span["start"]])
                at = span["end"]
            kept.append(b"".join(parts) + raw[at:])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary())], [*batch.schema.names, "kept"])


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    in_task: int = SORTED,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (null: none) and ``kept``, the remaining bytes, of each row.

    Null and empty texts have no bytes; texts shorter than ``length`` keep all of theirs, and copies of a longer
    text lose all. Repeated ids do not matter: results follow the text. No rows give no rows. The remaining bytes
    need not be whole characters.
    """
    spans = repeated_spans(docs, text_column, length, in_task)
    texts = docs.select(col(id_column).cast("long").alias("doc_id"), col(text_column).cast("string").alias("text"))
    # Only texts that may have spans are shuffled to meet them.
    shared = docs.sparkSession.sparkContext.broadcast(gram_filter(spans.select(F.xxhash64("digest").alias("gram"))))
    schema = "doc_id bigint, raw binary, digest binary"
    met = texts.mapInArrow(_digests(shared, True), schema).join(spans, "digest", "left")
    others = texts.mapInArrow(_digests(shared, False), schema).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    met = met.select("doc_id", "raw", "spans").union(others.select("doc_id", "raw", "spans"))
    kind = "array<struct<start:bigint,end:bigint>>"
    cut = met.mapInArrow(_cut, f"doc_id bigint, raw binary, spans {kind}, kept binary")
    return cut.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), "spans", "kept")
