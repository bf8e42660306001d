"""Packing of token sequences by best-fit decreasing, certified by dual-feasible lower bounds.

Each task packs its pieces by best-fit decreasing and bounds its bin count from below by dual-feasible functions.
Where count and bound meet, the bins are final. Other tasks keep their full bins; the pieces of bins with gaps go
to a common pool, which is dealt to fewer tasks and packed again, until all is certified, the pool is one task's
work, or the rounds are over.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.runtime import materialize

CAPACITY = 1024
# Id after a document's last token.
END_ID = 2
# Pieces that one task packs.
TASK_PIECES = 200_000
ROUNDS = 6
# Characters of white space in a row that the tokenizer itself encodes: the merge's pattern fails near a million.
LONG_RUN = 100_000
_SPACE = re.compile(r"\s+")


def _byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file, as little-endian unsigned 32-bit bytes.

    The ids of the file's vocabulary follow the order of its merges, so its texts can be merged by rank, which takes
    a quarter of the tokenizer's own time and gives the same ids. Texts with a very long run of white space, on
    which the merge's pattern fails, are left to the tokenizer. With ``added_tokens`` so are texts that hold an
    added token of the file, as ``<|endoftext|>``, which then is one id; without, it is plain text.
    """

    def __init__(self, path: str, end_id: int = END_ID, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added_tokens
        character = _byte_of_character()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(character.get, t)): n for t, n in vocabulary.items() if t not in special}
        self._merge = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._tokenizer = tokenizer
        self._added = sorted(special) if added_tokens else []
        self._end = end_id

    def _ids(self, text: str) -> list[int]:
        # Only a text of that many characters can hold such a run.
        long_run = len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _SPACE.finditer(text))
        if long_run or any(token in text for token in self._added):
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return self._merge(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text and the end id; null is the empty text."""
        for text in texts:
            ids = self._ids(text or "")
            ids.append(self._end)
            yield np.array(ids, "<u4").tobytes()


def cut(size: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: the first one takes what is over, all others are full."""
    head = size % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(at, capacity) for at in range(head, size, capacity)]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids`` as bytes) of each row's pieces.

    ``tokenizer`` is a file that every executor can read; its added tokens are found in texts, as it does by itself.
    Null texts are empty and give one piece, the end id.
    """
    narrow = docs.select(
        docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id, added_tokens=True)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(
                batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True
            ):
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    values = (doc_id, n, start, length, zlib.crc32(own), own if with_ids else None)
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, kind) for c, kind in zip(rows, kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            count = len(names) if with_ids else len(names) - 1
            yield pa.RecordBatch.from_arrays(arrays[:count], names[:count])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return narrow.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of two families of dual-feasible functions.

    The first rounds sizes above capacity - e up to the capacity and those below e down to nothing; the second
    maps a size to its share in k-ths, rounded down where it is not whole. Either keeps any set that fits in a bin
    within the bin, so the sum over all sizes bounds the bins from below.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = volume[capacity - e] - np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 101):
        share = (k + 1) * size
        whole = share % capacity == 0
        value = np.where(whole, k * size, (share // capacity) * capacity)
        best = max(best, int(-(-(count * value).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in its bin for each length. Equal lengths keep their order.

    A bit of ``open_gaps`` says that bins with this gap exist, so the tightest one is found by one shift.
    """
    bins = np.zeros(len(lengths), np.int64)
    place = np.zeros(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, made = 0, 0
    for n in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[n])
        fitting = open_gaps >> length
        if length and fitting:
            gap = length + (fitting & -fitting).bit_length() - 1
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            own, gap = made, capacity
            made += 1
        bins[n], place[n] = own, capacity - gap
        if gap > length:
            by_gap[gap - length].append(own)
            open_gaps |= 1 << (gap - length)
    return bins, place


def _pack_part(capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        # The order of arrival is not fixed; that of the content is.
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, place = best_fit_decreasing(lengths, capacity)
        made = int(bins.max()) + 1
        filled = np.bincount(bins, weights=lengths, minlength=made)
        certified = made == lower_bound(lengths, capacity)
        final = np.ones(made, bool) if certified or last else filled == capacity
        rows = rows.append_column("bin", pa.array(bins)).append_column("offset", pa.array(place))
        rows = rows.append_column("final", pa.array(final[bins]))
        yield from rows.to_batches()

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``rows`` (of ``pieces``, any columns) with ``sequence_id`` and ``offset``, its place in the sequence.

    A piece of full length is a sequence of its own. Rows that repeat an id are different pieces; null ids are
    dealt by their content. No rows give no rows. One task holds about ``task_pieces`` short pieces.
    """
    rows = materialize(rows, "pieces")
    names = rows.columns
    full = rows.where(F.col("length") >= capacity)
    result = full.select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left = rows.where(F.col("length") < capacity)
    for number in range(ROUNDS):
        count = left.count()
        if not count:
            break
        parts = -(-count // task_pieces)
        last = parts == 1 or number == ROUNDS - 1
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
        packed = left.repartition(parts).mapInArrow(
            _pack_part(capacity, last), fields + ", bin bigint, offset bigint, final boolean"
        )
        packed = materialize(packed.withColumn("part", F.spark_partition_id().cast("long")), "packed")
        identity = F.lit(number << 58) + F.col("part") * F.lit(1 << 31) + F.col("bin")
        result = result.union(
            packed.where("final").select(*names, identity.alias("sequence_id"), "offset")
        )
        if last:
            break
        left = packed.where("not final").select(*names)
    return result


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` (bytes), from packed pieces that carry their ids (``with_ids``)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(ordered, F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids"))
