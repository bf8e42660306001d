"""What the operators of this package share: tables, words and tasks that stream Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from driftspark.runtime import col

# One word is what lies between these: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


# Rows of an Arrow batch; batches hold whole texts, so few rows keep them small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also keeps the session's Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, A to Z in lower case; ``bytes`` splits at exactly the separators of ``WORD``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def extended(df: DataFrame, **added: str) -> StructType:
    """Schema of ``df`` with further columns by name and type."""
    return StructType([*df.schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in added.items())])


def map_batches(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None],
    schema: str | StructType,
) -> DataFrame:
    """``function`` on each Arrow batch of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out.to_batches()

    return df.mapInArrow(run, schema)


def sorted_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` into tables that hold whole runs of equal keys.

    Each table holds as many whole runs as one batch completes, so memory is bounded by a batch and the
    longest run.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1] for k in keys]
        # Rows of the last run stay until a later batch ends it.
        low, high = 0, batch.num_rows - 1
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        while low < high:
            middle = (low + high) // 2
            if all(c[middle].equals(v) for c, v in zip(columns, last, strict=True)):
                high = middle
            else:
                low = middle + 1
        if low:
            yield pa.Table.from_batches([*waiting, batch.slice(0, low)])
            waiting = [batch.slice(low)]
        elif waiting:
            before = waiting[-1]
            same = all(
                before.column(before.schema.get_field_index(k))[before.num_rows - 1].equals(v)
                for k, v in zip(keys, last, strict=True)
            )
            if same:
                waiting.append(batch)
            else:
                yield pa.Table.from_batches(waiting)
                waiting = [batch]
        else:
            waiting = [batch]
    if waiting:
        yield pa.Table.from_batches(waiting)
