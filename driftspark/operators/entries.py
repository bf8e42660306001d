"""Full profile entries of many tables at once: one entry per file, whatever its format and columns.

Columns of a file are numbered. A format delivers ``shapes`` (per file: ``n_rows`` and its ``fields``, name and type
class in order), ``stats`` (per file and position: values that are not missing, their minimum, maximum, mean and
population deviation) and ``values`` (per file and position: the text of each value of columns that are not numeric).
All files of all formats then share one count of frequent values and one assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.types import numeric_coerce
from driftspark.operators.profile import TOP_K, schema_fingerprint
from driftspark.runtime import materialize

KEY = "dest_path"
_AT = [KEY, "position"]
# Winners whose texts are looked up by broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
# Bytes up to which a value travels itself; a digest has 32.
SHORT_BYTES = 64
STATS = ("min", "max", "mean", "std")

FIELDS = "array<struct<name:string,kind:string>>"
SHAPES = f"{KEY} string, n_rows bigint, fields {FIELDS}"
ROWS = f"{KEY} string, position int, n_present bigint, min double, max double, mean double, std double"
VALUES = f"{KEY} string, position int, value string"

NUMERIC = ("int", "float")
_WHOLE = r"^\s*[+-]?\d+\s*$"


def number_stats(number: Column) -> list[Column]:
    return [
        F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
    ]


def text_columns(records: DataFrame, nulls: list[str], true: list[str], false: list[str]) -> DataFrame:
    """``stats`` and the class of each column of tables whose cells are text.

    ``records`` has ``dest_path`` and ``cells``. A column is of the narrowest of bool, int, float and string that holds
    every cell; one of nulls only is float. One partial aggregation covers all files, so a large file is no hot spot.
    """
    cells = records.select(KEY, F.posexplode("cells").alias("position", "cell"))
    cell = F.when(~F.col("cell").isin(nulls), F.col("cell"))
    number = numeric_coerce(cell)
    whole = cell.rlike(_WHOLE) & F.trim(cell).try_cast("long").isNotNull()
    found = cells.groupBy(*_AT).agg(
        F.count(cell).alias("n_present"),
        F.count_if(whole).alias("n_int"),
        F.count(number).alias("n_float"),
        F.count_if(cell.isin(true + false)).alias("n_bool"),
        *number_stats(number),
    )
    n = F.col("n_present")
    kind = (
        F.when((n > 0) & (F.col("n_int") == n), "int")
        .when(F.col("n_float") == n, "float")
        .when(F.col("n_bool") == n, "bool")
        .otherwise("string")
    )
    return found.withColumn("kind", kind).drop("n_int", "n_float", "n_bool")


def frequent_values(values: DataFrame, k: int = TOP_K) -> DataFrame:
    """``dest_path, position, rank, value, n``: the ``k`` most frequent values of each column of each file.

    Ties go to the smaller SHA-256 digest. Values travel as digests, or as they are if they are short, counted before the
    shuffle; ranks come with a limit per partition, so a file or column that holds most rows is no hot spot. The values
    are read again only where winners are long, and short ones are left out then. Nulls are left out.
    """
    short = F.octet_length("value") <= SHORT_BYTES
    digest = F.unhex(F.sha2("value", 256))
    keyed = values.where("value is not null").select(*_AT, F.when(short, F.col("value")).alias("value"), F.when(~short, digest).alias("digest"))
    # Short values are hashed once for each distinct one of a task or so, not for each row.
    counts = keyed.groupBy(*_AT, "value", "digest").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.coalesce("digest", digest))
    order = Window.partitionBy(*_AT).orderBy(F.desc("n"), "digest")
    winners = materialize(
        counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "winners"
    )
    key = [*_AT, "digest"]
    lacking = winners.where("value is null")
    chosen = lacking.select(*key)
    n = chosen.count()
    if not n:
        return winners.drop("digest")
    long = values.where(F.octet_length("value") > SHORT_BYTES).select(*_AT, "value", digest.alias("digest"))
    texts = long.join(F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen, key, "left_semi")
    found = lacking.drop("value").join(texts.groupBy(*key).agg(F.min("value").alias("value")), key)
    return winners.where("value is not null").unionByName(found).drop("digest")


def _by_position(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """A map by position for each file; a file's columns are few beside its rows."""
    return rows.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("position", value))).alias(name))


def assembled(shapes: DataFrame, stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """One entry per row of ``shapes``: ``n_rows, columns, dtypes, null_fraction, basic_stats, top_values`` and
    ``schema_fingerprint``.

    A column without statistics has only missing values. Statistics are given for numeric columns that have a value,
    frequent values for all others that have one. The share of nulls of a table without rows is 0.
    """
    ranked = frequent.groupBy(*_AT).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
            lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")),
        ).alias("top")
    )
    found = (
        shapes.join(_by_position(stats, F.struct("n_present", *STATS), "_stats"), KEY, "left")
        .join(_by_position(ranked, F.col("top"), "_top"), KEY, "left")
    )

    def by_name(value, keep=None) -> Column:
        """Map from the names of columns to what ``value`` gives for a position and a class."""
        pairs = F.transform(
            "fields", lambda f, i: F.struct(f["name"].alias("name"), value(i.cast("int"), f["kind"]).alias("value"))
        )
        return F.map_from_entries(pairs if keep is None else F.filter(pairs, keep))

    def stat(i: Column) -> Column:
        return F.try_element_at("_stats", i)

    def null_share(i: Column, _: Column) -> Column:
        present = F.coalesce(stat(i)["n_present"], F.lit(0))
        return F.when(F.col("n_rows") == 0, 0.0).otherwise((F.col("n_rows") - present) / F.col("n_rows"))

    def numbers(i: Column, kind: Column) -> Column:
        return F.when(kind.isin(*NUMERIC), F.struct(*[stat(i)[s].alias(s) for s in STATS]))

    def tops(i: Column, kind: Column) -> Column:
        return F.when(~kind.isin(*NUMERIC), F.try_element_at("_top", i))

    return found.select(
        KEY,
        "n_rows",
        F.transform("fields", lambda f: f["name"]).alias("columns"),
        by_name(lambda _, kind: kind).alias("dtypes"),
        by_name(null_share).alias("null_fraction"),
        by_name(numbers, lambda p: p["value"]["min"].isNotNull()).alias("basic_stats"),
        by_name(tops, lambda p: p["value"].isNotNull()).alias("top_values"),
    ).withColumn("schema_fingerprint", schema_fingerprint(F.col("columns"), F.col("dtypes")))
