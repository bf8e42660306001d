"""Table profile: type classes, null fractions, numeric statistics, frequent values, fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.types import WITH_NULLS, is_missing, numeric_coerce, type_class
from driftspark.operators import frequent
from driftspark.runtime import col

# Fixed value: frequent values kept per column.
TOP_K = 10

_STATS = ("min", "max", "mean", "std")


def _is_numeric(kind: str) -> bool:
    return kind in ("int", "float")


def _one_pass(df: DataFrame) -> DataFrame:
    """One row with the row count and, by column position, missing counts and numeric statistics."""
    wanted = [F.count(F.lit(1)).alias("n_rows")]
    for i, field in enumerate(df.schema):
        column = col(field.name)
        missing = is_missing(column, field.dataType)
        wanted.append(F.count_if(missing).alias(f"missing{i}"))
        if _is_numeric(type_class(field.dataType)):
            value = F.when(~missing, column.cast("double"))
            wanted += [
                F.min(value).alias(f"min{i}"),
                F.max(value).alias(f"max{i}"),
                F.avg(value).alias(f"mean{i}"),
                F.stddev_pop(value).alias(f"std{i}"),
            ]
    return df.agg(*wanted)


def _fraction(i: int) -> Column:
    n = F.col("n_rows")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.col(f"missing{i}") / n)


def _class(i: int, kind: str, null_sensitive: bool) -> Column:
    if null_sensitive and kind in WITH_NULLS:
        return F.when(F.col(f"missing{i}") > 0, WITH_NULLS[kind]).otherwise(kind)
    return F.lit(kind)


def _stat(i: int, kind: str, name: str) -> Column:
    return F.col(f"{name}{i}") if _is_numeric(kind) else F.lit(None).cast("double")


def _column_rows(df: DataFrame, null_sensitive: bool = False) -> DataFrame:
    kinds = [(field.name, type_class(field.dataType)) for field in df.schema]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            _class(i, kind, null_sensitive).alias("type_class"),
            F.col("n_rows").alias("n_rows"),
            F.col(f"missing{i}").alias("n_missing"),
            _fraction(i).alias("null_fraction"),
            *[_stat(i, kind, s).alias(f"{s}_value") for s in _STATS],
        )
        for i, (name, kind) in enumerate(kinds)
    ]
    return _one_pass(df).select(F.inline(F.array(*entries)))


def profile_table(df: DataFrame, table_name: str, null_sensitive: bool = False) -> DataFrame:
    """One row per column: position, class, row count, null fraction, min, max, mean, population std.

    All columns share one aggregation. The class follows the schema, so a null never changes it;
    ``null_sensitive`` widens the class of columns that hold nulls instead.
    """
    rows = _column_rows(df, null_sensitive).drop("n_missing")
    return rows.select(F.lit(table_name).alias("table_name"), "*")


def null_fraction(df: DataFrame, table_name: str) -> DataFrame:
    return profile_table(df, table_name).select("table_name", "column_name", "null_fraction")


def numeric_stats(df: DataFrame, table_name: str) -> DataFrame:
    """Statistics of the numeric columns; a column of nulls has none."""
    return (
        profile_table(df, table_name)
        .where(F.col("type_class").isin("int", "float") & F.col("min_value").isNotNull())
        .select("table_name", "column_name", *[f"{s}_value" for s in _STATS])
    )


def coerced_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of text columns read as numbers; text that is no number is left out."""
    numbers = df.select(*[numeric_coerce(col(name)).alias(name) for name in columns])
    n_numeric = F.col("n_rows") - F.col("n_missing")
    return _column_rows(numbers).select(
        "column_name", "n_rows", n_numeric.alias("n_numeric"), *[f"{s}_value" for s in _STATS]
    )


def fingerprint_payload(columns: Column, dtypes: Column) -> Column:
    """Canonical JSON of the ordered columns and the classes by name."""
    by_name = F.map_from_entries(F.array_sort(F.map_entries(dtypes)))
    return F.to_json(F.struct(columns.alias("columns"), by_name.alias("dtypes")))


def schema_fingerprint(columns: Column, dtypes: Column) -> Column:
    """SHA-256 of the payload; the order of ``columns`` counts, that of ``dtypes`` does not."""
    return F.sha2(fingerprint_payload(columns, dtypes), 256)


def fingerprint_of(columns: Sequence[str], dtypes: Mapping[str, str]) -> str:
    """The same fingerprint for a schema at hand on the driver."""
    payload = json.dumps(
        {"columns": list(columns), "dtypes": dict(sorted(dtypes.items()))},
        separators=(",", ":"),
        ensure_ascii=False,
    )
    return hashlib.sha256(payload.encode("utf-8")).hexdigest()


def schema_of(df: DataFrame) -> tuple[list[str], dict[str, str]]:
    """Columns and classes of a DataFrame, from its schema alone."""
    return df.columns, {field.name: type_class(field.dataType) for field in df.schema}


def schema_entry(
    df: DataFrame, table_name: str, group: str = "default", ordinal: int = 0,
    null_sensitive: bool = False,
) -> DataFrame:
    """One row for the drift report: columns, classes, null fractions, statistics, fingerprint."""
    kinds = [(field.name, type_class(field.dataType)) for field in df.schema]

    def by_name(value_of, default: str) -> Column:
        cells = [x for i, (name, kind) in enumerate(kinds) for x in (F.lit(name), value_of(i, kind))]
        return F.create_map(*cells) if cells else F.expr(default)

    stats = by_name(
        lambda i, kind: F.struct(*[_stat(i, kind, s).alias(s) for s in _STATS]),
        "cast(map() as map<string, struct<min: double, max: double, mean: double, std: double>>)",
    )
    columns = F.array(*[F.lit(name) for name, _ in kinds]).cast("array<string>")
    return (
        _one_pass(df)
        .select(
            F.lit(table_name).alias("table_name"),
            F.lit(group).alias("group"),
            F.lit(ordinal).cast("long").alias("ordinal"),
            "n_rows",
            columns.alias("columns"),
            by_name(
                lambda i, kind: _class(i, kind, null_sensitive), "cast(map() as map<string, string>)"
            ).alias("dtypes"),
            by_name(lambda i, _: _fraction(i), "cast(map() as map<string, double>)").alias("null_fraction"),
            F.map_filter(stats, lambda _, s: s["min"].isNotNull()).alias("basic_stats"),
        )
        .withColumn("schema_fingerprint", schema_fingerprint(F.col("columns"), F.col("dtypes")))
    )


def as_text(column: Column, kind: str) -> Column:
    """Text that a value is counted by."""
    if kind == "bool":
        return F.when(column, "True").when(~column, "False")
    return column.cast("string")


def topk_values(
    df: DataFrame, k: int = TOP_K, columns: Sequence[str] | None = None, null_label: str | None = None
) -> DataFrame:
    """The ``k`` most frequent values of each non-numeric column: ``column_name, value, n, position``.

    Ties go to the smaller SHA-256 digest of the value, whatever its length. Nulls are left out, or counted
    as ``null_label`` if one is given. A sketch nominates the candidates and a recount certifies them, when this is
    called; only columns whose values hardly repeat have all their distinct values counted.
    """
    kinds = {field.name: type_class(field.dataType) for field in df.schema}
    chosen = columns or [name for name, kind in kinds.items() if not _is_numeric(kind)]
    if not chosen:
        return df.sparkSession.createDataFrame([], frequent.SCHEMA)
    texts = df.select(*[as_text(col(name), kinds[name]).alias(name) for name in chosen])
    values = texts.unpivot([], [col(name) for name in chosen], "column_name", "value")
    if null_label is None:
        values = values.where(F.col("value").isNotNull())
    else:
        values = values.fillna(null_label, ["value"])
    return frequent.top_values(values, k)
