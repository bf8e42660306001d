"""Schema drift between tables of a group.

Entries are rows with ``group, ordinal, table_name, columns, schema_fingerprint``. Results are flat:
one row per fingerprint or per changed table, so a group with very many tables never has to fit in
one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.operators.lookup import join_lookup

DEFAULT_GROUP = "default"


def with_group(entries: DataFrame) -> DataFrame:
    if "group" not in entries.columns:
        return entries.withColumn("group", F.lit(DEFAULT_GROUP))
    return entries.withColumn("group", F.coalesce("group", F.lit(DEFAULT_GROUP)))


def fingerprint_histogram(entries: DataFrame) -> DataFrame:
    """``group, schema_fingerprint, n_tables``."""
    return (
        with_group(entries)
        .groupBy("group", "schema_fingerprint")
        .agg(F.count(F.lit(1)).alias("n_tables"))
    )


def group_baselines(entries: DataFrame) -> DataFrame:
    """First entry of each group in plan order, found by a partially aggregated ``min_by``."""
    return (
        with_group(entries)
        .groupBy("group")
        .agg(
            F.min_by(F.struct("table_name", "columns"), "ordinal").alias("first"),
            F.min("ordinal").alias("first_ordinal"),
            F.count(F.lit(1)).alias("n_tables"),
        )
    )


def column_diffs(entries: DataFrame) -> DataFrame:
    """Columns added to and removed from the first table of the group; unchanged tables are left out.

    A changed class with the same column names is no difference.
    """
    added = F.array_sort(F.array_except("columns", "first.columns"))
    removed = F.array_sort(F.array_except("first.columns", "columns"))
    firsts = group_baselines(entries)
    counts = firsts.select("group", F.col("n_tables").alias("n"))
    return (
        join_lookup(with_group(entries), firsts.drop("n_tables"), ["group"], counts, spread_by="ordinal")
        .where(F.col("ordinal") != F.col("first_ordinal"))
        .select(
            "group",
            F.col("first.table_name").alias("from_table"),
            F.col("table_name").alias("to_table"),
            added.alias("added_columns"),
            removed.alias("removed_columns"),
        )
        .where((F.size("added_columns") > 0) | (F.size("removed_columns") > 0))
    )


def drift_report(entries: DataFrame) -> DataFrame:
    """All of the above in one long table ordered by group.

    ``section`` is ``tables`` (one row per group), ``fingerprint`` or ``diff``; ``n_tables`` counts the
    tables of the group, of the fingerprint, or 1.
    """
    text = F.lit(None).cast("string")
    texts = F.lit(None).cast("array<string>")
    tables = group_baselines(entries).select(
        "group", F.lit("tables").alias("section"), "n_tables",
        text.alias("schema_fingerprint"),
        F.col("first.table_name").alias("from_table"), text.alias("to_table"),
        texts.alias("added_columns"), texts.alias("removed_columns"),
    )
    prints = fingerprint_histogram(entries).select(
        "group", F.lit("fingerprint").alias("section"), "n_tables", "schema_fingerprint",
        text.alias("from_table"), text.alias("to_table"),
        texts.alias("added_columns"), texts.alias("removed_columns"),
    )
    diffs = column_diffs(entries).select(
        "group", F.lit("diff").alias("section"), F.lit(1).cast("long").alias("n_tables"),
        text.alias("schema_fingerprint"), "from_table", "to_table", "added_columns", "removed_columns",
    )
    return (
        tables.unionByName(prints)
        .unionByName(diffs)
        .orderBy("group", "section", "schema_fingerprint", "to_table")
    )
