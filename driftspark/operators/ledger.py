"""Stored files against the checksum ledger.

Frames: ``plan`` (``ordinal, logical_name, dest_path, group, optional``), ``ledger``
(``dest_path, sha256, size_bytes, mtime_utc``, one row per path) and ``inventory``
(``dest_path, sha256, size_bytes``, one row per stored file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.functions.errors import violations
from driftspark.functions.text import is_safe_path
from driftspark.operators.lookup import join_lookup, key_counts

# Fixed value: the group that stops being optional on request.
THREE_SIXTY = "three-sixty"


def _planned(plan: DataFrame) -> DataFrame:
    """Items with a destination; placeholders have none."""
    return plan.where(F.coalesce("dest_path", F.lit("")) != "")


def paths_to_check(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every path the checks below ask about."""
    return _planned(plan).select("dest_path").union(ledger.select("dest_path"))


def first_per_path(plan: DataFrame) -> DataFrame:
    """The first item of each path in plan order and how many there are, by partial aggregation."""
    item = F.struct("logical_name", "group", "optional")
    return (
        _planned(plan)
        .groupBy("dest_path")
        .agg(
            F.min_by(item, "ordinal").alias("first"),
            F.min("ordinal").alias("first_ordinal"),
            F.count(F.lit(1)).alias("n_items"),
        )
    )


def duplicate_paths(plan: DataFrame) -> DataFrame:
    """One row per repeated item, naming it and the item that came first."""
    firsts = first_per_path(plan)
    lookup = firsts.where(F.col("n_items") > 1).select(
        "dest_path", F.col("first.logical_name").alias("logical_name_a"), "first_ordinal"
    )
    counts = firsts.select("dest_path", F.col("n_items").alias("n"))
    return (
        join_lookup(_planned(plan), lookup, ["dest_path"], counts, spread_by="logical_name")
        .where(F.col("ordinal") != F.col("first_ordinal"))
        .select(
            F.lit(errors.JSON_PARSE).alias("code"),
            "dest_path",
            "logical_name_a",
            F.col("logical_name").alias("logical_name_b"),
        )
    )


def unsafe_paths(plan: DataFrame) -> DataFrame:
    """Items whose destination is empty, absolute or escapes its base."""
    return plan.where(~is_safe_path(F.col("dest_path"))).select(
        F.lit(errors.UNSAFE_DEST_PATH).alias("code"), "logical_name", "dest_path"
    )


def skip_known(plan: DataFrame, ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """Plan items with ``known``: the file is stored and the ledger has its hash, so it is not fetched."""
    hashed = ledger.where(F.coalesce("sha256", F.lit("")) != "").select("dest_path")
    known = hashed.join(inventory.select("dest_path"), "dest_path", "left_semi").withColumn(
        "known", F.lit(True)
    )
    counts = key_counts(plan, ["dest_path"])
    return join_lookup(plan, known, ["dest_path"], counts, spread_by="logical_name").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def ledger_upsert(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New hashes replace those of the same path; the latest counts if ``new`` names a path twice.

    An anti join, so a small ``new`` is broadcast and the ledger is not shuffled.
    """
    columns = ["dest_path", "sha256", "size_bytes", "mtime_utc"]
    record = F.struct("mtime_utc", "sha256", "size_bytes")
    latest = (
        new.groupBy("dest_path")
        .agg(F.max(record).alias("r"))
        .select("dest_path", "r.sha256", "r.size_bytes", "r.mtime_utc")
    )
    kept = ledger.select(*columns).join(latest, "dest_path", "left_anti")
    return kept.unionByName(latest)


def path_states(
    plan: DataFrame, ledger: DataFrame, inventory: DataFrame, require_360: bool = False
) -> DataFrame:
    """One row per path of plan or ledger with everything the integrity rules ask for.

    The three frames are stacked and meet in one aggregation by ``dest_path``: one shuffle in place of
    three joins, and a path with very many plan items is reduced before it. Both checks read the
    result, so a file is hashed once.
    """
    item = F.struct("logical_name", "group", "optional")
    parts = {"item": None, "ordinal": None, "expected": None, "in_ledger": F.lit(False), "actual": None, "exists": F.lit(False)}
    planned = _planned(plan).select("dest_path", item.alias("item"), "ordinal")
    kinds = {f.name: f.dataType for f in planned.schema} | {"expected": "string", "actual": "string"}

    def stacked(rows: DataFrame, **given: Column | str) -> DataFrame:
        def value(name: str) -> Column:
            if name in given:
                return given[name] if isinstance(given[name], Column) else F.col(given[name])
            default = parts[name]
            return F.lit(None).cast(kinds[name]) if default is None else default

        return rows.select("dest_path", *[value(name).alias(name) for name in parts])

    everything = (
        stacked(planned, item="item", ordinal="ordinal")
        .unionByName(stacked(ledger, expected="sha256", in_ledger=F.lit(True)))
        .unionByName(stacked(inventory, actual="sha256", exists=F.lit(True)))
    )
    states = (
        everything.groupBy("dest_path")
        .agg(
            # Rows without an ordinal take no part in ``min_by``.
            F.min_by("item", "ordinal").alias("first"),
            (F.count("ordinal") > 0).alias("in_plan"),
            F.max("expected").alias("expected"),
            F.max("in_ledger").alias("in_ledger"),
            F.max("actual").alias("actual"),
            F.max("exists").alias("exists"),
        )
        .where(F.col("in_plan") | F.col("in_ledger"))
    )
    optional = F.coalesce("first.optional", F.lit(False))
    promoted = F.lit(require_360) & (F.coalesce("first.group", F.lit("")) == THREE_SIXTY)
    return states.select(
        "dest_path",
        F.col("first.logical_name").alias("logical_name"),
        "in_ledger",
        "exists",
        "expected",
        "actual",
        (F.col("in_plan") & (~optional | promoted)).alias("required"),
        is_safe_path(F.col("dest_path")).alias("safe"),
    )


def _rule(condition: Column, code: str, message: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))


def _mismatch() -> Column:
    expected = F.coalesce("expected", F.lit(""))
    return F.col("exists") & ((expected == "") | (expected != F.col("actual")))


def _required_rules() -> list[Column]:
    due, safe = F.col("required"), F.col("safe")
    return [
        _rule(due & ~safe, errors.UNSAFE_DEST_PATH, "unsafe destination path"),
        _rule(due & safe & ~F.col("exists"), errors.REQUIRED_ASSET_MISSING, "required asset missing"),
        _rule(
            due & safe & ~F.col("in_ledger"),
            errors.CHECKSUM_RECORD_MISSING,
            "checksum record missing for required asset",
        ),
        _rule(
            due & safe & F.col("in_ledger") & _mismatch(),
            errors.CHECKSUM_MISMATCH,
            "checksum mismatch",
        ),
    ]


def _sweep_rules() -> list[Column]:
    listed, safe = F.col("in_ledger"), F.col("safe")
    return [
        _rule(listed & ~safe, errors.UNSAFE_DEST_PATH, "unsafe destination path"),
        _rule(listed & safe & ~F.col("exists"), errors.FILE_MISSING, "stored file missing"),
        _rule(listed & safe & _mismatch(), errors.CHECKSUM_MISMATCH, "checksum mismatch"),
    ]


def _report(states: DataFrame, found: Column) -> DataFrame:
    return states.select("logical_name", "dest_path", F.inline(found)).select(
        "code", "message", "logical_name", "dest_path"
    )


def integrity_required(states: DataFrame) -> DataFrame:
    """Required items must exist, have a ledger row and match it."""
    return _report(states, violations(*_required_rules()))


def integrity_sweep(states: DataFrame) -> DataFrame:
    """Every ledger row, optional or not, must be backed by a file with that hash."""
    return _report(states, violations(*_sweep_rules()))


def integrity_report(
    plan: DataFrame, ledger: DataFrame, inventory: DataFrame, require_360: bool = False
) -> DataFrame:
    """All violations ordered by code, logical name and path; no rows means intact.

    A path is one row here, so a rule found by both checks is reported once without a ``distinct``.
    """
    states = path_states(plan, ledger, inventory, require_360)
    found = F.array_union(violations(*_required_rules()), violations(*_sweep_rules()))
    nothing = F.lit(None).cast("string")
    repeated = duplicate_paths(plan).select(
        "code",
        F.concat(
            F.lit("duplicate destination path: "), "logical_name_a", F.lit(", "), "logical_name_b"
        ).alias("message"),
        nothing.alias("logical_name"),
        "dest_path",
    )
    return (
        _report(states, found)
        .unionByName(repeated)
        .orderBy("code", F.coalesce("logical_name", F.lit("")), "dest_path", "message")
    )
