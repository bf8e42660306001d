"""From a requested scope to a run record, and the gate before a dataset is built.

Fetching is not part of this: files are on storage, and what a fetcher could not get comes in as rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import errors, text
from driftspark.operators import catalog, drift, events, ledger, runs
from driftspark.operators.lookup import join_lookup, key_counts
from driftspark.runtime import materialize
from driftspark.sources.entries import file_entries
from driftspark.sources.files import INVENTORY_SCHEMA, file_stats, hash_files

PLAN_COLUMNS = [
    "ordinal", "logical_name", "url", "dest_path", "expected_type", "expected_size_bytes", "sha256", "group",
    "optional",
]


@dataclass(frozen=True)
class RunRequest:
    run_id: str
    source: str
    ref: str
    resolved_ref: str
    scope: str
    started_at_utc: str
    finished_at_utc: str
    allow_missing: bool = False
    allow_floating: bool = False
    require_360: bool = False
    dry_run: bool = False


@dataclass(frozen=True)
class RunResult:
    plan: DataFrame
    errors: DataFrame
    ledger: DataFrame
    schemas: DataFrame
    drift: DataFrame
    record: DataFrame
    events: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "plan": self.plan, "errors": self.errors, "schemas": self.schemas, "drift": self.drift,
            "runs": self.record, "events": self.events,
        }


def plan_release(
    scopes: DataFrame, listing: DataFrame, source: str, release: str,
    patterns: Mapping[str, str] = catalog.DATASET_PATTERNS, allow_missing: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Plan of one release and ``code, message`` of what stops it; ``scopes`` has ``scope_id, scope``."""
    parsed = catalog.parse_scopes(scopes)
    invalid = catalog.scope_violations(parsed, patterns).select("code", "message")
    resolved = catalog.resolve_assets(catalog.expand_scope(parsed), listing, patterns)
    unresolved = catalog.resolution_errors(resolved, allow_missing).select(
        "code", F.concat_ws(" ", "dataset", F.col("season").cast("string")).alias("message")
    )
    return catalog.plan_assets(resolved, source, release), invalid.unionByName(unresolved)


def plan_tree(
    pairs: DataFrame, match_rows: DataFrame | None, location: Mapping[str, str]
) -> DataFrame:
    """Catalog file, one match file per pair and, once those are stored, three files per match.

    ``ordinal`` orders by step, then by the numbers of pair or match.
    """
    root = pairs.sparkSession.createDataFrame([("competitions",)], "name STRING")
    none = F.lit(0).cast("long")
    steps = [
        (catalog.plan_catalog(root, **location), none, none),
        (catalog.plan_pair_files(pairs, **location), F.col("competition_id"), F.col("season_id")),
    ]
    if match_rows is not None:
        kinds = F.array(*[F.lit(group) for group, _, _ in catalog.MATCH_ARTIFACTS])
        files = catalog.artifact_fanout(catalog.extract_ids(match_rows), **location)
        steps.append((files, F.col("match_id"), F.array_position(kinds, F.col("group"))))
    parts = [
        items.withColumn(
            "ordinal",
            F.struct(
                F.lit(i).alias("step"), first.cast("long").alias("first"), second.cast("long").alias("second")
            ),
        ).select(*PLAN_COLUMNS)
        for i, (items, first, second) in enumerate(steps)
    ]
    return reduce(DataFrame.unionByName, parts)


def item_outcomes(
    plan: DataFrame, known_before: DataFrame, inventory: DataFrame, failures: DataFrame, run_id: str
) -> DataFrame:
    """One row per planned item: skipped, stored now, or failed with a code.

    ``failures`` has ``dest_path, error_code``, one row per path. An item that is neither stored nor
    named there counts as not found.
    """
    hashed = F.coalesce("sha256", F.lit("")) != ""
    nothing = F.lit(None).cast("string")
    facts = (
        known_before.select("dest_path", hashed.alias("recorded"), F.lit(False).alias("stored"), nothing.alias("reported"))
        .unionByName(
            inventory.select("dest_path", F.lit(False).alias("recorded"), F.lit(True).alias("stored"), nothing.alias("reported"))
        )
        .unionByName(
            failures.select("dest_path", F.lit(False).alias("recorded"), F.lit(False).alias("stored"), F.col("error_code").alias("reported"))
        )
        .groupBy("dest_path")
        .agg(*[F.max(name).alias(name) for name in ("recorded", "stored", "reported")])
    )
    items = plan.where(F.coalesce("url", F.lit("")) != "")
    known = F.coalesce(F.col("recorded") & F.col("stored"), F.lit(False))
    absent = ~F.coalesce("stored", F.lit(False))
    return join_lookup(
        items, facts, ["dest_path"], key_counts(items, ["dest_path"]), spread_by="logical_name"
    ).select(
        F.lit(run_id).alias("run_id"),
        "logical_name",
        "dest_path",
        "url",
        "group",
        "optional",
        F.when(~known, F.coalesce("reported", F.when(absent, errors.HTTP_404))).alias("error_code"),
        known.alias("skipped"),
    )


_ABOUT = ["dest_path", "ordinal", "group", "logical_name"]


def stored_schemas(spark: SparkSession, root: str, plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries of the stored plan items, with ``note`` where a file gives none.

    Each file is read once, however many items name it, and the number of jobs does not depend on the number of files.
    """
    items = plan.join(stored.select("dest_path"), "dest_path", "left_semi").select(*_ABOUT)
    found = materialize(file_entries(spark, stored.join(items.select("dest_path").distinct(), "dest_path", "left_semi"), root), "entries")
    rows = join_lookup(items, found, ["dest_path"], key_counts(items, ["dest_path"]), spread_by="logical_name")
    return rows.withColumn("table_name", F.element_at(F.split("dest_path", "/"), -1))


def _runs(spark: SparkSession, request: RunRequest) -> DataFrame:
    row = (
        request.run_id, request.started_at_utc, request.finished_at_utc, request.source, request.ref,
        request.resolved_ref, request.scope, request.require_360,
    )
    return spark.createDataFrame(
        [row],
        "run_id STRING, started_at_utc STRING, finished_at_utc STRING, source STRING, source_ref STRING, "
        "resolved_ref STRING, requested_scope STRING, require_360 BOOLEAN",
    ).withColumn("requested_scope", text.normalize_scope("requested_scope"))


def _record(spark: SparkSession, request: RunRequest, statuses: DataFrame) -> DataFrame:
    run = _runs(spark, request)
    return runs.attribution_lookup(runs.run_record(statuses, run), runs.terms_table(spark))


def ingest(
    spark: SparkSession, request: RunRequest, plan: DataFrame, known_before: DataFrame,
    failures: DataFrame, root: str, expansion_errors: DataFrame | None = None,
) -> RunResult:
    """Account for a run whose files are on storage below ``root``.

    ``expansion_errors`` (``code, message, value``, see ``catalog.expansion_violations``) are parts of the
    request that gave no item; each counts as failed.

    Unsafe destinations stop it before anything else; a dry run records the plan and nothing more.
    Plan, sizes and outcomes are written once, because several results read them. A stored file whose hash the ledger
    has is not hashed again; only new ones are.
    """
    plan = materialize(plan.select(*PLAN_COLUMNS), "plan")
    unsafe = ledger.unsafe_paths(plan.where(F.coalesce("dest_path", F.lit("")) != ""))
    if not unsafe.isEmpty():
        raise ValueError(f"{errors.UNSAFE_DEST_PATH}: {unsafe.first()['dest_path']}")
    if request.dry_run:
        return _dry_run(spark, request, plan)
    stored = materialize(file_stats(plan, root), "stored")
    outcomes = materialize(
        runs.optional_policy(
            item_outcomes(plan, known_before, stored, failures, request.run_id), request.require_360
        ),
        "outcomes",
    )
    arrived = stored.join(
        outcomes.where(F.col("error_code").isNull() & ~F.col("skipped")).select("dest_path"),
        "dest_path",
        "left_semi",
    )
    fresh = materialize(hash_files(materialize(arrived, "arrived"), root), "fresh")
    counters = _one_run(spark, request.run_id, runs.run_counters(outcomes))
    if expansion_errors is not None:
        counters = counters.withColumn("failed", F.col("failed") + F.lit(expansion_errors.count()))
    schemas = materialize(stored_schemas(spark, root, plan, stored), "schemas")
    none = F.lit(None).cast("string")

    def found(code: Column, detail: Column, message: Column = none, name: Column = none, path: Column = none, url: Column = none, optional: Column = F.lit(False)) -> list[Column]:  # noqa: B008, E501
        record = errors.full_record(code, message, F.map_filter(detail, lambda _, value: value.isNotNull()), url, path)
        return [F.inline(F.array(record)), name.alias("logical_name"), path.alias("dest_path"), optional.alias("optional")]

    def text_detail(value: Column) -> Column:
        return F.create_map(F.lit("detail"), value)

    failed_items = outcomes.where(F.col("error_code").isNotNull()).select(
        *found(
            F.col("error_code"), F.create_map(F.lit("optional"), F.when(F.col("optional_miss"), "true")),
            name=F.col("logical_name"), path=F.col("dest_path"), url=F.col("url"), optional=F.col("optional_miss"),
        )
    )
    parts = F.split("note", ": ", 2)
    bad_files = schemas.where(F.col("note").startswith("E_"))
    unreadable = bad_files.select(F.lit(request.run_id).alias("run_id"), F.col("dest_path").alias("path"), parts[0].alias("code"))
    bad_files = bad_files.select(
        *found(parts[0], text_detail(F.get(parts, F.lit(1))), name=F.col("logical_name"), path=F.col("dest_path"))
    )
    found_errors = failed_items.unionByName(bad_files)
    unresolved = None
    if expansion_errors is not None:
        message = F.concat_ws(": ", "message", "value")
        unresolved = expansion_errors.select(F.lit(request.run_id).alias("run_id"), "code", message.alias("message"))
        found_errors = found_errors.unionByName(
            expansion_errors.select(*found(F.col("code"), text_detail(F.col("value").cast("string")), message=message))
        )
    statuses = runs.run_status(counters)
    good = schemas.where(~F.coalesce(F.col("note").startswith("E_"), F.lit(False)))
    return RunResult(
        plan=plan,
        errors=found_errors,
        ledger=ledger.ledger_upsert(known_before, fresh),
        schemas=schemas,
        drift=drift.drift_report(good),
        record=_record(spark, request, statuses),
        events=events.run_events(_runs(spark, request), statuses, outcomes, unreadable, unresolved),
    )


def _one_run(spark: SparkSession, run_id: str, counters: DataFrame) -> DataFrame:
    """A run without items still has a row, all zero."""
    zero = ["planned", "downloaded", "skipped", "failed", "optional_missing"]
    one = spark.createDataFrame([(run_id,)], "run_id STRING")
    return one.join(counters, "run_id", "left").fillna(0, zero)


def _dry_run(spark: SparkSession, request: RunRequest, plan: DataFrame) -> RunResult:
    nothing = stored_schemas(spark, "/", plan.where(F.lit(False)), spark.createDataFrame([], INVENTORY_SCHEMA))
    counters = _one_run(
        spark, request.run_id,
        spark.createDataFrame(
            [], "run_id STRING, planned BIGINT, downloaded BIGINT, skipped BIGINT, failed BIGINT, optional_missing BIGINT"
        ),
    )
    return RunResult(
        plan=plan,
        errors=spark.createDataFrame(
            [],
            "code STRING, message STRING, detail MAP<STRING, STRING>, url STRING, path STRING, logical_name STRING, "
            "dest_path STRING, optional BOOLEAN",
        ),
        ledger=spark.createDataFrame([], "dest_path STRING, sha256 STRING, size_bytes BIGINT, mtime_utc STRING"),
        schemas=nothing,
        drift=drift.drift_report(nothing),
        record=_record(spark, request, runs.run_status(counters)),
        events=events.dry_run_events(_runs(spark, request), plan),
    )


def verify_run(
    record: DataFrame, plan: DataFrame, known: DataFrame | None, inventory: DataFrame, allow_floating: bool = False
) -> tuple[bool, DataFrame]:
    """The gate before a dataset is built: a record, a pinned reference, no integrity violation.

    Violations are ``code, message, logical_name, dest_path``, in that order. ``known`` is None where the
    ledger is lost: unlike an empty ledger, that is a violation even if the plan requires nothing.
    """
    spark = plan.sparkSession
    head = record.select("config.require_360").first()
    if head is None:
        missing = spark.createDataFrame(
            [(errors.MANIFEST_MISSING, "no run record", None, None)],
            "code STRING, message STRING, logical_name STRING, dest_path STRING",
        )
        return False, missing
    if known is None:
        lost = spark.createDataFrame(
            [(errors.CHECKSUMS_MISSING, "no checksum ledger", None, None)],
            "code STRING, message STRING, logical_name STRING, dest_path STRING",
        )
        return False, lost
    nothing = F.lit(None).cast("string")
    floating = runs.pinned_gate(record, allow_floating).select(
        "code", F.concat(F.lit("floating reference: "), "source_ref").alias("message"),
        nothing.alias("logical_name"), nothing.alias("dest_path"),
    )
    report = ledger.integrity_report(plan, known, inventory, bool(head["require_360"]))
    violations = materialize(report.unionByName(floating), "violations").orderBy(
        "code", F.coalesce("logical_name", F.lit("")), F.coalesce("dest_path", F.lit("")), "message"
    )
    return violations.isEmpty(), violations
