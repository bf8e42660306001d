"""Run outcomes: optional policy, counters, status, record, gates, terms, audit roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.functions.text import is_pinned_ref
from driftspark.operators.ledger import THREE_SIXTY

SCHEMA_VERSION = "1"

# Sources that need a full commit id, and what each source asks of its users.
PINNED_SOURCES = ["statsbomb-open-data"]
TERMS = [
    (
        "statsbomb-open-data",
        [
            "If you publish/ship results, attribute StatsBomb as the data source and use their logo "
            "per their open-data README."
        ],
        [("StatsBomb Open Data", "https://github.com/statsbomb/open-data", "Attribution required.")],
    ),
    (
        "nflverse",
        ["Attribute nflverse and underlying dataset authors as applicable."],
        [
            (
                "nflverse-data",
                "https://github.com/nflverse/nflverse-data",
                "Data stored in GitHub releases assets.",
            )
        ],
    ),
]

TERMS_SCHEMA = (
    "source STRING, requirements ARRAY<STRING>, "
    "links ARRAY<STRUCT<name: STRING, url: STRING, notes: STRING>>"
)


def optional_policy(outcomes: DataFrame, require_360: Column | bool = False) -> DataFrame:
    """Add ``optional_miss``: a 404 on an optional item, the only failure that does not gate.

    ``outcomes`` has ``run_id, group, optional, error_code`` (null when the item is fine) and
    ``skipped``.
    """
    demanded = F.lit(require_360) if isinstance(require_360, bool) else require_360
    promoted = demanded & (F.coalesce("group", F.lit("")) == THREE_SIXTY)
    miss = (
        F.coalesce("optional", F.lit(False))
        & ~promoted
        & (F.coalesce("error_code", F.lit("")) == errors.HTTP_404)
    )
    return outcomes.withColumn("optional_miss", miss)


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counts by run over the result of ``optional_policy``."""
    failed = F.col("error_code").isNotNull()
    return outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("planned"),
        F.count_if(~failed & ~F.col("skipped")).alias("downloaded"),
        F.count_if(~failed & F.col("skipped")).alias("skipped"),
        F.count_if(failed & ~F.col("optional_miss")).alias("failed"),
        F.count_if(F.col("optional_miss")).alias("optional_missing"),
    )


def run_status(counters: DataFrame) -> DataFrame:
    """Add ``status``. A run whose good items were all skipped and one failed counts as failed."""
    failed = F.col("failed") > 0
    return counters.withColumn(
        "status",
        F.when(failed & (F.col("downloaded") == 0), "failed")
        .when(failed | (F.col("optional_missing") > 0), "partial")
        .otherwise("success"),
    )


def run_record(statuses: DataFrame, runs: DataFrame) -> DataFrame:
    """One record per run; plan items and errors stay tables of their own, keyed by ``run_id``.

    ``runs`` has ``run_id, started_at_utc, finished_at_utc, source, source_ref, resolved_ref,
    requested_scope, require_360`` and optionally ``environment`` (MAP<STRING,STRING>).
    """
    results = F.struct(
        "status",
        F.col("downloaded").alias("downloaded_files"),
        F.col("skipped").alias("skipped_files"),
        F.col("failed").alias("failed_files"),
        F.col("optional_missing").alias("optional_missing_files"),
    )
    environment = ["environment"] if "environment" in runs.columns else []
    return runs.join(statuses, "run_id").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "run_id",
        "started_at_utc",
        "finished_at_utc",
        "source",
        "source_ref",
        "resolved_ref",
        "requested_scope",
        F.struct("require_360").alias("config"),
        results.alias("results"),
        *environment,
    )


def pinned_gate(runs: DataFrame, allow_floating: bool = False) -> DataFrame:
    """Runs stopped because their requested reference is not a full commit id."""
    floating = F.col("source").isin(PINNED_SOURCES) & ~F.coalesce(
        is_pinned_ref(F.col("source_ref")), F.lit(False)
    )
    return runs.where(floating & ~F.lit(allow_floating)).select(
        "run_id", "source", "source_ref", F.lit(errors.FLOATING_REF_DISALLOWED).alias("code")
    )


def terms_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, TERMS_SCHEMA)


def attribution_lookup(runs: DataFrame, terms: DataFrame) -> DataFrame:
    """Requirements and links of each run's source; empty for an unknown one.

    No broadcast is forced: the planner broadcasts ``terms`` when its measured size allows.
    """
    kinds = {field.name: field.dataType for field in terms.schema}

    def or_empty(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(kinds[name])).alias(name)

    return runs.join(terms, "source", "left").select(
        *runs.columns, or_empty("requirements"), or_empty("links")
    )


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Events per phase and level with first and last stamp; an event without a level is ``info``."""
    return (
        audit.withColumn("level", F.coalesce("level", F.lit("info")))
        .groupBy("phase", "level")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("ts_utc").alias("first_ts_utc"),
            F.max("ts_utc").alias("last_ts_utc"),
        )
    )
