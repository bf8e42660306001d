"""Audit events of runs: what was resolved, fetched, skipped, missing, unreadable, and how each run ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.operators.lookup import join_lookup, key_counts

EVENT_COLUMNS = ["run_id", "ts_utc", "phase", "msg", "level", "extras"]


def _extras(**fields: Column) -> Column:
    """Map of the fields that are not null."""
    pairs = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def _event(stamp: Column, phase: str, msg: Column | str, level: Column | None = None, **fields: Column) -> Column:
    msg = F.lit(msg) if isinstance(msg, str) else msg
    level = F.lit(None).cast("string") if level is None else level
    extras = _extras(**fields) if fields else F.create_map().cast("map<string,string>")
    return F.struct(
        stamp.alias("ts_utc"), F.lit(phase).alias("phase"), msg.alias("msg"), level.alias("level"), extras.alias("extras")
    )


def run_events(
    runs: DataFrame, statuses: DataFrame, outcomes: DataFrame, unreadable: DataFrame | None = None,
    unresolved: DataFrame | None = None,
) -> DataFrame:
    """``run_id, ts_utc, phase, msg, level, extras`` of any number of runs.

    ``runs`` has ``run_id, started_at_utc, finished_at_utc, requested_scope``; ``statuses`` is what ``run_status`` gives;
    ``outcomes`` what ``optional_policy`` gives, with ``logical_name`` and ``dest_path`` where they are known.
    ``unreadable`` (``run_id, path, code``) are stored files without a profile, ``unresolved`` (``run_id, code,
    message``) parts of the request that gave no item. An event without a level is of the usual kind. Resolving bears
    the stamp of the run's start, all else that of its end.
    """
    start, end = F.col("started_at_utc"), F.col("finished_at_utc")
    count = {name: F.coalesce(name, F.lit(0)) for name in ("planned", "downloaded", "skipped", "failed")}
    whole = runs.join(statuses.select("run_id", "planned", "downloaded", "skipped", "failed", "status"), "run_id", "left")
    framed = whole.select(
        "run_id",
        F.inline(
            F.array(
                _event(start, "resolve", "start_resolve", requested_scope=F.col("requested_scope")),
                _event(start, "resolve", "resolve_ok", planned_files=count["planned"]),
                _event(start, "download", "download_start", planned=count["planned"]),
                _event(
                    end, "finalize", "ingest_complete", status=F.coalesce("status", F.lit("success")),
                    **{name: count[name] for name in ("downloaded", "skipped", "failed")},
                ),
            )
        ),
    )
    stamps = runs.select("run_id", "started_at_utc", "finished_at_utc")

    def stamped(rows: DataFrame, event: Column, spread_by: str) -> DataFrame:
        # A run may hold most of the rows.
        met = join_lookup(rows, stamps, ["run_id"], key_counts(rows, ["run_id"]), spread_by)
        return met.select("run_id", F.inline(F.array(event)))

    def known(rows: DataFrame, name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None)

    failed = F.col("error_code").isNotNull()
    msg = (
        F.when(F.col("optional_miss"), "optional_missing").when(failed, "download_failed")
        .when(F.col("skipped"), "download_skipped").otherwise("download_ok")
    )
    level = F.when(F.col("optional_miss"), "warn").when(failed, "error")
    spread = "dest_path" if "dest_path" in outcomes.columns else "error_code"
    parts = [
        framed,
        stamped(
            outcomes,
            _event(
                end, "download", msg, level, logical_name=known(outcomes, "logical_name"),
                dest_path=known(outcomes, "dest_path"), error=F.col("error_code"),
            ),
            spread,
        ),
    ]
    if unreadable is not None:
        event = _event(end, "schema", "schema_failed", F.lit("warn"), path=F.col("path"), error=F.col("code"))
        parts.append(stamped(unreadable, event, "path"))
    if unresolved is not None:
        event = _event(start, "resolve", "expansion_failed", F.lit("error"), error=F.col("code"), message=F.col("message"))
        parts.append(stamped(unresolved, event, "message"))
    return reduce(DataFrame.unionByName, parts).select(*EVENT_COLUMNS)


def dry_run_events(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Events of one run that records its plan and does nothing else."""
    planned = plan.agg(F.count_if(F.coalesce("url", F.lit("")) != "").alias("planned"))
    start, end = F.col("started_at_utc"), F.col("finished_at_utc")
    # Both sides are one row.
    return runs.join(F.broadcast(planned)).select(
        "run_id",
        F.inline(
            F.array(
                _event(start, "resolve", "start_resolve", requested_scope=F.col("requested_scope")),
                _event(start, "resolve", "resolve_ok", planned_files=F.col("planned")),
                _event(end, "finalize", "dry_run_complete"),
            )
        ),
    ).select(*EVENT_COLUMNS)


def event_lines(events: DataFrame) -> DataFrame:
    """``line``: each event as JSON with sorted keys, for the audit log; a level is there if the event has one."""
    named = {name: F.col(name) for name in EVENT_COLUMNS if name != "extras"}
    pairs = [x for name, value in named.items() for x in (F.lit(name), value)]
    fields = F.map_filter(
        F.map_concat(F.map_filter(F.create_map(*pairs), lambda k, _: ~F.map_contains_key("extras", k)), F.col("extras")),
        lambda _, value: value.isNotNull(),
    )
    return events.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))).alias("line"))


def event_totals(events: DataFrame) -> DataFrame:
    """Events by run, phase and level, with first and last stamp."""
    return (
        events.withColumn("level", F.coalesce("level", F.lit("info")))
        .groupBy("run_id", "phase", "level")
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts_utc").alias("first_ts_utc"), F.max("ts_utc").alias("last_ts_utc"))
    )
