"""One query per operator over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import errors, text
from driftspark.operators import catalog, drift, events, ledger, metrics, models, profile, runs, sides, split
from driftspark.plans import training
from driftspark.runtime import materialize, scratch_dir
from driftspark.sources import artifacts, files, games, snapshots, splits, tables
from driftspark.sources.entries import file_entries
from driver import bindings as b

Query = Callable[[SparkSession, str], DataFrame]

PROFILED = ["events", "customer", "part", "documents"]
# Oracles add doubles in another order; six decimals are the same in both.
DECIMALS = 6


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, DECIMALS) for name in names})


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# --- sides and splits ----------------------------------------------------------------------------


def _sides(spark, sf, target="win", stats=b.GAME_STATS):
    return sides.two_sided_unpivot(b.games(spark, sf), stats, target)


def scan_games(spark, sf):
    return b.games(spark, sf)


def landed_games(spark, sf):
    """Two sports written below one path, one of them twice; the other one is read back."""
    path = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    rows = b.games(spark, sf)
    games.write_games(rows, path, "nba")
    for _ in range(2):
        games.write_games(rows.where("home_score > 0"), path, "nfl")
    return games.read_games(spark, path, "nba")


def scan_season_files(spark, sf):
    """Games written as season files, arrays of games of one season and 2,000 keys, and read as a sport's folder."""
    root = f"{scratch_dir(spark)}/seasons-{uuid.uuid4().hex}"
    renamed = {"items": "rebounds", "returns": "assists", "disc": "turnovers"}
    rows = b.games(spark, sf).withColumnsRenamed({f"{s}_{a}": f"{s}_{n}" for s in ("home", "away") for a, n in renamed.items()})
    place = F.concat_ws("", F.lit("nba/"), "season", F.lit("_"), F.floor(F.col("game_id").cast("long") / 2000).cast("string"), F.lit(".json"))
    documents = F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",")
    arrays = rows.groupBy(place.alias("dest_path")).agg(documents.alias("list"))
    content = F.concat(F.lit("["), "list", F.lit("]")).cast("binary")
    materialize(files.write_files(arrays.select("dest_path", content.alias("content")), root), "season-files")
    return games.read_season_files(spark, root, "nba")


def stored_splits(spark, sf):
    """Split games stored as Parquet by split, exported as CSV and read back under their schema."""
    root = f"{scratch_dir(spark)}/splits-{uuid.uuid4().hex}"
    splits.write_splits(b.split_games(spark, sf), f"{root}/parquet")
    rows = splits.read_splits(spark, f"{root}/parquet")
    written = splits.export_csv(rows, f"{root}/csv", "nba", "win")
    back = splits.read_csv_splits(spark, written, rows.drop("split").schema)
    return back.select("game_id", "season", "date", "team", "is_home", "items", "opp_disc", "target", "split")


def ledger_snapshots(spark, sf):
    """A ledger of all parts, and upserts of those that a supplier's line items name, by snapshots."""
    path = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    hashed = lambda text: F.sha2(text, 256).alias("sha256")
    parts = b.table(spark, sf, "part")
    name = F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("dest_path")
    snapshots.upsert_snapshot(
        parts.select(name, hashed(F.col("p_name")), F.col("p_size").cast("long").alias("size_bytes"), F.lit("2024").alias("mtime_utc")), path
    )
    lines = b.table(spark, sf, "lineitem").where("l_suppkey = 1").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    named = F.concat(F.lit("parts/"), F.col("l_partkey").cast("string")).alias("dest_path")
    snapshots.upsert_snapshot(
        lines.select(named, hashed(F.col("n").cast("string")), F.col("n").alias("size_bytes"), F.lit("2025").alias("mtime_utc")), path
    )
    return artifacts.read_ledger(spark, path)


def csv_documents(spark, sf):
    """Documents written as CSV and read with types found again; their texts hold commas, quotes and line breaks."""
    path = f"{scratch_dir(spark)}/documents-{uuid.uuid4().hex}.csv"
    rows = b.table(spark, sf, "documents")
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(header=True, **whole, **tables.CSV_QUOTING).csv(path)
    return tables.read_csv_table(spark, path)


def profile_json_files(spark, sf):
    """Events written as JSON arrays of a thousand from the tasks, and the schemas of the files of a plan."""
    root = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    place = F.concat(F.lit("events/"), F.floor(F.col("event_id") / 1000).cast("string"), F.lit(".json"))
    arrays = (
        b.table(spark, sf, "events")
        .groupBy(place.alias("dest_path"))
        .agg(F.array_join(F.collect_list(F.to_json(F.struct("event_id", "event_type", "value"))), ",").alias("list"))
    )
    content = F.concat(F.lit("["), F.col("list"), F.lit("]")).cast("binary")
    plan = materialize(files.write_files(arrays.select("dest_path", content.alias("content")), root), "plan")
    items = tables.parsed_items(plan, root)
    kinds = F.transform("columns", lambda c: F.element_at("dtypes", c))
    return tables.item_schemas(items, "dest_path").select(
        "dest_path", "n_rows", _joined("columns"), F.array_join(kinds, ",").alias("classes")
    )


def profile_entries(spark, sf):
    """Orders written as CSV, JSON and Parquet files from the tasks, and the full entries of these files by column."""
    root = f"{scratch_dir(spark)}/orders-{uuid.uuid4().hex}"
    stored = materialize(files.write_files(b.order_files(spark, sf), root), "stored")
    entries = file_entries(spark, stored, root)
    rows = entries.select("dest_path", "n_rows", "dtypes", "null_fraction", "basic_stats", "top_values", F.explode("columns").alias("column_name"))
    stats, name = F.try_element_at("basic_stats", F.col("column_name")), F.col("column_name")
    top = F.transform(F.try_element_at("top_values", name), lambda x: F.concat_ws("=", x["value"], x["n"].cast("string")))
    found = rows.select(
        "dest_path", "column_name", "n_rows", F.element_at("dtypes", name).alias("type_class"),
        F.element_at("null_fraction", name).alias("null_fraction"),
        *[stats[s].alias(f"{s}_value") for s in ("min", "max", "mean", "std")],
        F.array_join(top, "|").alias("top_values"),
    )
    return _rounded(found, "null_fraction", "mean_value", "std_value")


def stored_pages(spark, sf):
    """Pages written as files from the tasks, and the inventory of the files a plan asks for."""
    root = f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex}"
    place = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = b.table(spark, sf, "pages").select(place.alias("dest_path"), F.col("html").cast("binary").alias("content"))
    written = materialize(files.write_files(pages, root), "written")
    asked = written.select("dest_path").union(written.select(F.concat("dest_path", F.lit(".lost"))))
    return files.file_inventory(asked, root).drop("mtime_utc")


def two_sided_unpivot(spark, sf):
    return _sides(spark, sf)


def default_fill(spark, sf):
    """A statistic no game has is 0 on both sides."""
    rows = _sides(spark, sf, stats=["items", "assists"])
    return rows.select("game_id", "is_home", "items", "opp_items", "assists", "opp_assists")


def target_win(spark, sf):
    return _sides(spark, sf).select("game_id", "is_home", "target")


def target_score_diff(spark, sf):
    return _sides(spark, sf, "score_diff").select("game_id", "is_home", "target")


def feature_drop(spark, sf):
    return sides.feature_drop(_sides(spark, sf), ["returns", "opp_disc", "no_such_feature"])


def feature_list(spark, sf):
    return sides.feature_list(_sides(spark, sf))


def time_split(spark, sf):
    return b.split_games(spark, sf).select("game_id", "is_home", "date", "split")


def time_split_by_game(spark, sf):
    """No game on two sides of a cut."""
    rows = b.split_games(spark, sf).drop("split")
    return split.time_split(rows, keep_together="game_id").select("game_id", "is_home", "date", "split")


def split_sizes(spark, sf):
    rows = b.split_games(spark, sf)
    return split.split_sizes(rows, len(sides.feature_columns(rows, ["split"])))


# --- metrics -------------------------------------------------------------------------------------


def season_shift(spark, sf):
    return training.rule_shift(b.split_games(spark, sf), F.col("is_home"))


def shift_long(spark, sf):
    return metrics.shift_long(season_shift(spark, sf))


def binary_metrics(spark, sf):
    return metrics.binary_metrics(b.quality_guess(spark, sf), ["lang"])


def _predicted(spark, sf):
    return training.one_feature_predictor(b.split_games(spark, sf, "score_diff"), "items")


def regression_metrics(spark, sf):
    return _rounded(metrics.regression_metrics(_predicted(spark, sf), ["split"]), "mse", "mae", "r2")


def season_shift_regression(spark, sf):
    test = _predicted(spark, sf).where(F.col("split") == "test")
    return _rounded(metrics.season_shift(test, "regression"), "mse", "mae", "r2")


# --- profiling and drift -------------------------------------------------------------------------


def _profiles(spark, sf):
    parts = [profile.profile_table(b.table(spark, sf, name), name) for name in PROFILED]
    return reduce(DataFrame.unionByName, parts)


def profile_table(spark, sf):
    return _rounded(_profiles(spark, sf), "null_fraction", "mean_value", "std_value")


def null_fraction(spark, sf):
    return _rounded(profile.null_fraction(b.events_with_gaps(spark, sf), "events"), "null_fraction")


def numeric_stats(spark, sf):
    return _rounded(
        profile.numeric_stats(b.events_with_gaps(spark, sf), "events"), "mean_value", "std_value"
    )


def topk_values(spark, sf):
    documents = profile.topk_values(b.table(spark, sf, "documents")).select(
        F.lit("documents").alias("table_name"), "*"
    )
    events = profile.topk_values(b.events_with_gaps(spark, sf)).select(
        F.lit("events").alias("table_name"), "*"
    )
    return documents.unionByName(events)


def numeric_coerce(spark, sf):
    return _rounded(
        profile.coerced_stats(b.part_texts(spark, sf), ["size_text", "price_text"]),
        "mean_value", "std_value",
    )


def profile_csv(spark, sf):
    typed = tables.typed_text(b.event_cells(spark, sf))
    return _rounded(
        profile.profile_table(typed, "events_csv"), "null_fraction", "mean_value", "std_value"
    )


def flatten_json(spark, sf):
    flat = tables.flatten_json(b.event_documents(spark, sf), "document")
    named = flat.toDF(*[name.replace(".", "_") for name in flat.columns])
    return named.withColumn("tags", F.array_join("tags", "|"))


def schema_fingerprint(spark, sf):
    return b.schema_entries(spark, sf).select(
        "table_name",
        _joined("columns"),
        profile.fingerprint_payload(F.col("columns"), F.col("dtypes")).alias("payload"),
        "schema_fingerprint",
    )


def fingerprint_histogram(spark, sf):
    return drift.fingerprint_histogram(b.schema_entries(spark, sf))


def column_diffs(spark, sf):
    return drift.column_diffs(b.schema_entries(spark, sf)).select(
        "group", "from_table", "to_table", _joined("added_columns"), _joined("removed_columns")
    )


def drift_report(spark, sf):
    return drift.drift_report(b.schema_entries(spark, sf)).select(
        "group", "section", "n_tables", "schema_fingerprint", "from_table", "to_table",
        _joined("added_columns"), _joined("removed_columns"),
    )


# --- text rules ----------------------------------------------------------------------------------


def canonical_json(spark, sf):
    return b.event_documents(spark, sf).select(text.canonical_json(F.col("document")).alias("canonical"))


def normalize_scope(spark, sf):
    return b.event_scopes(spark, sf).select("event_id", text.normalize_scope("scope").alias("normalized"))


def scope_fingerprint(spark, sf):
    return b.event_scopes(spark, sf).select(
        "event_id", text.scope_fingerprint(F.col("scope")).alias("fingerprint")
    )


def sha256_hex(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", text.sha256_hex(F.col("text")).alias("sha256"))


def sanitize_name(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("name"))


def is_pinned_ref(spark, sf):
    digest = F.sha2("p_name", 256)
    length = F.element_at(F.array(*[F.lit(n) for n in (6, 7, 10, 12, 40, 64)]), (F.col("p_size") % 6 + 1).cast("int"))
    ref = F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.left(digest, length))
    return b.table(spark, sf, "part").select(
        "p_partkey", text.is_commit_id(ref).alias("is_commit_id"), text.is_pinned_ref(ref).alias("is_pinned")
    )


def split_trim(spark, sf):
    words = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" ,  ")), F.lit(","), F.col("p_type"))
    return b.table(spark, sf, "part").select(
        "p_partkey", F.array_join(text.split_trim(words), "|").alias("parts")
    )


def utc_stamp(spark, sf):
    return b.table(spark, sf, "events").select("event_id", text.utc_stamp(F.col("ts")).alias("stamp"))


def expected_type(spark, sf):
    suffixes = [".parquet", ".CSV", ".json", ".zip", ".tar", ".tar.gz", ".tgz", ".txt", ""]
    suffix = F.element_at(F.array(*[F.lit(s) for s in suffixes]), (F.col("p_size") % 9 + 1).cast("int"))
    return b.table(spark, sf, "part").select(
        "p_partkey", text.expected_type(F.concat("p_name", suffix)).alias("expected_type")
    )


def error_record(spark, sf):
    kind = F.col("event_type")
    detail = F.from_json("props", "MAP<STRING,STRING>")
    detail = F.when(kind == "error", F.map_concat(detail, F.create_map(F.lit("severity"), F.lit("fatal")))).otherwise(detail)
    record = errors.error_record(
        F.when(kind == "error", errors.TIMEOUT).otherwise(errors.IO),
        F.concat(F.lit("event "), kind),
        detail,
        retryable=kind == "error",
        severity=F.lit("warn"),
        path=F.when(kind != "view", F.col("event_id").cast("string")),
    )
    by_name = F.map_from_entries(F.array_sort(F.map_entries(F.col("r.detail"))))
    return (
        b.table(spark, sf, "events")
        .select("event_id", record.alias("r"))
        .select("event_id", "r.code", "r.message", F.to_json(by_name).alias("detail"), "r.url", "r.path")
    )


# --- catalog -------------------------------------------------------------------------------------


def _resolved(spark, sf):
    return catalog.resolve_assets(b.page_requests(spark, sf), b.page_listing(spark, sf), b.PAGE_PATTERNS)


def resolve_assets(spark, sf):
    return _resolved(spark, sf)


def plan_assets(spark, sf):
    return catalog.plan_assets(_resolved(spark, sf), "web", "v1").select(
        "ordinal", "logical_name", "url", "dest_path", "expected_type", "expected_size_bytes", "group", "season"
    )


def missing_assets(spark, sf):
    return catalog.missing_assets(_resolved(spark, sf))


def ambiguous_candidates(spark, sf):
    return catalog.ambiguous_candidates(_resolved(spark, sf), b.page_listing(spark, sf), b.PAGE_PATTERNS)


def scope_violations(spark, sf):
    return catalog.scope_violations(catalog.parse_scopes(b.page_scopes(spark, sf)), b.PAGE_PATTERNS)


def expand_scope(spark, sf):
    return catalog.expand_scope(catalog.parse_scopes(b.page_scopes(spark, sf)))


def _pairs(spark, sf):
    return catalog.expand_pairs(
        b.competition_catalog(spark, sf),
        competitions=b.european_competitions(spark, sf),
        seasons=[1996, 1997, 1998],
    )


def pair_violations(spark, sf):
    """Requests by event: the type is no competition, the user may be one."""
    events = b.table(spark, sf, "events")
    competition = F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    season = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy"))
    pairs = events.select(competition.alias("competition_id"), season.alias("season_id"))
    return catalog.pair_violations(pairs).groupBy("code", "message", "value").count().withColumnRenamed("count", "n")


def expand_pairs(spark, sf):
    return catalog.sorted_distinct(_pairs(spark, sf), "competition_id", "season_id")


def plan_pair_files(spark, sf):
    return catalog.plan_pair_files(_pairs(spark, sf), **b.LOCATION).drop("expected_size_bytes", "sha256")


def extract_ids(spark, sf):
    return catalog.extract_ids(b.match_rows(spark, sf))


def artifact_fanout(spark, sf):
    ids = catalog.extract_ids(b.match_rows(spark, sf))
    return catalog.artifact_fanout(ids, **b.LOCATION).drop("expected_size_bytes", "sha256")


# --- ledger --------------------------------------------------------------------------------------


def content_hash(spark, sf):
    return b.table(spark, sf, "pages").select(
        "page_id",
        files.content_hash(F.col("html")).alias("sha256"),
        F.octet_length("html").cast("long").alias("size_bytes"),
    )


def skip_known(spark, sf):
    known = ledger.skip_known(b.page_plan(spark, sf), b.page_ledger(spark, sf), b.page_inventory(spark, sf))
    return known.select("logical_name", "dest_path", "known")


def ledger_upsert(spark, sf):
    return ledger.ledger_upsert(b.page_ledger(spark, sf), b.page_new_hashes(spark, sf))


def _states(spark, sf):
    return ledger.path_states(
        b.page_plan(spark, sf), b.page_ledger(spark, sf), b.page_inventory(spark, sf), require_360=True
    )


def integrity_required(spark, sf):
    return ledger.integrity_required(_states(spark, sf))


def integrity_sweep(spark, sf):
    return ledger.integrity_sweep(_states(spark, sf))


def integrity_report(spark, sf):
    return ledger.integrity_report(
        b.page_plan(spark, sf), b.page_ledger(spark, sf), b.page_inventory(spark, sf), require_360=True
    )


def duplicate_paths(spark, sf):
    return ledger.duplicate_paths(b.page_plan(spark, sf))


def unsafe_paths(spark, sf):
    return ledger.unsafe_paths(b.page_plan(spark, sf))


# --- runs ----------------------------------------------------------------------------------------


def optional_policy(spark, sf):
    judged = runs.optional_policy(b.outcomes(spark, sf), require_360=True)
    return judged.select("event_id", "group", "error_code", "optional_miss")


def _counters(spark, sf):
    return runs.run_counters(runs.optional_policy(b.outcomes(spark, sf)))


def run_counters(spark, sf):
    return _counters(spark, sf)


def run_status(spark, sf):
    return runs.run_status(_counters(spark, sf)).select("run_id", "status")


def run_record(spark, sf):
    record = runs.run_record(runs.run_status(_counters(spark, sf)), b.runs(spark, sf))
    return record.select(
        *[c for c in record.columns if c not in ("config", "results")], "config.require_360", "results.*"
    )


def audit_rollup(spark, sf):
    return runs.audit_rollup(b.audit_events(spark, sf))


def run_events(spark, sf):
    """Audit events of all runs, counted by run, phase, message and level."""
    outcomes = runs.optional_policy(b.outcomes(spark, sf)).withColumnRenamed("event_id", "logical_name")
    statuses = runs.run_status(runs.run_counters(outcomes))
    found = events.run_events(b.runs(spark, sf), statuses, outcomes)
    return found.groupBy("run_id", "phase", "msg", F.coalesce("level", F.lit("info")).alias("level")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts_utc").alias("ts_utc")
    )


def attribution_lookup(spark, sf):
    found = runs.attribution_lookup(b.runs(spark, sf).select("run_id", "source"), runs.terms_table(spark))
    return found.select(
        "run_id",
        "source",
        F.size("requirements").alias("n_requirements"),
        F.array_join(F.transform("links", lambda link: link["url"]), "|").alias("urls"),
    )


def pinned_gate(spark, sf):
    return runs.pinned_gate(b.runs(spark, sf))


# --- models --------------------------------------------------------------------------------------


# What is left are ``is_home`` and ``items``: two features have a closed form in SQL.
BUT_TWO = ("returns", "disc", "opp_items", "opp_returns", "opp_disc")
# One feature and an intercept take a short Newton iteration in SQL.
BUT_ONE = ("is_home", *BUT_TWO)


def _model(spark, sf, target, model_type, drop=()):
    rows = b.split_games(spark, sf, target, drop)
    return training.train(rows, target, model_type, evaluate_shift=True).shift


def rf_classify(spark, sf):
    return _model(spark, sf, "win", "rf")


def logit_classify(spark, sf):
    return _model(spark, sf, "win", "linear", BUT_ONE)


def logit_classify_all(spark, sf):
    return _model(spark, sf, "win", "linear")


def rf_regress(spark, sf):
    return _model(spark, sf, "score_diff", "rf")


def ridge_regress(spark, sf):
    return _rounded(_model(spark, sf, "score_diff", "linear", BUT_TWO), "value")


def ridge_regress_all(spark, sf):
    return _rounded(_model(spark, sf, "score_diff", "linear"), "value")


def train_eval(spark, sf):
    rows = b.split_games(spark, sf, "score_diff")
    _, scores = models.train_eval(rows, "regression", "linear")
    return _rounded(scores.withColumn("features", F.array_join("features", ",")), "mse", "mae", "r2")


def drop_ablation(spark, sf):
    rows = b.split_games(spark, sf, "score_diff")
    compared = models.drop_ablation(rows, "regression", [["items"], ["is_home"]], "linear")
    return _rounded(compared, "value", "baseline", "delta")


ALL: list[Query] = [
    scan_games, two_sided_unpivot, default_fill, target_win, target_score_diff, feature_drop, feature_list,
    time_split, time_split_by_game, split_sizes, season_shift, shift_long, binary_metrics, regression_metrics,
    season_shift_regression, profile_table, null_fraction, numeric_stats, topk_values, numeric_coerce,
    profile_csv, flatten_json, schema_fingerprint, fingerprint_histogram, column_diffs, drift_report,
    canonical_json, normalize_scope, scope_fingerprint, sha256_hex, sanitize_name, is_pinned_ref,
    split_trim, utc_stamp, expected_type, error_record, resolve_assets, plan_assets, missing_assets,
    ambiguous_candidates, scope_violations, expand_scope, pair_violations,
    expand_pairs, plan_pair_files, extract_ids,
    artifact_fanout, content_hash, skip_known, ledger_upsert, integrity_required, integrity_sweep,
    integrity_report, duplicate_paths, unsafe_paths, optional_policy, run_counters, run_status, run_record,
    audit_rollup, run_events, attribution_lookup, pinned_gate, rf_classify, logit_classify, logit_classify_all,
    rf_regress, ridge_regress,
    ridge_regress_all, train_eval, drop_ablation, landed_games, csv_documents, profile_json_files,
    stored_pages, profile_entries, scan_season_files, stored_splits, ledger_snapshots,
]
