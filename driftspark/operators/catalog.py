"""From a requested scope to a list of assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.functions.errors import violations
from driftspark.functions.text import expected_type
from driftspark.operators.lookup import join_lookup, key_counts

# Dataset alias -> asset name pattern; group 1 is the season.
DATASET_PATTERNS = {
    "play_by_play": r"^play_by_play_(\d{4})\.parquet$",
    "pbp": r"^play_by_play_(\d{4})\.parquet$",
    "play_by_play_parquet": r"^play_by_play_(\d{4})\.parquet$",
    "pbp_parquet": r"^play_by_play_(\d{4})\.parquet$",
    "play_by_play_csv": r"^play_by_play_(\d{4})\.csv$",
    "pbp_csv": r"^play_by_play_(\d{4})\.csv$",
    "play_by_play_any": r"^play_by_play_(\d{4})\.(parquet|csv)$",
    "pbp_any": r"^play_by_play_(\d{4})\.(parquet|csv)$",
}

# Files per match as (group, logical name prefix, optional).
MATCH_ARTIFACTS = [
    ("events", "events", False),
    ("lineups", "lineups", False),
    ("three-sixty", "three_sixty", True),
]

_SCOPE_SCHEMA = "datasets ARRAY<STRING>, seasons ARRAY<STRING>"
# A season is a non-negative 32-bit number, so (dataset position, season) packs into one ordinal.
_SEASON_BITS = 32


def parse_scopes(scopes: DataFrame, scope: str = "scope") -> DataFrame:
    """Add ``datasets`` and ``seasons`` read from the JSON column ``scope``."""
    parsed = F.from_json(F.col(scope), _SCOPE_SCHEMA)
    return scopes.withColumns({"datasets": parsed["datasets"], "seasons": parsed["seasons"]})


def season_number(season: Column) -> Column:
    """A season as a number; JSON may write it as ``2023.0``. Null for what is none, or negative."""
    number = F.regexp_replace(season, r"\.0*\s*$", "").try_cast("int")
    return F.when(number >= 0, number)


def scope_violations(scopes: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """One row per broken rule; ``scopes`` has ``scope_id, datasets, seasons``."""

    def rule(broken: Column, message: str, value: Column) -> Column:
        return F.when(
            broken,
            F.struct(
                F.lit(errors.SCOPE_INVALID).alias("code"),
                F.lit(message).alias("message"),
                value.alias("value"),
            ),
        )

    def each(items: Column, is_bad, message: str) -> Column:
        bad = F.filter(F.coalesce(items, F.array()), is_bad)
        return F.transform(
            bad,
            lambda item: F.struct(
                F.lit(errors.SCOPE_INVALID).alias("code"),
                F.lit(message).alias("message"),
                item.alias("value"),
            ),
        )

    nothing = F.lit(None).cast("string")
    lists = violations(
        rule(F.coalesce(F.size("datasets"), F.lit(0)) <= 0, "datasets list missing or empty", nothing),
        rule(F.coalesce(F.size("seasons"), F.lit(0)) <= 0, "seasons list missing or empty", nothing),
    )
    known = list(patterns)
    bad_seasons = each(
        F.col("seasons"), lambda s: season_number(s).isNull(), "invalid season"
    )
    bad_datasets = each(
        F.col("datasets"), lambda d: d.isNull() | ~d.isin(known), "unknown dataset"
    )
    return scopes.select("scope_id", F.inline(F.concat(lists, bad_seasons, bad_datasets)))


def expand_scope(scopes: DataFrame) -> DataFrame:
    """``scope_id, dataset, season, ordinal``: every dataset with every distinct season of its scope."""
    seasons = F.array_distinct(F.transform("seasons", season_number))
    return (
        scopes.select("scope_id", F.posexplode("datasets").alias("at", "dataset"), seasons.alias("seasons"))
        .select("scope_id", "at", "dataset", F.explode("seasons").alias("season"))
        .where(F.col("season").isNotNull())
        .select("scope_id", "dataset", "season", _ordinal(F.col("at"), F.col("season")).alias("ordinal"))
    )


def _ordinal(at: Column, season: Column) -> Column:
    return F.shiftleft(at.cast("long"), _SEASON_BITS) + season


def match_listing(listing: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """``dataset, season, name, url, size``: each asset once per alias whose pattern takes its name.

    The patterns are a short fixed list, so they are tested inside the row and the rest of the
    resolution is an equality join.
    """
    seasons = {
        dataset: F.regexp_extract("name", pattern, 1) for dataset, pattern in patterns.items()
    }
    hits = violations(
        *[
            F.when(text != "", F.struct(F.lit(ds).alias("dataset"), text.try_cast("int").alias("season")))
            for ds, text in seasons.items()
        ]
    )
    return listing.select("name", "url", "size", F.inline(hits)).select(
        "dataset", "season", "name", "url", "size"
    )


def resolve_assets(
    requests: DataFrame, listing: DataFrame, patterns: Mapping[str, str] = DATASET_PATTERNS
) -> DataFrame:
    """Each request with ``status`` and, when exactly one asset matches, its name, URL and size.

    ``status``: ``missing`` (no asset), ``ambiguous`` (several), ``unusable`` (no URL) or ``found``.
    Assets are counted per key before the join, so a key that matches very many assets is one row.
    """
    matches = (
        match_listing(listing, patterns)
        .groupBy("dataset", "season")
        .agg(F.count(F.lit(1)).alias("n_assets"), F.min(F.struct("name", "url", "size")).alias("asset"))
    )
    n = F.coalesce("n_assets", F.lit(0))
    status = (
        F.when(n == 0, "missing")
        .when(n > 1, "ambiguous")
        .when(F.coalesce("asset.url", F.lit("")) == "", "unusable")
        .otherwise("found")
    )
    single = {
        field: F.when(n == 1, F.col(f"asset.{field}")).alias(field) for field in ("name", "url", "size")
    }
    keys = ["dataset", "season"]
    found = join_lookup(requests, matches, keys, key_counts(requests, keys), spread_by="ordinal")
    return found.select(
        *requests.columns, n.alias("n_assets"), status.alias("status"), *single.values()
    )


def missing_assets(resolved: DataFrame) -> DataFrame:
    """Requests without an asset; kept as data even where missing assets are allowed."""
    return resolved.where(F.col("status") == "missing").select(
        *[c for c in ("scope_id",) if c in resolved.columns],
        "dataset",
        "season",
        F.lit(errors.ASSET_MISSING).alias("code"),
    )


def ambiguous_candidates(
    resolved: DataFrame, listing: DataFrame, patterns: Mapping[str, str] = DATASET_PATTERNS
) -> DataFrame:
    """Every candidate name of each ambiguous request, one per row."""
    keys = ["dataset", "season"]
    wanted = resolved.where(F.col("status") == "ambiguous").select(*keys).distinct()
    matches = match_listing(listing, patterns)
    marked = wanted.withColumn("is_wanted", F.lit(True))
    return (
        join_lookup(matches, marked, keys, key_counts(matches, keys), spread_by="name")
        .where("is_wanted")
        .select(*keys, "name", F.lit(errors.AMBIGUOUS_MATCH).alias("code"))
    )


def resolution_errors(resolved: DataFrame, allow_missing: bool = False) -> DataFrame:
    """``dataset, season, code`` of every request that stops the run."""
    code = (
        F.when(F.col("status") == "ambiguous", errors.AMBIGUOUS_MATCH)
        .when(F.col("status") == "unusable", errors.REF_NOT_FOUND)
        .when((F.col("status") == "missing") & ~F.lit(allow_missing), errors.ASSET_MISSING)
    )
    return resolved.select("dataset", "season", code.alias("code")).where(F.col("code").isNotNull())


def plan_assets(resolved: DataFrame, source: str, release: str) -> DataFrame:
    """Plan items of the requests that found their asset."""
    return resolved.where(F.col("status") == "found").select(
        "ordinal",
        F.concat_ws("_", "dataset", "season").alias("logical_name"),
        "url",
        F.concat_ws("/", F.lit(source), F.lit(release), "dataset", "name").alias("dest_path"),
        expected_type(F.col("name")).alias("expected_type"),
        F.col("size").cast("long").alias("expected_size_bytes"),
        F.lit(None).cast("string").alias("sha256"),
        F.col("dataset").alias("group"),
        "season",
        F.lit(False).alias("optional"),
    )


def sorted_distinct(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct().orderBy(*columns)


def expand_pairs(
    catalog: DataFrame,
    competitions: DataFrame | Sequence[int] | None = None,
    seasons: DataFrame | Sequence[int] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``competition_id, season_id``.

    Explicit ``pairs`` are taken as they are, without a look at the catalog. Otherwise the catalog is
    filtered by each side that is given: a list, or a DataFrame for sets too large for one. What a request
    asks for in vain is no row here; ``expansion_violations`` reports it.
    """
    ids = ["competition_id", "season_id"]
    if pairs is not None:
        return pairs.select(*[F.col(i).try_cast("long").alias(i) for i in ids]).dropna().distinct()
    if competitions is None and seasons is None:
        raise ValueError("give pairs, competitions or seasons")
    rows = catalog.select(*[F.col(i).try_cast("long").alias(i) for i in ids]).dropna()
    for name, wanted in zip(ids, (competitions, seasons)):
        if isinstance(wanted, DataFrame):
            rows = rows.join(wanted.select(F.col(name).cast("long").alias(name)), name, "left_semi")
        elif wanted is not None:
            rows = rows.where(F.col(name).isin(list(wanted)))
    return rows.select(*ids).distinct()


def pair_violations(pairs: DataFrame) -> DataFrame:
    """Explicit pairs that lack a usable id."""
    broken = F.col("competition_id").try_cast("long").isNull() | F.col("season_id").try_cast("long").isNull()
    return pairs.where(broken).select(
        F.lit(errors.SCOPE_INVALID).alias("code"),
        F.lit("a pair needs competition_id and season_id").alias("message"),
        F.to_json(F.struct("competition_id", "season_id")).alias("value"),
    )


def expansion_violations(expanded: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``code, message, value`` of a request: its malformed pairs, or that it matches nothing at all."""
    nothing = expanded.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(errors.SCOPE_INVALID).alias("code"),
        F.lit("no competition and season match the request").alias("message"),
        F.lit(None).cast("string").alias("value"),
    )
    return nothing if pairs is None else pair_violations(pairs).unionByName(nothing)


def raw_url(base: str, owner: str, repo: str, ref: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.lit(owner), F.lit(repo), F.lit(ref), path)


def _json_item(
    logical_name: Column, path: Column, group: Column, optional: Column, *, source: str, owner: str,
    repo: str, ref: str, base: str,
) -> list[Column]:
    return [
        logical_name.alias("logical_name"),
        raw_url(base, owner, repo, ref, F.concat(F.lit("data/"), path)).alias("url"),
        F.concat_ws("/", F.lit(source), F.lit(ref), path).alias("dest_path"),
        F.lit("json").alias("expected_type"),
        F.lit(None).cast("long").alias("expected_size_bytes"),
        F.lit(None).cast("string").alias("sha256"),
        group.alias("group"),
        optional.alias("optional"),
    ]


def plan_catalog(names: DataFrame, **location: str) -> DataFrame:
    """The catalog file itself, one per ``name``."""
    return names.select(
        *_json_item(
            F.col("name"), F.concat("name", F.lit(".json")), F.col("name"), F.lit(False), **location
        )
    )


def plan_pair_files(pairs: DataFrame, **location: str) -> DataFrame:
    """One match file per pair; ``location`` is ``source, owner, repo, ref, base``."""
    return pairs.select(
        *_json_item(
            F.concat_ws("_", F.lit("matches"), "competition_id", "season_id"),
            F.concat(F.concat_ws("/", F.lit("matches"), "competition_id", "season_id"), F.lit(".json")),
            F.lit("matches"),
            F.lit(False),
            **location,
        ),
        "competition_id",
        "season_id",
    )


def extract_ids(matches: DataFrame) -> DataFrame:
    """Distinct ``match_id``, taken from ``id`` in rows that have none."""
    ids = [F.col(c).try_cast("long") for c in ("match_id", "id") if c in matches.columns]
    return (
        matches.select(F.coalesce(*ids).alias("match_id"))
        .where(F.col("match_id").isNotNull())
        .distinct()
    )


def artifact_fanout(match_ids: DataFrame, **location: str) -> DataFrame:
    """Three files per match: two required, one optional."""
    kinds = F.array(
        *[
            F.struct(F.lit(g).alias("kind"), F.lit(p).alias("prefix"), F.lit(o).alias("is_optional"))
            for g, p, o in MATCH_ARTIFACTS
        ]
    )
    return match_ids.select("match_id", F.inline(kinds)).select(
        *_json_item(
            F.concat_ws("_", "prefix", "match_id"),
            F.concat(F.concat_ws("/", "kind", "match_id"), F.lit(".json")),
            F.col("kind"),
            F.col("is_optional"),
            **location,
        ),
        "match_id",
    )
