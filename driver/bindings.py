"""Inputs of the operators, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.operators.profile import schema_fingerprint
from driftspark.plans.training import build_dataset

GAME_STATS = ["items", "returns", "disc"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per order with line items: open lines are the home side, fulfilled lines the away side.

    Lines are summed per order before anything is joined.
    """
    lines = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    cents = F.round(F.col("l_discount") * 100).cast("long")
    sums = []
    for side, status in (("home", "O"), ("away", "F")):
        mine = F.col("l_linestatus") == status
        sums += [
            F.sum(F.when(mine, F.col("l_quantity").cast("long")).otherwise(0)).alias(f"{side}_score"),
            F.count_if(mine).alias(f"{side}_items"),
            F.count_if(mine & returned).alias(f"{side}_returns"),
            F.sum(F.when(mine, cents).otherwise(0)).alias(f"{side}_disc"),
        ]
    per_order = lines.groupBy("l_orderkey").agg(*sums, F.min("l_suppkey").alias("first_suppkey"))

    def nations(owner: str, key: str, nation_key: str, name: str) -> DataFrame:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias(name))
        return (
            table(spark, sf_dir, owner)
            .join(nation, F.col(nation_key) == F.col("n_nationkey"))
            .select(key, name)
        )

    orders = table(spark, sf_dir, "orders")
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(nations("customer", "c_custkey", "c_nationkey", "home_team"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations("supplier", "s_suppkey", "s_nationkey", "away_team"), F.col("first_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("game_id"),
            F.date_format("o_orderdate", "yyyy").alias("season"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            "home_team",
            "away_team",
            *[f"{side}_{stat}" for stat in ("score", *GAME_STATS) for side in ("home", "away")],
        )
    )


def split_games(spark: SparkSession, sf_dir: str, target: str = "win", drop: tuple = ()) -> DataFrame:
    return build_dataset(games(spark, sf_dir), GAME_STATS, target, drop)


# --- metrics -------------------------------------------------------------------------------------


def quality_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the rule "long text is good text"."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return (
        table(spark, sf_dir, "labels")
        .join(documents, "doc_id")
        .select(
            "lang",
            F.col("quality").alias("target"),
            (F.col("n_chars") > 1000).cast("int").alias("prediction"),
        )
    )


# --- profiling -----------------------------------------------------------------------------------


def events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is null for errors and NaN for sign-ups, with a truth value."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(kind == "signup", F.lit(float("nan"))).when(kind != "error", F.col("value")).alias("value"),
        F.when(kind != "view", kind).alias("kind"),
        (kind == "purchase").alias("paid"),
    )


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes and prices as text, some of them names instead of numbers."""
    named = F.col("p_size") % 3 == 0
    return table(spark, sf_dir, "part").select(
        F.when(named, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("size_text"),
        F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("price_text"),
    )


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a CSV reader sees them: text only, with null tokens."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.when(F.col("event_type") == "error", "NA")
        .otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
        .alias("value"),
        F.when(F.col("event_type") == "signup", "n/a").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "purchase", "True").otherwise("False").alias("paid"),
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per event."""
    return table(spark, sf_dir, "events").select(
        F.concat(
            F.lit('{"event_id":'), F.col("event_id").cast("string"),
            F.lit(',"user":{"id":'), F.col("user_id").cast("string"),
            F.lit(',"kind":"'), F.col("event_type"),
            F.lit('"},"props":'), F.col("props"),
            F.lit(',"tags":["'), F.col("event_type"), F.lit('","all"]}'),
        ).alias("document")
    )


def event_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scope per event: keys and lists out of order, a nested object."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit('{"seasons": ['), F.col("user_id").cast("string"), F.lit(", "),
            F.col("event_id").cast("string"), F.lit(', 7], "datasets": ["'), F.col("event_type"),
            F.lit('", "all", "é"], "extra": '), F.col("props"), F.lit("}"),
        ).alias("scope"),
    )


# --- drift ---------------------------------------------------------------------------------------


def schema_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order year and status; the year decides which columns it has."""
    year = F.col("ordinal")
    columns = [
        ("o_orderkey", F.lit("int"), F.lit(True)),
        ("o_custkey", F.when(year % 4 == 0, "string").otherwise("int"), F.lit(True)),
        ("o_totalprice", F.lit("float"), year % 3 != 0),
        ("o_orderdate", F.lit("object"), F.lit(True)),
        ("o_orderpriority", F.lit("string"), year % 2 == 0),
        ("o_channel", F.lit("string"), year >= 2000),
    ]
    present = F.filter(
        F.array(
            *[
                F.when(kept, F.struct(F.lit(name).alias("name"), kind.alias("kind")))
                for name, kind, kept in columns
            ]
        ),
        lambda c: c.isNotNull(),
    )
    return (
        table(spark, sf_dir, "orders")
        .select(F.year("o_orderdate").cast("long").alias("ordinal"), F.col("o_orderstatus").alias("group"))
        .distinct()
        .withColumn("present", present)
        .select(
            "group",
            "ordinal",
            F.concat_ws("_", F.lit("orders"), "ordinal", "group").alias("table_name"),
            F.col("present.name").alias("columns"),
            F.map_from_entries("present").alias("dtypes"),
        )
        .withColumn("schema_fingerprint", schema_fingerprint(F.col("columns"), F.col("dtypes")))
    )


# --- catalog -------------------------------------------------------------------------------------

LANGUAGES = ["de", "en", "es", "fr"]
PAGE_PATTERNS = {lang: rf"^https?://[^/]+/{lang}/(\d+)" for lang in LANGUAGES}
LOCATION = {
    "source": "open-matches",
    "owner": "acme",
    "repo": "data",
    "ref": "0123456789abcdef0123456789abcdef01234567",
    "base": "https://files.example.org",
}


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("name"), "url", F.octet_length("html").cast("long").alias("size")
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number found in a page URL, wanted in every language."""
    season = F.regexp_extract("url", r"^https?://[^/]+/[a-z]{2}/(\d+)", 1).cast("int")
    languages = F.array(*[F.lit(lang) for lang in LANGUAGES])
    return (
        table(spark, sf_dir, "pages")
        .select(season.alias("season"))
        .distinct()
        .select(F.posexplode(languages).alias("at", "dataset"), "season")
        .select("dataset", "season", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("season")).alias("ordinal"))
    )


def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scope per page as JSON; some lack a list, some hold a bad season or dataset."""
    page = F.col("page_id")
    dataset = F.when(page % 3 == 0, "xx").otherwise(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1))
    season = F.when(page % 5 == 0, "abc").otherwise(F.regexp_extract("url", r"/(\d+)", 1))
    datasets = F.when(page % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), dataset, F.lit('"]')))
    seasons = F.concat(F.lit('["'), season, F.lit('", 2020]'))
    return table(spark, sf_dir, "pages").select(
        page.alias("scope_id"),
        F.when(page % 11 == 0, F.concat(F.lit('{"datasets":'), datasets, F.lit("}")))
        .otherwise(F.concat(F.lit('{"datasets":'), datasets, F.lit(',"seasons":'), seasons, F.lit("}")))
        .alias("scope"),
    )


def competition_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation of the customer and year of the order."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").cast("long").alias("competition_id"),
            F.year("o_orderdate").cast("long").alias("season_id"),
        )
    )


def european_competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where(F.col("r_name") == "EUROPE")
    return (
        table(spark, sf_dir, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
        .select(F.col("n_nationkey").alias("competition_id"))
    )


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: some carry the number of their predecessor in the older field."""
    key = F.col("o_orderkey")
    old = key % 3 == 0
    return table(spark, sf_dir, "orders").select(
        F.when(~old, key).alias("match_id"), F.when(old & (key > 0), key - 1).alias("id")
    )


# --- ledger --------------------------------------------------------------------------------------


def _url_has(part: str) -> Column:
    return F.col("url").contains(part)


def _page_path() -> Column:
    """Pages of the spam host lie outside the base folder."""
    own = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return F.when(_url_has("spam"), F.concat(F.lit("../"), own)).otherwise(own)


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per page; second pages repeat the path of the page before, blogs and mobile are optional."""
    page = F.col("page_id")
    before = F.concat(F.lit("pages/"), (page - 1).cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(
        page.alias("ordinal"),
        F.concat(F.lit("page_"), page.cast("string")).alias("logical_name"),
        F.when(_url_has("page=2"), before).otherwise(_page_path()).alias("dest_path"),
        F.when(_url_has("//m."), "three-sixty").otherwise("pages").alias("group"),
        (_url_has("//m.") | _url_has("//blog.")).alias("optional"),
    )


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hashes; pages with a fragment have none, pages from a feed a wrong one."""
    return (
        table(spark, sf_dir, "pages")
        .where(~_url_has("#"))
        .select(
            _page_path().alias("dest_path"),
            F.when(_url_has("utm_"), F.sha2(F.reverse("html"), 256)).otherwise(F.sha2("html", 256)).alias("sha256"),
            F.octet_length("html").cast("long").alias("size_bytes"),
            F.lit("2024-01-01T00:00:00Z").alias("mtime_utc"),
        )
    )


def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with the hash of their content; pages that end in ``.html`` are lost."""
    return (
        table(spark, sf_dir, "pages")
        .where(~_url_has(".html"))
        .select(
            _page_path().alias("dest_path"),
            F.sha2("html", 256).alias("sha256"),
            F.octet_length("html").cast("long").alias("size_bytes"),
        )
    )


def page_new_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh hashes of the pages that were wrong or absent in the ledger."""
    return (
        table(spark, sf_dir, "pages")
        .where(_url_has("#") | _url_has("utm_"))
        .select(
            _page_path().alias("dest_path"),
            F.sha2("html", 256).alias("sha256"),
            F.octet_length("html").cast("long").alias("size_bytes"),
            F.lit("2024-02-01T00:00:00Z").alias("mtime_utc"),
        )
    )


# --- runs ----------------------------------------------------------------------------------------


def _run_id() -> Column:
    return F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of plan items; a run is one user's day."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        _run_id().alias("run_id"),
        "event_id",
        F.when(F.col("event_id") % 4 == 0, "three-sixty").otherwise("events").alias("group"),
        (kind == "signup").alias("optional"),
        F.when(kind == "error", "E_TIMEOUT").when(kind == "signup", "E_HTTP_404").alias("error_code"),
        kind.isin("view", "click").alias("skipped"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user and day with its source, reference and scope."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    user = F.col("user_id")
    source = F.when(user % 3 == 0, "statsbomb-open-data").when(user % 3 == 1, "nflverse").otherwise("other")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", _run_id().alias("run_id"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select(
            "run_id",
            F.date_format("first", stamp).alias("started_at_utc"),
            F.date_format("last", stamp).alias("finished_at_utc"),
            source.alias("source"),
            F.when(user % 2 == 0, F.left(F.sha2("run_id", 256), F.lit(40))).otherwise("main").alias("source_ref"),
            F.left(F.sha2("run_id", 256), F.lit(40)).alias("resolved_ref"),
            F.concat(F.lit('{"user":'), user.cast("string"), F.lit("}")).alias("requested_scope"),
            (user % 5 == 0).alias("require_360"),
        )
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"),
        F.when(kind == "view", "resolve").when(kind == "signup", "schema").otherwise("download").alias("phase"),
        kind.alias("msg"),
        F.when(kind == "error", "error").when(kind == "signup", "warn").alias("level"),
    )


def _parquet_bytes(rows):
    import io

    import pandas as pd

    out = io.BytesIO()
    rows.drop(columns=["file", "priority_kept"]).drop(columns=[] if rows["priority_kept"].iloc[0] else ["o_orderpriority"]).to_parquet(
        out, index=False
    )
    return pd.DataFrame({"dest_path": ["parquet/" + rows["file"].iloc[0] + ".parquet"], "content": [out.getvalue()]})


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dest_path, content``: orders of one year and 20,000 keys as a CSV, a JSON and a Parquet file each.

    Files of even years lack the priority, which is null for pending orders elsewhere.
    """
    year = F.year("o_orderdate")
    file = F.concat_ws("_", year.cast("string"), F.floor(F.col("o_orderkey") / 20_000).cast("string"))
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(
        file.alias("file"), (year % 2 == 1).alias("priority_kept"), "o_orderkey", priority.alias("o_orderpriority"),
        "o_orderstatus", "o_totalprice",
    )
    kept = F.col("priority_kept")
    names = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    line = F.when(kept, F.concat_ws(",", *cells)).otherwise(F.concat_ws(",", *[c for c, n in zip(cells, names) if n != "o_orderpriority"]))
    head = F.when(kept, ",".join(names)).otherwise(",".join(n for n in names if n != "o_orderpriority"))
    document = F.to_json(F.struct("o_orderkey", F.when(kept, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus", "o_totalprice"))
    texts = rows.groupBy("file", "priority_kept").agg(
        F.array_join(F.collect_list(line), "\n").alias("lines"), F.array_join(F.collect_list(document), ",").alias("documents")
    )
    csv = texts.select(F.concat(F.lit("csv/"), "file", F.lit(".csv")).alias("dest_path"), F.concat_ws("\n", head, "lines").cast("binary").alias("content"))
    json = texts.select(
        F.concat(F.lit("json/"), "file", F.lit(".json")).alias("dest_path"), F.concat(F.lit("["), "documents", F.lit("]")).cast("binary").alias("content")
    )
    parquet = rows.groupBy("file").applyInPandas(_parquet_bytes, "dest_path STRING, content BINARY")
    return csv.union(json).union(parquet)
