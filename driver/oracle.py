"""The same results in SQL, written independently of the operators."""

from __future__ import annotations

import re

from driver.bindings import LANGUAGES, LOCATION

GAMES = """
lines AS (
  SELECT l_orderkey,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS home_score,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS away_score,
    count(*) FILTER (WHERE l_linestatus = 'O') AS home_items,
    count(*) FILTER (WHERE l_linestatus = 'F') AS away_items,
    count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS home_returns,
    count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS away_returns,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS home_disc,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS away_disc,
    min(l_suppkey) AS suppkey
  FROM lineitem GROUP BY l_orderkey
),
games AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS game_id, strftime(o_orderdate, '%Y') AS season,
    strftime(o_orderdate, '%Y-%m-%d') AS date, hn.n_name AS home_team, an.n_name AS away_team,
    home_score, away_score, home_items, away_items, home_returns, away_returns, home_disc, away_disc
  FROM lines JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation hn ON hn.n_nationkey = c_nationkey
  JOIN supplier ON s_suppkey = suppkey JOIN nation an ON an.n_nationkey = s_nationkey
)"""

SIDES = GAMES + """,
sides AS (
  SELECT game_id, season, date, home_team AS team, away_team AS opponent, 1 AS is_home,
    home_items AS items, home_returns AS returns, home_disc AS disc,
    away_items AS opp_items, away_returns AS opp_returns, away_disc AS opp_disc,
    CAST(home_score > away_score AS INTEGER) AS win, home_score - away_score AS score_diff
  FROM games
  UNION ALL
  SELECT game_id, season, date, away_team, home_team, 0, away_items, away_returns, away_disc,
    home_items, home_returns, home_disc, CAST(away_score > home_score AS INTEGER), away_score - home_score
  FROM games
)"""

# 0.6 + 0.2 is written as the double sum it is.
SPLIT = SIDES + """,
placed AS (
  SELECT *, row_number() OVER (ORDER BY date, game_id, is_home DESC) - 1 AS pos, count(*) OVER () AS total FROM sides
),
split AS (
  SELECT *, CASE WHEN pos < CAST(floor(total * CAST(0.6 AS DOUBLE)) AS BIGINT) THEN 'train'
    WHEN pos < CAST(floor(total * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM placed
)"""

SIDE_COLUMNS = "game_id, season, date, team, opponent, is_home, items, returns, disc, opp_items, opp_returns, opp_disc"

BINARY = """n,
  CAST(tp + tn AS DOUBLE) / n AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1"""

CONFUSION = """count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn"""

SHIFT = SPLIT + f""",
guessed AS (SELECT season, win AS y, is_home AS p FROM split WHERE split = 'test'),
segments AS (
  SELECT 'overall' AS segment_kind, 'overall' AS segment, {CONFUSION} FROM guessed
  UNION ALL
  SELECT 'season', season, {CONFUSION} FROM guessed GROUP BY season
),
shift AS (SELECT segment_kind, segment, {BINARY} FROM segments)"""

PREDICTED = SPLIT + """,
line AS (SELECT regr_slope(score_diff, items) AS a, regr_intercept(score_diff, items) AS b FROM split WHERE split = 'train'),
predicted AS (SELECT split, season, CAST(score_diff AS DOUBLE) AS y, a * items + b AS p FROM split, line)"""

# Ridge with penalty 1 on centred sums; a dropped feature has weight 0.
RIDGE = SPLIT + """,
means AS (
  SELECT count(*) AS n, avg(is_home) AS mh, avg(items) AS mi, avg(score_diff) AS my FROM split WHERE split = 'train'
),
sums AS (
  SELECT mh, mi, my, 1 + sum((is_home - mh) ** 2) AS hh, 1 + sum((items - mi) ** 2) AS ii,
    sum((is_home - mh) * (items - mi)) AS hi, sum((is_home - mh) * (score_diff - my)) AS hy,
    sum((items - mi) * (score_diff - my)) AS iy
  FROM split, means WHERE split = 'train' GROUP BY mh, mi, my
),
weights AS (
  SELECT '' AS dropped, (hy * ii - iy * hi) / (hh * ii - hi * hi) AS wh, (iy * hh - hy * hi) / (hh * ii - hi * hi) AS wi, mh, mi, my FROM sums
  UNION ALL SELECT 'items', hy / hh, 0, mh, mi, my FROM sums
  UNION ALL SELECT 'is_home', 0, iy / ii, mh, mi, my FROM sums
),
ridge AS (
  SELECT dropped, split, season, CAST(score_diff AS DOUBLE) AS y, my + wh * (is_home - mh) + wi * (items - mi) AS p
  FROM split, weights
),
ridge_scores AS (
  SELECT dropped, CASE WHEN grouping(season) = 1 THEN 'overall' ELSE 'season' END AS segment_kind, coalesce(season, 'overall') AS segment,
    avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2
  FROM ridge WHERE split = 'test' GROUP BY GROUPING SETS ((dropped, season), (dropped))
),
ridge_long AS (
  SELECT dropped, segment_kind, segment, 'mse' AS metric, mse AS value FROM ridge_scores
  UNION ALL SELECT dropped, segment_kind, segment, 'mae', mae FROM ridge_scores
  UNION ALL SELECT dropped, segment_kind, segment, 'r2', r2 FROM ridge_scores
)"""

FEATURES = ["is_home", "items", "returns", "disc", "opp_items", "opp_returns", "opp_disc"]


def _ridge_all(dropped: list[str]) -> str:
    """Ridge with penalty 1 over all features, next to those without one of ``dropped``.

    Gauss-Jordan elimination on centred sums in cells (i, j); the last column is the right side. A dropped feature
    has the row and column of the unit matrix, so its weight is 0.
    """
    n = len(FEATURES)
    names = [*FEATURES, "score_diff"]
    sums = ", ".join(
        f"sum(({names[i]} - m{i}) * ({names[j]} - m{j})){' + 1' if i == j else ''} AS s{i}_{j}"
        for i in range(n) for j in range(i, n + 1)
    )
    cells = "\n  UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, s{min(i, j)}_{max(i, j)} AS v FROM sums" for i in range(n) for j in range(n + 1)
    )
    variants = ", ".join(f"('{name}', {FEATURES.index(name) if name else -1})" for name in ["", *dropped])
    steps = "".join(
        f""",
m{k + 1} AS (
  SELECT a.dropped, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
  FROM m{k} a JOIN m{k} p ON p.dropped = a.dropped AND p.i = {k} AND p.j = {k}
  JOIN m{k} r ON r.dropped = a.dropped AND r.i = {k} AND r.j = a.j
  JOIN m{k} c ON c.dropped = a.dropped AND c.i = a.i AND c.j = {k}
)"""
        for k in range(n)
    )
    weights = ", ".join(f"max(v) FILTER (i = {k}) AS w{k}" for k in range(n))
    return SPLIT + f""",
means AS (SELECT {", ".join(f"avg({name}) AS m{k}" for k, name in enumerate(names))} FROM split WHERE split = 'train'),
sums AS (SELECT {sums} FROM split, means WHERE split = 'train'),
cells AS (
  {cells}
),
m0 AS (
  SELECT dropped, i, j, CASE WHEN i = gone OR j = gone THEN CAST(i = j AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS v
  FROM cells, (VALUES {variants}) d(dropped, gone)
){steps},
weights AS (SELECT dropped, {weights} FROM m{n} WHERE j = {n} GROUP BY dropped),
ridge AS (
  SELECT dropped, split, season, CAST(score_diff AS DOUBLE) AS y,
    m{n} + {" + ".join(f"w{k} * ({name} - m{k})" for k, name in enumerate(FEATURES))} AS p
  FROM split, means, weights
),""" + RIDGE[RIDGE.index("\nridge_scores AS (") :]


# Newton steps for the penalized likelihood; rows with the same feature value share a term.
LOGIT = SPLIT + f""",
cells AS (SELECT CAST(items AS DOUBLE) AS x, CAST(sum(win) AS DOUBLE) AS wins, CAST(count(*) AS DOUBLE) AS n FROM split WHERE split = 'train' GROUP BY items),
newton(step, w, b) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, w - (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb), b - (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb)
  FROM (
    SELECT step, w, b, w + sum((n * p - wins) * x) AS gw, sum(n * p - wins) AS gb,
      1 + sum(n * p * (1 - p) * x * x) AS hww, sum(n * p * (1 - p) * x) AS hwb, sum(n * p * (1 - p)) AS hbb
    FROM (SELECT step, w, b, x, wins, n, 1 / (1 + exp(-(w * x + b))) AS p FROM newton, cells WHERE step < 20)
    GROUP BY step, w, b
  )
),
logit AS (
  SELECT season, win AS y, CAST(w * items + b > 0 AS INTEGER) AS p FROM split, (SELECT * FROM newton WHERE step = 20) WHERE split = 'test'
),
logit_counts AS (
  SELECT 'overall' AS segment_kind, 'overall' AS segment, {CONFUSION} FROM logit
  UNION ALL SELECT 'season', season, {CONFUSION} FROM logit GROUP BY season
),
logit_shift AS (SELECT segment_kind, segment, {BINARY} FROM logit_counts)"""


def _logit_all(steps: int = 12) -> str:
    """The same over all features: a step solves the normal equations by elimination, one nested query a column."""
    n = len(FEATURES) + 1  # the last is the intercept, which has no penalty
    names = [*FEATURES, "1"]
    state = ", ".join(["step", *[f"w{i}" for i in range(n)]])
    margin = " + ".join(f"w{i} * x{i}" for i in range(n))
    hessian = [
        f"sum(p * (1 - p) * x{i} * x{j}){' + 1' if i == j < n - 1 else ''} AS a{i}_{j}" for i in range(n) for j in range(i, n)
    ]
    gradient = [f"sum((p - y) * x{i}){f' + w{i}' if i < n - 1 else ''} AS g{i}" for i in range(n)]
    query = f"""SELECT {state}, {", ".join(hessian + gradient)} FROM (
    SELECT {state}, y, {", ".join(f"x{i}" for i in range(n))}, 1 / (1 + exp(-({margin}))) AS p FROM newton, train WHERE step < {steps}
  ) GROUP BY {state}"""
    for k in range(n - 1):
        changed = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, n) for j in range(i, n)]
        changed += [f"g{i} - a{k}_{i} * g{k} / a{k}_{k} AS g{i}" for i in range(k + 1, n)]
        query = f"SELECT * REPLACE ({', '.join(changed)}) FROM (\n  {query})"
    for k in reversed(range(n)):
        known = "".join(f" - a{k}_{j} * d{j}" for j in range(k + 1, n))
        query = f"SELECT *, (g{k}{known}) / a{k}_{k} AS d{k} FROM (\n  {query})"
    values = " + ".join(f"w{i} * CAST({name} AS DOUBLE)" for i, name in enumerate(names))
    return SPLIT + f""",
train AS (SELECT {", ".join(f"CAST({name} AS DOUBLE) AS x{i}" for i, name in enumerate(names))}, win AS y FROM split WHERE split = 'train'),
newton({state}) AS (
  SELECT 0, {", ".join(["CAST(0 AS DOUBLE)"] * n)}
  UNION ALL
  SELECT step + 1, {", ".join(f"w{i} - d{i}" for i in range(n))} FROM (
  {query})
),
logit AS (
  SELECT season, win AS y, CAST({values} > 0 AS INTEGER) AS p FROM split, (SELECT * FROM newton WHERE step = {steps}) WHERE split = 'test'
),""" + LOGIT[LOGIT.index("\nlogit_counts AS (") :]


SCORES = """count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2"""


def _profile(table: str, columns: list[tuple[str, str]], name: str | None = None) -> str:
    """One row per column; null and NaN are missing."""
    rows = []
    for i, (column, kind) in enumerate(columns):
        numeric = kind in ("int", "float")
        missing = f"{column} IS NULL"
        if kind == "float":
            missing += f" OR isnan({column})"
        value = f"CASE WHEN NOT ({missing}) THEN CAST({column} AS DOUBLE) END"
        stats = (
            f"min({value}) AS min_value, max({value}) AS max_value, "
            f"round(avg({value}), 6) AS mean_value, round(stddev_pop({value}), 6) AS std_value"
            if numeric
            else "CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, "
            "CAST(NULL AS DOUBLE) AS mean_value, CAST(NULL AS DOUBLE) AS std_value"
        )
        rows.append(
            f"SELECT '{name or table}' AS table_name, {i} AS position, '{column}' AS column_name, "
            f"'{kind}' AS type_class, count(*) AS n_rows, "
            f"round(avg(CASE WHEN {missing} THEN 1.0 ELSE 0.0 END), 6) AS null_fraction, {stats} FROM {table}"
        )
    return "\nUNION ALL\n".join(rows)


TABLES = {
    "events": [("event_id", "int"), ("ts", "object"), ("user_id", "int"), ("event_type", "string"),
               ("value", "float"), ("props", "string")],
    "customer": [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "float"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "float")],
    "documents": [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "int")],
}

GAPS = """gaps AS (
  SELECT event_id, user_id,
    CASE WHEN event_type = 'signup' THEN CAST('nan' AS DOUBLE) WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN event_type <> 'view' THEN event_type END AS kind, event_type = 'purchase' AS paid
  FROM events
)"""
GAP_COLUMNS = [("event_id", "int"), ("user_id", "int"), ("value", "float"), ("kind", "string"), ("paid", "bool")]


def _topk(table: str, source: str, columns: dict[str, str]) -> str:
    """Ten most frequent; ties by the digest of the value."""
    rows = []
    for column, value in columns.items():
        rows.append(
            f"""SELECT '{table}' AS table_name, '{column}' AS column_name, value, n, position FROM (
  SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, sha256(value)) AS INTEGER) AS position
  FROM (SELECT {value} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)
) WHERE position <= 10"""
        )
    return "\nUNION ALL\n".join(rows)


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _coerced(column: str) -> str:
    value = f"CASE WHEN regexp_matches({column}, '{NUMBER}') THEN CAST(trim({column}) AS DOUBLE) END"
    return (
        f"SELECT '{column}' AS column_name, count(*) AS n_rows, count({value}) AS n_numeric, "
        f"min({value}) AS min_value, max({value}) AS max_value, round(avg({value}), 6) AS mean_value, "
        f"round(stddev_pop({value}), 6) AS std_value FROM texts"
    )


ENTRIES = """entry_keys AS (
  SELECT DISTINCT year(o_orderdate) AS ordinal, o_orderstatus AS grp FROM orders
),
entry_columns AS (
  SELECT grp, ordinal, c.name, c.kind, c.pos FROM entry_keys, LATERAL (VALUES
    (1, 'o_orderkey', 'int', true),
    (2, 'o_custkey', CASE WHEN ordinal % 4 = 0 THEN 'string' ELSE 'int' END, true),
    (3, 'o_totalprice', 'float', ordinal % 3 <> 0),
    (4, 'o_orderdate', 'object', true),
    (5, 'o_orderpriority', 'string', ordinal % 2 = 0),
    (6, 'o_channel', 'string', ordinal >= 2000)) c(pos, name, kind, kept)
  WHERE c.kept
),
entries AS (
  SELECT grp, ordinal, 'orders_' || ordinal || '_' || grp AS table_name,
    string_agg(name, ',' ORDER BY pos) AS columns,
    '{"columns":[' || string_agg('"' || name || '"', ',' ORDER BY pos) || '],"dtypes":{'
      || string_agg('"' || name || '":"' || kind || '"', ',' ORDER BY name) || '}}' AS payload
  FROM entry_columns GROUP BY grp, ordinal
),
firsts AS (SELECT grp, min(ordinal) AS ordinal FROM entry_keys GROUP BY grp),
diffs AS (
  SELECT e.grp, b.table_name AS from_table, e.table_name AS to_table,
    coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM entry_columns c WHERE c.grp = e.grp AND c.ordinal = e.ordinal
      AND name NOT IN (SELECT name FROM entry_columns x WHERE x.grp = f.grp AND x.ordinal = f.ordinal)), '') AS added_columns,
    coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM entry_columns c WHERE c.grp = f.grp AND c.ordinal = f.ordinal
      AND name NOT IN (SELECT name FROM entry_columns x WHERE x.grp = e.grp AND x.ordinal = e.ordinal)), '') AS removed_columns
  FROM entries e JOIN firsts f ON f.grp = e.grp JOIN entries b ON b.grp = f.grp AND b.ordinal = f.ordinal
  WHERE e.ordinal <> f.ordinal
),
changed AS (SELECT * FROM diffs WHERE added_columns <> '' OR removed_columns <> '')"""

DOCUMENT = """'{"event_id":' || event_id || ',"props":' || props || ',"tags":["' || event_type || '","all"],"user":{"id":' || user_id
  || ',"kind":"' || event_type || '"}}'"""

# Lists in the order of their elements' JSON text.
NORMALIZED = """'{"datasets":[' || array_to_string(list_sort(['"' || event_type || '"', '"all"', '"é"']), ',')
  || '],"extra":{"k":' || json_extract_string(props, '$.k') || '},"seasons":['
  || array_to_string(list_sort([CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), '7']), ',') || ']}'"""

REQUESTS = f"""urls AS (
  SELECT url, html, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS lang,
    CAST(regexp_extract(url, '^https?://[^/]+/[a-z]{{2}}/(\\d+)', 1) AS INTEGER) AS season FROM pages
),
requests AS (
  SELECT d.dataset, s.season, CAST(d.pos AS BIGINT) * 4294967296 + s.season AS ordinal
  FROM (SELECT DISTINCT season FROM urls) s,
    (VALUES {', '.join(f"({i}, '{lang}')" for i, lang in enumerate(LANGUAGES))}) d(pos, dataset)
),
resolved AS (
  SELECT r.dataset, r.season, r.ordinal, count(url) AS n_assets,
    CASE count(url) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status,
    CASE WHEN count(url) = 1 THEN min(url) END AS name, CASE WHEN count(url) = 1 THEN min(url) END AS url,
    CASE WHEN count(url) = 1 THEN CAST(min(strlen(html)) AS BIGINT) END AS size
  FROM requests r LEFT JOIN urls u ON u.lang = r.dataset AND u.season = r.season GROUP BY ALL
)"""

SCOPES = """scopes AS (
  SELECT page_id AS scope_id,
    CASE WHEN page_id % 7 = 0 THEN [] WHEN page_id % 3 = 0 THEN ['xx']
      ELSE [regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)] END AS datasets,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 5 = 0 THEN ['abc', '2020']
      ELSE [regexp_extract(url, '/(\\d+)', 1), '2020'] END AS seasons
  FROM pages
)"""

PAIRS = """pairs AS (
  SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS competition_id, year(o_orderdate) AS season_id
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'EUROPE' AND year(o_orderdate) IN (1996, 1997, 1998)
)"""

IDS = """ids AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE o_orderkey - 1 END AS match_id
  FROM orders WHERE o_orderkey > 0
)"""

ROOT = f"{LOCATION['base']}/{LOCATION['owner']}/{LOCATION['repo']}/{LOCATION['ref']}/data/"
DEST = f"{LOCATION['source']}/{LOCATION['ref']}/"

FILES = """own AS (
  SELECT *, CASE WHEN contains(url, 'spam') THEN '../pages/' ELSE 'pages/' END || page_id || '.html' AS path FROM pages
),
plan AS (
  SELECT page_id AS ordinal, 'page_' || page_id AS logical_name,
    CASE WHEN contains(url, 'page=2') THEN 'pages/' || (page_id - 1) || '.html' ELSE path END AS dest_path,
    (contains(url, '//blog.')) AS optional FROM own
),
ledger AS (
  SELECT path AS dest_path, sha256(CASE WHEN contains(url, 'utm_') THEN reverse(html) ELSE html END) AS sha256,
    strlen(html) AS size_bytes FROM own WHERE NOT contains(url, '#')
),
stored AS (SELECT path AS dest_path, sha256(html) AS sha256 FROM own WHERE NOT contains(url, '.html')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dest_path ORDER BY ordinal) AS rn,
    first_value(logical_name) OVER (PARTITION BY dest_path ORDER BY ordinal) AS first_name FROM plan
),
firsts AS (SELECT * FROM ranked WHERE rn = 1),
required AS (
  SELECT f.*, l.sha256 AS expected, s.sha256 AS actual, l.dest_path IS NOT NULL AS listed, s.dest_path IS NOT NULL AS here
  FROM firsts f LEFT JOIN ledger l USING (dest_path) LEFT JOIN stored s USING (dest_path) WHERE NOT f.optional
),
required_errors AS (
  SELECT 'E_UNSAFE_DEST_PATH' AS code, 'unsafe destination path' AS message, logical_name, dest_path FROM required WHERE dest_path LIKE '../%'
  UNION ALL
  SELECT 'E_REQUIRED_ASSET_MISSING', 'required asset missing', logical_name, dest_path FROM required WHERE dest_path NOT LIKE '../%' AND NOT here
  UNION ALL
  SELECT 'E_CHECKSUM_RECORD_MISSING', 'checksum record missing for required asset', logical_name, dest_path FROM required WHERE dest_path NOT LIKE '../%' AND NOT listed
  UNION ALL
  SELECT 'E_CHECKSUM_MISMATCH', 'checksum mismatch', logical_name, dest_path FROM required WHERE dest_path NOT LIKE '../%' AND listed AND here AND expected <> actual
),
swept AS (
  SELECT l.dest_path, l.sha256 AS expected, s.sha256 AS actual, f.logical_name
  FROM ledger l LEFT JOIN stored s USING (dest_path) LEFT JOIN firsts f USING (dest_path)
),
sweep_errors AS (
  SELECT 'E_UNSAFE_DEST_PATH' AS code, 'unsafe destination path' AS message, logical_name, dest_path FROM swept WHERE dest_path LIKE '../%'
  UNION ALL
  SELECT 'E_FILE_MISSING', 'stored file missing', logical_name, dest_path FROM swept WHERE dest_path NOT LIKE '../%' AND actual IS NULL
  UNION ALL
  SELECT 'E_CHECKSUM_MISMATCH', 'checksum mismatch', logical_name, dest_path FROM swept WHERE dest_path NOT LIKE '../%' AND expected <> actual
)"""

OUTCOMES = """outcomes AS (
  SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS run_id, event_type FROM events
),
counters AS (
  SELECT run_id, count(*) AS planned, count(*) FILTER (WHERE event_type = 'purchase') AS downloaded,
    count(*) FILTER (WHERE event_type IN ('view', 'click')) AS skipped,
    count(*) FILTER (WHERE event_type = 'error') AS failed,
    count(*) FILTER (WHERE event_type = 'signup') AS optional_missing
  FROM outcomes GROUP BY run_id
),
statuses AS (
  SELECT *, CASE WHEN failed > 0 AND downloaded = 0 THEN 'failed' WHEN failed > 0 OR optional_missing > 0 THEN 'partial'
    ELSE 'success' END AS status FROM counters
),
runs AS (
  SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS run_id,
    strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at_utc, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS finished_at_utc,
    CASE user_id % 3 WHEN 0 THEN 'statsbomb-open-data' WHEN 1 THEN 'nflverse' ELSE 'other' END AS source,
    CASE WHEN user_id % 2 = 0 THEN left(sha256(user_id || '_' || strftime(ts, '%Y-%m-%d')), 40) ELSE 'main' END AS source_ref,
    left(sha256(user_id || '_' || strftime(ts, '%Y-%m-%d')), 40) AS resolved_ref,
    '{"user":' || user_id || '}' AS requested_scope, user_id % 5 = 0 AS require_360
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')
)"""

PINNED = """refs AS (
  SELECT p_partkey, CASE WHEN p_size > 45 THEN p_name
    ELSE left(sha256(p_name), [6, 7, 10, 12, 40, 64][p_size % 6 + 1]) END AS ref FROM part
)"""


def _with(ctes: str, query: str) -> str:
    recursive = "RECURSIVE " if "newton(" in ctes else ""
    return f"WITH {recursive}{ctes.strip()}\n{query}"


PROFILE_ENTRIES = """WITH files AS (
  SELECT year(o_orderdate) || '_' || (o_orderkey // 20000) AS file, year(o_orderdate) % 2 = 1 AS kept, * FROM orders
),
cells AS (
  SELECT file, 'o_orderkey' AS column_name, 'int' AS type_class, CAST(o_orderkey AS DOUBLE) AS number, NULL AS text FROM files
  UNION ALL SELECT file, 'o_totalprice', 'float', o_totalprice, NULL FROM files
  UNION ALL SELECT file, 'o_orderstatus', 'string', NULL, o_orderstatus FROM files
  UNION ALL SELECT file, 'o_orderpriority', 'string', NULL, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END FROM files WHERE kept
),
stats AS (
  SELECT file, column_name, type_class, count(*) AS n_rows, round(1 - count(coalesce(CAST(number AS VARCHAR), text)) / count(*), 6) AS null_fraction,
    min(number) AS min_value, max(number) AS max_value, round(avg(number), 6) AS mean_value, round(stddev_pop(number), 6) AS std_value
  FROM cells GROUP BY ALL
),
ranked AS (
  SELECT file, column_name, text, count(*) AS n,
    row_number() OVER (PARTITION BY file, column_name ORDER BY count(*) DESC, sha256(text)) AS rank
  FROM cells WHERE text IS NOT NULL GROUP BY file, column_name, text
),
tops AS (
  SELECT file, column_name, string_agg(text || '=' || n, '|' ORDER BY rank) AS top_values FROM ranked WHERE rank <= 10 GROUP BY ALL
),
formats AS (SELECT unnest(['csv', 'json', 'parquet']) AS kind)
SELECT kind || '/' || file || '.' || kind AS dest_path, column_name, n_rows, type_class, null_fraction, min_value, max_value, mean_value,
  std_value, top_values
FROM stats LEFT JOIN tops USING (file, column_name), formats"""


def sql() -> dict[str, str]:
    side_row = _with(SIDES, f"SELECT {SIDE_COLUMNS}, win AS target FROM sides")
    features = re.split(r",\s*", SIDE_COLUMNS)[5:]
    return {
        "scan_games": _with(GAMES, "SELECT * FROM games"),
        "landed_games": _with(GAMES, "SELECT * FROM games"),
        "scan_season_files": _with(
            GAMES,
            "SELECT game_id, season, date, home_team, away_team, home_score, away_score, home_items AS home_rebounds, "
            "away_items AS away_rebounds, home_returns AS home_assists, away_returns AS away_assists, "
            "home_disc AS home_turnovers, away_disc AS away_turnovers, 0::DOUBLE AS home_fg_pct, 0::DOUBLE AS away_fg_pct, "
            "0::DOUBLE AS home_3p_pct, 0::DOUBLE AS away_3p_pct FROM games",
        ),
        "stored_splits": _with(
            SPLIT, "SELECT game_id, season, date, team, is_home, items, opp_disc, win AS target, split FROM split"
        ),
        "ledger_snapshots": """WITH named AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey = 1 GROUP BY l_partkey)
SELECT 'parts/' || coalesce(p_partkey, l_partkey) AS dest_path, sha256(coalesce(CAST(n AS VARCHAR), p_name)) AS sha256,
  coalesce(n, p_size) AS size_bytes, CASE WHEN n IS NULL THEN '2024' ELSE '2025' END AS mtime_utc
FROM part FULL JOIN named ON p_partkey = l_partkey""",
        "profile_json_files": "SELECT 'events/' || (event_id // 1000) || '.json' AS dest_path, count(*) AS n_rows, "
        "'event_id,event_type,value' AS columns, 'int,string,float' AS classes FROM events GROUP BY 1",
        "csv_documents": "SELECT * FROM documents",
        "profile_entries": PROFILE_ENTRIES,
        "stored_pages": "SELECT 'pages/' || page_id || '.html' AS dest_path, sha256(html) AS sha256, "
        "CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages",
        "two_sided_unpivot": side_row,
        "default_fill": _with(
            SIDES, "SELECT game_id, is_home, items, opp_items, 0 AS assists, 0 AS opp_assists FROM sides"
        ),
        "target_win": _with(SIDES, "SELECT game_id, is_home, win AS target FROM sides"),
        "target_score_diff": _with(SIDES, "SELECT game_id, is_home, score_diff AS target FROM sides"),
        "feature_drop": _with(
            SIDES,
            "SELECT game_id, season, date, team, opponent, is_home, items, disc, opp_items, opp_returns, win AS target FROM sides",
        ),
        "feature_list": _with(
            SIDES,
            "\nUNION ALL\n".join(
                f"SELECT {i} AS position, '{name}' AS feature, count({name}) AS n_values FROM sides"
                for i, name in enumerate(features)
            ),
        ),
        "time_split": _with(SPLIT, "SELECT game_id, is_home, date, split FROM split"),
        "time_split_by_game": _with(
            SPLIT.partition("\nsplit AS (")[0]
            + """
split AS (
  SELECT *, CASE WHEN min(pos) OVER game < CAST(floor(total * CAST(0.6 AS DOUBLE)) AS BIGINT) THEN 'train'
    WHEN min(pos) OVER game < CAST(floor(total * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM placed WINDOW game AS (PARTITION BY game_id)
)""",
            "SELECT game_id, is_home, date, split FROM split",
        ),
        "split_sizes": _with(
            SPLIT, f"SELECT split, count(*) AS n_rows, {len(features)} AS n_features FROM split GROUP BY split"
        ),
        "season_shift": _with(SHIFT, "SELECT * FROM shift"),
        "shift_long": _with(
            SHIFT,
            "\nUNION ALL\n".join(
                f"SELECT segment_kind, segment, '{m}' AS metric, {m} AS value FROM shift"
                for m in ("accuracy", "precision", "recall", "f1")
            ),
        ),
        "binary_metrics": _with(
            f"""guessed AS (
  SELECT lang, quality AS y, CAST(n_chars > 1000 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)
), counts AS (SELECT lang, {CONFUSION} FROM guessed GROUP BY lang)""",
            f"SELECT lang, {BINARY} FROM counts",
        ),
        "regression_metrics": _with(PREDICTED, f"SELECT split, {SCORES} FROM predicted GROUP BY split"),
        "season_shift_regression": _with(
            PREDICTED,
            f"""SELECT 'overall' AS segment_kind, 'overall' AS segment, {SCORES} FROM predicted WHERE split = 'test'
UNION ALL SELECT 'season', season, {SCORES} FROM predicted WHERE split = 'test' GROUP BY season""",
        ),
        "profile_table": "\nUNION ALL\n".join(_profile(t, c) for t, c in TABLES.items()),
        "logit_classify": _with(
            LOGIT,
            "\nUNION ALL\n".join(
                f"SELECT segment_kind, segment, '{m}' AS metric, {m} AS value FROM logit_shift"
                for m in ("accuracy", "precision", "recall", "f1")
            ),
        ),
        "logit_classify_all": _with(
            _logit_all(),
            "\nUNION ALL\n".join(
                f"SELECT segment_kind, segment, '{m}' AS metric, {m} AS value FROM logit_shift"
                for m in ("accuracy", "precision", "recall", "f1")
            ),
        ),
        "ridge_regress": _with(
            RIDGE,
            "SELECT segment_kind, segment, metric, round(value, 6) AS value FROM ridge_long WHERE dropped = ''",
        ),
        "ridge_regress_all": _with(
            _ridge_all([]),
            "SELECT segment_kind, segment, metric, round(value, 6) AS value FROM ridge_long WHERE dropped = ''",
        ),
        "train_eval": _with(
            _ridge_all([]),
            f"""SELECT 'linear' AS model_type, 'regression' AS task, 7 AS n_features, '{",".join(FEATURES)}' AS features, split, {SCORES}
FROM ridge WHERE dropped = '' AND split <> 'test' GROUP BY split""",
        ),
        "drop_ablation": _with(
            _ridge_all(["items", "is_home"]),
            """SELECT r.dropped, segment_kind, segment, metric, round(r.value, 6) AS value, round(b.value, 6) AS baseline,
  round(r.value - b.value, 6) AS delta
FROM ridge_long r JOIN (SELECT * EXCLUDE (dropped) FROM ridge_long WHERE dropped = '') b USING (segment_kind, segment, metric)
WHERE r.dropped <> ''""",
        ),
        "null_fraction": _with(
            GAPS,
            f"SELECT table_name, column_name, null_fraction FROM ({_profile('gaps', GAP_COLUMNS, 'events')})",
        ),
        "numeric_stats": _with(
            GAPS,
            "SELECT table_name, column_name, min_value, max_value, mean_value, std_value "
            f"FROM ({_profile('gaps', GAP_COLUMNS, 'events')}) WHERE type_class IN ('int', 'float')",
        ),
        "topk_values": _with(
            GAPS,
            _topk("documents", "documents", {"text": "text", "lang": "lang", "source": "source"})
            + "\nUNION ALL\n"
            + _topk("events", "gaps", {"kind": "kind", "paid": "CASE WHEN paid THEN 'True' ELSE 'False' END"}),
        ),
        "numeric_coerce": _with(
            """texts AS (
  SELECT CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS size_text,
    ' ' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS price_text FROM part
)""",
            _coerced("size_text") + "\nUNION ALL\n" + _coerced("price_text"),
        ),
        "profile_csv": _with(
            """cells AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_type <> 'error' THEN value END AS value,
    CASE WHEN event_type <> 'signup' THEN event_type END AS event_type, event_type = 'purchase' AS paid FROM events
)""",
            _profile(
                "cells",
                [("event_id", "int"), ("ts", "string"), ("value", "float"), ("event_type", "string"), ("paid", "bool")],
                "events_csv",
            ),
        ),
        "flatten_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, "
        "event_type || '|all' AS tags, user_id, event_type AS user_kind FROM events",
        "schema_fingerprint": _with(
            ENTRIES, "SELECT table_name, columns, payload, sha256(payload) AS schema_fingerprint FROM entries"
        ),
        "fingerprint_histogram": _with(
            ENTRIES,
            'SELECT grp AS "group", sha256(payload) AS schema_fingerprint, count(*) AS n_tables FROM entries GROUP BY ALL',
        ),
        "column_diffs": _with(
            ENTRIES, 'SELECT grp AS "group", from_table, to_table, added_columns, removed_columns FROM changed'
        ),
        "drift_report": _with(
            ENTRIES,
            """SELECT e.grp AS "group", 'tables' AS section, count(*) AS n_tables, CAST(NULL AS VARCHAR) AS schema_fingerprint,
  'orders_' || min(f.ordinal) || '_' || e.grp AS from_table, CAST(NULL AS VARCHAR) AS to_table,
  CAST(NULL AS VARCHAR) AS added_columns, CAST(NULL AS VARCHAR) AS removed_columns
FROM entries e JOIN firsts f ON f.grp = e.grp GROUP BY e.grp
UNION ALL
SELECT grp, 'fingerprint', count(*), sha256(payload), NULL, NULL, NULL, NULL FROM entries GROUP BY grp, payload
UNION ALL
SELECT grp, 'diff', 1, NULL, from_table, to_table, added_columns, removed_columns FROM changed""",
        ),
        "canonical_json": f"SELECT {DOCUMENT.replace('props ||', _compact('props') + ' ||')} AS canonical FROM events",
        "normalize_scope": f"SELECT event_id, {NORMALIZED} AS normalized FROM events",
        "scope_fingerprint": f"SELECT event_id, left(sha256({NORMALIZED}), 16) AS fingerprint FROM events",
        "sha256_hex": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "sanitize_name": "SELECT page_id, left(regexp_replace(trim(url), '[^\\p{L}\\p{N}_.-]', '_', 'g'), 128) AS name FROM pages",
        "is_pinned_ref": _with(
            PINNED,
            """SELECT p_partkey, length(ref) IN (7, 8, 9, 10, 40) AND regexp_full_match(ref, '[0-9a-fA-F]+') AS is_commit_id,
  length(ref) = 40 AND regexp_full_match(ref, '[0-9a-fA-F]+') AS is_pinned FROM refs""",
        ),
        "split_trim": "SELECT p_partkey, replace(p_name, ' ', '|') || '|' || p_type AS parts FROM part",
        "utc_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
        "expected_type": "SELECT p_partkey, ['parquet', 'csv', 'json', 'zip', 'tar', 'tar', 'tar', 'unknown', 'unknown']"
        "[p_size % 9 + 1] AS expected_type FROM part",
        "error_record": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'E_TIMEOUT' ELSE 'E_IO' END AS code,
  'event ' || event_type AS message,
  '{"k":"' || json_extract_string(props, '$.k') || '","retryable":"' || CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END
    || '","severity":"' || CASE WHEN event_type = 'error' THEN 'fatal' ELSE 'warn' END || '"}' AS detail,
  CAST(NULL AS VARCHAR) AS url, CASE WHEN event_type <> 'view' THEN CAST(event_id AS VARCHAR) END AS path FROM events""",
        "resolve_assets": _with(REQUESTS, "SELECT * FROM resolved"),
        "plan_assets": _with(
            REQUESTS,
            """SELECT ordinal, dataset || '_' || season AS logical_name, url, 'web/v1/' || dataset || '/' || url AS dest_path,
  'unknown' AS expected_type, size AS expected_size_bytes, dataset AS "group", season FROM resolved WHERE status = 'found'""",
        ),
        "missing_assets": _with(
            REQUESTS, "SELECT dataset, season, 'E_ASSET_MISSING' AS code FROM resolved WHERE n_assets = 0"
        ),
        "ambiguous_candidates": _with(
            REQUESTS,
            """SELECT lang AS dataset, season, url AS name, 'E_AMBIGUOUS_MATCH' AS code FROM urls
WHERE (lang, season) IN (SELECT (dataset, season) FROM resolved WHERE n_assets > 1)""",
        ),
        "scope_violations": _with(
            SCOPES,
            f"""SELECT scope_id, 'E_SCOPE_INVALID' AS code, 'datasets list missing or empty' AS message, CAST(NULL AS VARCHAR) AS value
FROM scopes WHERE len(datasets) = 0
UNION ALL SELECT scope_id, 'E_SCOPE_INVALID', 'seasons list missing or empty', NULL FROM scopes WHERE seasons IS NULL
UNION ALL SELECT scope_id, 'E_SCOPE_INVALID', 'invalid season', s FROM (SELECT scope_id, unnest(seasons) AS s FROM scopes) WHERE s = 'abc'
UNION ALL SELECT scope_id, 'E_SCOPE_INVALID', 'unknown dataset', d FROM (SELECT scope_id, unnest(datasets) AS d FROM scopes)
WHERE d NOT IN ({', '.join(f"'{lang}'" for lang in LANGUAGES)})""",
        ),
        "expand_scope": _with(
            SCOPES,
            """SELECT DISTINCT scope_id, dataset, season, CAST(season AS BIGINT) AS ordinal FROM (
  SELECT scope_id, datasets[1] AS dataset, TRY_CAST(unnest(seasons) AS INTEGER) AS season FROM scopes WHERE len(datasets) > 0
) WHERE season IS NOT NULL""",
        ),
        "pair_violations": """SELECT 'E_SCOPE_INVALID' AS code, 'a pair needs competition_id and season_id' AS message, value, count(*) AS n
FROM (SELECT CASE WHEN event_type = 'view' THEN '{"competition_id":"view","season_id":"' || strftime(ts, '%Y') || '"}'
  ELSE '{"competition_id":"' || user_id || '"}' END AS value FROM events WHERE event_type IN ('view', 'error')) GROUP BY value""",
        "expand_pairs": _with(PAIRS, "SELECT * FROM pairs ORDER BY 1, 2"),
        "plan_pair_files": _with(
            PAIRS,
            f"""SELECT 'matches_' || competition_id || '_' || season_id AS logical_name,
  '{ROOT}matches/' || competition_id || '/' || season_id || '.json' AS url,
  '{DEST}matches/' || competition_id || '/' || season_id || '.json' AS dest_path,
  'json' AS expected_type, 'matches' AS "group", false AS optional, competition_id, season_id FROM pairs""",
        ),
        "extract_ids": _with(IDS, "SELECT * FROM ids"),
        "artifact_fanout": _with(
            IDS,
            f"""SELECT prefix || '_' || match_id AS logical_name, '{ROOT}' || kind || '/' || match_id || '.json' AS url,
  '{DEST}' || kind || '/' || match_id || '.json' AS dest_path, 'json' AS expected_type, kind AS "group", optional, match_id
FROM ids, (VALUES ('events', 'events', false), ('lineups', 'lineups', false), ('three-sixty', 'three_sixty', true)) k(kind, prefix, optional)""",
        ),
        "content_hash": "SELECT page_id, sha256(html) AS sha256, strlen(html) AS size_bytes FROM pages",
        "skip_known": _with(
            FILES,
            """SELECT logical_name, dest_path,
  dest_path IN (SELECT dest_path FROM ledger) AND dest_path IN (SELECT dest_path FROM stored) AS known FROM plan""",
        ),
        "ledger_upsert": _with(
            FILES,
            """SELECT path AS dest_path, sha256(html) AS sha256, strlen(html) AS size_bytes,
  CASE WHEN contains(url, '#') OR contains(url, 'utm_') THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS mtime_utc FROM own""",
        ),
        "integrity_required": _with(FILES, "SELECT * FROM required_errors"),
        "integrity_sweep": _with(FILES, "SELECT * FROM sweep_errors"),
        "integrity_report": _with(
            FILES,
            """SELECT * FROM (SELECT * FROM required_errors UNION SELECT * FROM sweep_errors)
UNION ALL
SELECT 'E_JSON_PARSE', 'duplicate destination path: ' || first_name || ', ' || logical_name, NULL, dest_path FROM ranked WHERE rn > 1""",
        ),
        "duplicate_paths": _with(
            FILES,
            "SELECT 'E_JSON_PARSE' AS code, dest_path, first_name AS logical_name_a, logical_name AS logical_name_b FROM ranked WHERE rn > 1",
        ),
        "unsafe_paths": _with(
            FILES,
            "SELECT 'E_UNSAFE_DEST_PATH' AS code, logical_name, dest_path FROM plan WHERE dest_path LIKE '../%'",
        ),
        "optional_policy": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'three-sixty' ELSE 'events' END AS "group",
  CASE event_type WHEN 'error' THEN 'E_TIMEOUT' WHEN 'signup' THEN 'E_HTTP_404' END AS error_code,
  event_type = 'signup' AND event_id % 4 <> 0 AS optional_miss FROM events""",
        "run_counters": _with(OUTCOMES, "SELECT * FROM counters"),
        "run_status": _with(OUTCOMES, "SELECT run_id, status FROM statuses"),
        "run_record": _with(
            OUTCOMES,
            """SELECT '1' AS schema_version, run_id, started_at_utc, finished_at_utc, source, source_ref, resolved_ref,
  requested_scope, require_360, status, downloaded AS downloaded_files, skipped AS skipped_files, failed AS failed_files,
  optional_missing AS optional_missing_files FROM runs JOIN statuses USING (run_id)""",
        ),
        "audit_rollup": """WITH audit AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
    CASE event_type WHEN 'view' THEN 'resolve' WHEN 'signup' THEN 'schema' ELSE 'download' END AS phase,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level FROM events
)
SELECT phase, level, count(*) AS n_events, min(stamp) AS first_ts_utc, max(stamp) AS last_ts_utc FROM audit GROUP BY ALL""",
        "run_events": _with(
            OUTCOMES,
            """SELECT run_id, phase, msg, level, count(*) AS n_events, min(stamp) AS ts_utc FROM (
  SELECT run_id, 'download' AS phase, CASE event_type WHEN 'purchase' THEN 'download_ok' WHEN 'error' THEN 'download_failed'
      WHEN 'signup' THEN 'optional_missing' ELSE 'download_skipped' END AS msg,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, finished_at_utc AS stamp
  FROM outcomes JOIN runs USING (run_id)
  UNION ALL SELECT run_id, p[1], p[2], 'info', CASE WHEN p[1] = 'finalize' THEN finished_at_utc ELSE started_at_utc END
  FROM runs, (SELECT unnest([['resolve', 'start_resolve'], ['resolve', 'resolve_ok'], ['download', 'download_start'],
    ['finalize', 'ingest_complete']]) AS p)
) GROUP BY ALL""",
        ),
        "attribution_lookup": _with(
            OUTCOMES,
            """SELECT run_id, source, CASE WHEN source = 'other' THEN 0 ELSE 1 END AS n_requirements,
  CASE source WHEN 'statsbomb-open-data' THEN 'https://github.com/statsbomb/open-data'
    WHEN 'nflverse' THEN 'https://github.com/nflverse/nflverse-data' ELSE '' END AS urls FROM runs""",
        ),
        "pinned_gate": _with(
            OUTCOMES,
            """SELECT run_id, source, source_ref, 'E_FLOATING_REF_DISALLOWED' AS code FROM runs
WHERE source = 'statsbomb-open-data' AND length(source_ref) <> 40""",
        ),
    }


def _compact(column: str) -> str:
    """``{"k": 1}`` without its blank."""
    return f"replace({column}, ' ', '')"
