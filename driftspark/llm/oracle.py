"""SQL for queries of this package that stays readable only when it is put together from parts."""

from __future__ import annotations


def centroid_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds over full distances, one pair of common table expressions for each round."""

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
  SELECT vec_id, x, best[2] AS k, best[1] AS d FROM (
    SELECT vec_id, any_value(v.x) AS x,
      min([list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.k]) AS best
    FROM v CROSS JOIN c{n} AS c GROUP BY vec_id
  )
)"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM (
      SELECT k, p, sum(e) AS s, count(*) AS n FROM (
        SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{n}
      ) GROUP BY k, p
    ) GROUP BY k
  ) AS m ON c.k = m.k
)"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(rounds))
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT {clusters}
),
{steps},
{assigned(rounds)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.k = c.k"""


# Each order is replayed on the documents: the first filter of the order that a document fails removes it.
FILTER_AUDIT = r"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    min(doc_id) OVER (PARTITION BY text) AS first
  FROM texts
),
fails AS (
  SELECT doc_id, part, map(['A', 'B', 'C', 'D', 'E'], [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * capitals > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)
  ]) AS f
  FROM words
),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, f[letter] AS failing,
    len(list_filter(string_split(before, ''), lambda x: coalesce(f[x], false))) > 0 AS gone,
    len(list_filter(map_values(f), lambda x: x)) AS n_failing
  FROM counts, steps
),
report AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failing AND n_failing = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM report"""
