"""DuckDB SQL of the operators that SQL can express: plain full searches over the same tables."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(embedding) = list_count(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0"
_DISTANCE = "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
#: Integer division rounds towards zero; this rounds down.
_FLOOR_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _rounds(start: str, points: str, group: str, rounds: int) -> str:
    """CTEs c0..c<rounds> of centres and a0..a<rounds> of assignments; ``group`` names the column that
    separates independent codebooks (a constant where there is one)."""
    out = [f"c0 AS MATERIALIZED ({start})"]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, g, c, d, v FROM (
  SELECT p.rid, p.g, p.v, c.c, {_DISTANCE.format(a="p.v", b="c.w")} AS d FROM {points} p JOIN c{r} c ON c.g = p.g)
  QUALIFY row_number() OVER (PARTITION BY rid, g ORDER BY d, c) = 1)""")
        if r < rounds:
            out.append(f"""m{r} AS (SELECT g, c, list(x ORDER BY i) AS w FROM (
  SELECT g, c, i, {_FLOOR_MEAN} AS x FROM (SELECT g, c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY g, c, i) GROUP BY g, c)""")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.g, o.c, coalesce(m.w, o.w) AS w FROM c{r} o LEFT JOIN m{r} m ON m.g = o.g AND m.c = o.c)")
    return ",\n".join(out)


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    n = f"len(v) // {parts}"
    start = f"""SELECT p.g, s.c, p.v AS w FROM (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM e) s JOIN p ON p.rid = s.rid WHERE s.c < {entries}"""
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT rid, g, v[g * ({n}) + 1 : (g + 1) * ({n})] AS v FROM e, range({parts}) t(g)),
{_rounds(start, "p", "g", rounds)},
found AS (SELECT rid, string_agg(printf('%02x', c), '' ORDER BY g) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY g, c)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM e JOIN found USING (rid) CROSS JOIN books"""


def centroids_sql(dims: int = 64, centroids: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    start = f"SELECT 0 AS g, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS w FROM e QUALIFY c < {centroids}"
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, 0 AS g, vec_id,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND {_FINITE}),
{_rounds(start, "e", "g", rounds)}
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e ON e.rid = a.rid JOIN c{rounds} c ON c.c = a.c"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM q"""
