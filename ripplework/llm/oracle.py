"""SQL of the queries that SQL can express."""

_HANDLES = r"""
WITH h AS (
  SELECT 'author' AS field, lower(regexp_replace(author, '^[\s\p{Z}]*@*|[\s\p{Z}]+$', '', 'g')) AS handle FROM posts
  UNION ALL
  SELECT 'handle', lower(regexp_replace(regexp_extract(x_repost_of, 'twitter\.com/([^/]+)/status', 1), '^[\s\p{Z}]*@*|[\s\p{Z}]+$', '', 'g')) FROM posts
), c AS (SELECT field, handle, CAST(count(*) AS BIGINT) AS n FROM h WHERE handle <> '' GROUP BY 1, 2)
"""
_TERMS = r"""
WITH t AS (SELECT row_id, regexp_extract_all(lower(message_normalizer), '[a-zàâçéèêëîïôûùüÿñæœ]{3,}') AS l FROM posts WHERE message_normalizer IS NOT NULL),
g AS (
  SELECT row_id, CAST(k AS INTEGER) AS n_terms, array_to_string(l[i : i + k - 1], ' ') AS term
  FROM t, unnest([1, 2, 3]) AS n(k), unnest(range(1, len(l) - k + 2)) AS r(i)
), c AS (
  SELECT n_terms, term, CAST(count(*) AS BIGINT) AS n_occurrences, CAST(count(DISTINCT row_id) AS BIGINT) AS n_records FROM g GROUP BY 1, 2
), s AS (
  SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records > 0.5 * (SELECT count(*) FROM posts) THEN 'common' ELSE 'useful' END AS status FROM c
)
"""
_POSTS = r"""
p AS (
  SELECT row_id AS id, min(row_id) OVER w AS kept_id, count(*) OVER w AS n FROM (
    SELECT row_id, posted_at, lower(regexp_replace(author, '[^\p{L}\p{N}]+', '', 'g')) AS a, lower(regexp_replace(message_normalizer, '[^\p{L}\p{N}]+', '', 'g')) AS m,
      coalesce(nullif(lower(regexp_replace(engagement_type, '[^\p{L}\p{N}]+', '', 'g')), ''), 'original') AS e
    FROM posts WHERE posted_at IS NOT NULL AND author IS NOT NULL
  ) WHERE m <> '' WINDOW w AS (PARTITION BY posted_at, a, m, e)
)"""
_FIELD = r"""lower(regexp_replace(coalesce(list_filter(f, lambda x: x.k = '{}' AND trim(x.v) <> '')[1].v, ''), '[^\p{{L}}\p{{N}}]+', '', 'g'))"""
_RECORDS = r"""
j AS (SELECT record_id, unnest(json_keys(payload)) AS key, payload FROM raw_records WHERE starts_with(trim(payload), '{')),
f AS (
  SELECT record_id, list({'k': lower(regexp_replace(key, '[^\p{L}]+', '', 'g')), 'v': payload ->> ('$."' || key || '"')}) AS f FROM j GROUP BY 1
  UNION ALL
  SELECT record_id, list_transform(string_split(payload, '|'), lambda x: {'k': lower(regexp_replace(split_part(x, '=', 1), '[^\p{L}]+', '', 'g')), 'v': CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) END})
  FROM raw_records WHERE payload IS NULL OR NOT starts_with(trim(payload), '{')
), q AS (
  SELECT record_id AS id, min(record_id) OVER w AS kept_id, count(*) OVER w AS n FROM (
    SELECT record_id, """ + ", ".join(f"{_FIELD.format(name)} AS {alias}" for name, alias in (("author", "a"), ("date", "d"), ("messagenormalizer", "m"))) + ", coalesce(nullif(" + _FIELD.format("engagementtype") + r""", ''), 'original') AS e FROM f
  ) WINDOW w AS (PARTITION BY a, d, m, e)
)"""

_GROUPS = r"""
WITH RECURSIVE w AS (
  SELECT row_id, list_sort(list_distinct(list_transform(regexp_extract_all(message_normalizer, '[\p{L}\p{N}]+'), lambda x: lower(x)))) AS l FROM posts WHERE message_normalizer IS NOT NULL
), s AS (SELECT l, min(row_id) AS id FROM w WHERE len(l) >= 12 GROUP BY 1),
e AS (
  SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND 2 * least(len(a.l), len(b.l)) >= greatest(len(a.l), len(b.l))
  WHERE 3 * len(list_intersect(a.l, b.l)) >= len(a.l) + len(b.l)
), nb AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
g(id, label) USING KEY (id) AS (
  SELECT id, id FROM s
  UNION
  SELECT x.id, min(y.label) FROM recurring.g x JOIN nb ON x.id = nb.a JOIN recurring.g y ON y.id = nb.b WHERE y.label < x.label GROUP BY 1
), r AS (SELECT label AS cluster_id, row_id FROM w JOIN s USING (l) JOIN g ON g.id = s.id)
"""
SQL = {
    "p2_found": _GROUPS + "SELECT cluster_id, row_id FROM r QUALIFY count(*) OVER (PARTITION BY cluster_id) > 1",
    "p1_found": _HANDLES + "SELECT field, handle FROM c WHERE n >= 0.005 * (SELECT count(*) FROM posts)",
    "p1_top_handles": _HANDLES + """
SELECT field, handle, n, n / (SELECT count(*) FROM posts) AS share FROM c
QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, handle) <= 50""",
    "p3_found": _TERMS + "SELECT term, status FROM s WHERE status <> 'useful' AND n_terms = 1",
    "p3_terms": _TERMS + "SELECT * FROM s",
    "p4_found": "WITH" + _POSTS + "," + _RECORDS + """
SELECT 'posts' AS tbl, kept_id, id AS copy_id FROM p WHERE id <> kept_id
UNION ALL SELECT 'raw_records', kept_id, id FROM q WHERE id <> kept_id""",
    "p4_kept": "WITH" + _POSTS + "," + _RECORDS + """
SELECT 'posts' AS tbl, kept_id, CAST(n AS BIGINT) AS n_copies FROM p WHERE id = kept_id
UNION ALL SELECT 'raw_records', kept_id, CAST(n AS BIGINT) FROM q WHERE id = kept_id""",
}
