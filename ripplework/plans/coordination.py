"""Queries on copies, synchrony, networks, segments, topics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.operators import audit
from ripplework.operators import coordination as co
from ripplework.operators import profile as pro
from ripplework.operators.graph import CoActivity
from ripplework.operators.neardup import char_ngrams, near_dup_groups, near_dup_totals, similar_pairs
from ripplework.operators.segments import DIMENSIONS, breakdown, gaps
from ripplework.operators.topics import STOP_WORDS, Topics, term_weights
from ripplework.plans.base_sql import ACCOUNTS, DUP, sql
from ripplework.plans.profile import SQL as PROFILE_SQL
from ripplework.sources.posts import RETWEET, read_posts


def _q(f):
    return lambda spark, sf: f(read_posts(spark, sf))


def _retweets_of_dup(posts):
    texts = posts.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper("engagement") == RETWEET).alias("rt")).filter("n >= 5")
    return texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), pro.pct(F.sum("rt"), F.sum("n")).alias("share_pct"))


def _text_ngrams(posts):
    grams = co.dup_texts(posts).select("n", F.explode(char_ngrams("text")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_copies"))


def _near_pairs(posts):
    texts = co.dup_texts(posts).select(F.xxhash64("text").alias("id"), "text")
    pairs = similar_pairs(texts, "id", "text")
    a, b = texts.select(F.col("id").alias("src"), F.col("text").alias("a")), texts.select(F.col("id").alias("dst"), F.col("text").alias("b"))
    found = pairs.join(a, "src").join(b, "dst")
    return found.select(F.least("a", "b").alias("text_a"), F.greatest("a", "b").alias("text_b"), F.round("sim", 6).alias("sim"))


def _reports(spark, sf):
    posts = read_posts(spark, sf)
    reports = spark.read.parquet(f"{sf}/narratifs.parquet")
    counted = pro.summary(posts).select("n_messages", "retweet_share_pct", "verified_share_pct", "n_authors", "n_authors_1_msg", "n_authors_ge_20_msg", "span_days")
    values = counted.select(F.explode(F.array(*(F.col(c).cast("double") for c in counted.columns))).alias("value"))
    values = values.unionByName(pro.counts(posts, "sentiment").select(F.explode(F.array(F.col("n").cast("double"), "share_pct")).alias("value")))
    keys = ["run_id", "narratif_no"]
    return reports, keys, audit.findings(reports, keys, ["nom", "resume", "exemple"], pro.known_handles(posts), values, ["nom", "resume"], audit.MIN_FACTS, ["run_id"])


def _findings(spark, sf):
    return _reports(spark, sf)[2]


def _verdicts(spark, sf):
    reports, keys, found = _reports(spark, sf)
    return audit.verdicts(reports, keys, found)


def _leaks(spark, sf):
    """The handles and numbers in the examples of a run's narratives that their names and summaries don't hold."""
    reports = spark.read.parquet(f"{sf}/narratifs.parquet")
    return audit.leaks(reports, reports, ["run_id"], ["exemple"], ["nom", "resume"])


QUERIES = {
    "dup_texts": _q(co.dup_texts),
    "duplication": _q(co.duplication),
    "copy_paste_rate": _q(lambda p: co.duplication(p).select("copy_paste_rate_pct")),
    "verbatim_rate": _q(lambda p: co.duplication(p).select("n_distinct_duplicated_texts", "verbatim_duplication_rate_pct")),
    "null_model_lift": _q(lambda p: co.synchrony(p).select("expected_within_delta_uniform_pct", "synchrony_lift_vs_uniform")),
    "char_ngrams": _q(_text_ngrams),
    "retweet_share_of_dup": _q(_retweets_of_dup),
    "minute_bursts": _q(co.minute_bursts),
    "synchrony_per_text": _q(lambda p: co.synchrony_per_text(p).withColumn("expected", F.round("expected", 6))),
    "synchrony_score": _q(co.synchrony),
    "anchored_windows": _q(co.anchored_windows),
    "burst_size_over_time": _q(co.burst_sizes),
    "near_dup_pairs": _q(_near_pairs),
    "near_dup_groups": _q(lambda p: near_dup_groups(co.dup_texts(p)).withColumn("variant_examples", F.array_join("variant_examples", " | "))),
    "near_dup_totals": _q(lambda p: near_dup_totals(near_dup_groups(co.dup_texts(p)))),
    "top_synchronized_texts": _q(co.top_synchronized),
    "coactivity_edges": _q(lambda p: CoActivity(p).edges()),
    "coactivity_edges_repeated": _q(lambda p: CoActivity(p, min_edge_weight=2).edges()),
    "coactivity_links": _q(lambda p: CoActivity(p).account_links()),
    "network_components": _q(lambda p: CoActivity(p).components()),
    "network_summary": _q(lambda p: CoActivity(p).summary()),
    "network_summary_repeated": _q(lambda p: CoActivity(p, min_edge_weight=2).summary()),
    "network_community_summary": _q(lambda p: CoActivity(p).community_summary()),
    "network_communities": _q(lambda p: CoActivity(p).communities()),
    "network_clusters": _q(lambda p: CoActivity(p).clusters()),
    **{f"breakdown_by_{by}": _q(lambda p, by=by: breakdown(p, by)) for by in DIMENSIONS},
    "breakdown_gaps": _q(lambda p: gaps(breakdown(p, "engagement"))),
    "narratives": _q(lambda p: Topics(p).summary()),
    "narrative_timelines": _q(lambda p: Topics(p).timelines()),
    "narrative_lead_lag": _q(lambda p: Topics(p).lead_lag()),
    "narrative_terms": _q(lambda p: term_weights(p)),
    "narrative_drift": _q(lambda p: Topics(p).drift()),
    "report_findings": _findings,
    "report_verdicts": _verdicts,
    "report_leaks": _leaks,
}

_SEC = """
q AS (SELECT {k} text, epoch_us(ts) // 1000000 AS sec, author FROM {t} WHERE text <> ''),
w AS (SELECT *, count(*) OVER (PARTITION BY {k} text) AS n, lag(sec) OVER o AS b, lead(sec) OVER o AS f FROM q WINDOW o AS (PARTITION BY {k} text ORDER BY sec)),
sy AS (
  SELECT {k} text, count(*) AS copies, count(*) FILTER (WHERE sec - b <= 60 OR f - sec <= 60) AS within, median(sec - b) AS median_gap, max(sec) - min(sec) AS span FROM w WHERE n >= {m} GROUP BY {k} text
)"""
_SYNC = _SEC.format(k="", t="p", m=5) + """,
ex AS (SELECT *, CASE WHEN copies < 2 THEN 0.0 WHEN span > 0 THEN (1 - pow(greatest(0.0, 1 - 120.0 / span), copies - 1)) * copies ELSE CAST(copies AS DOUBLE) END AS expected FROM sy)"""
_WIN = _SEC.format(k="", t="p", m=5) + """,
s AS (SELECT DISTINCT text, sec FROM w WHERE n >= 5),
wn AS (
  SELECT text, min(sec) AS anchor FROM s GROUP BY 1
  UNION ALL
  SELECT wn.text, (SELECT min(s.sec) FROM s WHERE s.text = wn.text AND s.sec > wn.anchor + 60) AS anchor FROM wn WHERE wn.anchor IS NOT NULL
),
ww AS (SELECT w.text, anchor, count(*) AS n FROM w JOIN (SELECT * FROM wn WHERE anchor IS NOT NULL) x ON w.text = x.text AND w.sec BETWEEN anchor AND anchor + 60 WHERE w.n >= 5 GROUP BY 1, 2)"""
_MEMBERS = _WIN + """,
m0 AS (SELECT DISTINCT w.text, anchor, author FROM w JOIN (SELECT * FROM wn WHERE anchor IS NOT NULL) x ON w.text = x.text AND w.sec BETWEEN anchor AND anchor + 60 WHERE w.n >= 5 AND author IS NOT NULL),
m1 AS (SELECT *, count(*) OVER (PARTITION BY text, anchor) AS size FROM m0)"""
_GRAMS = """
g AS (SELECT text, regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g') AS c FROM dup),
gg AS (SELECT text, list_distinct(list_transform(range(1, len(c) - 1), lambda i: substr(c, i, 3))) AS l FROM g WHERE len(c) >= 3)"""


def _breakdown_sql(segment: str) -> str:
    seg = f"\nx AS (SELECT *, {segment} AS segment FROM p)"
    return sql("""
SELECT segment, count(*) AS volume, round(count(*) * 100.0 / (SELECT count(*) FROM p), 1) AS share_pct,
  coalesce(round(max(c) * 100.0 / count(*), 1), 0.0) AS dup_rate, coalesce(round(max(wi) * 100.0 / max(c), 1), 0.0) AS synchrony_score, round(count(*) FILTER (WHERE verified) * 100.0 / count(*), 1) AS verified_share,
  round(count(*) FILTER (WHERE author IN (SELECT author FROM low)) * 100.0 / count(*), 1) AS low_footprint_share, round(avg(reach), 1) AS mean_reach, round(avg(organic), 2) AS mean_organic_engagement
FROM x LEFT JOIN (SELECT segment, sum(copies) AS c, sum(within) AS wi FROM sy GROUP BY 1) USING (segment) GROUP BY 1 HAVING count(*) >= 30 ORDER BY 2 DESC, 1 LIMIT 30""", ACCOUNTS, seg, _SEC.format(k="segment,", t="x", m=2))


_EDGES = _MEMBERS + """,
ed AS (
  SELECT a.author AS src, b.author AS dst, count(*) AS weight, count(*) FILTER (WHERE a.size > 500) AS large
  FROM m1 a JOIN m1 b ON a.text = b.text AND a.anchor = b.anchor AND a.author < b.author GROUP BY 1, 2 HAVING count(*) >= {least}
)"""
# each node takes the least label among its neighbours' until none changes
_GROUPS = """,
nb AS (SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst, src FROM {edges}),
gr(node, label) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM nb
  UNION
  SELECT g.node, min(h.label) FROM recurring.gr g JOIN nb ON g.node = nb.a JOIN recurring.gr h ON h.node = nb.b WHERE h.label < g.label GROUP BY 1
)"""
_PAIRS = _GRAMS + """,
pr AS (
  SELECT a.text AS src, b.text AS dst FROM gg a JOIN gg b ON a.text < b.text AND least(len(a.l), len(b.l)) >= 0.8 * greatest(len(a.l), len(b.l))
  WHERE len(list_intersect(a.l, b.l)) >= 0.8 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))
)""" + _GROUPS.format(edges="pr") + """,
nd AS (SELECT label, text, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, text) AS r FROM gr JOIN dup ON text = node)"""


def _summary_sql(least: int) -> str:
    return sql("""
SELECT (SELECT count(*) FROM gr) AS n_nodes, (SELECT count(DISTINCT label) FROM gr) AS n_components, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM gr GROUP BY label)), 0) AS largest_component,
  (SELECT CAST(coalesce(sum((size - 1) / 2), 0) AS BIGINT) FROM m1) AS link_weight, (SELECT count(*) FROM ed) AS n_edges""", DUP, _EDGES.format(least=least) + _GROUPS.format(edges="ed"))


_METRICS = "dup_rate synchrony_score verified_share low_footprint_share mean_reach mean_organic_engagement".split()
# figures of the corpus, and the numbers and handles of the reports
_REPORTS = f"""
vals AS (
  SELECT DISTINCT round(v, 4) AS v FROM (
    SELECT unnest([n_messages, retweet_share_pct, verified_share_pct, n_authors, n_authors_1_msg, n_authors_ge_20_msg, span_days]) AS v FROM ({PROFILE_SQL['profile_summary']})
    UNION ALL SELECT unnest([n, share_pct]) FROM ({PROFILE_SQL['sentiment_counts']})
  ) WHERE v IS NOT NULL
),
gap AS (SELECT DISTINCT round(abs(a.v - b.v), 2) AS g FROM vals a, vals b WHERE a.v <> b.v),
rp AS (SELECT run_id, narratif_no, concat_ws(chr(10), nom, resume, exemple) AS t, concat_ws(chr(10), nom, resume) AS prose FROM narratifs),
hd AS (SELECT run_id, narratif_no, unnest(list_distinct(list_transform(regexp_extract_all(t, '{audit.HANDLE}', 1), lambda x: lower(x)))) AS token FROM rp),
nr AS (SELECT run_id, narratif_no, unnest(regexp_extract_all(regexp_replace(t, '{audit.HANDLE}', ' ', 'g'), '{audit.NUMBER}')) AS raw FROM rp),
nb AS (SELECT run_id, narratif_no, replace(regexp_replace(raw, '[\\s\u00a0\u202f]', '', 'g'), ',', '.') AS c FROM nr),
nc AS (SELECT run_id, narratif_no, CASE WHEN len(c) - len(replace(c, '.', '')) > 1 THEN replace(c, '.', '') ELSE c END AS token FROM nb),
nm AS (
  SELECT DISTINCT run_id, narratif_no, token FROM nc
  WHERE regexp_full_match(token, '\\d+(\\.\\d+)?') AND (contains(token, '.') OR (len(token) >= 3 AND NOT regexp_full_match(token, '(19|20)\\d\\d')))
),
ng AS (
  SELECT *, EXISTS (SELECT 1 FROM (SELECT unnest([v, v * 100, v / 100]) AS b FROM vals) WHERE abs(CAST(token AS DOUBLE) - b) <= 0.05 + 0.01 * abs(b))
    OR round(CAST(token AS DOUBLE), 2) IN (SELECT g FROM gap WHERE g > 0) AS ok
  FROM nm
),
fc AS (
  SELECT run_id, count(token) AS n FROM narratifs LEFT JOIN (
    SELECT DISTINCT run_id, token FROM ng WHERE ok UNION SELECT run_id, '@' || token FROM hd WHERE token IN (SELECT handle FROM ({PROFILE_SQL['known_handles']}))
  ) USING (run_id) GROUP BY run_id, narratif_no
),
fi AS (
  SELECT run_id, narratif_no, 'unknown_handle' AS kind, 'error' AS severity, token FROM hd WHERE token NOT IN (SELECT handle FROM ({PROFILE_SQL['known_handles']}))
  UNION ALL SELECT run_id, narratif_no, 'ungrounded_number', 'warning', token FROM ng WHERE NOT ok
  UNION ALL SELECT run_id, narratif_no, 'tone', 'warning', unnest(list_distinct(list_transform(regexp_extract_all(prose, '{audit.TONE.replace("(?iu)", "(?i)")}', 1), lambda x: lower(x)))) FROM rp
  UNION ALL SELECT DISTINCT run_id, narratif_no, 'empty_diagnosis', 'error', CAST(n AS VARCHAR) FROM narratifs JOIN (SELECT DISTINCT * FROM fc) USING (run_id) WHERE n < 3
)"""
SQL = {
    "near_dup_groups": sql("""
SELECT max(n_variants) AS n_variants, max(total_count) AS total_count, max(substr(text, 1, 160)) FILTER (WHERE r = 1) AS representative, coalesce(string_agg(substr(text, 1, 120), ' | ' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 4), '') AS variant_examples
FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n_variants, CAST(sum(n) OVER (PARTITION BY label) AS BIGINT) AS total_count FROM nd) GROUP BY label""", DUP, _PAIRS),
    "near_dup_totals": sql("SELECT count(DISTINCT label) AS n_near_dup_groups, count(*) AS n_texts_merged, CAST(coalesce(sum(n), 0) AS BIGINT) AS messages_in_near_dup_groups FROM nd", DUP, _PAIRS),
    "top_synchronized_texts": sql("""
SELECT substr(text, 1, 120) AS text, copies, round(within * 100.0 / copies, 1) AS within_delta_pct, round(median_gap, 1) AS median_inter_arrival_seconds FROM ex ORDER BY within / copies DESC, copies DESC, ex.text LIMIT 15""", _SYNC),
    "coactivity_edges": sql("SELECT src, dst, weight, large FROM ed", DUP, _EDGES.format(least=1)),
    "coactivity_edges_repeated": sql("SELECT src, dst, weight, large FROM ed", DUP, _EDGES.format(least=2)),
    "network_components": sql("SELECT node AS author, label AS component FROM gr", DUP, _EDGES.format(least=1) + _GROUPS.format(edges="ed")),
    "network_summary": _summary_sql(1),
    "network_summary_repeated": _summary_sql(2),
    "breakdown_gaps": f"""
SELECT metric, arg_min(segment, [-v, r]) AS max_segment, max(v) AS max, arg_min(segment, [v, r]) AS min_segment, min(v) AS min, round(max(v) - min(v), 2) AS spread FROM (
  SELECT segment, row_number() OVER (ORDER BY segment) AS r, unnest([{', '.join(f"'{m}'" for m in _METRICS)}]) AS metric, unnest([{', '.join(f"CAST({m} AS DOUBLE)" for m in _METRICS)}]) AS v FROM ({_breakdown_sql("engagement")})
) WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "report_findings": sql("SELECT * FROM fi", _REPORTS),
    "narrative_terms": sql(f"""
SELECT term, round(any_value(weight), 9) AS weight, CAST(sum(tf) AS BIGINT) AS n, round(sum(tf * weight / norm), 6) AS mass FROM (
  SELECT *, sqrt(sum(pow(tf * weight, 2)) OVER (PARTITION BY text)) AS norm FROM (
    SELECT *, ln((1 + (SELECT count(*) FROM tx)) / (1 + df)) + 1 AS weight FROM (SELECT text, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM tm GROUP BY 1, 2)
    WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM tx)
  )
) GROUP BY 1""", f"""
tx AS (SELECT DISTINCT text FROM p WHERE text <> ''),
tw AS (SELECT text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]{{2,}}'), lambda x: x NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})) AS l FROM tx),
tm AS (SELECT text, unnest(l) AS term FROM tw UNION ALL SELECT text, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM tw)"""),
    "report_leaks": f"""
WITH rp AS (SELECT run_id, concat_ws(chr(10), nom, resume) AS told, exemple AS made FROM narratifs),
hd AS (SELECT DISTINCT run_id, unnest(list_transform(regexp_extract_all(made, '{audit.HANDLE}', 1), lambda x: lower(x))) AS token FROM rp),
ht AS (SELECT DISTINCT run_id, unnest(list_transform(regexp_extract_all(told, '{audit.HANDLE}', 1), lambda x: lower(x))) AS token FROM rp),
nr AS (
  SELECT run_id, side, replace(regexp_replace(raw, '[\\s\u00a0\u202f]', '', 'g'), ',', '.') AS c FROM (
    SELECT run_id, 'made' AS side, unnest(regexp_extract_all(regexp_replace(made, '{audit.HANDLE}', ' ', 'g'), '{audit.NUMBER}')) AS raw FROM rp
    UNION ALL SELECT run_id, 'told', unnest(regexp_extract_all(told, '{audit.NUMBER}')) FROM rp
  )
),
nc AS (SELECT DISTINCT run_id, side, CASE WHEN len(c) - len(replace(c, '.', '')) > 1 THEN replace(c, '.', '') ELSE c END AS token FROM nr),
vals AS (SELECT DISTINCT run_id, round(TRY_CAST(token AS DOUBLE), 4) AS v FROM nc WHERE side = 'told' AND TRY_CAST(token AS DOUBLE) IS NOT NULL),
gap AS (SELECT DISTINCT a.run_id, round(abs(a.v - b.v), 2) AS g FROM vals a JOIN vals b USING (run_id) WHERE round(abs(a.v - b.v), 2) > 0)
SELECT run_id, 'livrable_leak' AS kind, 'error' AS severity, token FROM hd ANTI JOIN ht USING (run_id, token)
UNION ALL SELECT run_id, 'livrable_leak', 'warning', token FROM nc
WHERE side = 'made' AND regexp_full_match(token, '\\d+(\\.\\d+)?') AND (contains(token, '.') OR (len(token) >= 3 AND NOT regexp_full_match(token, '(19|20)\\d\\d')))
  AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.run_id = nc.run_id AND (abs(CAST(token AS DOUBLE) - v) <= 0.05 + 0.01 * abs(v) OR abs(CAST(token AS DOUBLE) - v * 100) <= 0.05 + abs(v) OR abs(CAST(token AS DOUBLE) - v / 100) <= 0.05 + 0.0001 * abs(v)))
  AND NOT EXISTS (SELECT 1 FROM gap WHERE gap.run_id = nc.run_id AND g = round(CAST(token AS DOUBLE), 2))""",
    "report_verdicts": sql("""
SELECT n.run_id, n.narratif_no, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
  CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'revision' ELSE 'ok' END AS verdict
FROM (SELECT DISTINCT run_id, narratif_no FROM narratifs) n LEFT JOIN fi USING (run_id, narratif_no) GROUP BY 1, 2""", _REPORTS),
    "dup_texts": sql("SELECT * FROM dup", DUP),
    "duplication": sql("""
SELECT (SELECT count(*) FROM dup) AS n_distinct_duplicated_texts, round((SELECT sum(n) FROM dup) * 100.0 / count(*), 1) AS verbatim_duplication_rate_pct,
  round(count(*) FILTER (WHERE upper(engagement) = 'RETWEET' AND text IN (SELECT text FROM dup)) * 100.0 / (SELECT sum(n) FROM dup), 1) AS retweet_share_of_duplicated_pct,
  (SELECT round(sum(k) FILTER (WHERE k >= 2 AND text <> '') * 100.0 / sum(k), 1) FROM own) AS copy_paste_rate_pct
FROM p""", DUP, "\nown AS (SELECT text, count(*) AS k FROM p WHERE upper(engagement) NOT IN ('RETWEET', 'REPLY') GROUP BY 1)"),
    "copy_paste_rate": sql("SELECT round(sum(k) FILTER (WHERE k >= 2 AND text <> '') * 100.0 / sum(k), 1) AS copy_paste_rate_pct FROM (SELECT text, count(*) AS k FROM p WHERE upper(engagement) NOT IN ('RETWEET', 'REPLY') GROUP BY 1)"),
    "verbatim_rate": sql("SELECT (SELECT count(*) FROM dup) AS n_distinct_duplicated_texts, round((SELECT sum(n) FROM dup) * 100.0 / count(*), 1) AS verbatim_duplication_rate_pct FROM p", DUP),
    "null_model_lift": sql("""
SELECT round(sum(expected) / sum(copies) * 100, 1) AS expected_within_delta_uniform_pct, round((sum(within) / sum(copies)) / (sum(expected) / sum(copies)), 1) AS synchrony_lift_vs_uniform FROM ex""", _SYNC),
    "char_ngrams": sql("""
SELECT gram, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_copies FROM (SELECT n, unnest(CASE WHEN c = '' THEN [] WHEN len(c) < 3 THEN [c] ELSE list_distinct(list_transform(range(1, len(c) - 1), lambda i: substr(c, i, 3))) END) AS gram FROM g) GROUP BY 1""", DUP, """
g AS (SELECT n, regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g') AS c FROM dup)"""),
    "retweet_share_of_dup": sql("SELECT count(*) AS n_rows, round(count(*) FILTER (WHERE upper(engagement) = 'RETWEET') * 100.0 / count(*), 1) AS share_pct FROM p SEMI JOIN dup USING (text)", DUP),
    "minute_bursts": sql("SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, text, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 1, 2 LIMIT 15"),
    "synchrony_per_text": sql("SELECT text, copies, within, median_gap, span, round(expected, 6) AS expected, round(within * 100.0 / copies, 1) AS within_pct FROM ex", _SYNC),
    "synchrony_score": sql("""
SELECT CAST(sum(copies) AS BIGINT) AS copies_considered, CAST(sum(within) AS BIGINT) AS copies_within_delta, round(sum(within) / sum(copies) * 100, 1) AS coordination_score_pct,
  round(sum(expected) / sum(copies) * 100, 1) AS expected_within_delta_uniform_pct, round((sum(within) / sum(copies)) / (sum(expected) / sum(copies)), 1) AS synchrony_lift_vs_uniform FROM ex""", _SYNC),
    "anchored_windows": sql("SELECT * FROM ww", _WIN),
    "burst_size_over_time": sql("SELECT CAST(make_timestamp(anchor * 1000000) AS DATE) AS day, max(n) AS max_burst, count(*) FILTER (WHERE n >= 3) AS n_bursts_ge3 FROM ww WHERE n >= 2 GROUP BY 1", _WIN),
    "near_dup_pairs": sql("""
SELECT a.text AS text_a, b.text AS text_b, round(len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l))), 6) AS sim FROM gg a JOIN gg b ON a.text < b.text
AND least(len(a.l), len(b.l)) >= 0.8 * greatest(len(a.l), len(b.l)) WHERE len(list_intersect(a.l, b.l)) >= 0.8 * (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))""", DUP, _GRAMS),
    "coactivity_links": sql("SELECT author, count(*) AS n_windows, CAST(sum(size - 1) AS BIGINT) AS link_weight FROM m1 WHERE size > 1 GROUP BY 1", _MEMBERS),
    "breakdown_by_sentiment": _breakdown_sql("coalesce(sentiment, 'None')"),
    "breakdown_by_engagement": _breakdown_sql("engagement"),
    "breakdown_by_verified": _breakdown_sql("CASE WHEN verified THEN 'verified' ELSE 'non_verifie' END"),
    "breakdown_by_day": _breakdown_sql("strftime(ts, '%Y-%m-%d')"),
    "breakdown_by_hour": _breakdown_sql("strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"),
}
