"""Queries on the corpus as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.operators import engagement as eng
from ripplework.operators import profile as pro
from ripplework.operators.coordination import dup_texts
from ripplework.operators.topics import TERM_STOP_WORDS, representatives, term_docfreq
from ripplework.plans.base_sql import ACCOUNTS, DUP, sql
from ripplework.sources.posts import RETWEET, read_posts

#: The account that the registered dossier is about.
ACTOR = "@Le_Ulric_Village"


def _q(f):
    return lambda spark, sf: f(read_posts(spark, sf))


def _share(condition):
    return lambda posts: posts.agg(pro.pct(F.count_if(F.expr(condition)), F.count(F.lit(1))).alias("share_pct"))


CLEAN = ["row_id", "id", "ts", "author", "text", "engagement", "repost_handle", "reply_handle", "sentiment", "verified", "followers", "following", "lifetime_posts", "reach", "impressions", "organic"]
SAMPLE = "row_id, author, ts, engagement, substr(text_raw, 1, 280) AS text, reach, sentiment, repost_handle AS reposts, CAST((SELECT count(*) FROM m) AS BIGINT) AS n_matching"


def _sample_sql(where: str, order: str = "reach DESC, row_id") -> str:
    return sql(f"SELECT {SAMPLE} FROM m ORDER BY {order} LIMIT 5", f"\nm AS (SELECT * FROM p WHERE {where})")


QUERIES = {
    "scan_posts": _q(lambda p: p.select("row_id", "id", "ts", "author", "engagement")),
    "load_clean": _q(lambda p: p.select(*CLEAN)),
    "extract_handle": _q(lambda p: p.filter("repost_handle IS NOT NULL OR reply_handle IS NOT NULL").select("row_id", "repost_handle", "reply_handle")),
    "verified_share": _q(_share("verified")),
    "retweet_share": _q(_share(f"engagement = '{RETWEET}'")),
    "profile_summary": _q(pro.summary),
    "activity_concentration": _q(pro.concentration),
    "author_activity_hist": _q(pro.activity_histogram),
    "engagement_counts": _q(lambda p: pro.counts(p, "engagement")),
    "sentiment_counts": _q(lambda p: pro.counts(p, "sentiment")),
    "top_active_authors": _q(lambda p: pro.top(p, "author", 15)),
    "top_amplified": _q(lambda p: pro.top(p, "repost_handle", 15)),
    "account_table": _q(lambda p: pro.accounts(p).drop("follower_ratio")),
    "follower_ratio": _q(lambda p: pro.accounts(p).select("author", "follower_ratio")),
    "low_footprint": _q(pro.low_footprint),
    "account_behaviour": _q(lambda p: pro.account_behaviour(p, dup_texts(p))),
    "known_handles": _q(pro.known_handles),
    "sample_contains": _q(lambda p: pro.sample(p, contains="Zorvelac")),
    "sample_author": _q(lambda p: pro.sample(p, author="ludobrique")),
    "sample_amplified": _q(lambda p: pro.sample(p, amplified="TIBOR_BOCAL", sort="oldest")),
    "sample_engagement": _q(lambda p: pro.sample(p, engagement="quote", sort="recent")),
    "sample_sentiment": _q(lambda p: pro.sample(p, sentiment="Negative")),
    "sample_daterange": _q(lambda p: pro.sample(p, date_from="2025-09-10", date_to="2025-09-20", contains="rappel")),
    "term_docfreq": _q(term_docfreq),
    "distinct_representatives": _q(representatives),
    "engagement_quality": _q(eng.quality),
    "organic_by_engagement": _q(eng.by_engagement),
    "high_reach_zero_organic": _q(lambda p: eng.high_reach(p).filter("organic = 0").select("row_id", "author", "reach")),
    "engagement_anomalies": _q(eng.anomalies),
    "reply_summary": _q(eng.reply_summary),
    "reply_targets": _q(eng.reply_targets),
    "actor": _q(lambda p: eng.actor(p, ACTOR)),
    "actor_mix": _q(lambda p: eng.actor_mix(p, ACTOR)),
    "actor_messages": _q(lambda p: eng.actor_messages(p, ACTOR)),
}

_TERM_STOP = " ".join(TERM_STOP_WORDS)
_BIG = "round(x * 100.0 / n, 1)"
_LOW = "lower(author) = 'le_ulric_village'"
SQL = {
    "scan_posts": sql("SELECT row_id, id, ts, author, engagement FROM p"),
    "load_clean": sql(f"SELECT {', '.join(CLEAN)} FROM p"),
    "extract_handle": sql("SELECT row_id, repost_handle, reply_handle FROM p WHERE repost_handle IS NOT NULL OR reply_handle IS NOT NULL"),
    "verified_share": sql("SELECT round(count(*) FILTER (WHERE verified) * 100.0 / count(*), 1) AS share_pct FROM p"),
    "retweet_share": sql("SELECT round(count(*) FILTER (WHERE engagement = 'RETWEET') * 100.0 / count(*), 1) AS share_pct FROM p"),
    "profile_summary": sql("""
SELECT CAST(count(*) AS BIGINT) AS n_messages, min(ts) AS date_min, max(ts) AS date_max, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days,
  round(count(*) FILTER (WHERE engagement = 'RETWEET') * 100.0 / count(*), 1) AS retweet_share_pct, round(count(*) FILTER (WHERE verified) * 100.0 / count(*), 1) AS verified_share_pct,
  (SELECT count(*) FROM a) AS n_authors, (SELECT count(*) FROM a WHERE n_msgs = 1) AS n_authors_1_msg, (SELECT count(*) FROM a WHERE n_msgs >= 20) AS n_authors_ge_20_msg
FROM p""", ACCOUNTS),
    "activity_concentration": sql("SELECT count(*) AS n_authors, count(*) FILTER (WHERE n_msgs = 1) AS n_authors_1_msg, count(*) FILTER (WHERE n_msgs >= 20) AS n_authors_ge_20_msg FROM a", ACCOUNTS),
    "author_activity_hist": sql("SELECT least(n_msgs, 50) AS n_posts, count(*) AS n_authors FROM a GROUP BY 1", ACCOUNTS),
    "engagement_counts": sql("SELECT engagement, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM p), 1) AS share_pct FROM p GROUP BY 1"),
    "sentiment_counts": sql("SELECT sentiment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM p), 1) AS share_pct FROM p WHERE sentiment IS NOT NULL GROUP BY 1"),
    "top_active_authors": sql("SELECT author, count(*) AS n FROM p WHERE author IS NOT NULL GROUP BY 1 ORDER BY n DESC, author LIMIT 15"),
    "top_amplified": sql("SELECT repost_handle, count(*) AS n FROM p WHERE repost_handle IS NOT NULL GROUP BY 1 ORDER BY n DESC, repost_handle LIMIT 15"),
    "account_table": sql("SELECT * FROM a", ACCOUNTS),
    "follower_ratio": sql("SELECT author, followers / (nullif(following, 0) + 1) AS follower_ratio FROM a", ACCOUNTS),
    "low_footprint": sql("SELECT * FROM low", ACCOUNTS),
    "account_behaviour": sql("""
SELECT count(*) AS n_accounts, round(count(*) FILTER (WHERE n_msgs = 1) * 100.0 / count(*), 1) AS single_message_share_pct, round(median(followers), 1) AS median_followers, round(median(following), 1) AS median_following,
  round(median(lifetime_posts), 1) AS median_posts, round(count(*) FILTER (WHERE following > followers) * 100.0 / count(*), 1) AS following_over_followers_share_pct,
  (SELECT count(*) FROM low) AS low_footprint_amplifiers, round((SELECT count(*) FROM low) * 100.0 / count(*), 1) AS low_footprint_amplifiers_pct,
  (SELECT count(*) FROM c) AS n_accounts_posting_duplicated_text, (SELECT round(sum(v) * 100.0 / sum(n), 1) FROM c) AS verified_share_among_duplicators_pct
FROM a""", ACCOUNTS, DUP, "\nc AS (SELECT author, count(*) AS n, count(*) FILTER (WHERE verified) AS v FROM p SEMI JOIN dup USING (text) GROUP BY 1)"),
    "known_handles": sql("SELECT DISTINCT ltrim(lower(h), '@') AS handle FROM (SELECT unnest([author, repost_handle, reply_handle]) AS h FROM p) WHERE ltrim(lower(h), '@') <> ''"),
    "sample_contains": _sample_sql("contains(text, 'zorvelac')"),
    "sample_author": _sample_sql("lower(author) = 'ludobrique'"),
    "sample_amplified": _sample_sql("lower(repost_handle) = 'tibor_bocal'", "ts, row_id"),
    "sample_engagement": _sample_sql("upper(engagement) = 'QUOTE'", "ts DESC, row_id"),
    "sample_sentiment": _sample_sql("lower(sentiment) = 'negative'"),
    "sample_daterange": _sample_sql("ts >= TIMESTAMP '2025-09-10' AND ts <= TIMESTAMP '2025-09-20' AND contains(text, 'rappel')"),
    "term_docfreq": sql(f"""
SELECT term, count(*) AS n_posts FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-zàâçéèêëîïôûùüÿñæœ]{{3,}}'))) AS term FROM p)
WHERE term NOT IN (SELECT unnest(string_split('{_TERM_STOP}', ' '))) GROUP BY 1 ORDER BY n_posts DESC, term LIMIT 40"""),
    "distinct_representatives": sql("SELECT text, count(*) AS weight, arg_min(row_id, [-reach, row_id]) AS row_id FROM p WHERE text <> '' GROUP BY 1"),
    "engagement_quality": sql("""
SELECT round(sum(organic) / nullif(sum(reach), 0), 5) AS organic_per_reach_overall, round(sum(organic) FILTER (WHERE d) / nullif(sum(reach) FILTER (WHERE d), 0), 5) AS organic_per_reach_duplicated,
  round(sum(organic) FILTER (WHERE NOT d) / nullif(sum(reach) FILTER (WHERE NOT d), 0), 5) AS organic_per_reach_unique, round(median(reach), 1) AS median_reach,
  round(quantile_cont(reach, 0.9), 1) AS high_reach_threshold_p90, count(*) FILTER (WHERE organic = 0 AND reach >= (SELECT quantile_cont(reach, 0.9) FROM m)) AS n_high_reach_zero_organic
FROM m""", DUP, "\nm AS (SELECT *, text IN (SELECT text FROM dup) AS d FROM p WHERE reach >= 1)"),
    "organic_by_engagement": sql("SELECT engagement, round(sum(organic) FILTER (WHERE reach >= 1) / nullif(sum(reach) FILTER (WHERE reach >= 1), 0), 5) AS organic_per_reach FROM p GROUP BY 1"),
    "high_reach_zero_organic": sql("SELECT row_id, author, reach FROM p WHERE reach >= (SELECT quantile_cont(reach, 0.9) FROM p WHERE reach >= 1) AND reach >= 1 AND organic = 0"),
    "engagement_anomalies": sql("""
SELECT row_id, author, engagement, reach, organic, round(organic / reach, 6) AS organic_per_reach, substr(text_raw, 1, 160) AS text
FROM p WHERE reach >= 1 AND reach >= (SELECT quantile_cont(reach, 0.9) FROM p WHERE reach >= 1) ORDER BY organic / reach, row_id LIMIT 15"""),
    "reply_summary": sql("SELECT count(reply_handle) AS n_replies, round(count(reply_handle) * 100.0 / count(*), 1) AS reply_share_pct, count(DISTINCT reply_handle) AS n_distinct_reply_targets FROM p"),
    "reply_targets": sql("""
SELECT reply_handle, count(*) AS n_replies_received, round(count(*) FILTER (WHERE lower(sentiment) = 'negative') * 100.0 / count(*), 1) AS negative_share_pct
FROM p WHERE reply_handle IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""),
    "actor": sql(f"""
SELECT 'Le_Ulric_Village' AS handle, count(*) FILTER (WHERE {_LOW}) AS n_messages_authored, count(*) FILTER (WHERE lower(repost_handle) = 'le_ulric_village') AS n_times_content_reposted,
  count(DISTINCT author) FILTER (WHERE lower(repost_handle) = 'le_ulric_village') AS n_distinct_relayers, count(*) FILTER (WHERE lower(reply_handle) = 'le_ulric_village') AS n_replies_received,
  round(count(*) FILTER (WHERE lower(reply_handle) = 'le_ulric_village' AND lower(sentiment) = 'negative') * 100.0 / nullif(count(*) FILTER (WHERE lower(reply_handle) = 'le_ulric_village'), 0), 1) AS replies_received_negative_share_pct,
  min(ts) FILTER (WHERE {_LOW}) AS first_seen, max(ts) FILTER (WHERE {_LOW}) AS last_seen, max(followers) FILTER (WHERE {_LOW}) AS followers, max(following) FILTER (WHERE {_LOW}) AS following,
  max(lifetime_posts) FILTER (WHERE {_LOW}) AS lifetime_posts, bool_or(verified) FILTER (WHERE {_LOW}) AS verified, CAST(sum(reach) FILTER (WHERE {_LOW}) AS BIGINT) AS total_reach
FROM p"""),
    "actor_mix": sql(f"""
SELECT kind, value, n FROM (
  SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS r FROM (
    SELECT unnest(['engagement', 'sentiment', 'reply_handle', 'repost_handle']) AS kind, unnest([engagement, sentiment, reply_handle, repost_handle]) AS value FROM p WHERE {_LOW}
  ) WHERE value IS NOT NULL GROUP BY 1, 2
) WHERE r <= 5 OR kind IN ('engagement', 'sentiment')"""),
    "actor_messages": sql(f"SELECT row_id, ts, engagement, CAST(reach AS BIGINT) AS reach, substr(text_raw, 1, 200) AS text FROM p WHERE {_LOW} ORDER BY p.reach DESC, row_id LIMIT 5"),
}
