"""The canonical posts, as a common table expression."""

POSTS = r"""
p AS (
  SELECT row_id, post_id AS id, posted_at AS ts, author, full_text AS text_raw, coalesce(message_normalizer, '') AS text, coalesce(engagement_type, 'ORIGINAL') AS engagement,
    nullif(regexp_extract(x_repost_of, 'twitter\.com/([^/]+)/status', 1), '') AS repost_handle, nullif(regexp_extract(x_reply_to, 'twitter\.com/([^/]+)/status', 1), '') AS reply_handle,
    sentiment, coalesce(lower(x_verified) IN ('true', '1', '1.0', 'yes'), false) AS verified, x_followers AS followers, x_following AS following, x_posts AS lifetime_posts,
    coalesce(reach, 0) AS reach, coalesce(impressions, 0) AS impressions, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments, coalesce(shares, 0) AS shares,
    coalesce(likes, 0) + coalesce(comments, 0) + coalesce(shares, 0) AS organic
  FROM posts WHERE posted_at IS NOT NULL
)"""
ACCOUNTS = """
a AS (
  SELECT author, CAST(count(*) AS BIGINT) AS n_msgs, max(followers) AS followers, max(following) AS following, max(lifetime_posts) AS lifetime_posts, bool_or(verified) AS any_verified
  FROM p WHERE author IS NOT NULL GROUP BY 1
), low AS (
  SELECT author, followers, lifetime_posts FROM a
  WHERE n_msgs = 1 AND lifetime_posts <= (SELECT quantile_cont(lifetime_posts, 0.25) FROM a) AND followers <= (SELECT median(followers) FROM a)
)"""
DUP = """
dup AS (SELECT text, CAST(count(*) AS BIGINT) AS n FROM p WHERE text <> '' GROUP BY 1 HAVING count(*) >= 5)"""


def sql(body: str, *tables: str) -> str:
    return "WITH RECURSIVE " + ", ".join((POSTS, *tables)) + "\n" + body
