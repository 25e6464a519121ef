"""Overview of a corpus: volumes, shares, rankings. All take canonical posts; shares are of all rows, NULL keys aren't ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.functions.text import text_key
from ripplework.functions.time import micros
from ripplework.operators.quantiles import percentiles
from ripplework.plans.cluster import cut, lookup_join
from ripplework.sources.posts import RETWEET


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100 / F.nullif(whole, F.lit(0)), digits)


def counts(posts: DataFrame, key: str) -> DataFrame:
    """``key``, ``n`` and ``share_pct`` of every value of ``key`` but NULL."""
    whole = posts.agg(F.count(F.lit(1)).alias("_all"))
    found = posts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(whole)).select(key, "n", pct(F.col("n"), F.col("_all")).alias("share_pct"))


def top(posts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of ``key``; of equally frequent ones the lesser."""
    found = posts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), key).limit(k)


def activity(posts: DataFrame) -> DataFrame:
    """Posts of each author."""
    return posts.filter("author IS NOT NULL").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def summary(posts: DataFrame) -> DataFrame:
    """One row: volume, dates, authors, their concentration, retweet and verified shares. Two passes of partial aggregation."""
    whole = posts.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("ts").alias("date_min"),
        F.max("ts").alias("date_max"),
        F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 86_400_000_000).cast("long").alias("span_days"),
        pct(F.count_if(F.col("engagement") == RETWEET), F.count(F.lit(1))).alias("retweet_share_pct"),
        pct(F.count_if("verified"), F.count(F.lit(1))).alias("verified_share_pct"),
    )
    return whole.join(F.broadcast(concentration(posts)))


def concentration(posts: DataFrame) -> DataFrame:
    """How many authors there are, with one post and with twenty or more."""
    return activity(posts).agg(F.count(F.lit(1)).alias("n_authors"), F.count_if(F.col("n") == 1).alias("n_authors_1_msg"), F.count_if(F.col("n") >= 20).alias("n_authors_ge_20_msg"))


def activity_histogram(posts: DataFrame, cap: int = 50) -> DataFrame:
    """Authors by their number of posts, those above ``cap`` counted at it."""
    return activity(posts).groupBy(F.least("n", F.lit(cap)).alias("n_posts")).agg(F.count(F.lit(1)).alias("n_authors"))


def accounts(posts: DataFrame, *more: Column) -> DataFrame:
    """One row for each author: posts, greatest figures, whether ever verified, follower ratio, and ``more`` aggregates."""
    found = posts.filter("author IS NOT NULL").groupBy("author").agg(
        F.count(F.lit(1)).alias("n_msgs"), F.max("followers").alias("followers"), F.max("following").alias("following"),
        F.max("lifetime_posts").alias("lifetime_posts"), F.bool_or("verified").alias("any_verified"), *more,
    )
    return found.withColumn("follower_ratio", F.col("followers") / (F.nullif("following", F.lit(0.0)) + 1))


def low_footprint(posts: DataFrame, *more: Column) -> DataFrame:
    """Authors of a single post with at most the lower quartile of lifetime posts and the median of followers over all authors, and ``more``
    aggregates of their post."""
    table = accounts(posts, *more)
    bounds = percentiles(table, {"_p": ("lifetime_posts", 0.25), "_f": ("followers", 0.5)})
    few = (F.col("n_msgs") == 1) & (F.col("lifetime_posts") <= F.col("_p")) & (F.col("followers") <= F.col("_f"))
    return table.join(F.broadcast(bounds)).filter(few).drop("n_msgs", "following", "any_verified", "follower_ratio", "_p", "_f")


def account_behaviour(posts: DataFrame, dup: DataFrame) -> DataFrame:
    """One row of figures on accounts; ``dup`` has the duplicated texts."""
    table = cut(accounts(posts))
    bounds = percentiles(table, {"_p": ("lifetime_posts", 0.25), "_f": ("followers", 0.5), "_g": ("following", 0.5), "_l": ("lifetime_posts", 0.5)})
    few = (F.col("n_msgs") == 1) & (F.col("lifetime_posts") <= F.col("_p")) & (F.col("followers") <= F.col("_f"))
    figures = table.join(F.broadcast(bounds)).agg(
        F.count(F.lit(1)).alias("n_accounts"),
        pct(F.count_if(F.col("n_msgs") == 1), F.count(F.lit(1))).alias("single_message_share_pct"),
        *(F.round(F.max(b), 1).alias(f"median_{name}") for b, name in (("_f", "followers"), ("_g", "following"), ("_l", "posts"))),
        pct(F.count_if(F.col("following") > F.col("followers")), F.count(F.lit(1))).alias("following_over_followers_share_pct"), F.count_if(few).alias("low_footprint_amplifiers"),
    )
    keys = cut(dup.select(text_key("text").alias("k"), "n", F.lit(True).alias("_dup")))
    rows = posts.groupBy(text_key("text").alias("k"), "author").agg(F.count(F.lit(1)).alias("c"), F.count_if("verified").alias("v"))
    copied = lookup_join(rows, keys, ["k"], "n", "author").filter("_dup").groupBy("author").agg(F.sum("c").alias("n"), F.sum("v").alias("v"))
    copied = copied.agg(F.count(F.lit(1)).alias("n_accounts_posting_duplicated_text"), pct(F.sum("v"), F.sum("n")).alias("verified_share_among_duplicators_pct"))
    return figures.join(F.broadcast(copied)).withColumn("low_footprint_amplifiers_pct", pct(F.col("low_footprint_amplifiers"), F.col("n_accounts")))


def sample(posts: DataFrame, contains: str | None = None, author: str | None = None, amplified: str | None = None, engagement: str | None = None,
           sentiment: str | None = None, date_from: str | None = None, date_to: str | None = None, n: int = 5, sort: str = "reach") -> DataFrame:
    """The first ``n`` posts that meet all conditions, with ``n_matching``. ``sort``: reach, oldest or recent; ties by ``row_id``."""
    found = posts
    if contains:
        found = found.filter(F.contains("text", F.lit(contains.lower())))
    if author:
        found = found.filter(F.lower("author") == author.lower())
    if amplified:
        found = found.filter(F.lower("repost_handle") == amplified.lower())
    if engagement:
        found = found.filter(F.upper("engagement") == engagement.upper())
    if sentiment:
        found = found.filter(F.lower("sentiment") == sentiment.lower())
    if date_from:
        found = found.filter(F.col("ts") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        found = found.filter(F.col("ts") <= F.lit(date_to).cast("timestamp_ntz"))
    order = {"reach": F.desc("reach"), "oldest": F.asc("ts")}.get(sort, F.desc("ts"))
    whole = found.agg(F.count(F.lit(1)).alias("n_matching"))
    rows = found.orderBy(order, "row_id").limit(n)
    return rows.join(F.broadcast(whole)).select("row_id", "author", "ts", "engagement", F.substring("text_raw", 1, 280).alias("text"), "reach", "sentiment", F.col("repost_handle").alias("reposts"), "n_matching")


def known_handles(posts: DataFrame) -> DataFrame:
    """All handles that occur as author, relayed or answered account, lower-cased, without leading ``@``."""
    every = F.explode(F.array("author", "repost_handle", "reply_handle")).alias("handle")
    return posts.select(every).select(F.ltrim(F.lower("handle"), F.lit("@")).alias("handle")).filter("handle <> ''").distinct()
