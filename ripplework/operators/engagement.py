"""Reactions against reach, replies, and dossiers of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.operators.profile import pct
from ripplework.operators.quantiles import percentiles


def _ratio(where: Column | None = None) -> Column:
    organic, reach = F.col("organic"), F.col("reach")
    if where is not None:
        organic, reach = F.when(where, organic), F.when(where, reach)
    return F.round(F.sum(organic) / F.nullif(F.sum(reach), F.lit(0.0)), 5)


def quality(posts: DataFrame, min_reach: int = 1, min_dup: int = 5) -> DataFrame:
    """One row on posts of at least ``min_reach``: reactions to reach overall, of duplicated and of other texts, median and 90th percentile of
    reach, and how many posts beyond the latter have no reaction."""
    seen = F.col("reach") >= min_reach
    texts = posts.groupBy("text").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(seen, F.col(c))).alias(c) for c in ("organic", "reach")))
    dup = (F.col("text") != "") & (F.col("n") >= min_dup)
    figures = texts.agg(_ratio().alias("organic_per_reach_overall"), _ratio(dup).alias("organic_per_reach_duplicated"), _ratio(~dup).alias("organic_per_reach_unique"))
    rows = posts.filter(seen)
    bounds = percentiles(rows, {"_m": ("reach", 0.5), "_p90": ("reach", 0.9)})
    far = rows.join(F.broadcast(bounds)).agg(
        F.coalesce(F.round(F.max("_m"), 1), F.lit(0.0)).alias("median_reach"), F.coalesce(F.round(F.max("_p90"), 1), F.lit(0.0)).alias("high_reach_threshold_p90"),
        F.count_if((F.col("reach") >= F.col("_p90")) & (F.col("organic") == 0)).alias("n_high_reach_zero_organic"),
    )
    return figures.join(F.broadcast(far))


def by_engagement(posts: DataFrame, min_reach: int = 1) -> DataFrame:
    """Reactions to reach by kind of engagement; NULL for kinds without a post of ``min_reach``."""
    return posts.groupBy("engagement").agg(_ratio(F.col("reach") >= min_reach).alias("organic_per_reach"))


def high_reach(posts: DataFrame, min_reach: int = 1) -> DataFrame:
    """Posts from the 90th percentile of reach (of those with ``min_reach``) on."""
    seen = posts.filter(F.col("reach") >= min_reach)
    return seen.join(F.broadcast(percentiles(seen, {"_p90": ("reach", 0.9)}))).filter("reach >= _p90").drop("_p90")


def anomalies(posts: DataFrame, min_reach: int = 1, k: int = 15) -> DataFrame:
    """The ``k`` far-reaching posts with the fewest reactions for their reach; ties by ``row_id``."""
    rows = high_reach(posts, min_reach).withColumn("organic_per_reach", F.col("organic") / F.col("reach"))
    rows = rows.orderBy("organic_per_reach", "row_id").limit(k)
    return rows.select("row_id", "author", "engagement", "reach", "organic", F.round("organic_per_reach", 6).alias("organic_per_reach"), F.substring("text_raw", 1, 160).alias("text"))


def _negative() -> Column:
    return F.count_if(F.lower("sentiment") == "negative")


def reply_summary(posts: DataFrame) -> DataFrame:
    to = posts.groupBy("reply_handle").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("reply_handle").isNotNull()
    found = to.agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_replies"), F.sum("n").alias("_all"), F.count_if(known).alias("n_distinct_reply_targets"))
    return found.select("n_replies", pct(F.col("n_replies"), F.col("_all")).alias("reply_share_pct"), "n_distinct_reply_targets")


def reply_targets(posts: DataFrame, k: int = 15) -> DataFrame:
    found = posts.filter("reply_handle IS NOT NULL").groupBy("reply_handle").agg(F.count(F.lit(1)).alias("n_replies_received"), pct(_negative(), F.count(F.lit(1))).alias("negative_share_pct"))
    return found.orderBy(F.desc("n_replies_received"), "reply_handle").limit(k)


def _named(c: str, handle: str) -> Column:
    return F.lower(c) == handle.lstrip("@").lower()


def actor(posts: DataFrame, handle: str) -> DataFrame:
    """One row on an account: what it wrote, how often others relayed and answered it, its figures. One pass over the posts."""
    own, relayed, answered = (F.coalesce(_named(c, handle), F.lit(False)) for c in ("author", "repost_handle", "reply_handle"))
    mine = lambda c: F.when(own, c)
    return posts.agg(
        F.lit(handle.lstrip("@")).alias("handle"), F.count_if(own).alias("n_messages_authored"), F.count_if(relayed).alias("n_times_content_reposted"),
        F.count_distinct(F.when(relayed, F.col("author"))).alias("n_distinct_relayers"), F.count_if(answered).alias("n_replies_received"),
        pct(F.count_if(answered & (F.lower("sentiment") == "negative")), F.count_if(answered)).alias("replies_received_negative_share_pct"),
        F.min(mine(F.col("ts"))).alias("first_seen"), F.max(mine(F.col("ts"))).alias("last_seen"), F.max(mine(F.col("followers"))).alias("followers"), F.max(mine(F.col("following"))).alias("following"),
        F.max(mine(F.col("lifetime_posts"))).alias("lifetime_posts"), F.bool_or(mine(F.col("verified"))).alias("verified"), F.sum(mine(F.col("reach"))).cast("long").alias("total_reach"),
    )


def actor_mix(posts: DataFrame, handle: str) -> DataFrame:
    """Counts of what an account does: by engagement, by sentiment, and whom it answers and relays (five of each)."""
    kinds = ("engagement", "sentiment", "reply_handle", "repost_handle")
    long = posts.filter(_named("author", handle)).select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds)))).filter("value IS NOT NULL")
    found = long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    return found.withColumn("_r", rank).filter((F.col("_r") <= 5) | F.col("kind").isin("engagement", "sentiment")).drop("_r")


def actor_messages(posts: DataFrame, handle: str, k: int = 5) -> DataFrame:
    """The account's furthest-reaching posts."""
    rows = posts.filter(_named("author", handle)).orderBy(F.desc("reach"), "row_id").limit(k)
    return rows.select("row_id", "ts", "engagement", F.col("reach").cast("long").alias("reach"), F.substring("text_raw", 1, 200).alias("text"))
