"""Reading a post table of any layout into canonical roles."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.text import URL_HANDLE, url_handle

#: Fixed values of the vocabulary.
RETWEET, REPLY, ORIGINAL = "RETWEET", "REPLY", "ORIGINAL"
VERIFIED = ("true", "1", "1.0", "yes")


@dataclass(frozen=True)
class RoleMap:
    """The physical column of each role; None or a column that isn't there leaves the role unmapped."""

    row_id: str | None = "row_id"
    id: str | None = "post_id"
    ts: str | None = "posted_at"
    author: str | None = "author"
    text_raw: str | None = "full_text"
    text: str | None = "message_normalizer"
    engagement: str | None = "engagement_type"
    repost_url: str | None = "x_repost_of"
    reply_to: str | None = "x_reply_to"
    sentiment: str | None = "sentiment"
    verified: str | None = "x_verified"
    followers: str | None = "x_followers"
    following: str | None = "x_following"
    lifetime_posts: str | None = "x_posts"
    reach: str | None = "reach"
    impressions: str | None = "impressions"
    likes: str | None = "likes"
    comments: str | None = "comments"
    shares: str | None = "shares"
    url_pattern: str = field(default=URL_HANDLE)
    verified_values: tuple[str, ...] = VERIFIED

    def mapped(self, df: DataFrame) -> set[str]:
        return {f.name for f in fields(self) if isinstance(getattr(self, f.name), str) and getattr(self, f.name) in df.columns}


def project(df: DataFrame, roles: RoleMap = RoleMap()) -> DataFrame:
    """The canonical roles of ``df``: typed columns, posts without a readable time dropped, handles taken from URLs.

    Unreadable figures are NULL. Without its column a text role is NULL (``text`` is empty), ``verified`` is false, a count
    of reactions 0. A missing engagement is ORIGINAL.
    """
    there = roles.mapped(df)

    def of(role: str, kind: str = "string") -> Column:
        return df[getattr(roles, role)] if role in there else F.lit(None).cast(kind)

    def number(role: str) -> Column:
        return F.nullif(of(role).try_cast("double"), F.lit(float("nan")))

    ts = of("ts", "timestamp_ntz")
    out = df.select(
        of("row_id").cast("long").alias("row_id"),
        of("id").cast("string").alias("id"),
        ts.try_cast("timestamp_ntz").alias("ts"),
        of("author").cast("string").alias("author"),
        of("text_raw").cast("string").alias("text_raw"),
        F.coalesce(of("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(of("engagement").cast("string"), F.lit(ORIGINAL)).alias("engagement"),
        url_handle(of("repost_url").cast("string"), roles.url_pattern).alias("repost_handle"),
        url_handle(of("reply_to").cast("string"), roles.url_pattern).alias("reply_handle"),
        of("sentiment").cast("string").alias("sentiment"),
        F.coalesce(F.lower(of("verified").cast("string")).isin(*roles.verified_values), F.lit(False)).alias("verified"),
        *(number(r).alias(r) for r in ("followers", "following", "lifetime_posts")),
        *(F.coalesce(number(r), F.lit(0.0)).alias(r) for r in ("reach", "impressions", "likes", "comments", "shares")),
    )
    return out.filter("ts IS NOT NULL").withColumn("organic", F.col("likes") + F.col("comments") + F.col("shares"))


def read_posts(spark: SparkSession, sf: str, roles: RoleMap = RoleMap()) -> DataFrame:
    return project(spark.read.parquet(f"{sf}/posts.parquet"), roles)


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table from parquet, CSV (with a header), JSON lines or ORC, by ``kind`` or the file's ending."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown kind of table: {kind}")
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.options(**({"header": True} if kind == "csv" else {}) | options).mode(mode).format(kind).save(path)
