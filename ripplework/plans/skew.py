"""Queries of problem 5: a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.text import handle, url_handle
from ripplework.operators.balance import SLOT, match_rows, top_rows


def post_handles(posts: DataFrame, *keep: str) -> DataFrame:
    """One row for each post and field of it that holds a handle: ``author``, and ``handle`` for the relayed account."""
    fields = F.array(
        F.struct(F.lit("author").alias("field"), handle("author").alias("handle")),
        F.struct(F.lit("handle").alias("field"), handle(url_handle("x_repost_of")).alias("handle")),
    )
    return posts.select(*keep, F.inline(fields)).filter(F.col("handle").isNotNull())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = post_handles(spark.read.parquet(f"{sf}/posts.parquet"), "row_id", "reach").filter("reach IS NOT NULL")
    return top_rows(rows, ["field", "handle"], [F.desc("reach"), F.asc("row_id")], 3, "row_id").select("field", "handle", "row_id")


def p5_account_reach(spark: SparkSession, sf: str) -> DataFrame:
    """For each handle its posts, their reach, and how many of them reached more people than follow the account."""
    rows = post_handles(spark.read.parquet(f"{sf}/posts.parquet"), "row_id", "reach")
    accounts = spark.read.parquet(f"{sf}/accounts.parquet").select(handle("author").alias("handle"), "x_followers").filter("handle IS NOT NULL")
    accounts = accounts.groupBy("handle").agg(F.max("x_followers").alias("followers"))
    accounts = accounts.select(F.explode(F.array(F.lit("author"), F.lit("handle"))).alias("field"), "handle", "followers")
    met, _ = match_rows(rows, accounts, ["field", "handle"], "row_id")
    sums = [F.count(F.lit(1)).alias("n_posts"), F.sum(F.coalesce("reach", F.lit(0.0))).alias("total_reach"), F.max("followers").alias("followers"), F.count_if(F.col("reach") > F.col("followers")).alias("n_beyond_followers")]
    shards = met.groupBy(SLOT, "field", "handle").agg(*sums)
    return shards.groupBy("field", "handle").agg(F.sum("n_posts").alias("n_posts"), F.sum("total_reach").alias("total_reach"), F.max("followers").alias("followers"), F.sum("n_beyond_followers").alias("n_beyond_followers"))


_HANDLES = r"""
WITH named AS (
  SELECT row_id, reach, 'author' AS field, lower(regexp_replace(author, '^[\s\p{Z}]*@*|[\s\p{Z}]+$', '', 'g')) AS handle FROM posts
  UNION ALL
  SELECT row_id, reach, 'handle', lower(regexp_replace(regexp_extract(x_repost_of, 'twitter\.com/([^/]+)/status', 1), '^[\s\p{Z}]*@*|[\s\p{Z}]+$', '', 'g')) FROM posts
), h AS (SELECT * FROM named WHERE handle <> '')
"""

QUERIES = {"p5_found": p5_found, "p5_account_reach": p5_account_reach}
SQL = {
    "p5_found": _HANDLES + """
SELECT field, handle, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY field, handle ORDER BY reach DESC, row_id) AS k FROM h WHERE reach IS NOT NULL
) WHERE k <= 3""",
    "p5_account_reach": _HANDLES + r""", a AS (
  SELECT lower(regexp_replace(author, '^[\s\p{Z}]*@*|[\s\p{Z}]+$', '', 'g')) AS handle, max(x_followers) AS followers FROM accounts GROUP BY 1
)
SELECT field, h.handle, CAST(count(*) AS BIGINT) AS n_posts, sum(coalesce(reach, 0.0)) AS total_reach, max(followers) AS followers,
  CAST(count(*) FILTER (WHERE reach > followers) AS BIGINT) AS n_beyond_followers
FROM h LEFT JOIN a ON h.handle = a.handle GROUP BY 1, 2""",
}
