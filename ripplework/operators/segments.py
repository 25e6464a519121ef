"""Metrics by segment, the cross-tabulation of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.functions.time import floor_to
from ripplework.operators.coordination import synchrony_by_key
from ripplework.operators.profile import low_footprint, pct

DIMENSIONS = ("sentiment", "engagement", "verified", "day", "hour")
METRICS = ("dup_rate", "synchrony_score", "verified_share", "low_footprint_share", "mean_reach", "mean_organic_engagement")
ALL_METRICS = ("volume", "share_pct", *METRICS)


def segmented(posts: DataFrame, by: str) -> DataFrame:
    if by not in DIMENSIONS:
        raise ValueError(f"unknown dimension {by}; known are {', '.join(DIMENSIONS)}")
    label = {
        "verified": F.when(F.col("verified"), "verified").otherwise("non_verifie"),
        "day": F.to_date("ts").cast("string"),
        "hour": floor_to("hour", "ts").cast("string"),
        "engagement": F.col("engagement"),
        "sentiment": F.coalesce("sentiment", F.lit("None")),
    }[by]
    return posts.withColumn("segment", label)


def breakdown(posts: DataFrame, by: str, min_dup: int = 2, delta: int = 60, min_seg: int = 30, top: int = 30, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each of the ``top`` largest segments with at least ``min_seg`` posts: ``segment`` and the ``metrics`` of ``ALL_METRICS``, by default all.
    Shares are of all posts; copies count within the segment. Unknown metrics are left out, ``ignored`` lists them; none known is an error.
    Only what the metrics need is computed."""
    known = [m for m in metrics or ALL_METRICS if m in ALL_METRICS]
    if not known:
        raise ValueError(f"unknown metrics {', '.join(metrics)}; known are {', '.join(ALL_METRICS)}")
    rows = segmented(posts, by)
    found = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("volume"), pct(F.count_if("verified"), F.count(F.lit(1))).alias("verified_share"),
        F.round(F.avg("reach"), 1).alias("mean_reach"), F.round(F.avg("organic"), 2).alias("mean_organic_engagement"),
    )
    found = found.filter(F.col("volume") >= min_seg).orderBy(F.desc("volume"), "segment").limit(top)
    if "share_pct" in known:
        whole = posts.agg(F.count(F.lit(1)).alias("_all"))
        found = found.join(F.broadcast(whole)).withColumn("share_pct", pct(F.col("volume"), F.col("_all")))
    if {"dup_rate", "synchrony_score"} & set(known):
        texts = synchrony_by_key(rows, delta, max(min_dup, 2), ("segment",)).groupBy("segment").agg(F.sum("copies").alias("c"), F.sum("within").alias("w"))
        found = found.join(texts, "segment", "left")
        found = found.withColumn("dup_rate", F.coalesce(pct(F.col("c"), F.col("volume")), F.lit(0.0))).withColumn("synchrony_score", F.coalesce(pct(F.col("w"), F.col("c")), F.lit(0.0)))
    if "low_footprint_share" in known:
        # such an author has one post, so its segment is found with its figures
        low = low_footprint(rows, F.max("segment").alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("l"))
        found = found.join(low, "segment", "left").withColumn("low_footprint_share", pct(F.coalesce("l", F.lit(0)), F.col("volume")))
    return found.select("segment", *known)


def ignored(metrics: tuple[str, ...]) -> list[str]:
    """The metrics that ``breakdown`` leaves out."""
    return [m for m in metrics if m not in ALL_METRICS]


def gaps(table: DataFrame) -> DataFrame:
    """For each metric its greatest and least segment and the spread between them; of equal ones the lesser label. One segment: no rows."""
    if not set(METRICS) & set(table.columns):
        return table.sparkSession.createDataFrame([], "metric string, max_segment string, max double, min_segment string, min double, spread double")
    long = table.select("segment", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS if m in table.columns)))).filter("v IS NOT NULL")
    found = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("v")).alias("v"), "segment")).alias("hi"), F.min(F.struct("v", "segment")).alias("lo")).filter("n > 1")
    return found.select("metric", F.col("hi.segment").alias("max_segment"), (-F.col("hi.v")).alias("max"), F.col("lo.segment").alias("min_segment"), F.col("lo.v").alias("min"), F.round(-F.col("hi.v") - F.col("lo.v"), 2).alias("spread"))
