"""Series over time: bins, peaks, onset, growth and decline. A series has ``period`` and ``value``; bins are few, so windows over a
series are small whatever the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.functions.time import floor_to
from ripplework.operators.profile import pct

UNITS = {"D": "day", "h": "hour", "W": "week"}
STEP = {"D": "1 day", "h": "1 hour", "W": "7 days"}


def window(posts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Posts from ``start`` to ``end``, both included; a date alone is its midnight."""
    if start:
        posts = posts.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return posts.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else posts


def period(freq: str, ts: str = "ts") -> Column:
    """The bin of a time; weeks are named by their Sunday."""
    if freq not in UNITS:
        raise ValueError(f"freq must be one of {', '.join(UNITS)}")
    start = floor_to(UNITS[freq], ts)
    return start + F.expr("INTERVAL 6 DAYS") if freq == "W" else start


def series(posts: DataFrame, freq: str = "D", weight: str = "count", keys: tuple[str, ...] = ()) -> DataFrame:
    """Posts, or the sum of a figure, in each bin; bins at 0 left out. A weight that isn't ``reach`` or ``impressions`` counts posts."""
    value = F.sum(weight).cast("long") if weight in ("reach", "impressions") else F.count(F.lit(1))
    return posts.groupBy(*keys, period(freq).alias("period")).agg(value.alias("value")).filter("value <> 0")


def filled(binned: DataFrame, freq: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """The series with its empty bins at 0."""
    ends = binned.agg(F.min("period").alias("a"), F.max("period").alias("b")).filter("a IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {STEP[freq]}"))).alias("period"))
    return spine.join(binned, "period", "left").select("period", *(F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in values))


def peaks(binned: DataFrame, k: int = 5) -> DataFrame:
    return binned.orderBy(F.desc("value"), "period").limit(k)


def patient_zero(posts: DataFrame) -> DataFrame:
    """The earliest post; of several the one with the least ``row_id``."""
    first = F.min(F.struct("ts", "row_id", "author", "engagement", F.substring("text_raw", 1, 280).alias("text"))).alias("p")
    return posts.agg(first).filter("p IS NOT NULL").select("p.*")


def onsets(posts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most relayed handles with their first relay, earliest first."""
    found = posts.filter("repost_handle IS NOT NULL").groupBy("repost_handle").agg(F.count(F.lit(1)).alias("total"), F.min("ts").alias("first_relay"))
    return found.orderBy(F.desc("total"), "repost_handle").limit(k).orderBy("first_relay", "repost_handle")


def velocity(posts: DataFrame) -> DataFrame:
    """One row on the hourly volume: peak, onset (first hour of a tenth of it), growth, doubling time, half-life, core hours.

    Fewer than two bins: no row.
    """
    hourly = filled(series(posts, "h"), "h")
    at = F.row_number().over(Window.orderBy("period")) - 1
    bins = hourly.withColumn("pos", at)
    peak = bins.agg(F.min(F.struct((-F.col("value")).alias("v"), "pos", "period"))["pos"].alias("peak_pos"), F.max("value").alias("peak_volume"), F.count(F.lit(1)).alias("n_bins"))
    bins = bins.join(F.broadcast(peak))
    rise = (F.col("value") >= 0.1 * F.col("peak_volume")) & (F.col("pos") <= F.col("peak_pos"))
    fall = (F.col("value") <= 0.5 * F.col("peak_volume")) & (F.col("pos") >= F.col("peak_pos"))
    found = bins.groupBy("peak_pos", "peak_volume", "n_bins").agg(
        F.min(F.when(F.col("pos") == F.col("peak_pos"), F.col("period"))).alias("peak_period"),
        F.min(F.when(rise, F.struct("pos", "period", "value"))).alias("onset"),
        F.min(F.when(fall, F.col("pos"))).alias("half_pos"),
        F.count_if(F.col("value") >= 0.5 * F.col("peak_volume")).alias("core_hours"),
    )
    ramp = F.col("peak_pos") - F.col("onset.pos")
    growth = F.when(ramp > 0, F.pow(F.col("peak_volume") / F.col("onset.value"), 1 / ramp) - 1)
    found = found.filter("n_bins >= 2").withColumn("g", growth)
    return found.select(
        "peak_period", "peak_volume", F.col("onset.period").alias("onset_period"), F.col("onset.value").alias("onset_volume"),
        ramp.cast("double").alias("time_to_peak_hours"), F.round(F.col("g") * 100, 2).alias("growth_pct_per_hour"),
        F.round(F.when(F.col("g") > 0, F.log(F.lit(2.0)) / F.log(1 + F.col("g"))), 2).alias("doubling_time_hours"),
        (F.col("half_pos") - F.col("peak_pos")).cast("double").alias("half_life_hours"), "core_hours",
    )


def reach_lead(posts: DataFrame, freq: str = "h") -> DataFrame:
    """Peak of reach and of volume on one grid, and by how many bins reach is later. No reach at all: no row."""
    binned = posts.groupBy(period(freq).alias("period")).agg(F.count(F.lit(1)).alias("volume"), F.sum("reach").cast("long").alias("reach"))
    bins = filled(binned, freq, ("volume", "reach")).withColumn("pos", F.row_number().over(Window.orderBy("period")) - 1)
    by = {v: F.min(F.struct((-F.col(v)).alias("v"), "pos", "period")) for v in ("volume", "reach")}
    found = bins.agg(by["volume"].alias("a"), by["reach"].alias("b")).filter("b.v < 0")
    return found.select(F.col("b.period").alias("reach_peak_period"), (-F.col("b.v")).alias("reach_peak_value"), F.col("a.period").alias("volume_peak_period"), (F.col("b.pos") - F.col("a.pos")).cast("long").alias("lead_bins"))


def sentiments(posts: DataFrame, freq: str = "D") -> DataFrame:
    """Posts by bin and sentiment (weeks by their Monday), the bin's volume and negative share."""
    start = floor_to(UNITS[freq], "ts").alias("period")
    each = {s: F.count_if((F.col("sentiment") == s) & F.col("id").isNotNull()) for s in ("negative", "neutral", "positive")}
    found = posts.filter("sentiment IS NOT NULL").groupBy(start).agg(*(c.alias(s) for s, c in each.items()), F.count("id").alias("volume"))
    return found.filter("volume > 0").withColumn("negative_share_pct", pct(F.col("negative"), F.col("volume")))


def sentiment_dynamics(posts: DataFrame, freq: str = "D") -> DataFrame:
    """One row: the bin of most posts, its negative share, that of all posts, and the bin with the greatest (the first of several)."""
    bins = sentiments(posts, freq)
    whole = posts.agg(F.count(F.lit(1)).alias("_all"))
    found = bins.agg(
        F.min(F.struct((-F.col("volume")).alias("v"), "period", "negative_share_pct")).alias("peak"),
        F.min(F.struct((-F.col("negative_share_pct")).alias("s"), "period")).alias("most"), F.sum("negative").alias("_neg"),
    ).filter("peak IS NOT NULL")
    return found.join(F.broadcast(whole)).select(
        F.col("peak.period").alias("peak_volume_period"), F.col("peak.negative_share_pct").alias("negative_share_on_peak_pct"),
        pct(F.col("_neg"), F.col("_all")).alias("negative_share_overall_pct"), F.col("most.period").alias("most_negative_period"), (-F.col("most.s")).alias("most_negative_share_pct"),
    )


def around_peak(posts: DataFrame, days: int = 2) -> DataFrame:
    """Hourly volume and reach of the ``days`` days from the day of most posts on."""
    day = peaks(series(posts, "D"), 1).select(F.col("period").alias("_day"))
    near = posts.join(F.broadcast(day)).filter((F.col("ts") >= F.col("_day")) & (F.col("ts") < F.col("_day") + F.expr(f"INTERVAL {days} DAYS")))
    return near.groupBy(period("h").alias("period")).agg(F.count(F.lit(1)).alias("volume"), F.sum("reach").cast("long").alias("reach"))
