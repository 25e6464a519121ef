"""Queries on the course of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.operators import timeseries as ts
from ripplework.plans.base_sql import sql
from ripplework.sources.posts import read_posts
from ripplework.streaming import posts as live


def _q(f):
    return lambda spark, sf: f(read_posts(spark, sf))


def _live(f, keys):
    return lambda spark, sf: live.latest(f(live.post_stream(spark, sf)), keys)


QUERIES = {
    "timeline_daily": _q(lambda p: ts.series(p, "D")),
    "timeline_hourly": _q(lambda p: ts.series(p, "h")),
    "timeline_weekly": _q(lambda p: ts.series(p, "W")),
    "timeline_reach": _q(lambda p: ts.series(p, "D", "reach")),
    "timeline_impressions": _q(lambda p: ts.series(p, "D", "impressions")),
    "timeline_window": _q(lambda p: ts.series(ts.window(p, "2025-09-08", "2025-09-22"), "h")),
    "timeline_zero_filled": _q(lambda p: ts.filled(ts.series(p, "h"), "h")),
    "volume_reach_hourly": _q(lambda p: ts.window(p, "2025-09-08", "2025-09-12").groupBy(ts.period("h").alias("period")).agg(F.count(F.lit(1)).alias("volume"), F.sum("reach").cast("long").alias("reach"))),
    "top_peaks": _q(lambda p: ts.peaks(ts.series(p, "D"))),
    "hourly_around_peak": _q(ts.around_peak),
    "patient_zero": _q(ts.patient_zero),
    "amplified_onsets": _q(ts.onsets),
    "velocity": _q(ts.velocity),
    "reach_volume_lead": _q(ts.reach_lead),
    "sentiment_pivot": _q(ts.sentiments),
    "sentiment_dynamics": _q(ts.sentiment_dynamics),
    "stream_hourly": _live(live.hourly, ["period"]),
    "stream_minute_bursts": _live(live.minute_bursts, ["minute", "text"]),
    "stream_first_deliveries": lambda spark, sf: live.latest(live.first_deliveries(live.post_stream(spark, sf)).withColumn("n", F.lit(1)), ["id"], "append").select("id"),
}

_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"
_HOUR = "CAST(date_trunc('hour', ts) AS TIMESTAMP)"
_SERIES = "\nd AS (SELECT " + _DAY + " AS period, count(*) AS value FROM p GROUP BY 1)"
_GRID = """
h0 AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, count(*) AS volume, CAST(sum(reach) AS BIGINT) AS reach FROM p GROUP BY 1),
h AS (
  SELECT s.period, coalesce(volume, 0) AS volume, coalesce(reach, 0) AS reach, row_number() OVER (ORDER BY s.period) - 1 AS pos
  FROM (SELECT unnest(generate_series((SELECT min(period) FROM h0), (SELECT max(period) FROM h0), INTERVAL 1 HOUR)) AS period) s LEFT JOIN h0 USING (period)
)"""
_SENT = """
s AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(id) FILTER (WHERE sentiment = 'negative') AS negative, count(id) FILTER (WHERE sentiment = 'neutral') AS neutral,
    count(id) FILTER (WHERE sentiment = 'positive') AS positive, count(id) AS volume, round(count(id) FILTER (WHERE sentiment = 'negative') * 100.0 / nullif(count(id), 0), 1) AS negative_share_pct
  FROM p WHERE sentiment IS NOT NULL GROUP BY 1 HAVING count(id) > 0
)"""
SQL = {
    "timeline_daily": sql(f"SELECT {_DAY} AS period, count(*) AS value FROM p GROUP BY 1"),
    "timeline_hourly": sql(f"SELECT {_HOUR} AS period, count(*) AS value FROM p GROUP BY 1"),
    "timeline_weekly": sql("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 6 DAYS AS period, count(*) AS value FROM p GROUP BY 1"),
    "timeline_reach": sql(f"SELECT {_DAY} AS period, CAST(sum(reach) AS BIGINT) AS value FROM p GROUP BY 1 HAVING sum(reach) <> 0"),
    "timeline_impressions": sql(f"SELECT {_DAY} AS period, CAST(sum(impressions) AS BIGINT) AS value FROM p GROUP BY 1 HAVING sum(impressions) <> 0"),
    "timeline_window": sql(f"SELECT {_HOUR} AS period, count(*) AS value FROM p WHERE ts >= TIMESTAMP '2025-09-08' AND ts <= TIMESTAMP '2025-09-22' GROUP BY 1"),
    "timeline_zero_filled": sql("SELECT period, volume AS value FROM h", _GRID),
    "volume_reach_hourly": sql(f"SELECT {_HOUR} AS period, count(*) AS volume, CAST(sum(reach) AS BIGINT) AS reach FROM p WHERE ts >= TIMESTAMP '2025-09-08' AND ts <= TIMESTAMP '2025-09-12' GROUP BY 1"),
    "top_peaks": sql("SELECT * FROM d ORDER BY value DESC, period LIMIT 5", _SERIES),
    "hourly_around_peak": sql(f"""
SELECT {_HOUR} AS period, count(*) AS volume, CAST(sum(reach) AS BIGINT) AS reach FROM p, (SELECT period AS day FROM d ORDER BY value DESC, period LIMIT 1)
WHERE ts >= day AND ts < day + INTERVAL 2 DAYS GROUP BY 1""", _SERIES),
    "patient_zero": sql("SELECT ts, row_id, author, engagement, substr(text_raw, 1, 280) AS text FROM p ORDER BY ts, row_id LIMIT 1"),
    "amplified_onsets": sql("SELECT repost_handle, count(*) AS total, min(ts) AS first_relay FROM p WHERE repost_handle IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "velocity": sql("""
SELECT peak_period, peak_volume, onset_period, onset_volume, CAST(peak_pos - onset_pos AS DOUBLE) AS time_to_peak_hours, round(g * 100, 2) AS growth_pct_per_hour,
  round(CASE WHEN g > 0 THEN ln(2.0) / ln(1 + g) END, 2) AS doubling_time_hours, CAST(half_pos - peak_pos AS DOUBLE) AS half_life_hours, core_hours
FROM (SELECT *, CASE WHEN peak_pos > onset_pos THEN pow(peak_volume / onset_volume, 1.0 / (peak_pos - onset_pos)) - 1 END AS g FROM (
  SELECT k.period AS peak_period, k.volume AS peak_volume, k.pos AS peak_pos, arg_min(h.period, h.pos) FILTER (WHERE h.volume >= 0.1 * k.volume AND h.pos <= k.pos) AS onset_period,
    arg_min(h.volume, h.pos) FILTER (WHERE h.volume >= 0.1 * k.volume AND h.pos <= k.pos) AS onset_volume, min(h.pos) FILTER (WHERE h.volume >= 0.1 * k.volume AND h.pos <= k.pos) AS onset_pos,
    min(h.pos) FILTER (WHERE h.volume <= 0.5 * k.volume AND h.pos >= k.pos) AS half_pos, count(*) FILTER (WHERE h.volume >= 0.5 * k.volume) AS core_hours
  FROM h, (SELECT * FROM h ORDER BY volume DESC, pos LIMIT 1) k GROUP BY 1, 2, 3 HAVING count(*) >= 2))""", _GRID),
    "reach_volume_lead": sql("""
SELECT b.period AS reach_peak_period, b.reach AS reach_peak_value, a.period AS volume_peak_period, b.pos - a.pos AS lead_bins
FROM (SELECT * FROM h ORDER BY volume DESC, pos LIMIT 1) a, (SELECT * FROM h ORDER BY reach DESC, pos LIMIT 1) b WHERE b.reach > 0""", _GRID),
    "sentiment_pivot": sql("SELECT * FROM s", _SENT),
    "sentiment_dynamics": sql("""
SELECT a.period AS peak_volume_period, a.negative_share_pct AS negative_share_on_peak_pct, (SELECT round(sum(negative) * 100.0 / (SELECT count(*) FROM p), 1) FROM s) AS negative_share_overall_pct,
  b.period AS most_negative_period, b.negative_share_pct AS most_negative_share_pct
FROM (SELECT * FROM s ORDER BY volume DESC, period LIMIT 1) a, (SELECT * FROM s ORDER BY negative_share_pct DESC, period LIMIT 1) b""", _SENT),
    "stream_hourly": sql(f"SELECT {_HOUR} AS period, count(*) AS volume, CAST(sum(reach) AS BIGINT) AS reach FROM p GROUP BY 1"),
    "stream_minute_bursts": sql("SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, text, count(*) AS n FROM p GROUP BY 1, 2"),
    "stream_first_deliveries": sql("SELECT DISTINCT id FROM p WHERE id IS NOT NULL"),
}
