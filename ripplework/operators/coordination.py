"""Signals of coordination: copies, synchronised copies, anchored windows.

Copies are first counted by text and second. A text that a third of all posts share is thus as many rows as it has different
seconds, and all that follows works on these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.functions.text import text_key
from ripplework.functions.time import date_of, floor_to, seconds
from ripplework.operators.profile import pct
from ripplework.plans.cluster import cut, lookup_join
from ripplework.sources.posts import REPLY, RETWEET


def dup_texts(posts: DataFrame, min_dup: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Texts, blank ones left out, that occur at least ``min_dup`` times (within each of ``keys``)."""
    return posts.filter("text <> ''").groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_dup)


def duplication(posts: DataFrame, min_dup: int = 5) -> DataFrame:
    """One row: how many texts are duplicated, the share of all posts they make up, how much of it are retweets, and the share of copies among
    posts that aren't retweets or replies (two of a text are enough there). One grouping by text serves all figures."""
    kind = F.upper("engagement")
    own = ~kind.isin(RETWEET, REPLY)
    texts = posts.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == RETWEET).alias("rt"), F.count_if(own).alias("own"))
    full, dup = F.col("text") != "", (F.col("text") != "") & (F.col("n") >= min_dup)
    figures = texts.agg(
        F.count_if(dup).alias("n_distinct_duplicated_texts"), F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("d"), F.sum(F.when(dup, F.col("rt"))).alias("rt"),
        F.sum(F.when(full & (F.col("own") >= 2), F.col("own"))).alias("cp"), F.sum("own").alias("own"), F.sum("n").alias("n"),
    )
    return figures.filter("n > 0").select(
        "n_distinct_duplicated_texts", pct(F.col("d"), F.col("n")).alias("verbatim_duplication_rate_pct"),
        F.coalesce(pct(F.col("rt"), F.col("d")), F.lit(0.0)).alias("retweet_share_of_duplicated_pct"), F.coalesce(pct(F.col("cp"), F.col("own")), F.lit(0.0)).alias("copy_paste_rate_pct"),
    )


def minute_bursts(posts: DataFrame, least: int = 3, k: int | None = 15) -> DataFrame:
    """Copies of one text (the empty one too) within one minute; the ``k`` greatest, all of them with None."""
    found = posts.groupBy(floor_to("minute", "ts").alias("minute"), "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return found if k is None else found.orderBy(F.desc("n"), "minute", "text").limit(k)


def text_seconds(posts: DataFrame, min_dup: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``k`` (the text's key), ``sec`` and ``c``, the copies of duplicated texts by second. No text is shuffled."""
    rows = posts.filter("text <> ''").groupBy(*keys, text_key("text").alias("k"), seconds("ts").alias("sec")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys, "k"))
    return rows.withColumn("_n", total).filter(F.col("_n") >= min_dup).drop("_n")


def synchrony_by_key(posts: DataFrame, delta: int = 60, min_dup: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each duplicated text, by its key ``k``: copies, those with another at most ``delta`` seconds away, median gap, life span, and the copies one
    would expect within ``delta`` if all were spread evenly over it. Different gaps of a text add up to its life span at most, so the median looks at no
    more values than the root of twice the span in seconds, however many copies there are."""
    at = Window.partitionBy(*keys, "k").orderBy("sec")
    rows = text_seconds(posts, min_dup, keys).withColumn("before", F.col("sec") - F.lag("sec").over(at)).withColumn("after", F.lead("sec").over(at) - F.col("sec"))
    near = (F.col("c") > 1) | (F.least("before", "after") <= delta)
    gaps = F.array(F.struct(F.col("before").alias("gap"), F.lit(1).cast("long").alias("w")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("c") - 1).alias("w")))
    rows = rows.select(*keys, "k", "sec", "c", near.alias("near"), F.posexplode(gaps).alias("i", "g"))
    one = F.col("i") == 0
    found = rows.groupBy(*keys, "k").agg(
        F.sum(F.when(one, F.col("c"))).alias("copies"), F.coalesce(F.sum(F.when(one & F.col("near"), F.col("c"))), F.lit(0)).alias("within"),
        F.percentile("g.gap", 0.5, F.when(F.col("g.gap").isNotNull(), F.col("g.w")).otherwise(0)).alias("median_gap"), (F.max("sec") - F.min("sec")).alias("span"),
    )
    n = F.col("copies")
    even = F.when(F.col("span") > 0, (1 - F.pow(F.greatest(F.lit(0.0), 1 - 2.0 * delta / F.col("span")), n - 1)) * n).otherwise(n.cast("double"))
    return found.withColumn("expected", F.when(n >= 2, even).otherwise(0.0)).withColumn("within_pct", pct(F.col("within"), n))


def synchrony_per_text(posts: DataFrame, delta: int = 60, min_dup: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``synchrony_by_key`` with the texts."""
    texts = dup_texts(posts, min_dup, keys).select(*keys, "text", text_key("text").alias("k"))
    return synchrony_by_key(posts, delta, min_dup, keys).join(texts, [*keys, "k"]).drop("k")


def synchrony(posts: DataFrame, delta: int = 60, min_dup: int = 5) -> DataFrame:
    """One row: observed and expected share of copies within ``delta`` seconds of another, and their ratio."""
    figures = synchrony_by_key(posts, delta, min_dup).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies_considered"), F.coalesce(F.sum("within"), F.lit(0)).alias("copies_within_delta"), F.sum("expected").alias("e"))
    n = F.nullif("copies_considered", F.lit(0))
    seen, even = F.col("copies_within_delta") / n * 100, F.col("e") / n * 100
    return figures.select(
        "copies_considered", "copies_within_delta", F.coalesce(F.round(seen, 1), F.lit(0.0)).alias("coordination_score_pct"),
        F.coalesce(F.round(even, 1), F.lit(0.0)).alias("expected_within_delta_uniform_pct"), F.round(seen / F.nullif(even, F.lit(0.0)), 1).alias("synchrony_lift_vs_uniform"),
    )


def top_synchronized(posts: DataFrame, delta: int = 60, min_dup: int = 5, k: int = 15) -> DataFrame:
    """The ``k`` duplicated texts with the greatest share of copies within ``delta`` seconds of another, of equal shares those with more copies."""
    found = synchrony_per_text(posts, delta, min_dup).orderBy(F.desc(F.col("within") / F.col("copies")), F.desc("copies"), "text").limit(k)
    return found.select(F.substring("text", 1, 120).alias("text"), "copies", F.col("within_pct").alias("within_delta_pct"), F.round("median_gap", 1).alias("median_inter_arrival_seconds"))


def _anchors(delta: int):
    """The anchor of each second: the first of its window, which holds what is at most ``delta`` after it. One step a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, stretch, sec = batch.column("k").to_numpy(zero_copy_only=False), batch.column("stretch").to_numpy(), batch.column("sec").to_numpy()
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])
            new[0] = last != (key[0], stretch[0])
            found, starts = np.empty(n, np.int64), np.flatnonzero(new)
            for start, end in zip([0, *starts[starts > 0]], [*starts[starts > 0], n]):
                at = start
                if not new[start]:
                    at = start + int(np.searchsorted(sec[start:end], anchor + delta, "right"))
                    found[start:at] = anchor
                while at < end:
                    anchor = sec[at]
                    stop = at + int(np.searchsorted(sec[at:end], anchor + delta, "right"))
                    found[at:stop] = anchor
                    at = stop
            last = (key[-1], stretch[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "anchor"])

    return run


def _anchored(rows: DataFrame, delta: int) -> DataFrame:
    """``k``, ``sec``, ``c`` and ``anchor`` of the seconds of each key ``k``. A window starts with the first copy after the one before.

    A copy more than ``delta`` after the last starts a window in any case, so the stretches between such gaps are folded
    apart from each other, and one text can be many tasks' work.
    """
    at = Window.partitionBy("k").orderBy("sec")
    gap = F.col("sec") - F.lag("sec").over(at)
    rows = rows.withColumn("stretch", F.max(F.when(gap.isNull() | (gap > delta), F.col("sec"))).over(at))
    rows = rows.select("k", "stretch", "sec", "c").repartition("k", "stretch").sortWithinPartitions("k", "stretch", "sec")
    return rows.mapInArrow(_anchors(delta), "k binary, stretch long, sec long, c long, anchor long").drop("stretch")


def _copies(posts: DataFrame, min_dup: int) -> tuple[DataFrame, DataFrame]:
    """The duplicated texts (``k``, ``text``, ``n``), and their copies by second (``k``, ``sec``, ``c``)."""
    texts = cut(dup_texts(posts, min_dup).withColumn("k", text_key("text")))
    rows = posts.filter("text <> ''").groupBy(text_key("text").alias("k"), seconds("ts").alias("sec")).agg(F.count(F.lit(1)).alias("c"))
    rows = lookup_join(rows, texts.select("k", "n", F.lit(True).alias("_dup")), ["k"], "n", "sec")
    return texts, rows.filter("_dup").drop("_dup")


def anchored_windows(posts: DataFrame, delta: int = 60, min_dup: int = 5) -> DataFrame:
    """``text``, ``anchor`` and the number of copies of each window."""
    texts, rows = _copies(posts, min_dup)
    found = _anchored(rows, delta).groupBy("k", "anchor").agg(F.sum("c").alias("n"))
    return lookup_join(found, texts.select("k", "n", "text"), ["k"], "n", "anchor").select("text", "anchor", "n")


def burst_sizes(posts: DataFrame, delta: int = 60, min_dup: int = 5) -> DataFrame:
    """For each day that starts a window of two or more copies: the largest one, and how many have three or more."""
    day = date_of("anchor").alias("day")
    found = _anchored(_copies(posts, min_dup)[1], delta).groupBy("k", "anchor").agg(F.sum("c").alias("n")).filter("n >= 2")
    return found.groupBy(day).agg(F.max("n").alias("max_burst"), F.count_if(F.col("n") >= 3).alias("n_bursts_ge3"))


def post_windows(posts: DataFrame, delta: int = 60, min_dup: int = 5) -> tuple[DataFrame, DataFrame]:
    """The duplicated texts (``k``, ``text``, ``n``), and the different authors of each anchored window (``k``, ``anchor``, ``author``)."""
    texts, rows = _copies(posts, min_dup)
    windows = _anchored(rows, delta).select("k", "sec", "anchor")
    posted = posts.filter("author IS NOT NULL AND text <> ''").groupBy(text_key("text").alias("k"), seconds("ts").alias("sec"), "author").agg(F.count(F.lit(1)).alias("c"))
    posted = lookup_join(posted, texts.select("k", "n", F.lit(True).alias("_dup")), ["k"], "n", "author").filter("_dup")
    return texts, posted.join(windows, ["k", "sec"]).groupBy("k", "anchor", "author").agg(F.sum("c").alias("c"))
