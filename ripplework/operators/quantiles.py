"""Exact percentiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.plans.cluster import cut, tasks_of


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """One row with the percentile of each wanted (column, share), interpolated between the values around its rank; NULL without values.

    Values are counted, the counts range-partitioned, and the ranges' totals say in which range a rank lies; only such ranges are summed
    up value by value. NULL isn't a value.
    """
    fields = F.array(*(F.struct(F.lit(i).alias("f"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for i, (c, _) in enumerate(wanted.values())))
    counts = df.select(F.inline(fields)).filter("v IS NOT NULL").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counts.repartitionByRange(tasks_of(df.sparkSession), "f", "v").withColumn("p", F.spark_partition_id()))
    by = Window.partitionBy("f")
    parts = ranged.groupBy("f", "p").agg(F.sum("n").alias("s"))
    parts = parts.withColumn("before", F.sum("s").over(by.orderBy("p")) - F.col("s")).withColumn("total", F.sum("s").over(by))
    shares = F.create_map(*(F.lit(x) for i, (_, q) in enumerate(wanted.values()) for x in (i, float(q))))
    at = F.element_at(shares, F.col("f")) * (F.col("total") - 1)
    parts = parts.withColumn("at", at).withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at"))
    held = (F.col("before") <= F.col("hi")) & (F.col("before") + F.col("s") > F.col("lo"))
    rows = ranged.join(F.broadcast(parts.filter(held)), ["f", "p"])
    rows = rows.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("f", "p").orderBy("v")))

    def value(i: int) -> Column:
        own = F.col("f") == i
        low, high = (F.min(F.when(own & (F.col("upto") > F.col(rank)), F.col("v"))) for rank in ("lo", "hi"))
        place, least, most = (F.max(F.when(own, F.col(c))) for c in ("at", "lo", "hi"))
        return F.when((least == most) | (low == high), low).otherwise((most - place) * low + (place - least) * high)

    return rows.agg(*(value(i).alias(name) for i, name in enumerate(wanted)))
