"""Streaming versions: posts arrive as files, results are kept up to date in a table of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.plans.cluster import ensure_checkpoint_dir
from ripplework.sources.posts import RoleMap, project


def post_stream(spark: SparkSession, sf: str, roles: RoleMap = RoleMap(), files_a_batch: int = 1000) -> DataFrame:
    """Canonical posts as a stream of parquet files."""
    schema = spark.read.parquet(f"{sf}/posts.parquet").schema
    posts = project(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf}/posts.parque[t]"), roles)
    return posts.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one


def latest(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over all that is there and return its newest row for each of ``keys``."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1)).write.parquet(f"{at}/rows/batch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/rows").drop("batch")
    values = [c for c in stream.columns if c not in keys]
    newest = F.max(F.struct("_batch", *values)).alias("_new")
    return rows.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_new.{c}").alias(c) for c in values))


def hourly(posts: DataFrame, late: str = "60 days") -> DataFrame:
    """Posts and reach of each hour; posts may come up to ``late`` after the newest one."""
    bins = posts.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    return bins.agg(F.count(F.lit(1)).alias("volume"), F.sum("reach").cast("long").alias("reach")).select(F.col("w.start").cast("timestamp_ntz").alias("period"), "volume", "reach")


def minute_bursts(posts: DataFrame, late: str = "60 days") -> DataFrame:
    """Copies of one text within one minute."""
    bins = posts.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "text")
    return bins.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "text", "n")


def first_deliveries(posts: DataFrame, late: str = "60 days") -> DataFrame:
    """The ids of posts, each once however often it was delivered within ``late``."""
    return posts.filter("id IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).select("id")
