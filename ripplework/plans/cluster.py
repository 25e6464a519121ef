"""Helpers for plans that must survive skew and lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared checkpoint folder. Only a session inside one machine gets a temporary one of its own, which goes with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ripplework-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared checkpoint folder and go on from there, with the columns that are needed. Its size on disk is known."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``cut`` returned and that no plan still to run reads. Others are left alone."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, spread: str, share: float = 0.001) -> DataFrame:
    """Left-join ``rows`` with ``table`` (unique ``keys``; ``n`` is the number of rows of each key) without a hot task.

    A table of at most ``1 / share`` keys is broadcast. Of a larger one, keys that hold more than ``share`` of all counted rows are at most ``1 / share`` many, so these are broadcast whatever the
    input's size. Their rows then take a salt from the hash of ``spread`` for the shuffled join, where they match nothing, so
    no shuffle partition gets more of one key than ``share`` of the rows. NULL keys match nothing. ``table`` is read three times: pass a table that is
    cheap to read. ``n`` isn't returned.
    """
    values = [c for c in table.columns if c not in (*keys, n)]
    total, size = table.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(F.lit(1))).first()
    if size <= 1 / share:
        found = rows.join(F.broadcast(table.select(*keys, F.struct(*values).alias("_found"))), keys, "left")
        return found.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in values))
    hot = table.filter(F.col(n) > total * share).select(*keys, F.struct(*values).alias("_hot"))
    cold = table.filter(F.col(n) <= total * share).select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)) + 1)
    )
    found = salted.join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in values))
