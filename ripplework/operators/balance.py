"""Per-key work without a few tasks running far longer than the rest: fragment and replicate by estimated load.

The load of each key is counted in one pass with map-side combine. Keys above a quarter of a task's average load are named
one by one (at most four a task, whatever the input); all others are counted in hash buckets, a fixed number a task. So the
driver packs a number of items that depends on the tasks alone: greatest load first, each to the task with the least so far.
A large key is first split into as many shards as its load needs. Rows go to their task through a column whose hash
is the task's partition, so windows and aggregates by (slot, key) need no further exchange. A matching side goes to the slot
of its key, and is replicated only to the shards of split keys.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ripplework.plans.cluster import cut, release, tasks_of

SLOT = "_slot"
BUCKETS_A_TASK = 16
HEAVY_A_TASK = 4


def pack(loads: list[int], tasks: int) -> list[int]:
    """The task of each load: greatest first, each to the task with the least so far."""
    heap, out = [(0, t) for t in range(tasks)], [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, task = heapq.heappop(heap)
        out[i] = task
        heapq.heappush(heap, (load + loads[i], task))
    return out


def slots(spark: SparkSession, tasks: int) -> list[int]:
    """For each of ``tasks`` shuffle partitions the least number that hashes to it."""
    known: dict[int, int] = {}
    start, step = 0, tasks * 16
    while len(known) < tasks:
        ids = spark.range(start, start + step, 1, 1).select(F.pmod(F.hash("id"), F.lit(tasks)).alias("p"), "id")
        for p, least in ids.groupBy("p").agg(F.min("id")).collect():
            known.setdefault(p, least)
        start += step
    return [known[p] for p in range(tasks)]


class Placement:
    """Where the rows of each key go. ``keys`` may hold NULLs; such rows count as one more key."""

    def __init__(self, df: DataFrame, keys: list[str], tasks: int | None = None):
        spark = df.sparkSession
        self.keys, self.tasks = keys, tasks or tasks_of(spark)
        self.buckets = self.tasks * BUCKETS_A_TASK
        counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_bucket", self._bucket()))
        total = counts.agg(F.sum("n")).first()[0] or 0
        heavy = max(1, total // (self.tasks * HEAVY_A_TASK))
        key = F.when(F.col("n") > heavy, F.struct(*keys))
        load = counts.groupBy("_bucket", key.alias("key")).agg(F.sum("n").alias("n")).collect()
        release(counts)
        items = []
        for bucket, key, n in load:
            shards = 1 if key is None else math.ceil(n / heavy)
            items += [(bucket, key, n // shards)] * shards
        items.sort(key=lambda x: (-x[2], x[0], str(x[1])))
        place = pack([n for _, _, n in items], self.tasks)
        slot = slots(spark, self.tasks)
        self.loads = [0] * self.tasks
        light, split = {}, {}
        for (bucket, key, n), task in zip(items, place):
            self.loads[task] += n
            if key is None:
                light[bucket] = slot[task]
            else:
                split.setdefault((bucket, key), []).append(slot[task])
        fields = [df.schema[k] for k in keys]
        self.split_keys = len(split)
        self._light = spark.createDataFrame(
            [(b, light.get(b, slot[b % self.tasks])) for b in range(self.buckets)], "_bucket long, _light long"
        )
        self._split = spark.createDataFrame(
            [(*key, shards) for (_, key), shards in split.items()],
            T.StructType([*(T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("_shards", T.ArrayType(T.LongType()))]),
        )

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.tasks * BUCKETS_A_TASK).cast("long"))

    def _planned(self, df: DataFrame) -> DataFrame:
        same = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        on = same[0]
        for x in same[1:]:
            on = on & x
        df = df.join(F.broadcast(self._split), on, "left").drop(*(f"_k{i}" for i in range(len(self.keys))))
        return df.withColumn("_bucket", self._bucket()).join(F.broadcast(self._light), "_bucket").drop("_bucket")

    def label(self, df: DataFrame, spread: str) -> DataFrame:
        """Add ``SLOT``: of a split key, the shard that the hash of ``spread`` picks."""
        shard = F.get("_shards", F.pmod(F.xxhash64(spread), F.size("_shards").cast("long")).cast("int"))
        return self._planned(df).withColumn(SLOT, F.when(F.col("_shards").isNull(), F.col("_light")).otherwise(shard)).drop("_shards", "_light")

    def replicate(self, df: DataFrame) -> DataFrame:
        """Add ``SLOT``: one row for each slot that holds rows of the key."""
        where = F.array_distinct(F.when(F.col("_shards").isNull(), F.array("_light")).otherwise(F.col("_shards")))
        return self._planned(df).withColumn(SLOT, F.explode(where)).drop("_shards", "_light")

    def place(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks, SLOT)


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, spread: str, tasks: int | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order``. Keys that are NULL form one key. An empty table gives none.

    Each shard keeps its own first ``k``, so the last step merges at most ``k`` rows a shard.
    """
    plan = Placement(df, keys, tasks)
    rows = plan.place(plan.label(df, spread))
    shard = Window.partitionBy(SLOT, *keys).orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(shard)).filter(F.col("_rank") <= k)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= k).drop("_rank", SLOT)


def match_rows(df: DataFrame, other: DataFrame, keys: list[str], spread: str, tasks: int | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of ``other`` (one row a key) beside each row; NULL where it has none.

    Both sides meet in the slot through one exchange: every shard of a key holds one copy of the matching row, which a window
    over (slot, key) hands to the shard's rows. The result keeps the column ``SLOT``, for aggregates by (SLOT, key) without an exchange.
    Returns the columns of ``other`` under their names, ``match_`` put before those that clash.
    """
    plan = Placement(df, keys, tasks)
    values = [c for c in other.columns if c not in keys]
    names = {c: c if c not in df.columns else f"match_{c}" for c in values}
    left = plan.label(df, spread).withColumn("_side", F.lit(True))
    right = plan.replicate(other.select(*keys, F.struct(*(F.col(c).alias(names[c]) for c in values)).alias("_match"))).withColumn("_side", F.lit(False))
    both = plan.place(left.unionByName(right, allowMissingColumns=True))
    match = F.max("_match").over(Window.partitionBy(SLOT, *keys))
    both = both.withColumn("_match", match).filter("_side")
    return both.select(*df.columns, SLOT, *(F.col(f"_match.{n}").alias(n) for n in names.values())), list(names.values())
