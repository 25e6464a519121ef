"""Most frequent items of columns with any number of distinct values, in bounded memory.

External sort and run-length counting. Each input task sorts a buffer of values, bounded in bytes, and writes it as a run of (value, count),
so a value that holds a third of all rows leaves a task as a few rows. Runs are range-partitioned by value and merged by an
external sort; equal neighbours add up, and each range keeps only a heap of its k greatest counts. A value lies in one range,
so counts are exact, and the k greatest of all are among the ranges' heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.plans.cluster import cut, tasks_of

#: Bytes of the values of one column that a task holds before it writes a run; one Arrow batch may come on top.
BUFFER_BYTES = 64 << 20
_RUN = "field string, value string, n long"


def _sorted_runs(names: list[str], buffer_bytes: int):
    def write(field: str, chunks: list[pa.Array]) -> pa.RecordBatch:
        counted = pa.chunked_array(chunks).combine_chunks().value_counts()
        value, n = counted.field("values"), counted.field("counts")
        order = pc.sort_indices(value)
        return pa.RecordBatch.from_arrays([pa.array([field] * len(value), pa.string()), value.take(order).cast(pa.string()), n.take(order).cast(pa.int64())], ["field", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {name: [] for name in names}, dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                held[name].append(batch.column(name).cast(pa.large_string()))
                size[name] += batch.column(name).nbytes
                if size[name] >= buffer_bytes:
                    yield write(name, held[name])
                    held[name], size[name] = [], 0
        yield from (write(name, chunks) for name, chunks in held.items() if sum(map(len, chunks)))

    return run


def _merge_runs(k: int):
    """Add up equal neighbours of the sorted runs; keep k of each field, and the rows counted (with value NULL)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list[tuple[str, int]]] = {}
        totals: dict[str, int] = {}
        last: tuple[str, str | None, int] | None = None

        def keep(field: str, values: pa.Array, counts: np.ndarray) -> None:
            best = heaps.setdefault(field, [])
            # values come in their order, so of equal counts those held already go first
            above = pc.is_valid(values).to_numpy(zero_copy_only=False) & (counts > (best[-1][1] if len(best) == k else 0))
            if above.any():
                best += zip(values.filter(pa.array(above)).to_pylist(), counts[above].tolist())
                heaps[field] = heapq.nsmallest(k, best, key=lambda x: (-x[1], x[0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            field, value, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            same = np.zeros(len(n), bool)
            if len(n) > 1:
                pair = pc.equal(value.slice(1), value.slice(0, len(n) - 1))
                both_null = pc.and_(pc.is_null(value.slice(1)), pc.is_null(value.slice(0, len(n) - 1)))
                alike = pc.and_(pc.equal(field.slice(1), field.slice(0, len(n) - 1)), pc.or_(pc.fill_null(pair, False), both_null))
                same[1:] = alike.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~same)
            counts = np.add.reduceat(n, starts)
            field, value = field.take(pa.array(starts)), value.take(pa.array(starts))
            if last is not None:
                if (field[0].as_py(), value[0].as_py()) == last[:2]:
                    counts[0] += last[2]
                    totals[last[0]] -= last[2]
                else:
                    keep(last[0], pa.array([last[1]], pa.string()), np.array([last[2]]))
            last = (field[-1].as_py(), value[-1].as_py(), int(counts[-1]))
            coded = field.dictionary_encode()
            for i, f in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(coded.indices.to_numpy() == i)
                totals[f] = totals.get(f, 0) + int(counts[at].sum())
                at = at[at < len(counts) - 1]
                keep(f, value.take(pa.array(at)), counts[at])
        if last is not None:
            keep(last[0], pa.array([last[1]], pa.string()), np.array([last[2]]))
        rows = [(f, v, n) for f, best in heaps.items() for v, n in best] + [(f, None, n) for f, n in totals.items()]
        if rows:
            f, v, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())], ["field", "value", "n"])

    return merge


def frequent_items(df: DataFrame, columns: dict[str, Column], k: int, ranges: int | None = None, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """``field``, ``value``, ``n`` (its rows) and ``total`` (all rows, NULL ones included) of the k most frequent values of each column.

    Of equal counts the lesser values come first. NULL isn't a value, the empty string is. No rows: no result. A column without
    a value gives no rows. Values count as strings.
    """
    values = df.select(*(c.cast("string").alias(name) for name, c in columns.items()))
    runs = cut(values.mapInArrow(_sorted_runs(list(columns), buffer_bytes), _RUN))
    ranges = ranges or tasks_of(df.sparkSession)
    merged = runs.repartitionByRange(ranges, "field", "value").sortWithinPartitions("field", "value")
    best = merged.mapInArrow(_merge_runs(k), _RUN)
    best = best.withColumn("total", F.sum(F.when(F.col("value").isNull(), F.col("n"))).over(Window.partitionBy("field")))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return best.filter("value IS NOT NULL").withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def items_above(df: DataFrame, columns: dict[str, Column], min_share: float) -> DataFrame:
    """Every value that holds at least ``min_share`` of all rows in its column; there are at most 1 / min_share."""
    k = int(1 / min_share) + 1
    return frequent_items(df, columns, k).filter(F.col("n") >= F.lit(min_share) * F.col("total"))
