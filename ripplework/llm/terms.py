"""Occurrences and record counts of all n-grams, by a suffix array cut at a depth and its common-prefix intervals.

Records with the same terms are collapsed first and counted with their number. In each record the suffixes are sorted; the
common prefix of a suffix with the one before it says up to which length its n-grams occur in this record already. Suffixes
(their first ``depth`` terms) are combined in sorted runs, then range-partitioned by their terms and sorted: the suffix array
of the collection. The range bounds may lie within a term, so a term that half of all records hold is many tasks' work. Where neighbours
share their first d terms they are in one interval; an interval's size is the n-gram's occurrences, and less the suffixes that repeat an
n-gram of their own record, its records. Intervals on the border of a range or batch are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.functions.text import TERM
from ripplework.plans.cluster import cut, tasks_of

BUFFER_TERMS = 2_000_000


def _same(codes: list[np.ndarray]) -> np.ndarray:
    """The common prefix, in terms, of each row with the row before it."""
    lcp, going = np.zeros(len(codes[0]), np.int32), np.ones(max(0, len(codes[0]) - 1), bool)
    for c in codes:
        going &= (c[1:] == c[:-1]) & (c[1:] >= 0)
        lcp[1:] += going
    return lcp


def _suffix_runs(depth: int, buffer_terms: int):
    def run_of(lists: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
        split = pc.split_pattern(pa.chunked_array(lists).combine_chunks(), " ")
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(split).dictionary_encode()
        terms, first = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        record = np.repeat(np.arange(len(size)), size)
        codes = [first]
        for d in range(1, depth):
            later, there = np.full(len(first), -1, np.int64), np.zeros(len(first), bool)
            there[:-d or None] = record[d:] == record[:-d] if d < len(record) else False
            later[: len(first) - d][there[: len(first) - d]] = first[d:][there[: len(first) - d]]
            codes.append(later)
        order = np.lexsort([*codes[::-1], record])
        codes, record = [c[order] for c in codes], record[order]
        dup = _same(codes)
        dup[1:][record[1:] != record[:-1]] = 0
        n = n[record]
        order = np.lexsort([dup, *codes[::-1]])
        codes, dup, n = [c[order] for c in codes], dup[order], n[order]
        new = np.ones(len(dup), bool)
        new[1:] = dup[1:] != dup[:-1]
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        columns = [terms.take(pa.array(c[starts], mask=c[starts] < 0)) for c in codes]
        columns += [pa.array(dup[starts], pa.int32()), pa.array(np.add.reduceat(n, starts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [*(f"t{d}" for d in range(depth)), "dup", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, counts, chars = [], [], 0
        for batch in batches:
            if batch.num_rows:
                lists.append(batch.column(0))
                counts.append(batch.column(1).to_numpy())
                chars += pc.sum(pc.binary_length(batch.column(0))).as_py()
            if chars > buffer_terms * 6:
                yield run_of(lists, np.concatenate(counts))
                lists, counts, chars = [], [], 0
        if lists:
            yield run_of(lists, np.concatenate(counts))

    return run


def _intervals(depth: int, lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dup, n = (batch.column(i).to_numpy() for i in (depth, depth + 1))
            codes = [pc.fill_null(batch.column(d).dictionary_encode().indices, -1).to_numpy() for d in range(max(lengths))]
            lcp = _same(codes)
            for d in lengths:
                starts = np.flatnonzero(lcp < d)
                occurrences = np.add.reduceat(n, starts)
                records = occurrences - np.add.reduceat(np.where(dup >= d, n, 0), starts)
                whole = codes[d - 1][starts] >= 0
                at = pa.array(starts[whole])
                gram = batch.column(0).take(at) if d == 1 else pc.binary_join_element_wise(*(batch.column(i).take(at) for i in range(d)), " ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), d, np.int32)), gram, pa.array(occurrences[whole]), pa.array(records[whole])], ["n_terms", "term", "n_occurrences", "n_records"]
                )

    return run


def term_lists(text: Column | str, pattern: str = TERM) -> Column:
    """The terms of a text in their order, joined by a blank; NULL and texts without a term give the empty string."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)), " ")


def _suffixes(records: DataFrame, depth: int, buffer_terms: int) -> DataFrame:
    """The suffix array of ``records`` (``terms``, ``n``), sorted in ranges: columns ``t0`` and on, ``dup``, ``n``."""
    names = [f"t{d}" for d in range(depth)]
    schema = ", ".join(f"{t} string" for t in names) + ", dup int, n long"
    # written, since the range partition reads them twice
    runs = cut(records.filter("terms <> ''").mapInArrow(_suffix_runs(depth, buffer_terms), schema))
    return runs.repartitionByRange(tasks_of(records.sparkSession), *names).sortWithinPartitions(*names)


def _counted(records: DataFrame, depth: int, lengths: tuple[int, ...], buffer_terms: int) -> DataFrame:
    found = _suffixes(records, depth, buffer_terms).mapInArrow(_intervals(depth, lengths), "n_terms int, term string, n_occurrences long, n_records long")
    return found.groupBy("n_terms", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def repeated_length(df: DataFrame, text: Column | str, pattern: str = TERM, buffer_terms: int = BUFFER_TERMS) -> int:
    """The terms of the longest n-gram that two different lists of terms share, 0 without one. The array's depth is doubled while n-grams of full depth are shared."""
    records = cut(df.select(term_lists(text, pattern).alias("terms")).distinct().withColumn("n", F.lit(1).cast("long")))
    depth, last = 4, 0
    while True:
        shared = _counted(records, depth, tuple(range(last + 1, depth + 1)), buffer_terms).filter("n_records > 1")
        longest = shared.agg(F.max("n_terms")).first()[0] or last
        if longest < depth:
            return longest
        depth, last = depth * 2, depth


def term_counts(df: DataFrame, text: Column | str, depth: int | None = 3, lengths: tuple[int, ...] | None = (1,), rare_below: int = 5, common_share: float = 0.5, pattern: str = TERM, buffer_terms: int = BUFFER_TERMS) -> DataFrame:
    """``n_terms``, ``term``, ``n_occurrences``, ``n_records`` and ``status`` of every n-gram of ``lengths`` (at most ``depth``).

    ``rare``: fewer than ``rare_below`` records hold it; ``common``: more than ``common_share`` of all records, those without
    a text included, hold it (``rare`` goes first); else ``useful``. No terms: no rows. Every term of ``depth`` makes the suffixes longer. With a ``depth`` of None
    it is that of the longest n-gram which two different texts share (at least 1), beyond which every n-gram is in one of them only; ``lengths`` of None are
    all up to the depth.
    """
    depth = max(1, repeated_length(df, text, pattern, buffer_terms)) if depth is None else depth
    lengths = tuple(range(1, depth + 1)) if lengths is None else lengths
    if not 1 <= max(lengths) <= depth:
        raise ValueError("lengths must lie between 1 and depth")
    records = cut(df.groupBy(term_lists(text, pattern).alias("terms")).agg(F.count(F.lit(1)).alias("n")))
    total = records.agg(F.sum("n")).first()[0] or 0
    whole = _counted(records, depth, lengths, buffer_terms)
    status = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > total * common_share, "common").otherwise("useful")
    return whole.withColumn("status", status)
