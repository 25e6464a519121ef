"""Clusters of mutually similar records, by parallel pivot correlation clustering.

Records are sets of words; equal sets are collapsed first. Similar sets are found in two waves of min-hash bands (banded hash buckets of all sets,
none capped): the first takes in close variants, the second, of ``FINE`` bands, only pairs not yet linked. In a bucket the member
of least hash is the pivot and absorbs whoever is plainly like it; the others are held against the whole bucket. A 128-bit sketch
of each set sorts out strangers; every remaining pair is checked on its word sets, so no false link is used.

Links then feed the rounds: a set whose hash is less than that of all its active neighbours is a pivot and absorbs these.
The links hold the groups together but leave out pairs that are joined through others. For clusters they only propose pivots: of similar
pivots one stays, every set is held against all pivots it shares a bucket with, rounds go on among the sets that no pivot is like,
members go to the pivot most like them, and the medoids follow.
For groups linked by similarity, each round's clusters are contracted to their pivots and the links between clusters go on, until none is left.

A bucket too large for a task is divided into a grid of cells in which the same pairs meet.

Recall of a single link of similarity s, however large its buckets, is 1 - (1 - s**5)**80: 0.92 at 0.5, 0.998 at 0.6, one from 0.65 on. A member is in
its group if any of its links is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.operators.graph import absorb, hash_order, linked_groups
from ripplework.plans.cluster import cut, lookup_join, release, tasks_of

MIN_WORDS, SIMILARITY = 12, 0.5
#: (bands, rows a band) of the two waves.
CLOSE, FINE = (10, 6), (80, 5)
#: Bits of 128 that agree: at a similarity of 0.5 they are 96 +- 5, of strangers 72 +- 6.
PLAIN, MAYBE = 109, 82
PAIRS_AT_ONCE = 1_000_000
#: One set in so many is looked at for large buckets, which hold more than so many of them.
PROBE, PROBE_LEAST = 64, 16
#: The low bits of a bucket's key: a member of a whole bucket, or in a cell of a divided one a member plainly like the pivot or not, and one held against these.
WHOLE, PLAINLY, REST, HELD = 0, 1, 2, 3


def word_sets(df: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The id of each record with at least ``min_words`` (two or more) distinct words, their sorted 64-bit ``hashes``, and the set's 128-bit key ``k1``, ``k2``."""
    spaced = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    hashes = F.sort_array(F.array_distinct(F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w))))
    # through a generator, below which the filter isn't pushed: it would find the words a second time
    found = df.select(id_col, F.explode(F.array(hashes)).alias("hashes")).filter(F.size("hashes") >= min_words)
    return found.select(id_col, "hashes", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.reverse("hashes")).alias("k2"))


def _bands(bands: int, rows: int):
    draw = np.random.default_rng(20_240_607)
    count = max(128, bands * rows)
    mult = draw.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**63, count, np.uint64)
    mix = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("hashes")
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            h = lists.flatten().to_numpy().view(np.uint64)
            keys, sketch = np.zeros((bands, n), np.uint64), np.zeros((2, n), np.uint64)
            for p in range(count):
                least = np.minimum.reduceat((h * mult[p] + add[p]) >> np.uint64(32), starts)
                if p < 128:
                    sketch[p // 64] |= (least & np.uint64(1)) << np.uint64(p % 64)
                if p < bands * rows:
                    keys[p // rows] ^= (least + np.uint64(p + 1)) * mix[p]
            keys ^= keys >> np.uint64(29)
            for b in range(0, bands, 10):
                part = keys[b : b + 10]
                times = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel().view(np.int64)), *(pa.array(np.tile(batch.column(c).to_numpy(), times)) for c in ("set_id", "label")), *(pa.array(np.tile(s, times).view(np.int64)) for s in sketch)],
                    ["bucket", "set_id", "label", "s1", "s2"],
                )

    return run


def _bucket_pairs(batches: Iterator[pa.RecordBatch], every: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs to check of the buckets and cells, which come one after another, each by its low bits, then in hash order. One that
    goes on in the next batches is kept whole until it ends. ``every``: those of members that their pivot absorbs too."""
    names, open_ = ["bucket", "set_id", "label", "s1", "s2"], []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if not open_ or rows[0][-1] >> 2 != open_[0][0][-1] >> 2:
            rows = [np.concatenate(x) for x in zip(*open_, rows)]
            start = int(np.searchsorted(rows[0], rows[0][-1] >> 2 << 2))
            open_ = []
            if start:
                yield from _pairs_within([x[:start] for x in rows], every)
            rows = [x[start:] for x in rows]
        open_.append([x.copy() for x in rows])
    if open_:
        yield from _pairs_within([np.concatenate(x) for x in zip(*open_)], every)


def _pairs_within(rows: list[np.ndarray], every: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of whole buckets, ``PAIRS_AT_ONCE`` or one member's at once."""
    key, ids, label, s1, s2 = rows
    role, key = key & 3, key >> 2
    new = np.ones(len(ids), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    bucket = np.cumsum(new) - 1
    some = (sizes[bucket] > 1) & (role == WHOLE)
    # those held against the others come last in their cell
    others = np.add.reduceat((role != HELD).astype(np.int64), starts)

    def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 128 - np.bitwise_count((s1[a] ^ s1[b]).view(np.uint64)).astype(np.int64) - np.bitwise_count((s2[a] ^ s2[b]).view(np.uint64))

    def batch_of(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["src", "dst"])

    row, pivot = np.flatnonzero(some & ~new), starts[bucket[some & ~new]]
    alike, apart = agree(row, pivot), label[row] != label[pivot]
    take = apart & (alike >= MAYBE)
    yield from batch_of(ids[pivot[take]], ids[row[take]])
    absorbed = np.zeros(len(new), bool)
    absorbed[row] = ~apart | ((alike >= PLAIN) & (not every))
    rest = np.concatenate([row[~absorbed[row]], np.flatnonzero((role == HELD) & (others[bucket] > 0))])
    to = np.cumsum(others[bucket[rest]])
    at = 0
    while at < len(rest):
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        part = rest[at:end]
        n = others[bucket[part]]
        one = np.repeat(part, n)
        other = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[bucket[part]], n)
        whole = ~new[other] & (absorbed[other] | (other > one))
        good = (label[one] != label[other]) & np.where(role[one] == HELD, (role[other] == PLAINLY) | (ids[other] > ids[one]), whole)
        one, other = one[good], other[good]
        good = agree(one, other) >= MAYBE
        yield from batch_of(ids[one[good]], ids[other[good]])
        at = end


def _spread(rows: DataFrame, shape: tuple[int, int], every: bool = False) -> DataFrame:
    """The sets in their buckets. A bucket with more than a task's part of all sets, as one set in ``PROBE`` shows, is divided into a grid of cells.

    Its pivot is the probed member of least hash. Each member is in the cells of one line of the grid, and the pivot and whoever is not
    plainly like it are held, in the cells of one column, against all lines; so every pair that a whole bucket forms meets in a cell.
    The grid's shape keeps the copies few. There are at most as many such buckets as bands times tasks, which bounds the broadcast table.
    """
    schema, tasks = "bucket long, set_id long, label long, s1 long, s2 long", tasks_of(rows.sparkSession)
    banded = rows.mapInArrow(_bands(*shape), schema)
    probe = cut(rows.filter(F.pmod(F.xxhash64("set_id", F.lit(1)), F.lit(PROBE)) == 0))
    least = max(PROBE_LEAST, probe.count() // tasks)
    seen = probe.mapInArrow(_bands(*shape), schema)
    first = F.min(F.struct(hash_order("set_id").alias("h"), "set_id", "label", "s1", "s2"))
    large = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), first.alias("_p")).filter(F.col("_n") > least)
    large = cut(large.select("bucket", "_n", F.col("_p.set_id").alias("_pivot"), F.col("_p.label").alias("_label"), F.col("_p.s1").alias("_s1"), F.col("_p.s2").alias("_s2")))
    whole = F.col("bucket").bitwiseAND(F.lit(-4))
    if large.isEmpty():
        return banded.withColumn("bucket", whole)
    differ = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"_s{k}"))) for k in (1, 2))
    plain = (F.col("label") == F.col("_label")) | ((differ <= 128 - PLAIN) & F.lit(not every))
    held = seen.join(F.broadcast(large), "bucket").groupBy("bucket").agg(F.greatest(F.count_if(~plain), F.lit(1)).alias("_held"))
    parts = F.ceil(F.col("_n") * 2 / least)
    grid = large.join(held, "bucket").withColumn("_lines", F.least(parts, F.ceil(F.sqrt(parts * F.col("_n") / F.col("_held"))))).withColumn("_columns", F.ceil(parts / F.col("_lines")))
    parted = banded.join(F.broadcast(cut(grid.drop("_n", "_held"))), "bucket", "left")
    line, column = F.pmod(F.xxhash64("set_id", "bucket"), F.col("_lines")), F.pmod(F.xxhash64("set_id", "bucket", F.lit(1)), F.col("_columns"))

    def cell(i: Column, j: Column, role: Column) -> Column:
        return F.xxhash64("bucket", i, j).bitwiseAND(F.lit(-4)) + role

    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_columns") - 1), lambda j: cell(line, j, F.when(plain, PLAINLY).otherwise(REST)))
    against = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_lines") - 1), lambda i: cell(i, column, F.lit(HELD)))
    cells = F.when(F.col("_lines").isNull(), F.array(whole)).when(plain & (F.col("set_id") != F.col("_pivot")), own).otherwise(F.concat(own, against))
    return parted.select(F.explode(cells).alias("bucket"), "set_id", "label", "s1", "s2")


def links(sets: DataFrame, labels: DataFrame | None, shape: tuple[int, int], threshold: float, every: bool = False) -> DataFrame:
    """``src``, ``dst`` and ``sim`` of pairs of ``sets`` that meet in a bucket, differ in label and are similar enough: those that hold all of them together, in
    which members of a bucket that are plainly like its pivot are linked to that only, or ``every`` one."""
    spark = sets.sparkSession
    rows = sets.select("set_id", "hashes")
    rows = rows.withColumn("label", F.col("set_id")) if labels is None else rows.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    banded = _spread(rows, shape, every)
    buckets = banded.repartition(tasks_of(spark), F.shiftright("bucket", 2)).sortWithinPartitions("bucket", hash_order("set_id"))
    pairs = buckets.mapInArrow(lambda batches: _bucket_pairs(batches, every), "src long, dst long").distinct()
    left, right = (sets.select(F.col("set_id").alias(end), F.col("hashes").alias(f"_{end}")) for end in ("src", "dst"))
    both = pairs.join(left, "src").join(right, "dst")
    shared = F.size(F.array_intersect("_src", "_dst"))
    sim = shared / (F.size("_src") + F.size("_dst") - shared)
    return both.select("src", "dst", sim.alias("sim")).filter(F.col("sim") >= threshold)


def pivot_clusters(edges: DataFrame) -> DataFrame:
    """``set_id`` and ``pivot`` of every end of an edge, by rounds of local minima; then each member goes to the pivot most like
    it (of equally similar ones that of least hash). Whoever has no pivot left among its neighbours is its own."""
    edges = cut(edges)
    active, rounds = edges.select("src", "dst"), []
    while not active.isEmpty():
        found = cut(absorb(active))
        rounds.append(found)
        gone = found.select("node")
        active = cut(active.join(gone, active.src == gone.node, "left_anti").join(gone, active.dst == gone.node, "left_anti"))
    ends = edges.select(F.col("src").alias("set_id"), F.col("dst").alias("other"), "sim").unionByName(edges.select(F.col("dst").alias("set_id"), F.col("src").alias("other"), "sim"))
    nodes = ends.select("set_id").distinct()
    if not rounds:
        return nodes.withColumn("pivot", F.col("set_id"))
    placed = rounds[0]
    for x in rounds[1:]:
        placed = placed.unionByName(x)
    alone = nodes.join(placed, F.col("set_id") == F.col("node"), "left_anti")
    pivots = cut(placed.filter("node = pivot").select("pivot").unionByName(alone.select(F.col("set_id").alias("pivot"))))
    own = pivots.select(F.col("pivot").alias("set_id"), "pivot")
    near = ends.join(pivots, F.col("other") == F.col("pivot")).join(own.select("set_id"), "set_id", "left_anti")
    closest = near.groupBy("set_id").agg(F.min(F.struct((-F.col("sim")).alias("d"), hash_order("pivot").alias("h"), "pivot"))["pivot"].alias("pivot"))
    return own.unionByName(closest)


def near_pivots(sets: DataFrame, pivots: DataFrame, shape: tuple[int, int], threshold: float) -> DataFrame:
    """``set_id``, ``pivot`` and ``sim`` of each of ``sets`` and each of ``pivots`` (both with ``hashes``) that share a bucket and are similar
    enough. No pairs of members are formed."""
    schema = "bucket long, set_id long, label long, s1 long, s2 long"

    def banded(df: DataFrame) -> DataFrame:
        return df.select("set_id", "hashes", F.col("set_id").alias("label")).mapInArrow(_bands(*shape), schema).select("bucket", "set_id", "s1", "s2")

    of = banded(pivots).select("bucket", F.col("set_id").alias("pivot"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    differ = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"p{k}"))) for k in (1, 2))
    met = banded(sets).join(of, "bucket").filter((F.col("set_id") != F.col("pivot")) & (differ <= 128 - MAYBE)).select("set_id", "pivot").distinct()
    both = met.join(sets.select("set_id", "hashes"), "set_id").join(pivots.select(F.col("set_id").alias("pivot"), F.col("hashes").alias("_of")), "pivot")
    shared = F.size(F.array_intersect("hashes", "_of"))
    return both.select("set_id", "pivot", (shared / (F.size("hashes") + F.size("_of") - shared)).alias("sim")).filter(F.col("sim") >= threshold)


def whole_clusters(sets: DataFrame, edges: DataFrame, threshold: float, shape: tuple[int, int] = FINE) -> DataFrame:
    """``set_id`` and ``pivot`` of every end of an edge. ``edges`` hold the groups together but not all neighbours, so they only propose
    pivots. Of pivots that are similar the one of least hash stays, in rounds until no two are; then every set is held against the
    pivots. Sets that none of them is like go through the same again, and last each set goes to the pivot most like it."""
    edges = cut(edges)
    ends = edges.select(F.col("src").alias("set_id"), F.col("dst").alias("pivot"), "sim").unionByName(edges.select(F.col("dst").alias("set_id"), F.col("src").alias("pivot"), "sim"))
    linked = cut(sets.select("set_id", "hashes").join(ends.select("set_id").distinct(), "set_id"))
    active, chosen, near = linked, None, None
    while not active.isEmpty():
        inner = edges
        for end in ("src", "dst"):
            inner = inner.join(active.select(F.col("set_id").alias(end)), end, "left_semi")
        proposed = pivot_clusters(inner)
        members = proposed.filter("set_id <> pivot").select("set_id")
        pivots = cut(active.join(members, "set_id", "left_anti"))
        while not (similar := cut(links(pivots, None, shape, threshold).select("src", "dst"))).isEmpty():
            gone = absorb(similar).filter("node <> pivot").select(F.col("node").alias("set_id"))
            pivots = cut(pivots.join(gone, "set_id", "left_anti"))
        ids = pivots.select(F.col("set_id").alias("pivot"))
        found = near_pivots(active, pivots, shape, threshold).unionByName(ends.join(ids, "pivot", "left_semi").select("set_id", "pivot", "sim"))
        found = cut(found)
        rest = active.join(found.select("set_id").distinct(), "set_id", "left_anti").join(pivots.select("set_id"), "set_id", "left_anti")
        if chosen is None:
            chosen, near, later = pivots, found, None
        else:
            chosen, near = chosen.unionByName(pivots), near.unionByName(found)
            later = pivots if later is None else later.unionByName(pivots)
        active = cut(rest)
    if chosen is None:
        return linked.select("set_id", F.col("set_id").alias("pivot"))
    if later is not None:  # sets that earlier pivots took in may be more like a later one
        near = near.unionByName(near_pivots(linked, later, shape, threshold))
    own = chosen.select("set_id", F.col("set_id").alias("pivot"))
    closest = near.join(own.select("set_id"), "set_id", "left_anti").groupBy("set_id").agg(F.min(F.struct((-F.col("sim")).alias("d"), hash_order("pivot").alias("h"), "pivot"))["pivot"].alias("pivot"))
    return own.unionByName(closest)


class Narratives:
    """The messages of ``df``. NULL, blank and short messages take part in no cluster but count as records."""

    def __init__(self, df: DataFrame, id_col: str, text: str, min_words: int = MIN_WORDS, similarity: float = SIMILARITY):
        self.df, self.id_col, self.similarity = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), id_col, similarity
        self.rows = word_sets(self.df, "_id", "_text", min_words)
        self.sets = cut(self.rows.groupBy("k1", "k2", "hashes").agg(F.min("_id").cast("long").alias("set_id"), F.count(F.lit(1)).alias("n")))
        close = cut(links(self.sets, None, CLOSE, similarity))
        groups = linked_groups(close).withColumnRenamed("node", "set_id")
        fine = links(self.sets, groups, FINE, similarity)
        self.edges = cut(close.unionByName(fine))
        release(close)

    def _expand(self, sets: DataFrame, *values: str) -> DataFrame:
        """One row for each record of ``sets``."""
        rows = self.rows.select("_id", "k1", "k2")
        found = lookup_join(rows, cut(sets.select("k1", "k2", "n", *values)), ["k1", "k2"], "n", "_id").filter(F.col(values[0]).isNotNull())
        return found.select(*values, F.col("_id").alias(self.id_col))

    def found(self) -> DataFrame:
        """``cluster_id`` and the id of each record in a largest group linked by similarity, of at least two records;
        ``cluster_id`` is the least id in it."""
        labels = linked_groups(self.edges).withColumnRenamed("node", "set_id")
        least = cut(labels.groupBy("label").agg(F.min("set_id").alias("cluster_id"), F.count(F.lit(1)).alias("n")))
        groups = lookup_join(labels, least, ["label"], "n", "set_id").select("set_id", "cluster_id")
        sets = self.sets.join(groups, "set_id", "left").filter("cluster_id IS NOT NULL OR n > 1")
        return self._expand(sets.withColumn("cluster_id", F.coalesce("cluster_id", "set_id")), "cluster_id")

    def described(self, typical: int = 3) -> DataFrame:
        """One row a cluster of at least two records: ``n_posts``, its ``share_pct`` of all records, ``n_texts`` (different sets of words),
        the ids of its ``typical`` most typical texts' first records, and the ``medoid`` message.

        The typicality of a text is its similarity to the cluster's word profile: the words it shares with the mean member
        over the words found in either."""
        sets = self.sets.join(whole_clusters(self.sets, self.edges, self.similarity), "set_id", "left").withColumn("pivot", F.coalesce("pivot", "set_id"))
        sets = cut(sets)
        sizes = sets.groupBy("pivot").agg(F.sum("n").alias("n_posts"), F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n") * F.size("hashes")).alias("_words")).filter("n_posts > 1")
        sizes = cut(sizes.withColumn("_t", F.col("n_texts")))
        sized = cut(lookup_join(sets.select("pivot", "set_id", "n", "hashes"), sizes, ["pivot"], "_t", "set_id").filter("n_posts IS NOT NULL"))
        several = sized.filter("n_texts > 1")
        exploded = several.select("pivot", "set_id", "n", "n_posts", "_words", F.size("hashes").alias("size"), F.explode("hashes").alias("word"))
        weight = cut(exploded.groupBy("pivot", "word").agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_n")))
        profile = lookup_join(exploded, weight, ["pivot", "word"], "_n", "set_id")
        shared = profile.groupBy("pivot", "set_id", "n", "n_posts", "_words", "size").agg(F.sum("_in").alias("_shared"))
        mean, common = F.col("_words") / F.col("n_posts"), F.col("_shared") / F.col("n_posts")
        scored = shared.select("pivot", "set_id", "n", F.round(common / (F.col("size") + mean - common), 9).alias("score"))
        scored = scored.unionByName(sized.filter("n_texts = 1").select("pivot", "set_id", "n", F.lit(1.0).alias("score")))
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), (-F.col("n")).alias("b"), F.col("set_id").alias("id")))), 1, typical)
        # the best of each hash share first, so that no group is gathered whole
        share = F.pmod(hash_order("set_id"), F.lit(1024))
        rank = F.row_number().over(Window.partitionBy("pivot", share).orderBy(F.desc("score"), F.desc("n"), "set_id"))
        few = scored.withColumn("_r", rank).filter(F.col("_r") <= typical)
        last = F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("score"), F.desc("n"), "set_id"))
        few = few.withColumn("_r", last).filter(F.col("_r") <= typical)
        tops = few.groupBy("pivot").agg(best.alias("t"))
        whole = self.df.agg(F.count(F.lit(1)).alias("_all"))
        out = sizes.drop("_t").join(tops, "pivot").join(F.broadcast(whole))
        out = out.select(
            F.col("pivot").alias("pivot_id"), "n_posts", F.round(F.col("n_posts") * 100 / F.col("_all"), 4).alias("share_pct"), "n_texts",
            F.transform("t", lambda x: x["id"]).alias("typical_ids"), F.get("t", F.lit(0))["id"].alias("medoid_id"),
        )
        texts = self.df.select(F.col("_id").alias("medoid_id"), F.col("_text").alias("medoid"))
        return out.join(texts, "medoid_id")
