"""Similarity clusters against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from ripplework.llm import narratives
from ripplework.llm.narratives import FINE, Narratives, _bucket_pairs, links, pivot_clusters, whole_clusters, word_sets
from ripplework.plans.cluster import cut
from tests.conftest import SMALL

WORDS = [f"mot{i}" for i in range(400)]


def brute(rows, threshold=0.5, least=12):
    sets = {i: frozenset(w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")) for i, t in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    distinct = list(set(sets.values()))
    up = {s: s for s in distinct}

    def find(s):
        while up[s] != s:
            up[s] = s = up[up[s]]
        return s

    vocabulary = {w: k for k, w in enumerate(sorted({w for s in distinct for w in s}))}
    x = np.zeros((len(distinct), len(vocabulary)), np.float32)
    for k, s in enumerate(distinct):
        x[k, [vocabulary[w] for w in s]] = 1
    both = x @ x.T
    size = x.sum(1)
    edges = [(distinct[i], distinct[j]) for i, j in zip(*np.nonzero(both >= threshold * (size[:, None] + size[None] - both))) if i < j]
    for a, b in edges:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for i, s in sets.items():
        groups[find(s)].append(i)
    return {(min(g), i) for g in groups.values() if len(g) > 1 for i in g}, edges


def variants(rng, n=60, per=8):
    rows, i = [], 0
    for _ in range(n):
        base = rng.sample(WORDS, 30)
        for _ in range(rng.randrange(1, per)):
            own = [w for w in base if rng.random() > 0.08] + rng.sample(WORDS, rng.randrange(0, 3))
            rng.shuffle(own)
            text = " ".join(own) if rng.random() > 0.3 else ", ".join(own).upper() + " !"
            rows += [(i + k, text) for k in range(rng.choice([1, 1, 3]))]
            i += 3
    return rows + [(10_000, None), (10_001, ""), (10_002, "  "), (10_003, "court message"), (10_004, "mot1 " * 50), (10_005, " ".join(WORDS * 40)), (10_006, " ".join(WORDS[::-1]))]


def test_groups_and_their_description(spark):
    """Nulls, blanks, short and very long messages, repeats, a message that a third of the records share, clashing columns."""
    rows = variants(random.Random(8))
    rows += [(20_000 + i, " ".join(WORDS[:20])) for i in range(len(rows) // 2)]
    df = spark.createDataFrame([(i, t, "k", 1, "h") for i, t in rows], "id long, text string, key string, n int, hashes string").repartition(5)
    want, _ = brute(rows)
    n = Narratives(df, "id", "text")
    assert {(r.cluster_id, r.id) for r in n.found().collect()} == want
    table = n.described().collect()
    text = dict(rows)
    for r in table:
        assert r.n_posts >= 2 and r.n_posts >= r.n_texts and r.medoid == text[r.medoid_id] and r.typical_ids[0] == r.medoid_id
        assert abs(r.share_pct - 100 * r.n_posts / len(rows)) < 1e-3
    edges = {frozenset((e.src, e.dst)) for e in n.edges.collect()}
    own = {r.set_id: r.pivot for r in pivot_clusters(n.edges).collect()}
    assert all(p == s or frozenset((s, p)) in edges for s, p in own.items())
    chosen = set(own.values())
    assert all(own[p] == p for p in chosen) and not any(frozenset((a, b)) in edges for a in chosen for b in chosen if a < b)


def test_recall_near_the_threshold(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):  # pairs of 30 words each that share 20: a similarity of exactly one half
        words = rng.sample(WORDS, 40)
        rows += [(2 * k, " ".join(words[:30])), (2 * k + 1, " ".join(words[10:]))]
    df = spark.createDataFrame(rows, "id long, text string")
    sets = cut(word_sets(df, "id", "text").groupBy("k1", "k2", "hashes").agg(F.min("id").alias("set_id"), F.count("*").alias("n")))
    got = {(r.src, r.dst) for r in links(sets, None, FINE, 0.5).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(300)}
    assert len(got & want) >= 0.9 * len(want)


def test_no_messages(spark):
    n = Narratives(spark.createDataFrame([(1, None), (2, "trop court")], "id long, text string").filter("id < 2"), "id", "text")
    assert n.found().count() == 0 and n.described().count() == 0


def test_a_large_family_of_different_texts(spark):
    rng = random.Random(12)
    base = WORDS[:60]
    rows = [(i, " ".join(base[: 55 + i % 6]) + f" seul{i}") for i in range(1600)] + [(i, " ".join(rng.sample(WORDS, 20))) for i in range(1600, 2200)]
    want, _ = brute(rows)
    got = Narratives(spark.createDataFrame(rows, "id long, text string").repartition(6), "id", "text").found().collect()
    assert {(r.cluster_id, r.id) for r in got} == want and len(want) >= 1600


def test_pivots_against_all_links(spark):
    """Families joined through third sets: no two pivots are similar, and each set is with the pivot most like it, by brute force."""
    rng = random.Random(21)
    rows, i = [], 0
    for _ in range(12):
        base = rng.sample(WORDS, 40)
        for _ in range(40):
            rows.append((i, " ".join(sorted(rng.sample(base, rng.choice([26, 30, 34]))) + rng.sample(WORDS, 2))))
            i += 1
    n = Narratives(spark.createDataFrame(rows, "id long, text string").repartition(5), "id", "text")
    words = {i: frozenset(t.split()) for i, t in rows}
    own = {r.set_id: r.pivot for r in whole_clusters(n.sets, n.edges, 0.5).collect()}

    def sim(a, b):
        return len(words[a] & words[b]) / len(words[a] | words[b])

    pivots = sorted(set(own.values()))
    assert set(own) == {a for e in n.edges.collect() for a in (e.src, e.dst)} and all(own[p] == p for p in pivots)
    # recall is 0.9997 and more from 0.63 on
    assert not [(a, b) for a in pivots for b in pivots if a < b and sim(a, b) >= 0.63]
    for s, p in own.items():
        best = max(sim(s, q) for q in pivots)
        assert s == p or (sim(s, p) >= 0.5 and (sim(s, p) == best or best < 0.63))
    assert len({r.pivot_id for r in n.described().collect()} - set(pivots)) == 0


def test_recall_of_all_links_of_the_test_table(spark, monkeypatch):
    """Every true link between word sets of the test table is looked for; buckets whole and divided."""
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/posts.parquet").select("row_id", "message_normalizer")
    sets = cut(word_sets(df, "row_id", "message_normalizer").groupBy("k1", "k2", "hashes").agg(F.min("row_id").alias("set_id"), F.count("*").alias("n")))
    words = [(r.set_id, set(r.hashes)) for r in sets.collect()]
    want = {(min(a, b), max(a, b)) for k, (a, s) in enumerate(words) for b, t in words[:k] if 3 * len(s & t) >= len(s) + len(t)}
    got = {(r.src, r.dst) for r in links(sets, None, FINE, 0.5, every=True).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 1500
    monkeypatch.setattr(narratives, "PROBE", 2)
    monkeypatch.setattr(narratives, "PROBE_LEAST", 3)
    monkeypatch.setattr(narratives, "tasks_of", lambda spark: 64)
    assert {(r.src, r.dst) for r in links(sets.repartition(3), None, (80, 5), 0.5, every=True).collect()} == got


def test_links_do_not_depend_on_batches_or_partitions(spark):
    df = spark.read.parquet(f"{SMALL}/posts.parquet").select("row_id", "message_normalizer")
    sets = cut(word_sets(df, "row_id", "message_normalizer").groupBy("k1", "k2", "hashes").agg(F.min("row_id").alias("set_id"), F.count("*").alias("n")))
    found = []
    for batch, partitions in ((100, 4), (10_000, 4), (10_000, 60)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            found.append({(r.src, r.dst) for r in links(sets, None, FINE, 0.5).collect()})
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] and found[0]


def test_clusters_of_the_test_table(spark):
    """No two pivots are similar, no member has a closer pivot, sizes add up: by brute force over all word sets."""
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/posts.parquet").select("row_id", "message_normalizer")
    n = Narratives(df, "row_id", "message_normalizer")
    sets = {r.set_id: set(r.hashes) for r in n.sets.collect()}
    own = {r.set_id: r.pivot for r in whole_clusters(n.sets, n.edges, 0.5).collect()}
    pivots = sorted(set(own.values()))
    sim = {s: {q: len(sets[s] & sets[q]) / len(sets[s] | sets[q]) for q in pivots} for s in own}
    assert not [(a, b) for a in pivots for b in pivots if a < b and sim[a][b] >= 0.5]
    assert all(s == p or (sim[s][p] == max(sim[s].values()) >= 0.5) for s, p in own.items())
    copies = {r.set_id: r.n for r in n.sets.collect()}
    sizes = Counter()
    for s, c in copies.items():
        sizes[own.get(s, s)] += c
    assert {r.pivot_id: r.n_posts for r in n.described().collect()} == {p: c for p, c in sizes.items() if c > 1}


def test_a_bucket_over_several_batches():
    """Members that are not plainly like the pivot meet all others, wherever the batches end."""
    n = 400
    sketch = np.full(n, (1 << 32) - 1, np.int64)
    sketch[0] = 0
    columns = [np.full(n, 8, np.int64), np.arange(n), np.arange(n), sketch, np.zeros(n, np.int64)]
    names = ["bucket", "set_id", "label", "s1", "s2"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 150]) for c in columns], names) for a in range(0, n, 150)]
    got = {(a, b) for r in _bucket_pairs(iter(batches)) for a, b in zip(r.column("src").to_pylist(), r.column("dst").to_pylist())}
    assert got == {(a, b) for b in range(n) for a in range(b)}


def test_divided_buckets_lose_no_pair(spark, monkeypatch):
    """A family of different texts shares few large buckets: divided or whole, the same links come out."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(WORDS[:36], 28))) for i in range(160)] + [(i, " ".join(WORDS[100:130] + [f"seul{i}"])) for i in range(160, 240)]
    sets = cut(word_sets(spark.createDataFrame(rows, "id long, text string"), "id", "text").withColumnRenamed("id", "set_id"))
    monkeypatch.setattr(narratives, "PROBE", 1)
    found = {}
    for least in (8, 10_000):
        monkeypatch.setattr(narratives, "PROBE_LEAST", least)
        monkeypatch.setattr(narratives, "tasks_of", lambda spark, n=16 if least == 8 else 1: n)
        found[least] = {(r.src, r.dst) for r in links(sets, None, (1, 1), 0.5).collect()}
    assert found[8] == found[10_000] and len(found[8]) > 100
