"""Operators against brute force on small hand-made tables."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ripplework.functions.text import handle, letters_digits, url_handle
from ripplework.operators import audit, coordination as co, engagement as eng, neardup, profile as pro, timeseries as ts, topics
from ripplework.operators.balance import SLOT, Placement, match_rows, pack, top_rows
from ripplework.operators.graph import CoActivity, linked_groups
from ripplework.operators.neardup import char_ngrams, near_dup_groups, near_dup_totals, similar_groups, similar_pairs
from ripplework.operators.quantiles import percentiles
from ripplework.operators.segments import METRICS, breakdown, gaps, ignored
from ripplework.operators.topics import Topics
from ripplework.plans.cluster import cut, lookup_join, release
from ripplework.sources.posts import RoleMap, project, read_posts, read_table, write_table
from tests.conftest import SMALL

DAY = datetime(2025, 9, 1)
RAW = "row_id long, post_id string, posted_at timestamp_ntz, author string, full_text string, message_normalizer string, engagement_type string, x_repost_of string, x_reply_to string, sentiment string, x_verified string, x_followers double, x_following double, x_posts double, reach double, impressions double, likes double, comments double, shares double"


def posts(spark, rows):
    """Posts from (second, author, text, ...) given as dicts."""
    names = [f.split()[0] for f in RAW.split(", ")]
    filled = [{"row_id": i, "post_id": str(i), **r, "posted_at": None if r.get("sec", 0) is None else DAY + timedelta(seconds=r.get("sec", 0))} for i, r in enumerate(rows)]
    return project(spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], RAW))


def copies(spark, seconds, text="x", authors=None):
    return posts(spark, [{"sec": s, "message_normalizer": text, "author": authors[i] if authors else f"a{i}"} for i, s in enumerate(seconds)])


# text


def test_text_expressions(spark):
    rows = [(" @@Foo ",), (" Bar",), ("",), (" @ ",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(handle("s")).collect()] == ["foo", "bar", None, None, None]
    urls = spark.createDataFrame([("https://twitter.com/Foo/statuses/12",), ("https://x.com/Foo/status/1",), (None,)], "s string")
    assert [r[0] for r in urls.select(url_handle("s")).collect()] == ["Foo", None, None]
    texts = spark.createDataFrame([("L'Été, 2e fois: été!",), ("  ",), (None,)], "s string")
    assert [r[0] for r in texts.select(letters_digits("s")).collect()] == ["lété2efoisété", "", None]


# sources


def test_roles_missing_columns_and_bad_figures(spark):
    df = spark.createDataFrame([("7", "2025-09-01 10:00:00", "12", "TRUE"), ("8", "no date", "x", None), ("9", "2025-09-02", "abc", "no")], "k string, t string, r string, v string")
    rows = project(df, RoleMap(row_id="k", ts="t", reach="r", verified="v", likes=None)).orderBy("row_id").collect()
    assert [(r.row_id, r.reach, r.verified, r.text, r.engagement, r.organic, r.sentiment) for r in rows] == [(7, 12.0, True, "", "ORIGINAL", 0.0, None), (9, 0.0, False, "", "ORIGINAL", 0.0, None)]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_tables_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    write_table(df, f"{tmp_path}/t.{kind}", kind)
    assert sorted((int(r.k), r.s) for r in read_table(spark, f"{tmp_path}/t.{kind}").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        read_table(spark, f"{tmp_path}/t.xls")


# time


def test_velocity_by_hand(spark):
    volumes = [1, 5, 10, 20, 10, 4]
    rows = [{"sec": h * 3600 + i} for h, n in enumerate(volumes) for i in range(n)]
    r = ts.velocity(posts(spark, rows)).first()
    assert (r.peak_volume, r.onset_volume, r.time_to_peak_hours, r.growth_pct_per_hour, r.doubling_time_hours, r.half_life_hours, r.core_hours) == (20, 5, 2.0, 100.0, 1.0, 1.0, 3)
    assert ts.velocity(posts(spark, rows[:1])).count() == 0


def test_week_is_named_by_its_sunday(spark):
    df = posts(spark, [{"sec": 0}])  # a Monday
    assert ts.series(df, "W").first().period == datetime(2025, 9, 7)
    with pytest.raises(ValueError):
        ts.series(df, "M")


def test_gaps_are_filled(spark):
    df = ts.filled(ts.series(posts(spark, [{"sec": 0}, {"sec": 3 * 3600}]), "h"), "h")
    assert [r.value for r in df.orderBy("period").collect()] == [1, 0, 0, 1]


def test_empty_corpus(spark):
    none = posts(spark, [])
    assert pro.summary(none).first().n_messages == 0
    for df in (ts.series(none), ts.patient_zero(none), ts.onsets(none), ts.reach_lead(none), ts.sentiment_dynamics(none), co.duplication(none), co.minute_bursts(none), co.anchored_windows(none), co.burst_sizes(none), breakdown(none, "day"), pro.low_footprint(none), eng.anomalies(none)):
        assert df.count() == 0
    assert co.synchrony(none).first().copies_considered == 0
    assert eng.quality(none).first().n_high_reach_zero_organic == 0
    assert CoActivity(none).summary().first().n_nodes == 0
    assert Topics(none).summary().count() == 0


def test_onsets_are_in_order_of_the_first_relay(spark):
    url = "https://twitter.com/{}/status/1"
    rows = [{"sec": s, "x_repost_of": url.format(h)} for s, h in ((50, "a"), (60, "a"), (70, "a"), (10, "b"), (80, "b"), (5, "c"))]
    assert [(r.repost_handle, r.total) for r in ts.onsets(posts(spark, rows), 2).collect()] == [("b", 2), ("a", 3)]


# percentiles


def test_percentiles_against_sorting(spark):
    rng = random.Random(9)
    for values in ([], [None], [3.0], [rng.choice([1.0, 2.0, 7.5]) for _ in range(101)], [rng.uniform(-1e6, 1e6) for _ in range(500)] + [None] * 7 + [0.0] * 200):
        df = spark.createDataFrame([(v, None) for v in values], "v double, w double").repartition(3)
        got = percentiles(df, {"a": ("v", 0.25), "b": ("v", 0.9), "c": (F.col("v") * 2, 0.5), "d": ("w", 0.5), "e": ("v", 0.0), "f": ("v", 1.0)}).first()
        known = sorted(v for v in values if v is not None)

        def at(q, known=known):
            h = q * (len(known) - 1)
            lo, hi = known[int(h)], known[min(int(h) + 1, len(known) - 1)]
            return lo + (h - int(h)) * (hi - lo)

        want = [None] * 6 if not known else [at(0.25), at(0.9), 2 * at(0.5), None, known[0], known[-1]]
        assert all(x == w or abs(x - w) < 1e-6 for x, w in zip(got, want))


# intermediate tables


def test_cut_tables_are_removed_on_release(spark):
    df = cut(spark.createDataFrame([(1, "a"), (2, None)], "k int, s string"))
    files = [f.removeprefix("file:") for f in df.inputFiles()]
    assert files and all(map(os.path.exists, files)) and df.count() == 2
    release(df, spark.range(3))
    assert not any(map(os.path.exists, files))


# coordination


def windows(secs, delta):
    out, anchor = [], None
    for s in sorted(secs):
        if anchor is None or s - anchor > delta:
            anchor = s
            out.append([])
        out[-1].append(s)
    return out


def test_anchored_windows_by_hand(spark):
    found = co.anchored_windows(copies(spark, [0, 30, 60, 61, 100, 130]), 60, 2).orderBy("anchor").collect()
    base = int((DAY - datetime(1970, 1, 1)).total_seconds())
    assert [(r.anchor - base, r.n) for r in found] == [(0, 3), (61, 2), (130, 1)]


def test_anchored_windows_and_synchrony_against_brute_force(spark):
    rng = random.Random(3)
    times = {t: [rng.randrange(0, 4000) for _ in range(rng.randrange(1, 60))] for t in "abcdef"}
    df = posts(spark, [{"sec": s, "message_normalizer": t, "author": "u"} for t, ss in times.items() for s in ss])
    base = int((DAY - datetime(1970, 1, 1)).total_seconds())
    got = {(r.text, r.anchor - base): r.n for r in co.anchored_windows(df, 60, 5).collect()}
    assert got == {(t, w[0]): len(w) for t, ss in times.items() if len(ss) >= 5 for w in windows(ss, 60)}
    for r in co.synchrony_per_text(df, 60, 5).collect():
        ss = sorted(times[r.text])
        gaps = [b - a for a, b in itertools.pairwise(ss)]
        near = sum(min([abs(s - o) for k, o in enumerate(ss) if k != i], default=1e9) <= 60 for i, s in enumerate(ss))
        assert (r.copies, r.within, r.span) == (len(ss), near, ss[-1] - ss[0])
        gaps.sort()
        assert r.median_gap == (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2


def test_synchrony_micro(spark):
    r = co.synchrony_per_text(copies(spark, [0, 30, 200]), 60, 1).first()
    assert (r.copies, r.within, r.median_gap) == (3, 2, 100.0)
    r = co.synchrony_per_text(copies(spark, [5]), 60, 1).first()
    assert (r.copies, r.within, r.median_gap, r.expected) == (1, 0, None, 0.0)
    assert co.synchrony_per_text(copies(spark, [9, 9]), 60, 1).first().expected == 2.0


# graphs


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(up):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(1, 2), (2, 3), (3, 1), (7, 8), (9, 10), (10, 8)], []])
def test_linked_groups(spark, edges):
    got = defaultdict(set)
    for r in linked_groups(spark.createDataFrame(edges, "src long, dst long")).collect():
        got[r.label].add(r.node)
    assert {frozenset(g) for g in got.values()} == components(edges)


def test_coactivity_against_pairs(spark):
    rng = random.Random(5)
    rows = [{"sec": rng.randrange(0, 900), "message_normalizer": rng.choice("abc"), "author": f"u{rng.randrange(25)}"} for _ in range(120)]
    pairs = Counter()
    for t in "abc":
        own = sorted((r["sec"], r["author"]) for r in rows if r["message_normalizer"] == t)
        anchor, win = None, set()
        for s, a in [*own, (10**9, None)]:
            if anchor is None or s - anchor > 60:
                pairs.update(itertools.combinations(sorted(win), 2))
                anchor, win = s, set()
            win.add(a)
    table = posts(spark, rows)
    # small windows only, and large ones that are never written out as pairs
    for least, pair_window in ((1, 500), (1, 3), (2, 3), (3, 2)):
        kept = {p: w for p, w in pairs.items() if w >= least}
        net = CoActivity(table, min_edge_weight=least, pair_window=pair_window)
        s = net.summary().first()
        want = components(kept)
        assert (s.n_nodes, s.n_edges, s.link_weight, s.n_components, s.largest_component) == (sum(map(len, want)), len(kept), sum(pairs.values()), len(want), max(map(len, want)))
        edges = {(r.src, r.dst): r.weight for r in net.edges().collect()}
        assert edges == (kept if pair_window == 500 else {p: kept[p] for p in edges})
        where = {r.author: r.component for r in net.components().collect()}
        assert {min(c) for c in want} == set(where.values())
        if pair_window != 3:
            continue
        found = net.communities(rounds=4, levels=2).collect()
        own, within = {r.author: r.community for r in found}, defaultdict(set)
        for r in found:
            within[r.community].add(where[r.author])
        assert set(own) == set(where) and all(len(c) == 1 for c in within.values())
        clusters = net.clusters(k=50, communities=spark.createDataFrame(list(own.items()), "author string, community string")).collect()
        for c in clusters:
            members = {a for a, g in own.items() if g == c.community}
            assert (c.size, c.internal_edges) == (len(members), sum(a in members and b in members for a, b in kept))
            assert c.sample_accounts == sorted(members)[:8]
            counts = Counter(r["message_normalizer"] for r in rows if r["author"] in members)
            assert [(x["text"], x["count"]) for x in c.dominant_texts] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        if least == 1:
            total = sum(kept.values())
            degree = Counter()
            for (a, b), w in kept.items():
                degree[own[a]] += w
                degree[own[b]] += w
            q = sum(w for (a, b), w in kept.items() if own[a] == own[b]) / total - sum((d / (2 * total)) ** 2 for d in degree.values())
            assert abs(net.modularity(spark.createDataFrame(list(own.items()), "author string, community string")).first()[0] - q) < 1e-5


@pytest.mark.parametrize("pair_window", [500, 5])
def test_communities_are_the_planted_ones(spark, pair_window):
    """Four crews that post together, in large windows or small ones, and a few stray meetings between crews."""
    rng = random.Random(7)
    rows = []
    for win in range(60):
        crew = win % 4
        members = [f"c{crew}_{k}" for k in rng.sample(range(9), 6)] + ([f"c{(crew + 1) % 4}_0"] if win % 15 == 0 else [])
        rows += [{"sec": win * 1000 + k, "message_normalizer": "abc"[win % 3], "author": a} for k, a in enumerate(members)]
    net = CoActivity(posts(spark, rows), pair_window=pair_window)
    found = net.communities().collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.community].add(r.author)
    assert {frozenset(g) for g in groups.values()} == {frozenset(f"c{c}_{k}" for k in range(9)) for c in range(4)}
    table = spark.createDataFrame(found)
    assert net.modularity(table).first().modularity > 0.5 and net.community_summary(table).first()[:2] == (4, 36)


def test_ngrams_and_pairs_against_brute_force(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), (" ",), ("a  b\tc",)], "t string")
    assert [sorted(r[0]) for r in df.select(char_ngrams("t")).collect()] == [["abc", "bcd", "cde", "def"], ["ab"], [], [" b ", "a b", "b c"]]
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        t = "".join(rng.choice("abcde ") for _ in range(40))
        texts += [t, t[:20] + "x" + t[20:], t + rng.choice("abc"), t[:-3]]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set())
    sets = [grams(" ".join(t.split())) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    assert {(r.src, r.dst) for r in got} == want and want
    linked = defaultdict(set)
    for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect():
        linked[r.label].add(r.node)
    assert {frozenset(g) for g in linked.values()} == components(want)
    groups = near_dup_groups(spark.createDataFrame([(t, 5 + i) for i, t in enumerate(dict.fromkeys(texts))], "text string, n long")).collect()
    assert all(r.n_variants >= 2 and len(r.variant_examples) == min(3, r.n_variants - 1) for r in groups)
    totals = near_dup_totals(spark.createDataFrame([(2, 11), (3, 20)], "n_variants long, total_count long")).first()
    assert (totals.n_near_dup_groups, totals.n_texts_merged, totals.messages_in_near_dup_groups) == (2, 5, 31)


def test_a_large_family_of_variants_is_linked_in_rounds(spark, monkeypatch):
    """Chains and families, with every budget for pairs too small and with gram blocks of a few texts: the same groups."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = [" ".join(words[:18]) + f" {i:05d}" for i in range(120)] + [" ".join(words[k : k + 20]) for k in range(12)] + [" ".join(rng.sample(words, 12)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "id long, t string")

    def groups():
        found = defaultdict(set)
        for r in similar_groups(df, "id", "t").collect():
            found[r.label].add(r.node)
        return {frozenset(g) for g in found.values()}

    want = components((r.src, r.dst) for r in similar_pairs(df, "id", "t").collect())
    assert groups() == want and any(len(g) >= 120 for g in want)
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert groups() == want


def test_unlike_texts_of_common_grams_seldom_meet(spark, monkeypatch):
    """All sizes from one gram on, edited and unlike texts over few words: the pairs of brute force from parts and from rare grams, but fewer to look at by parts."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))) for _ in range(50)]
    texts = [("abcdefghijklmnopqrstuvwxyz" * 2)[:k] for k in range(1, 40)] + [" ".join(rng.choices(words, k=28)) for _ in range(150)]
    texts += [t[:k] + "#" * (1 + k % 6) + t[k + k % 4 :] for t in texts[39:99] for k in (rng.randrange(len(t)), 3)] + ["z", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set()) for t in texts]
    for threshold in (0.8, 0.93, 1.0):
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if grams[i] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= threshold}
        assert {(r.src, r.dst) for r in similar_pairs(df, "id", "t", threshold).collect()} == want and (want or threshold == 1)
    found = {(r.src, r.dst) for r in similar_pairs(df, "id", "t").collect()}
    sets = neardup._sets(df, "id", "t", 3)
    few = neardup._left(neardup._keys(sets, 0.8).withColumn("label", F.col("id")))
    monkeypatch.setattr(neardup, "LOW", 2)
    assert {(r.src, r.dst) for r in similar_pairs(df, "id", "t").collect()} == found
    assert 2 * few < neardup._left(neardup._keys(sets, 0.8).withColumn("label", F.col("id")))


def test_totals_of_texts_that_meet_by_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_prefixes", None)
    texts = [f"{a} {a[::-1]} {a * 2} et la suite {k}" for a in ("abcdefghij", "klmnopqrst", "uvwxyz0123") for k in range(3)] + ["tout autre chose", "z"]
    groups = near_dup_groups(spark.createDataFrame([(t, 5 + i) for i, t in enumerate(texts)], "text string, n long"))
    totals = near_dup_totals(groups).first()
    assert (totals.n_near_dup_groups, totals.n_texts_merged, totals.messages_in_near_dup_groups) == (3, 9, sum(range(5, 14)))


def test_parts_are_dealt_where_a_text_is(spark):
    """The grams are shuffled once, by text; pairs are counted without labels as if each text had its own."""
    words = ["abcdefghij", "klmnopqrst", "uvwxyz0123"]
    df = spark.createDataFrame([(i, f"{a} {a[::-1]} et la suite {k}") for i, (a, k) in enumerate(itertools.product(words, range(4)))], "id long, t string")
    sets = neardup._sets(df, "id", "t", 3)
    keys = neardup._parts(sets, 0.8)
    assert keys._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {r.id: (r.size, r.b0, r.b1, r.b2, r.b3) for r in keys.collect()} == {r[0]: tuple(r[1:]) for r in sets.select("id", F.size("grams"), *neardup._maps()).collect()}
    grams = defaultdict(set)
    for r in keys.collect():
        grams[r.gram].add(r.id)
    pairs = sum(len(ids) * (len(ids) - 1) // 2 for ids in grams.values())
    assert neardup._left(keys) == neardup._left(keys.withColumn("label", F.col("id"))) == pairs > 0
    assert neardup._left(keys.limit(0)) == 0


def test_rounds_end_when_they_do_not_pay(spark, monkeypatch):
    """Pairs of unlike texts stay whatever the rounds do, so these end; the groups are those of all pairs."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(60)]
    texts += [t[: 30 * k] + "#" + t[30 * k :] for t in texts for k in (1, 2, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rounds, stars = [], neardup._stars
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(neardup, "LOW", 2)
    monkeypatch.setattr(neardup, "_stars", lambda *args: rounds.append(1) or stars(*args))
    linked = defaultdict(set)
    for r in similar_groups(df, "id", "t").collect():
        linked[r.label].add(r.node)
    assert {frozenset(g) for g in linked.values()} == components((r.src, r.dst) for r in similar_pairs(df, "id", "t").collect())
    assert len(linked) == 60 and len(rounds) == 1


# load


def test_pack_is_balanced():
    place = pack([100, 90, 5, 5, 5, 5, 80, 10], 3)
    loads = Counter()
    for n, t in zip([100, 90, 5, 5, 5, 5, 80, 10], place):
        loads[t] += n
    assert max(loads.values()) <= 105


def skewed(spark, n=3000):
    rng = random.Random(2)
    return [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", float(rng.randrange(20)), "x") for i in range(n)]


def test_top_rows_with_hot_and_null_keys(spark):
    rows = skewed(spark)
    df = spark.createDataFrame(rows, "id long, key string, v double, slot string")
    plan = Placement(df, ["key"], 8)
    assert plan.split_keys >= 1 and max(plan.loads) <= 1.3 * len(rows) / 8
    placed = plan.place(plan.label(df, "id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in placed) <= 1.4 * len(rows) / 8
    want = set()
    by = defaultdict(list)
    for i, k, v, _ in rows:
        by[k].append((-v, i))
    for k, vs in by.items():
        want |= {(k, i) for _, i in sorted(vs)[:3]}
    got = top_rows(df, ["key"], [F.desc("v"), F.asc("id")], 3, "id", 8)
    assert got.columns == ["id", "key", "v", "slot"]
    assert sorted(map(str, ((r.key, r.id) for r in got.collect()))) == sorted(map(str, want))
    assert top_rows(df.limit(0), ["key"], [F.desc("v")], 3, "id").count() == 0


def test_match_rows(spark):
    rows = skewed(spark, 900)
    df = spark.createDataFrame(rows, "id long, key string, v double, slot string")
    other = spark.createDataFrame([("hot", 1.0), ("k3", 2.0), ("absent", 3.0)], "key string, v double")
    met, names = match_rows(df, other, ["key"], "id", 6)
    assert names == ["match_v"]
    figures = {"hot": 1.0, "k3": 2.0}
    assert sorted((r.id, str(r.match_v)) for r in met.collect()) == sorted((i, str(figures.get(k))) for i, k, _, _ in rows)
    assert met.groupBy("key").agg(F.count_distinct(SLOT).alias("n")).filter("key = 'hot'").first().n > 1


def test_lookup_join_spreads_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(900)], "id long, key string")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("key <> 'k3'")
    least = {}
    for i in range(900):
        least.setdefault("hot" if i % 3 else f"k{i % 40}", i)
    for share in (0.1, 0.001):  # with a shuffled part, and all broadcast
        got = lookup_join(rows, table, ["key"], "n", "id", share=share).collect()
        assert len(got) == 900 and all(r.least == (None if r.key == "k3" else least[r.key]) for r in got)


# façade pieces


def test_sample_conditions(spark):
    df = read_posts(spark, SMALL)
    r = pro.sample(df, author="ludobrique", engagement="retweet", n=3, sort="oldest").collect()
    assert len(r) == 3 and r[0].n_matching >= 3 and r[0].ts <= r[1].ts <= r[2].ts
    assert pro.sample(df, contains="no such text").count() == 0


def test_breakdown_volumes_sum_to_all(spark):
    df = read_posts(spark, SMALL)
    assert sum(r.volume for r in breakdown(df, "day", min_seg=1, top=10_000).collect()) == df.count()
    with pytest.raises(ValueError):
        breakdown(df, "colour")
    with pytest.raises(ValueError):
        breakdown(df, "day", metrics=("colour",))
    few = breakdown(df, "verified", metrics=("mean_reach", "colour", "volume"))
    assert few.columns == ["segment", "mean_reach", "volume"] and ignored(("mean_reach", "colour")) == ["colour"]
    whole = {r.segment: r for r in breakdown(df, "verified").collect()}
    assert {r.segment: (r.mean_reach, r.volume) for r in few.collect()} == {k: (r.mean_reach, r.volume) for k, r in whole.items()}
    assert [r.metric for r in gaps(few).collect()] == ["mean_reach"] and {r.metric for r in gaps(breakdown(df, "verified")).collect()} <= set(METRICS)
    assert gaps(breakdown(df, "day", metrics=("volume",))).count() == 0


def test_topics_cover_all_texts(spark):
    df = read_posts(spark, SMALL)
    topics = Topics(df, k=3, n_init=1)
    assert sum(r.n_messages for r in topics.summary().collect()) == df.filter("text <> ''").count()
    assert len(topics.centres) == 3 and topics.terms().count() > 0
    named = {r.text: 0 for r in topics.texts.select("text").collect()}
    rows = topics.assigned().select("row_id", "text", "cluster").collect()
    assert len({r.row_id for r in rows}) == len(rows) and {r.text for r in rows} == set(named)
    lines = topics.timelines().collect()
    totals = Counter()
    for r in lines:
        totals[r.cluster] += r.value
    assert totals == Counter(r.cluster for r in rows) and {r.cluster for r in lines if r.of_peak == 1.0} == set(totals)
    order = topics.lead_lag().collect()
    assert [r.peak_period for r in order] == sorted(r.peak_period for r in order)
    assert {(r.cluster, r.peak_value) for r in order} == {(c, max(r.value for r in lines if r.cluster == c)) for c in totals}
    drift = topics.drift(k=2, start="2025-09-05", end="2025-09-20").collect()
    assert {r.cluster for r in drift} == {c for c, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:2]}
    assert all(datetime(2025, 9, 5) <= r.period <= datetime(2025, 9, 20) and 0 < r.of_peak <= 1 for r in drift)
    summary = topics.summary(samples=2).collect()
    assert abs(sum(r.share_pct for r in summary) - 100) < 0.5 and all(r.n_texts <= r.n_messages and len(r.samples) <= 2 and r.negative + r.neutral + r.positive <= r.n_messages for r in summary)
    assert sum(r.n_texts for r in summary) == len(named)
    single = Topics(df, k=3, n_init=1, dedupe=False)
    assert single.assigned().count() == len(rows)


@pytest.mark.parametrize("broadcast", [1 << 18, 100, 0])
def test_term_weights_cost_what_texts_hold(spark, monkeypatch, broadcast):
    """Few terms a text of a large vocabulary, some of them twice, with all, some or none of the weights broadcast; no row for a term that a text lacks."""
    monkeypatch.setattr(topics, "BROADCAST", broadcast)
    monkeypatch.setattr(topics, "vector_to_array", None)
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{int(400 * rng.random() ** 2)}" for _ in range(8)] + ["common"] * 5, k=9)) for _ in range(600)] + ["le la", "", "x"]
    counts = []
    for t in dict.fromkeys(t for t in texts if t):
        w = [x for x in t.split() if x not in ("le", "la", "x")]
        counts.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(t for c in counts for t in c)
    weight = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items() if 5 <= n <= 0.5 * len(counts)}
    mass, n = Counter(), Counter()
    for c in counts:
        held = {t: k * weight[t] for t, k in c.items() if t in weight}
        for t, x in held.items():
            mass[t] += x / math.sqrt(sum(y * y for y in held.values()))
            n[t] += c[t]
    got = topics.term_weights(posts(spark, [{"message_normalizer": t} for t in texts + texts[:50]])).collect()
    assert {r.term: r.n for r in got} == n and len(got) == len(weight) > 300 and "common" not in weight
    assert all(abs(r.weight - weight[r.term]) < 1e-8 and abs(r.mass - mass[r.term]) < 1e-5 for r in got)


def test_audit_findings(spark):
    reports = spark.createDataFrame([(1, "@Known et @ghost ont publié 1 234 messages, soit 85,8 %"), (2, "Des bots : 77777 vues en 2025"), (3, None)], "run long, t string")
    known = spark.createDataFrame([("known",)], "handle string")
    values = spark.createDataFrame([(1234.0,), (0.858,)], "value double")
    assert audit.findings(reports, ["run"], ["t"], known, values, prose=["run"]).filter("kind = 'tone'").count() == 0
    many = spark.range(5000).select(F.col("id").cast("double").alias("value"))
    with pytest.raises(Exception, match="more than 2000 figures"):
        audit.findings(reports, ["run"], ["t"], known, many).collect()
    found = audit.findings(reports, ["run"], ["t"], known, values)
    assert sorted((r.run, r.kind, r.token) for r in found.collect()) == [(1, "unknown_handle", "ghost"), (2, "tone", "bots"), (2, "ungrounded_number", "77777")]
    assert {r.run: r.verdict for r in audit.verdicts(reports, ["run"], found).collect()} == {1: "revision", 2: "ok", 3: "ok"}


def test_reports_without_facts_and_leaks(spark):
    texts = [(1, 1, "@Known a publié 1 234 messages"), (1, 2, "@known, soit 85,8 %"), (2, 1, "@known et @ghost, 77777 vues"), (2, 2, None)]
    reports = spark.createDataFrame(texts, "run long, no int, t string")
    known = spark.createDataFrame([("known",)], "handle string")
    values = spark.createDataFrame([(1234.0,), (0.858,)], "value double")

    def empty(**kwargs):
        found = audit.findings(reports, ["run", "no"], ["t"], known, values, min_facts=audit.MIN_FACTS, **kwargs)
        verdicts = {(r.run, r.no): r.verdict for r in audit.verdicts(reports, ["run", "no"], found).collect()}
        return sorted((r.run, r.no, r.severity, r.token) for r in found.collect() if r.kind == "empty_diagnosis"), verdicts

    rows, verdicts = empty(report=["run"])
    assert rows == [(2, 1, "error", "1"), (2, 2, "error", "1")]
    assert verdicts == {(1, 1): "ok", (1, 2): "ok", (2, 1): "revision", (2, 2): "revision"}
    assert [r[:2] + r[3:] for r in empty()[0]] == [(1, 1, "2"), (1, 2, "2"), (2, 1, "1"), (2, 2, "0")]
    made = spark.createDataFrame([(1, "@known et @other : 85,8 % puis 1148,20 vues et 5555 comptes"), (3, "@known 400")], "run long, d string")
    leaks = audit.leaks(made, reports, ["run"], ["d"], ["t"])
    assert sorted((r.run, r.severity, r.token) for r in leaks.collect()) == [(1, "error", "other"), (1, "warning", "5555"), (3, "error", "known"), (3, "warning", "400")]
