"""Counting operators against brute force, with nulls, empty values, ties, long texts, repeated rows, clashing columns, empty tables."""

import json
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from ripplework.llm.copies import Copies, parse_payloads
from ripplework.llm.frequent import _merge_runs, _sorted_runs, frequent_items, items_above
from ripplework.llm.terms import TERM, repeated_length, term_counts

# most frequent items


@pytest.mark.parametrize("buffer_bytes", [1, 500, 10**7])
def test_top_items(spark, buffer_bytes):
    rng = random.Random(buffer_bytes)
    rows = [(rng.choice(["hot"] * 20 + [f"v{i}" for i in range(40)] + ["", None]), rng.choice(["a", "b", None]), "x", 1) for _ in range(1500)]
    df = spark.createDataFrame(rows, "v string, w string, field string, n int").repartition(5)
    got = frequent_items(df, {"v": F.col("v"), "w": F.col("w")}, 12, ranges=3, buffer_bytes=buffer_bytes).collect()
    for k, name in enumerate("vw"):
        want = sorted(((x, n) for x, n in Counter(r[k] for r in rows if r[k] is not None).items()), key=lambda x: (-x[1], x[0]))[:12]
        assert sorted(((r.value, r.n) for r in got if r.field == name), key=lambda x: (-x[1], x[0])) == want
    assert {r.total for r in got} == {1500}


def test_buffers_are_bounded_in_bytes():
    """Long values: a run holds the buffer and one batch at most, whatever the number of rows."""
    texts = [f"{i % 700:05d}" * 2000 for i in range(4000)]
    batches = (pa.RecordBatch.from_arrays([pa.array(texts[a : a + 50]), pa.array(["x"] * 50)], ["v", "w"]) for a in range(0, 4000, 50))
    counts, runs = Counter(), 0
    for run in _sorted_runs(["v", "w"], 2 << 20)(batches):
        assert run.nbytes <= 3 << 20 and run.column(1).to_pylist() == sorted(run.column(1).to_pylist())
        counts.update({(f, v): n for f, v, n in zip(*(run.column(i).to_pylist() for i in range(3)))})
        runs += 1
    assert counts == Counter(("v", t) for t in texts) + Counter({("w", "x"): 4000}) and runs >= 17


def test_runs_merge_across_batches():
    rng = random.Random(5)
    for _ in range(100):
        rows = [(rng.choice("ab"), rng.choice([None, "", *map(str, range(20))]), rng.randint(1, 5)) for _ in range(rng.randint(1, 120))]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        cuts = [0, *sorted(rng.choices(range(len(rows)), k=5)), len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["field", "value", "n"]) for a, b in zip(cuts, cuts[1:])]
        k, want = rng.randint(1, 6), []
        for f in {r[0] for r in rows}:
            counts = Counter()
            for _, v, n in (r for r in rows if r[0] == f):
                counts[v] += n
            want += [(f, None, sum(counts.values())), *((f, v, n) for v, n in sorted(((v, n) for v, n in counts.items() if v is not None), key=lambda x: (-x[1], x[0]))[:k])]
        got = [tuple(r.values()) for b in _merge_runs(k)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_items_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "v string")
    assert frequent_items(df, {"v": F.col("v")}, 5).count() == 0
    assert frequent_items(df.limit(0), {"v": F.col("v")}, 5).count() == 0


def test_items_above_include_the_bound(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "v string")
    assert [r.value for r in items_above(df, {"v": F.col("v")}, 0.05).collect()] == ["a"]


# terms


def brute_terms(texts, lengths):
    occurrences, records = Counter(), Counter()
    for t in texts:
        words = re.findall(TERM, (t or "").lower())
        grams = [" ".join(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    return {g: (n, records[g]) for g, n in occurrences.items()}


@pytest.mark.parametrize("depth,lengths,buffer_terms", [(1, (1,), 10**6), (3, (1, 2, 3), 10**6), (3, (1, 3), 1), (4, (2,), 40)])
def test_ngram_counts(spark, depth, lengths, buffer_terms):
    rng = random.Random(depth)
    words = ["lait", "zorvelac", "été", "rappel", "ab", "cœur"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, "", "  ", "AB 12 !", "lait " * 300, "LAIT,lait;Lait"]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(texts)], "id long, text string, terms string, n int").repartition(4)
    got = term_counts(df, "text", depth, lengths, buffer_terms=buffer_terms).collect()
    assert {r.term: (r.n_occurrences, r.n_records) for r in got} == brute_terms(texts, lengths)
    assert len(got) == len({r.term for r in got})
    for r in got:
        assert r.status == ("rare" if r.n_records < 5 else "common" if r.n_records > len(texts) / 2 else "useful")
        assert r.n_terms == len(r.term.split())


def test_ngrams_as_long_as_two_texts_share(spark):
    """The depth follows the longest n-gram that two different texts share."""
    rng = random.Random(1)
    base = [f"mot{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    texts = [" ".join(base[:23]), " ".join(["autre", *base[2:21], "fin"]), " ".join(rng.sample(base, 9)), " ".join(base[:23]), None, "motb " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert repeated_length(df, "text") == 19 and repeated_length(df.limit(0), "text") == 0 and repeated_length(df.filter("text LIKE 'motb%'"), "text") == 0
    got = term_counts(df, "text", None, None).collect()
    assert {r.term: (r.n_occurrences, r.n_records) for r in got} == brute_terms(texts, range(1, 20))


def test_no_terms(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "text string")
    assert term_counts(df, "text").count() == 0 and term_counts(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        term_counts(df, "text", 2, (3,))


# copies


def canon(v):
    return regex.sub(r"[^\p{L}\p{N}]", "", v or "").lower()


def test_copies_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, m, e = rng.choice(["Ann", "@ann ", "ANN", "bob", None, ""]), rng.choice(["Un rappel !", "un  RAPPEL", "un, rappel", "autre", None, "...", "é" * 20_000, "É " * 20_000]), rng.choice(["RETWEET", "re-tweet", None, "", "original"])
        rows.append((i, a, m, e, rng.choice([1, 2]), "x", 3))
    df = spark.createDataFrame(rows, "id long, a string, m string, e string, at long, raw string, field int").repartition(3)
    groups = defaultdict(list)
    for i, a, m, e, at, *_ in rows:
        if canon(m):
            groups[canon(a), canon(m), canon(e) or "original", at].append(i)
    found = Copies(df, "id", ["a", "m", "e"], ("at",), {"e": "original"}, ("m",))
    assert {(r.kept_id, r.copy_id) for r in found.found().collect()} == {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {(r.kept_id, r.n_copies) for r in found.kept().collect()} == {(min(g), len(g)) for g in groups.values()}


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", None), (3, " . ", None)], "id long, a string, b string")
    assert {(r.kept_id, r.copy_id) for r in Copies(df, "id", ["a", "b"]).found().collect()} == {(1, 2), (1, 3)}
    assert Copies(df.limit(0), "id", ["a", "b"]).found().count() == 0


def test_payloads(spark):
    payloads = [
        json.dumps({"Author": "x|y=z", "Engagement Type": None, "DATE": "2025"}), "date=1 | AUTHOR = a=b |engagementType=", "Author=|author=q", "{broken", "", None, "no fields", json.dumps({"author": 5, "Message Normalizer": "é\n"}),
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    rows = parse_payloads(df, "i", "p", ["author", "date", "messagenormalizer", "engagementtype"]).orderBy("i").collect()
    assert [(canon(r.author), canon(r.date), canon(r.messagenormalizer), canon(r.engagementtype)) for r in rows] == [("xyz", "2025", "", ""), ("ab", "1", "", ""), ("q", "", "", ""), *[("",) * 4] * 4, ("5", "", "é", "")]
