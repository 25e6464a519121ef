"""Tokens, mixtures and pieces: exact round trips, totals and limits."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.llm.mixing import Mix, fly, settle
from ripplework.llm.splitting import pieces, split_texts
from ripplework.llm.tokens import Codec, round_trip, with_ids, with_text, with_token_count
from tests.conftest import SMALL

ODD = [None, "", " ", "\n\n\n", "été 😀 <|endoftext|> [MASK]", "x" * 30_000, "mot " * 20_000, "ab1!" * 5_000, "​\x00\r\n", "l'été  l'été", "é" * 9_000]


@pytest.fixture(scope="module")
def codec():
    return Codec()


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()]


def test_ids_equal_another_library(spark, texts):
    from tokenizers import Tokenizer

    from ripplework.llm.tokens import TOKENIZERS

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = list(enumerate(texts + ODD))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r.ids for r in with_ids(df, "text").collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in rows}


def test_long_texts_split_safely(codec, texts):
    whole = "\n".join(t or "" for t in texts)
    for size in (1, 10, 1000):
        assert codec.encode(whole[:20_000], size) == codec.encode(whole[:20_000])
    assert codec.decode(codec.encode(whole)) == whole.encode()


def test_odd_white_space_and_separators(codec):
    rng = random.Random(3)
    odd = ["a", "é", " ", "  ", "\n", "\x1c", "\x1f", "\x85", "!", "'s", "9", "漢", "\u200b", " " * 5_000, " x"]
    for _ in range(60):
        t = "".join(rng.choices(odd, k=rng.randint(1, 200)))
        assert codec.encode(t, 8) == codec.encode(t, len(t))
        short = t.replace(" " * 5_000, "   ")
        assert all(n == len(codec.encode(short[s:e])) <= 60 for s, _, e, n in pieces(short, codec, 60, 8))


@pytest.mark.parametrize("text", [" " * 1_100_000, "x" + " \t" * 600_000 + "y z", "!\x1c" * 550_000])
def test_very_long_runs(codec, text):
    assert codec.decode(codec.encode(text)) == text.encode()


def test_round_trip_of_bytes(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    back = round_trip(spark.createDataFrame(rows, "i int, text string"), "text").collect()
    assert len(back) == len(rows) and all(r.same for r in back)
    raw = spark.createDataFrame([(bytearray(b"\xff\xfeabc\x80"),)], "b binary").select(F.col("b").cast("string").alias("text"))
    assert bytes(with_text(with_ids(raw, "text"), "ids").first().raw) == b"\xff\xfeabc\x80"


def test_token_counts_and_clashes(spark):
    df = spark.createDataFrame([(1, "un mot", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, other int")
    n = len(Codec().encode("un mot"))
    assert [(r.doc_id, r.other, r.n_tokens) for r in with_token_count(df, "text").orderBy("doc_id").collect()] == [(1, 7, n), (2, 8, 0), (3, 9, 0)]
    with pytest.raises(ValueError):
        with_ids(df.withColumn("ids", F.lit(1)), "text")
    assert with_ids(df.limit(0), "text").count() == 0


# mixtures


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for trial in range(30):
        size = [float(rng.choice([5, 5, 8, 100, 0])) for _ in range(rng.randrange(1, 200))]
        p = [rng.choice([0.25, 0.5, 0.9]) for _ in size]
        q = fly(p, size, random.Random(trial))
        left = [x for x in q if 0 < x < 1]
        assert len(left) <= 2 and abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, size)) - sum(a * b for a, b in zip(p, size))) < 1e-4
        landed = fly(q, size, random.Random(trial), land=True)
        assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - sum(p)) < 1.001


def test_equal_sizes_are_settled_at_once():
    rng = np.random.default_rng(3)
    for p in (0.001, 0.25, 0.5, 0.731, 0.999):
        size = np.sort(rng.integers(0, 40, 500))[::-1]
        got = settle(p, size)
        assert abs(got.sum() - p * 500) < 1e-6 and abs((got * size).sum() - p * size.sum()) < 1e-4
        assert (((got > 0) & (got < 1)).sum() <= len(set(size.tolist()))) and got.min() >= 0 and got.max() <= 1
    assert settle(0.5, np.array([], np.int64)).size == 0


def test_flight_keeps_chances():
    hits = [0] * 6
    for trial in range(4000):
        for i, x in enumerate(fly([0.3] * 6, [1.0, 2.0, 3.0, 50.0, 5.0, 5.0], random.Random(trial), land=True)):
            hits[i] += x
    assert all(abs(h / 4000 - 0.3) < 0.04 for h in hits)


@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_mix_reaches_its_shares(spark, bucket_rows):
    rng = random.Random(3)
    docs = [(i, rng.choice([" News", "news", "FORUM ", "forum", "forum", "tiny", None, "unlisted"]), rng.choice([None, 0, 10, 20, 35])) for i in range(900)]
    targets = [("news", 0.5, 3), ("forum", 0.2, 2), ("tiny", 0.25, 1), ("absent", 0.05, 9), (None, 0.5, 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens int, copies string")
    mix = Mix(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), bucket_rows=bucket_rows)
    rows = mix.sample().collect()
    names = {i: (s or "").strip().lower() for i, s, _ in docs}
    size = {i: n or 0 for i, _, n in docs}
    listed = {"news": (0.5, 3), "forum": (0.2, 2), "tiny": (0.25, 1), "absent": (0.05, 9)}
    assert sorted(r.doc_id for r in rows) == sorted(i for i in names if names[i] in listed)
    total = sum(size[i] for i in names if names[i] in listed)
    report = {r.source: r for r in mix.report().collect()}
    assert set(report) == set(listed)
    for s, (share, cap) in listed.items():
        own = sum(size[i] for i in names if names[i] == s)
        want = min(share * total, own * cap)
        used = sum(r.copies * size[r.doc_id] for r in rows if r.source == s)
        assert report[s].used_tokens == used and abs(used - want) <= 70 and report[s].capped == (own * cap < share * total)
        assert all(0 <= r.copies <= cap for r in rows if r.source == s)
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", None, None)], "source string, target_share double, max_repeats int")
    mix = Mix(docs, targets)
    assert mix.sample().count() == 0 and [(r.used_tokens, r.actual_share, r.capped) for r in mix.report().collect()] == [(0, None, False)] * 2
    assert Mix(docs, targets.limit(0)).report().count() == 0


# pieces


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (64, 16), (16, 0), (8, 7)])
def test_pieces_cover_and_fit(codec, texts, limit, overlap):
    for t in [t for t in texts[:40] + ODD if t and (limit >= 64 or len(t) < 5_000)]:
        cut = pieces(t, codec, limit, overlap)
        assert "".join(t[c:e] for _, c, e, _ in cut) == t
        assert (len(cut) > 1) == (len(codec.encode(t)) > limit)
        for s, c, e, n in cut:
            assert n == len(codec.encode(t[s:e])) <= limit and s <= c < e and len(codec.encode(t[s:c])) <= overlap


def test_cuts_prefer_strong_boundaries(codec):
    words = "un deux trois quatre cinq six sept huit"
    text = f"{words} {words}. {words}, {words}\n\n{words} {words}. {words} {words}"
    cut = pieces(text, codec, 80, 0)
    assert any(text[e : e + 2] == "\n\n" for _, _, e, _ in cut)


def test_split_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "court", "x"), (4, "mot " * 3000, "x")], "doc_id long, text string, piece string")
    rows = split_texts(df, "doc_id", "text").collect()
    assert {r.doc_id: r.n_pieces for r in rows if r.doc_id != 4} == {2: 1, 3: 1}
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [0]
    own = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece_no)
    assert [r.piece_no for r in own] == list(range(own[0].n_pieces)) and len(own) > 2 and all(0 < r.core_start - r.start for r in own[1:])
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "text", 64, 64)
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0
