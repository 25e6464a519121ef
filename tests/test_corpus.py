"""The façade: every analysis gives plain blocks; times don't depend on the session's zone."""

import json
from datetime import datetime

import pytest

from ripplework.corpus import Corpus, collected
from ripplework.functions.time import date_of, floor_to, micros, seconds
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.read.parquet(f"{SMALL}/posts.parquet"))


@pytest.mark.parametrize(
    "name,options",
    [("profile", {}), ("timeline", {"freq": "h", "weight": "reach", "window": ("2025-09-05", None)}), ("sample", {"sentiment": "negative"}), ("semantics", {}), ("breakdown", {"by": "verified"}), ("actor", {"handle": "@LudoBrique"}), ("engagement_quality", {}), ("reply_network", {})],
)
def test_blocks_are_json(corpus, name, options):
    out = collected(getattr(corpus, name)(**options))
    assert all(out.values()), {k: len(v) for k, v in out.items()}
    json.dumps(out)


def test_large_blocks_are_an_error(corpus):
    with pytest.raises(ValueError, match="summary"):
        collected({"summary": corpus.posts}, rows=5)


def test_network_and_coordination_blocks(corpus):
    out = collected(corpus.coordination(top=3))
    assert len(out["top_synchronized_texts"]) <= 3 and out["near_duplicate_totals"][0]["n_near_dup_groups"] >= len(out["near_duplicates"])
    net = collected(corpus.coordination_network())
    assert net["summary"][0]["n_nodes"] >= net["communities"][0]["n_accounts_in_clusters"] >= sum(c["size"] for c in net["clusters"])
    json.dumps([out, net])
    some = collected(corpus.breakdown("day", metrics=("mean_reach", "colour")))
    assert some["ignored_metrics"] == [{"metric": "colour"}]


def test_profile_figures_agree(corpus):
    out = collected(corpus.profile())
    assert sum(r["n"] for r in out["engagement"]) == out["summary"][0]["n_messages"]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_times_have_no_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2025-03-30 02:31:07.000123' AS ts")  # a time that Paris skips
        r = df.select(seconds("ts").alias("s"), micros("ts").alias("u"), floor_to("minute", "ts").alias("m"), floor_to("hour", "ts").alias("h"), floor_to("day", "ts").alias("d"), floor_to("week", "ts").alias("w"), date_of(seconds("ts")).alias("a")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = int((datetime(2025, 3, 30, 2, 31, 7) - datetime(1970, 1, 1)).total_seconds())
    assert (r.s, r.u) == (base, base * 1_000_000 + 123)
    assert (r.m, r.h, r.d, r.w) == (datetime(2025, 3, 30, 2, 31), datetime(2025, 3, 30, 2), datetime(2025, 3, 30), datetime(2025, 3, 24)) and str(r.a) == "2025-03-30"
