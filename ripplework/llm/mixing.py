"""Mixing sources to target weights with balanced sampling (the cube method).

A source whose target is f times its tokens gives each of its documents floor(f) times, and once more with probability
f - floor(f), where f is held to the source's cap on repeats. Which documents are used once more is decided by the cube
method: the probabilities move along the null space of two constraints, the total of tokens and the number of documents, until
each is 0 or 1. The flight runs on hash buckets of bounded size, so a source with a third of all documents is many tasks' work. Each
bucket leaves at most two fractional documents; these are gathered level by level into fewer buckets, until at most two a source
remain. They are landed by first giving up the balance of tokens, then that of documents. So the used tokens of a source miss
its target by no more than two documents' tokens, and its documents by one.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.plans.cluster import cut

BUCKET_ROWS = 20_000
MAX_SOURCES = 10_000
_NEAR = 1e-9


def _step(p: list[float], units: list[int], u: list[float], rng: random.Random) -> None:
    """Move the probabilities of ``units`` along ``u`` or against it until one is 0 or 1, each keeping its expectation."""
    up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(units, u) if d)
    down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(units, u) if d)
    by = up if rng.random() * (up + down) < down else -down
    for i, d in zip(units, u):
        x = p[i] + by * d
        p[i] = 0.0 if x < _NEAR else 1.0 if x > 1 - _NEAR else x


def fly(p: list[float], size: list[float], rng: random.Random, land: bool = False) -> list[float]:
    """Keep sum(p) and sum(p * size) while at least three (if their sizes are equal, two) of ``p`` lie between 0 and 1."""
    p, held = list(p), []
    for unit in range(len(p)):
        if not 0 < p[unit] < 1:
            continue
        held.append(unit)
        while len(held) >= 2:
            alike = next(((a, b) for k, a in enumerate(held) for b in held[k + 1 :] if size[a] == size[b]), None)
            if alike:
                _step(p, list(alike), [1.0, -1.0], rng)
            elif len(held) == 3:
                a, b, c = (size[i] for i in held)
                scale = max(abs(b - c), abs(c - a), abs(a - b))
                _step(p, held, [(b - c) / scale, (c - a) / scale, (a - b) / scale], rng)
            else:
                break
            held = [i for i in held if 0 < p[i] < 1]
    if land:
        while len(held) == 2:
            _step(p, held, [1.0, -1.0], rng)
            held = [i for i in held if 0 < p[i] < 1]
        for i in held:
            p[i] = float(rng.random() < p[i])
    return p


def settle(p: float, size: np.ndarray) -> np.ndarray:
    """What the steps between documents of equal size come to where all have the chance ``p``: of those of a size, which stand together and in random
    order, as many are taken as their chances add up to, the next one keeps the rest, and no others are."""
    new = np.ones(len(size), bool)
    new[1:] = size[1:] != size[:-1]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(size)))
    whole = np.floor(n * p + _NEAR)
    place = np.arange(len(size)) - np.repeat(starts, n)
    rest = n * p - whole
    return np.where(place < np.repeat(whole, n), 1.0, np.where(place == np.repeat(whole, n), np.repeat(np.where(rest > _NEAR, rest, 0.0), n), 0.0))


class Mix:
    """The mixture of ``docs`` (``doc_id``, ``source``, ``n_tokens``) for ``targets`` (``source``, ``target_share``, ``max_repeats``).

    Sources are compared trimmed and lower-cased. Documents of NULL or unlisted sources take no part. A source listed more than
    once has the sum of its shares and the greatest of its caps; one with NULL or negative figures has 0. ``total`` is the size to reach, by default
    the tokens of all documents that take part. Documents without tokens count as documents. A listed source without documents
    is reported with zeros. ``docs`` is read several times: pass a table that is cheap to read. The plan of the sources is made on the driver:
    more than ``MAX_SOURCES`` listed sources are an error.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, bucket_rows: int = BUCKET_ROWS):
        spark = docs.sparkSession
        name = F.lower(F.trim("source"))
        listed = targets.select(name.alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").groupBy("source")
        wanted = listed.agg(F.greatest(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("cap")).limit(MAX_SOURCES + 1).collect()
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources are listed")
        names = spark.createDataFrame([(r.source,) for r in wanted], "source string")
        self.docs = docs.select("doc_id", name.alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).join(F.broadcast(names), "source")
        sizes = {r.source: (r.n, r.tokens) for r in self.docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
        self.total = sum(t for _, t in sizes.values()) if total is None else total
        self.seed, self.bucket_rows, self.rows = seed, bucket_rows, []
        for r in sorted(wanted):
            n, tokens = sizes.get(r.source, (0, 0))
            target = r.share * self.total
            factor = min(target / tokens if tokens else 0.0, float(r.cap))
            base = math.floor(factor)
            self.rows.append((r.source, n, tokens, r.cap, r.share, target, tokens * r.cap < target, base, factor - base, max(1, math.ceil(n / bucket_rows))))
        self.plan = spark.createDataFrame(
            self.rows, "source string, n_documents long, n_tokens long, max_repeats int, target_share double, target_tokens double, capped boolean, base long, chance double, buckets long"
        )

    def sample(self) -> DataFrame:
        """``doc_id``, ``source``, ``n_tokens`` and ``copies`` of each document that takes part; 0 if it isn't used."""
        seed = self.seed

        def flight(land: bool):
            def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                # large documents first, so that small ones are left for the landing
                rows = rows.sort_values(["n_tokens", "order", "doc_id"], ascending=[False, True, True])
                rng = random.Random(f"{seed} {key}")
                p, size = rows["p"].to_numpy(), rows["n_tokens"].to_numpy()
                if len(p) and 0 < p[0] < 1 and (p == p[0]).all():
                    p = settle(p[0], size)
                left = np.flatnonzero((p > 0) & (p < 1))
                p = p.copy()
                p[left] = fly(p[left].tolist(), size[left].astype(float).tolist(), rng, land)
                rows["p"] = p
                return rows

            return run

        planned = self.docs.join(F.broadcast(self.plan.select("source", "base", "chance", "buckets")), "source")
        rows = planned.select("doc_id", "source", "n_tokens", "base", F.col("chance").alias("p"), "buckets", F.xxhash64("doc_id", F.lit(seed)).alias("order"))
        schema = rows.schema
        done, buckets = [], max([r[-1] for r in self.rows], default=1)
        while True:
            rows = rows.groupBy("source", F.pmod("order", "buckets").alias("_bucket")).applyInPandas(flight(buckets == 1), schema)
            rows = cut(rows)
            if buckets == 1:
                break
            fractional = (F.col("p") > 0) & (F.col("p") < 1)
            done.append(rows.filter(~fractional))
            fewer = F.ceil(F.col("buckets") * 2 / self.bucket_rows)
            rows, buckets = rows.filter(fractional).withColumn("buckets", F.greatest(F.lit(1), fewer).cast("long")), max(1, math.ceil(buckets * 2 / self.bucket_rows))
        for x in done:
            rows = rows.unionByName(x)
        return rows.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("long")).alias("copies"))

    def report(self) -> DataFrame:
        """The plan and the outcome of each listed source; ``actual_share`` is its part of all tokens used. ``capped``: even with
        all repeats the source can't reach its target."""
        used = self.sample().groupBy("source").agg(F.sum("copies").alias("used_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"))
        plan = self.plan.drop("base", "chance", "buckets")
        used = plan.join(used, "source", "left").fillna(0, ["used_documents", "used_tokens"])
        whole = used.agg(F.sum("used_tokens").alias("_all"))
        return used.join(F.broadcast(whole)).withColumn("actual_share", F.col("used_tokens") / F.nullif("_all", F.lit(0))).drop("_all")
