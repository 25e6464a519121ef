"""The analyses of one corpus, each a set of named DataFrames."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Row

from ripplework.operators import coordination as co
from ripplework.operators import engagement as eng
from ripplework.operators import profile as pro
from ripplework.operators import segments as seg
from ripplework.operators import timeseries as ts
from ripplework.operators.graph import CoActivity
from ripplework.operators.neardup import near_dup_groups, near_dup_totals
from ripplework.operators.topics import Topics
from ripplework.plans.cluster import cut
from ripplework.sources.posts import RoleMap, project


def _plain(v):
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, (date, datetime)):
        return str(v)
    return float(v) if isinstance(v, Decimal) else v


def collected(blocks: dict[str, DataFrame], rows: int = 10_000) -> dict[str, list[dict]]:
    """The blocks as lists of plain dicts, for JSON. A block of more than ``rows`` rows is an error: write it to a table instead."""
    out = {}
    for name, df in blocks.items():
        found = df.limit(rows + 1).collect()
        if len(found) > rows:
            raise ValueError(f"{name} has more than {rows} rows")
        out[name] = [_plain(r) for r in found]
    return out


class Corpus:
    """A post table under a mapping of roles. Nothing runs before a block is used, but for models and graphs."""

    def __init__(self, table: DataFrame, roles: RoleMap = RoleMap()):
        self.posts = project(table, roles)

    def profile(self, top: int = 10) -> dict[str, DataFrame]:
        p = self.posts
        return {"summary": pro.summary(p), "engagement": pro.counts(p, "engagement"), "sentiment": pro.counts(p, "sentiment"), "top_active_authors": pro.top(p, "author", top), "top_amplified_authors": pro.top(p, "repost_handle", top)}

    def timeline(self, freq: str = "D", top: int = 5, amplified_onsets: int = 5, window: tuple[str | None, str | None] = (None, None), weight: str = "count") -> dict[str, DataFrame]:
        p = ts.window(self.posts, *window)
        binned = ts.series(p, freq, weight)
        return {"series": binned, "top_peaks": ts.peaks(binned, top), "patient_zero": ts.patient_zero(p), "amplified_onsets": ts.onsets(p, amplified_onsets), "reach": ts.reach_lead(p, freq), "velocity": ts.velocity(p)}

    def narratives(self, k: int = 6, samples: int = 3, **model) -> dict[str, DataFrame]:
        return {"clusters": Topics(self.posts, k, **model).summary(samples)}

    def narrative_timelines(self, k: int = 6, freq: str = "D", window: tuple[str | None, str | None] = (None, None), **model) -> dict[str, DataFrame]:
        topics = Topics(ts.window(self.posts, *window), k, **model)
        return {"series": topics.timelines(freq), "lead_lag": topics.lead_lag(freq), "drift": topics.drift(freq), "terms": topics.terms(8)}

    def sample(self, **conditions) -> dict[str, DataFrame]:
        return {"rows": pro.sample(self.posts, **conditions)}

    def coordination(self, min_dup: int = 5, top: int = 15, delta: int = 60, similarity: float = 0.8, ngram: int = 3) -> dict[str, DataFrame]:
        p, dup = self.posts, co.dup_texts(self.posts, min_dup)
        near = cut(near_dup_groups(dup, similarity, ngram))
        return {
            "duplication": co.duplication(p, min_dup), "top_duplicated": dup.orderBy(dup.n.desc(), "text").limit(top), "bursts": co.minute_bursts(p, k=top), "concentration": pro.concentration(p), "synchrony": co.synchrony(p, delta, min_dup),
            "burst_size_over_time": co.burst_sizes(p, delta, min_dup), "top_synchronized_texts": co.top_synchronized(p, delta, min_dup, top),
            "near_duplicates": near.orderBy(near.total_count.desc(), "representative").limit(top), "near_duplicate_totals": near_dup_totals(near), "account_behaviour": pro.account_behaviour(p, dup),
        }

    def coordination_network(self, min_dup: int = 5, delta: int = 60, min_edge_weight: int = 1, top_clusters: int = 10, sample_accounts: int = 8) -> dict[str, DataFrame]:
        net = CoActivity(self.posts, delta, min_dup, min_edge_weight)
        found = cut(net.communities())
        return {"summary": net.summary(), "communities": net.community_summary(found), "clusters": net.clusters(top_clusters, sample_accounts, communities=found)}

    def semantics(self, freq: str = "D") -> dict[str, DataFrame]:
        return {"counts": pro.counts(self.posts, "sentiment"), "dynamics": ts.sentiment_dynamics(self.posts, freq), "per_period": ts.sentiments(self.posts, freq)}

    def breakdown(self, by: str, **options) -> dict[str, DataFrame]:
        """Names among ``metrics`` that aren't known make a block ``ignored_metrics``."""
        table, unknown = seg.breakdown(self.posts, by, **options), seg.ignored(options.get("metrics") or ())
        blocks = {"segments": table, "gaps": seg.gaps(table)}
        return blocks | {"ignored_metrics": self.posts.sparkSession.createDataFrame([(m,) for m in unknown], "metric string")} if unknown else blocks

    def actor(self, handle: str, samples: int = 5) -> dict[str, DataFrame]:
        return {"dossier": eng.actor(self.posts, handle), "mix": eng.actor_mix(self.posts, handle), "top_messages": eng.actor_messages(self.posts, handle, samples)}

    def engagement_quality(self, min_reach: int = 1, min_dup: int = 5, top: int = 15) -> dict[str, DataFrame]:
        p = self.posts
        return {"quality": eng.quality(p, min_reach, min_dup), "by_engagement": eng.by_engagement(p, min_reach), "anomalies": eng.anomalies(p, min_reach, top)}

    def reply_network(self, top: int = 15) -> dict[str, DataFrame]:
        return {"summary": eng.reply_summary(self.posts), "targets": eng.reply_targets(self.posts, top)}
