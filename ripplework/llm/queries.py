"""The registered queries of the operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.text import handle, url_handle
from ripplework.functions.time import micros
from ripplework.llm.copies import Copies, parse_payloads
from ripplework.llm.frequent import frequent_items, items_above
from ripplework.llm.mixing import Mix
from ripplework.llm.narratives import Narratives
from ripplework.llm.splitting import split_texts
from ripplework.llm.terms import term_counts
from ripplework.llm.tokens import round_trip, with_ids, with_token_count
from ripplework.plans.cluster import cut


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _handles() -> dict:
    return {"author": handle("author"), "handle": handle(url_handle("x_repost_of"))}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Handles with at least 0.5 % of all posts, as author and as relayed account."""
    return items_above(_table(spark, sf, "posts"), _handles(), 0.005).select("field", F.col("value").alias("handle"))


def p1_top_handles(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent handles of both fields, with their counts and shares of all posts."""
    top = frequent_items(_table(spark, sf, "posts"), _handles(), 50)
    return top.select("field", F.col("value").alias("handle"), "n", (F.col("n") / F.col("total")).alias("share"))


def _narratives(spark: SparkSession, sf: str) -> Narratives:
    return Narratives(_table(spark, sf, "posts").select("row_id", "message_normalizer"), "row_id", "message_normalizer")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The posts of every narrative of at least two posts linked by similarity."""
    return _narratives(spark, sf).found()


def p2_narratives(spark: SparkSession, sf: str) -> DataFrame:
    """Size, share and most typical messages of each cluster."""
    return _narratives(spark, sf).described()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return term_counts(_table(spark, sf, "posts"), "message_normalizer").filter("status <> 'useful'").select("term", "status")


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and posts of every sequence of up to three terms, marked."""
    return term_counts(_table(spark, sf, "posts"), "message_normalizer", lengths=(1, 2, 3))


def _post_copies(spark: SparkSession, sf: str) -> Copies:
    posts = _table(spark, sf, "posts").filter("posted_at IS NOT NULL AND author IS NOT NULL")
    posts = posts.select("row_id", "author", "message_normalizer", "engagement_type", micros("posted_at").alias("posted"))
    return Copies(posts, "row_id", ["author", "message_normalizer", "engagement_type"], ("posted",), {"engagement_type": "original"}, ("message_normalizer",))


def _record_copies(spark: SparkSession, sf: str) -> Copies:
    fields = ["author", "date", "messagenormalizer", "engagementtype"]
    records = cut(parse_payloads(_table(spark, sf, "raw_records"), "record_id", "payload", fields))
    return Copies(records, "record_id", fields, (), {"engagementtype": "original"})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Posts and raw records that repeat an earlier one but for its formatting."""
    posts, records = _post_copies(spark, sf).found(), _record_copies(spark, sf).found()
    return posts.select(F.lit("posts").alias("tbl"), "*").unionByName(records.select(F.lit("raw_records").alias("tbl"), "*"))


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each different record, with its number of copies."""
    posts, records = _post_copies(spark, sf).kept(), _record_copies(spark, sf).kept()
    return posts.select(F.lit("posts").alias("tbl"), "*").unionByName(records.select(F.lit("raw_records").alias("tbl"), "*"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return with_ids(_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the ids of each document decode to its very bytes."""
    return round_trip(_table(spark, sf, "documents").select("doc_id", "text"), "text")


def _mix(spark: SparkSession, sf: str) -> Mix:
    docs = cut(with_token_count(_table(spark, sf, "documents").select("doc_id", "source", "text"), "text"))
    return Mix(docs, _table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that can't reach their target."""
    return _mix(spark, sf).report().filter("capped").select("source")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and actual shares of the sources."""
    return _mix(spark, sf).report()


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, sf).sample()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that had to be cut."""
    return split_texts(_table(spark, sf, "documents"), "doc_id", "text").filter("piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document."""
    return split_texts(_table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_top_handles, p2_found, p2_narratives, p3_found, p3_terms, p4_found, p4_kept, p6_ids, p6_round_trip, p7_found, p7_report, p7_mix, p8_found, p8_pieces)}
