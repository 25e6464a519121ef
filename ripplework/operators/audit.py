"""Checks whether the handles and figures of written reports trace back to computed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: a handle, a number in French notation, a claim that a neutral report must not make.
HANDLE = r"@([A-Za-z0-9_]{2,30})"
NUMBER = r"\d[\d\s  .,]*\d|\d"
TONE = r"(?iu)\b(bots?|automatis\w+|robots?|prouv\w+|démontr\w+|orchestr\w+|manipulation)\b"

#: A report has to cite so many known handles and grounded figures.
MIN_FACTS = 3
#: The different figures that gaps are formed from.
MAX_FIGURES = 2_000


def handles(text: Column) -> Column:
    """The handles in a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(1)), F.lower))


def _compact(token: Column) -> Column:
    bare = F.replace(F.regexp_replace(token, r"[\s  ]", ""), F.lit(","), F.lit("."))
    return F.when(F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) > 1, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)


def numbers(text: Column) -> Column:
    """The substantive numbers of a text: with decimals, or of three digits and more and not a year of 19xx or 20xx. Handles don't count."""
    bare = F.regexp_replace(text, HANDLE, " ")
    tokens = F.transform(F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0)), _compact)
    weighty = F.filter(tokens, lambda t: t.rlike(r"^\d+(\.\d+)?$") & (t.contains(".") | ((F.length(t) >= 3) & ~t.rlike(r"^(19|20)\d\d$"))))
    return F.array_distinct(weighty)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 0.05 + 0.01 * F.abs(b)


def _bin(v: Column) -> Column:
    """Two numbers that are ``_close`` lie in one bin or in neighbouring ones: 0.05 + 0.01 |b| is less than a bin's width at any b."""
    return F.floor(F.asinh(v / 5) * 50)


def _grounded(claims: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``claims`` (``keys``, ``token``) that a figure (``keys``, ``v``) grounds: one close to the number, to its hundredfold or its hundredth, or
    a gap of two figures that is equal to it on two decimals. A corpus or report has at most ``MAX_FIGURES`` different figures, more
    are an error; gaps are formed from a list of these."""
    claims = claims.select(*keys, "token", F.col("token").cast("double").alias("_c")).distinct()
    scaled = figures.select(*keys, F.explode(F.array(F.col("v"), F.col("v") * 100, F.col("v") / 100)).alias("b"))
    scaled = scaled.select(*keys, "b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bin(F.col("b")) + d)).alias("_bin")).distinct()
    near = claims.withColumn("_bin", _bin(F.col("_c"))).join(scaled, [*keys, "_bin"]).filter(_close(F.col("_c"), F.col("b"))).select(*keys, "token")
    listed = figures.groupBy(*keys).agg(F.sort_array(F.collect_set("v")).alias("_v"))
    few = F.when(F.size("_v") <= MAX_FIGURES, F.col("_v")).otherwise(F.raise_error(F.lit(f"more than {MAX_FIGURES} figures")))
    gaps = F.flatten(F.transform("_v", lambda a: F.transform("_v", lambda b: F.round(F.abs(a - b), 2))))
    gaps = listed.withColumn("_v", few).select(*keys, F.explode(F.array_distinct(gaps)).alias("_gap")).filter("_gap > 0")
    apart = claims.withColumn("_gap", F.round("_c", 2)).join(gaps, [*keys, "_gap"]).select(*keys, "token")
    return near.unionByName(apart).distinct()


def findings(reports: DataFrame, keys: list[str], texts: list[str], known: DataFrame, values: DataFrame, prose: list[str] | None = None, min_facts: int = 0, report: list[str] | None = None) -> DataFrame:
    """``keys``, ``kind``, ``severity`` and ``token`` of what a report claims without ground.

    ``known`` has the corpus' ``handle``s; ``values`` (``value``) the computed figures. Claims are looked for in ``texts``, the tone of claims in ``prose`` (by
    default ``texts``): leave out fields that quote posts. NULL texts claim nothing.
    A report, which is all rows of equal ``report`` (by default ``keys``), is empty if it cites fewer than ``min_facts`` different known handles
    and grounded numbers; each of its rows has that finding, with the count as its token.
    """
    rows = reports.select(*keys, F.concat_ws("\n", *texts).alias("_text"), F.concat_ws("\n", *(prose or texts)).alias("_prose"))
    said = rows.select(*keys, F.explode(handles(F.col("_text"))).alias("token"))
    known = known.withColumnRenamed("handle", "token")
    figures = values.filter("value IS NOT NULL").select(F.round(F.col("value").cast("double"), 4).alias("v")).distinct()
    claimed = rows.select(*keys, F.explode(numbers(F.col("_text"))).alias("token"))
    grounded = _grounded(claimed.select("token"), figures, [])
    tone = rows.select(*keys, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_prose", F.lit(TONE), F.lit(1)), F.lower))).alias("token"))

    def of(df: DataFrame, kind: str, severity: str) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "token")

    found = of(said.join(known, "token", "left_anti"), "unknown_handle", "error").unionByName(of(claimed.join(grounded, "token", "left_anti"), "ungrounded_number", "warning")).unionByName(of(tone, "tone", "warning"))
    if not min_facts:
        return found
    report = report or keys
    present = said.join(known, "token", "left_semi").select(*report, F.concat(F.lit("@"), "token").alias("token"))
    facts = present.unionByName(claimed.join(grounded, "token", "left_semi").select(*report, "token"))
    facts = facts.unionByName(rows.select(*report, F.lit(None).cast("string").alias("token"))).groupBy(*report).agg(F.count_distinct("token").alias("_facts"))
    empty = rows.select(*keys).distinct().join(facts.filter(F.col("_facts") < min_facts), report)
    return found.unionByName(of(empty.withColumn("token", F.col("_facts").cast("string")), "empty_diagnosis", "error"))


def leaks(deliverables: DataFrame, reports: DataFrame, keys: list[str], texts: list[str], report_texts: list[str]) -> DataFrame:
    """Like ``findings``, the handles (errors) and numbers (warnings) of deliverables that the report of the same ``keys`` doesn't contain. A
    number is contained under the rules by which figures ground one; all numbers of the report count as its figures."""
    made = deliverables.select(*keys, F.concat_ws("\n", *texts).alias("_text"))
    told = reports.select(*keys, F.concat_ws("\n", *report_texts).alias("_text"))

    def named(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.explode(handles(F.col("_text"))).alias("token")).distinct()

    read = F.transform(F.regexp_extract_all("_text", F.lit(NUMBER), F.lit(0)), lambda t: F.round(_compact(t).try_cast("double"), 4))
    figures = told.select(*keys, F.explode(read).alias("v")).filter("v IS NOT NULL").distinct()
    claimed = made.select(*keys, F.explode(numbers(F.col("_text"))).alias("token")).distinct()
    new = claimed.join(_grounded(claimed, figures, keys), [*keys, "token"], "left_anti")
    of = [(named(made).join(named(told), [*keys, "token"], "left_anti"), "error"), (new, "warning")]
    handle, number = (df.select(*keys, F.lit("livrable_leak").alias("kind"), F.lit(severity).alias("severity"), "token") for df, severity in of)
    return handle.unionByName(number)


def verdicts(reports: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """For each report its errors and warnings; one with an error needs revision."""
    tally = found.groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    rows = reports.select(*keys).distinct().join(tally, keys, "left")
    rows = rows.select(*keys, F.coalesce("e", F.lit(0)).alias("n_errors"), F.coalesce("w", F.lit(0)).alias("n_warnings"))
    return rows.withColumn("verdict", F.when(F.col("n_errors") > 0, "revision").otherwise("ok"))
