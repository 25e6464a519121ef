"""Records that differ only in white space, case, punctuation or field order.

Columns are dictionary-encoded: each distinct raw value is canonicalised once, each distinct canonical value gets an integer,
and a record becomes its (field, integer) pairs in the order of the fields, without the fields that are missing, null or
empty. These compact tuples are grouped. Raw values are matched to the dictionary by 128-bit keys, so texts are shuffled
once, and only distinct ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplework.functions.text import letters_digits
from ripplework.plans.cluster import cut, lookup_join


def _key(c: Column | str) -> Column:
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


def dictionary(df: DataFrame, fields: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """``field`` (its number), ``raw`` (key of a raw value), ``id`` (of its canonical value; NULL if nothing is left of it) and
    ``n`` (rows with the raw value). NULL counts as empty; ``defaults`` has the canonical value of an empty one."""
    defaults = defaults or {}
    entries = F.array(*(F.struct(F.lit(i).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for i, f in enumerate(fields)))
    raw = df.select(F.inline(entries)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    canonical = letters_digits("value")
    for i, f in enumerate(fields):
        if f in defaults:
            canonical = F.when((F.col("field") == i) & (letters_digits("value") == ""), F.lit(defaults[f])).otherwise(canonical)
    raw = cut(raw.select("field", _key("value").alias("raw"), "n", F.nullif(canonical, F.lit("")).alias("canonical")))
    # sorted, so that the numbers are the same if a task is run again
    ids = raw.filter("canonical IS NOT NULL").select("field", "canonical").distinct().sortWithinPartitions("field", "canonical")
    ids = ids.withColumn("id", F.monotonically_increasing_id())
    return cut(raw.join(ids, ["field", "canonical"], "left").select("field", "raw", "id", "n"))


def tuples(df: DataFrame, id_col: str, fields: list[str], exact: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """The id and the ``tuple`` of each record. ``exact`` columns are integers already. Fields are numbered as listed, then the exact ones."""
    words = dictionary(df, fields, defaults)
    rows = df.select(F.col(id_col), *(_key(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_k{i}") for i, f in enumerate(fields)), *(F.col(c).cast("long").alias(f"_x{i}") for i, c in enumerate(exact)))
    for i in range(len(fields)):
        table = words.filter(F.col("field") == i).select(F.col("raw").alias(f"_k{i}"), F.col("id").alias(f"_v{i}"), "n")
        rows = lookup_join(rows, table, [f"_k{i}"], "n", id_col).drop(f"_k{i}")
    pairs = [(i, F.col(f"_v{i}")) for i in range(len(fields))] + [(len(fields) + i, F.col(f"_x{i}")) for i in range(len(exact))]
    listed = F.array(*(F.struct(F.lit(i).alias("field"), v.alias("id")) for i, v in pairs))
    return rows.select(id_col, F.filter(listed, lambda p: p["id"].isNotNull()).alias("tuple"))


class Copies:
    """Groups of ``df``'s records with equal tuples. Ids must be unique; records with no field at all are copies of each other."""

    def __init__(self, df: DataFrame, id_col: str, fields: list[str], exact: tuple[str, ...] = (), defaults: dict[str, str] | None = None, required: tuple[str, ...] = ()):
        """``required``: fields without which a record is no case."""
        self.id_col = id_col
        rows = tuples(df, id_col, fields, exact, defaults)
        names = [*fields, *exact]
        for number in map(names.index, required):
            rows = rows.filter(F.array_contains(F.transform("tuple", lambda p: p["field"]), number))
        self.rows = cut(rows)
        self.groups = self.rows.groupBy("tuple").agg(F.min(id_col).alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))

    def kept(self) -> DataFrame:
        """``kept_id`` (the least id) and ``n_copies`` (itself included) of each group."""
        return self.groups.select("kept_id", "n_copies")

    def found(self) -> DataFrame:
        """``kept_id`` and ``copy_id`` of each record but the kept one."""
        more = cut(self.groups.filter("n_copies > 1"))
        rows = lookup_join(self.rows, more, ["tuple"], "n_copies", self.id_col)
        return rows.filter(F.col(self.id_col) != F.col("kept_id")).select("kept_id", F.col(self.id_col).alias("copy_id"))


def parse_payloads(df: DataFrame, id_col: str, payload: str, names: list[str]) -> DataFrame:
    """The id and the named fields of each record that is a JSON object or ``name=value`` fields separated by ``|``. Names are compared by
    their letters. Of fields with one name the first that isn't empty counts; what can't be read has no fields."""
    payload = F.trim(F.col(payload))
    json = F.map_entries(F.from_json(payload, T.MapType(T.StringType(), T.StringType())))
    pairs = F.transform(
        F.split(payload, r"\|"),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.instr(p, "=") > 0, p.substr(F.instr(p, "=") + 1, F.length(p))).alias("value")),
    )
    entries = F.when(payload.startswith("{"), json).otherwise(pairs)
    known = F.transform(entries, lambda e: F.struct(F.lower(F.regexp_replace(e["key"], r"[^\p{L}]+", "")).alias("key"), e["value"].alias("value")))
    full = F.filter(known, lambda e: F.trim(e["value"]) != "")

    def first(name: str) -> Column:
        return F.get(F.filter("_full", lambda e: e["key"] == name), F.lit(0))["value"]

    # through a generator, so that the fields are read once and not again for each name
    return df.select(id_col, F.explode(F.array(full)).alias("_full")).select(id_col, *(first(name).alias(name) for name in names))
