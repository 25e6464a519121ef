"""Near-duplicate texts by the Jaccard similarity of their character n-grams.

Two texts similar to t, of a and b grams, differ in at most (1 - t) / (1 + t) (a + b) of them. If all grams are dealt to more parts than that by their hashes, one
part is the same in both; such a part holds several grams, so few other texts have it. Where t is low, pairs come from the rarest grams instead: of a text with n grams, the first
n - ceil(t n) + 1 in the order of rarity hold one of the common ones. Pairs are checked on the whole sets, after those have gone whose sizes or maps of
256 bits differ too much: a bit is set if an odd number of the text's grams fall on it, so two maps differ in no more bits than there are grams
in one of the texts only. Nothing is lost by this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.operators.graph import linked_groups
from ripplework.plans.cluster import cut, lookup_join, release

#: 64-bit words of a text's map.
WORDS = 4
BITMAP = [f"b{i}" for i in range(WORDS)]
#: Texts of one gram that meet in one task.
BLOCK = 2_000
PAIRS_A_ROW = 64
#: A round that leaves more than this share of the pairs is the last one.
PAYS = 0.9
#: Least threshold at which texts meet by parts.
LOW = 0.75


def char_ngrams(text: Column | str, n: int = 3) -> Column:
    """The distinct character n-grams of the text with single blanks for white space. A shorter text is its own gram, an empty one has none."""
    whole = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))

    def of(text: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n)))
        return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(F.array_distinct(grams))

    return F.get(F.transform(F.array(whole), of), F.lit(0))  # as a variable of the lambda, the white space is replaced once and not for each gram


def _sets(texts: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    grams = F.transform(char_ngrams(F.coalesce(F.col(text), F.lit("")), n), lambda g: F.xxhash64(g))
    return cut(texts.select(F.col(id_col).alias("id"), F.explode(F.array(grams)).alias("grams")).filter(F.size("grams") > 0))


def _levels(largest: int, threshold: float) -> list[tuple[int, int]]:
    """Least size and parts of each level up to that of ``largest``. Of two similar texts the one with more grams is on the other's level or the next one, and
    fewer grams than the lower level has parts are in one of them only."""
    levels, least = [], 1
    while least <= largest:
        above = max(int(least / threshold + 1e-9), int(least * 1.1)) + 1
        levels.append((least, int((above - 1) * (1 - threshold) / threshold + 1e-6) + 1))
        least = above
    return levels


def _parts(sets: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``size``, the words of the bitmap, and as ``gram`` a key for each part of a text, on its own level and the one below. The hashes of grams deal them
    to the parts; since two similar texts differ in fewer grams than there are parts, one part is the same in both, be it empty."""
    levels = _levels(sets.agg(F.coalesce(F.max(F.size("grams")), F.lit(0))).first()[0], threshold)
    least, parts = (F.array(*(F.lit(x).cast("int") for x in xs)) for xs in (zip(*levels) if levels else ([1], [1])))
    own = F.size(F.filter(least, lambda x: x <= F.size("grams"))) - 1
    # by text from here on, so that the grams are shuffled once as arrays and their parts not at all
    kept = ["id", "size", *BITMAP]
    each = sets.repartition("id").select("id", F.size("grams").alias("size"), *_maps(), "grams", F.explode(F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))).alias("level"))
    each = each.select(*kept, "grams", "level", F.explode(F.array(F.get(parts, F.col("level")))).alias("parts"))
    dealt = F.transform("grams", lambda g: F.struct(F.pmod(F.shiftright(g, 8), F.col("parts").cast("long")).alias("part"), g.alias("g")))
    none = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.cast("long").alias("part"), F.lit(0).cast("long").alias("g")))
    keys = each.select(*kept, "level", F.inline(F.concat(dealt, none))).groupBy(*kept, "level", "part").agg(F.bit_xor(F.xxhash64("g")).alias("x"), F.count(F.lit(1)).alias("n"))
    return keys.select(*kept, F.xxhash64("level", "part", "x", "n").alias("gram"))


def _maps() -> list[Column]:
    """The words of the bitmap of ``grams``."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(g, F.lit(64)).cast("int"))
    word = lambda i: F.filter("grams", lambda g: F.pmod(F.shiftright(g, 6), F.lit(WORDS)) == i)
    return [F.aggregate(word(i), F.lit(0).cast("long"), lambda b, g: b.bitwiseXOR(bit(g))).alias(f"b{i}") for i in range(WORDS)]


def _keys(sets: DataFrame, threshold: float) -> DataFrame:
    """What similar texts share: parts, or rare grams where a threshold is so low that parts would be of one gram or none."""
    return cut((_parts if threshold >= LOW else _prefixes)(sets, threshold))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``size``, the words of the bitmap, and each of the rarest grams of a text, of which a similar one has at least one among its own."""
    each = sets.select("id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    rarity = cut(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("df", F.col("n")))
    word = F.expr("shiftleft(1L, cast(pmod(gram, 64) AS int))")
    maps = [F.coalesce(F.bit_xor(F.when(F.pmod(F.shiftright("gram", 6), F.lit(WORDS)) == i, word)), F.lit(0).cast("long")).alias(f"b{i}") for i in range(WORDS)]
    ranked = lookup_join(each, rarity, ["gram"], "n", "id").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o"), *maps)
    first = F.slice("o", 1, (F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1).cast("int"))
    return ranked.select("id", "size", *BITMAP, F.explode(first).alias("p")).select("id", "size", *BITMAP, "p.gram")


def _close(a: str, b: str, threshold: float) -> Column:
    """Whether two rows can be similar: by their sizes, and by the bits in which their maps differ, which are no more than the grams that
    one has and the other hasn't."""
    size = {x: F.col(f"{x}.size") for x in (a, b)}
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITMAP), F.lit(0))
    return (F.least(*size.values()) >= threshold * F.greatest(*size.values()) - 1e-9) & (differ <= (1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-6)


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    left, right = (sets.select(F.col("id").alias(end), F.col("grams").alias(f"_{end}")) for end in ("src", "dst"))
    both = F.size(F.array_intersect("_src", "_dst"))
    found = pairs.distinct().join(left, "src").join(right, "dst").withColumn("sim", both / (F.size("_src") + F.size("_dst") - both))
    return found.filter(F.col("sim") >= threshold).select("src", "dst", "sim")


def _meeting(prefix: DataFrame, threshold: float, apart: str) -> DataFrame:
    """Pairs that share a prefix gram, can be similar, and differ in the column ``apart``. Grams whose texts are alike in ``apart`` are left out first.

    The texts of a gram meet in blocks: of every two parts, and within each, in a task of its own, so a gram of a million texts is
    many tasks' work.
    """
    grams = prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min(apart) != F.max(apart)).alias("_split")).filter("_split")
    grams = cut(grams.withColumn("_parts", F.ceil(F.col("n") / BLOCK)))
    rows = lookup_join(prefix, grams.select("gram", "n", "_parts"), ["gram"], "n", "id").filter("_parts IS NOT NULL")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("id"), "_parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda q: F.struct(F.least(q, "_part").alias("i"), F.greatest(q, "_part").alias("j")))
    rows = rows.select("id", "size", *BITMAP, "gram", apart if apart != "id" else F.col("id").alias("_id"), "_part", F.explode(cells).alias("_cell"))
    side = apart if apart != "id" else "_id"
    a, b = rows.alias("a"), rows.alias("b")
    block = (F.col("a._part") == F.col("a._cell.i")) & (F.col("b._part") == F.col("b._cell.j")) & ((F.col("a._part") != F.col("b._part")) | (F.col("a.id") < F.col("b.id")))
    on = (F.col("a.gram") == F.col("b.gram")) & (F.col("a._cell") == F.col("b._cell")) & block & (F.col(f"a.{side}") != F.col(f"b.{side}")) & _close("a", "b", threshold)
    return a.join(b, on).select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"))


def similar_pairs(texts: DataFrame, id_col: str, text: str, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """``src`` < ``dst`` and ``sim`` of the pairs of at least ``threshold``. NULL and empty texts have none."""
    sets = _sets(texts, id_col, text, n)
    return _checked(_meeting(_keys(sets, threshold), threshold, "id"), sets, threshold)


def similar_groups(texts: DataFrame, id_col: str, text: str, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """``node`` and ``label`` of every text that is linked to another one.

    What is left of different groups meets pair by pair once that is no more than ``PAIRS_A_ROW`` pairs for each text and gram of its prefix. Before,
    in rounds with different hashes, each text is held against one text of another group for each such gram, that of least hash, and groups that this
    links are joined; so a large family costs one row a text and gram. Rounds end when one joins nothing or leaves nearly all pairs, which are then not of families.
    """
    sets = _sets(texts, id_col, text, n)
    prefix = _keys(sets, threshold)
    total, turn, before = prefix.count(), 0, float("inf")
    labels = cut(sets.select(F.col("id").alias("node"), F.col("id").alias("label")))
    rows, left = prefix.withColumn("label", F.col("id")), _left(prefix)
    while PAIRS_A_ROW * total < left <= PAYS * before:
        found = _checked(_stars(rows, threshold, turn), sets, threshold)
        labels, joined = _joined(labels, found)
        if not joined:
            break
        before = left
        release(rows)
        rows, turn = cut(prefix.join(labels.withColumnRenamed("node", "id"), "id")), turn + 1
        left = _left(rows)
    labels, _ = _joined(labels, _checked(_meeting(rows, threshold, "label"), sets, threshold))
    sizes = cut(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("_in")).filter("n > 1"))
    return lookup_join(labels, sizes, ["label"], "n", "node").filter("_in").select("node", "label")


def _left(rows: DataFrame) -> int:
    """Pairs of texts that share a gram and differ in label, if they have any yet."""
    if "label" not in rows.columns:
        n = F.col("n").cast("double")
        return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    sizes = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).cast("double").alias("m"))
    left = sizes.groupBy("gram").agg(((F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"))
    return left.agg(F.sum("p")).first()[0] or 0


def _joined(labels: DataFrame, found: DataFrame) -> tuple[DataFrame, bool]:
    """``labels`` after the groups that links join have become one, and whether there was one to join."""
    moved = found.select("src", "dst")
    for end in ("src", "dst"):
        moved = moved.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    groups = cut(linked_groups(moved.filter("src <> dst").distinct()))
    if groups.isEmpty():
        return labels, False
    sizes = cut(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(groups.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label"))
    after = lookup_join(labels, sizes, ["label"], "n", "node")
    after = cut(after.select("node", F.coalesce("_to", "label").alias("label")))
    release(labels, sizes, groups)
    return after, True


def _stars(rows: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs of a text and, for each gram of its prefix, the text of least hash among those of other groups."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "label", "size", *BITMAP)
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("p"), (F.min("label") != F.max("label")).alias("_split")).filter("_split")
    met = lookup_join(rows, cut(grams.drop("_split")), ["gram"], "n", "id").filter("p IS NOT NULL AND p.label <> label")
    met = met.select(F.struct("id", "size", *BITMAP).alias("t"), "p").filter(_close("t", "p", threshold))
    return met.select(F.least("t.id", "p.id").alias("src"), F.greatest("t.id", "p.id").alias("dst"))


def near_dup_groups(dup: DataFrame, threshold: float = 0.8, n: int = 3, examples: int = 3) -> DataFrame:
    """Groups of at least two linked texts of ``dup`` (``text``, ``n`` copies): variants, copies, the most frequent variant, and the next ones
    as ``variant_examples``; of equally frequent ones the lesser text goes first."""
    texts = cut(dup.select(F.xxhash64("text").alias("id"), "text", F.col("n").alias("copies")))
    groups = cut(similar_groups(texts, "id", "text", threshold, n))
    sizes = cut(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n_variants")))
    found = texts.join(groups.withColumnRenamed("node", "id"), "id")
    totals = found.groupBy("label").agg(F.sum("copies").alias("total_count"))
    # the first of each hash share before the first of all, so that no group is sorted whole in one task
    order = (F.desc("copies"), "text")
    few = found.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(256)))
    for by in (("label", "_s"), ("label",)):
        few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= examples + 1)
    first = few.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("t"))
    found = sizes.join(totals, "label").join(first, "label")
    shown = F.transform(F.slice("t", 2, examples), lambda x: F.substring(x, 1, 120))
    return found.select("n_variants", "total_count", F.substring(F.get("t", F.lit(0)), 1, 160).alias("representative"), shown.alias("variant_examples"))


def near_dup_totals(groups: DataFrame) -> DataFrame:
    """One row on ``near_dup_groups``: how many there are, the texts in them, and their copies."""
    return groups.agg(F.count(F.lit(1)).alias("n_near_dup_groups"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n_variants", "n_texts_merged"), ("total_count", "messages_in_near_dup_groups"))))
