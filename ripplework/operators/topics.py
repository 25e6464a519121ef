"""Topics of a corpus: term frequencies, TF-IDF, k-means over distinct texts, and their course over time."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.functions.text import TERM, text_key
from ripplework.operators.profile import pct
from ripplework.operators.timeseries import series, window
from ripplework.plans.cluster import cut, lookup_join

#: Stop words of the topic model.
STOP_WORDS = """
le la les un une des de du et a à en au aux ce cet cette ces que qui quoi dont ou où pour par sur avec sans dans est sont ete été
être etre c s il elle ils elles on nous vous je tu son sa ses mon ma mes ton ta tes leur leurs se ne pas ni plus moins mais donc or
car si comme tout tous toute toutes meme même aussi bien fait faire cela ça ca y d l m n t qu jai rt via https http co amp lol ont
avoir etre quand votre notre propos entre non rien faut certains personne
""".split()

#: Stop words of the term counts.
TERM_STOP_WORDS = """
le la les un une des de du et a à en au aux ce cette ces que qui quoi dont ou où pour par sur avec sans dans est sont ete été être
c est s il elle ils elles on nous vous je tu son sa ses mon ma mes ton ta tes leur leurs se ne pas ni plus moins mais donc or car si
comme tout tous toute toutes meme même aussi bien fait faire cela ça y d l m n t qu jai jaine rt via https http co t.co amp lol
""".split()


#: Terms whose weights are broadcast.
BROADCAST = 1 << 18


def term_docfreq(posts: DataFrame, k: int = 40, stop: list[str] = TERM_STOP_WORDS) -> DataFrame:
    """The ``k`` terms in most posts. Equal texts are counted once and weighted."""
    texts = posts.groupBy(F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    terms = F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), F.array(*map(F.lit, stop)))
    return texts.select("n", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("n").alias("n_posts")).orderBy(F.desc("n_posts"), "term").limit(k)


def representatives(posts: DataFrame) -> DataFrame:
    """Each distinct text but the empty one with its number of posts and the one of greatest reach (of several, the least ``row_id``)."""
    best = F.min(F.struct((-F.col("reach")).alias("a"), "row_id"))["row_id"]
    return posts.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("weight"), best.alias("row_id"))


def _words(texts: DataFrame, ngram: int) -> DataFrame:
    """``texts`` with their ``terms``: words and, with ``ngram`` 2, pairs of neighbours once stop words are gone."""
    words = RegexTokenizer(inputCol="text", outputCol="_all", gaps=False, pattern=r"(?U)\b\w\w+\b").transform(texts)
    words = StopWordsRemover(inputCol="_all", outputCol="_one", stopWords=STOP_WORDS).transform(words)
    for n in range(2, ngram + 1):
        words = NGram(n=n, inputCol="_one", outputCol=f"_{n}").transform(words)
    return words.select(*texts.columns, F.concat("_one", *(f"_{n}" for n in range(2, ngram + 1))).alias("terms"))


def tfidf(texts: DataFrame, min_df: int = 5, max_features: int = 5000, ngram: int = 2) -> tuple[DataFrame | None, list[str], list[float]]:
    """The rows of ``texts`` with their ``terms`` and vectors (``tf``, and ``features``, weighted and at unit length), the vocabulary and its weights.

    Terms are words and, with ``ngram`` 2, pairs of neighbours once stop words are gone, of which the ``max_features`` most frequent ones that occur in at least
    ``min_df`` texts and at most half of them are kept. A weight is ln((1 + texts) / (1 + texts with the term)) + 1. Without such terms: None."""
    words = cut(_words(texts, ngram))
    try:
        counter = CountVectorizer(inputCol="terms", outputCol="tf", minDF=float(min_df), maxDF=0.5, vocabSize=max_features).fit(words)
    except Exception as e:
        if "vocabulary" not in str(e).lower() and "requirement failed" not in str(e):
            raise
        return None, [], []
    counted = counter.transform(words)
    weights = IDF(inputCol="tf", outputCol="_").fit(counted).idf.toArray() + 1.0
    scaled = ElementwiseProduct(inputCol="tf", outputCol="w", scalingVec=Vectors.dense(weights)).transform(counted)
    return Normalizer(inputCol="w", outputCol="features").transform(scaled).drop("w"), counter.vocabulary, weights.tolist()


def _counted(words: DataFrame) -> DataFrame:
    """``id``, ``term`` and ``tf`` of the terms of each text; ``s`` holds its terms in order, equal ones side by side."""
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    runs = words.filter(F.size("s") > 0).select("id", "s", F.explode(F.array(starts)).alias("at"))
    end = lambda k: F.coalesce(F.get("at", k + 1), F.size("s"))
    return runs.select("id", F.inline(F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("term"), (end(k) - i).alias("tf")))))


def term_weights(posts: DataFrame, min_df: int = 5, max_features: int | None = None, ngram: int = 2) -> DataFrame:
    """The vocabulary of the distinct texts of ``posts``: ``term``, ``weight``, how often it occurs (``n``), and the sum of its parts of the texts' vectors
    (``mass``). Terms and weights are those of ``tfidf``; with ``max_features`` None none is left out.

    A text is as many rows as it has different terms, whatever the vocabulary's size. Weights of the terms in most texts, at most ``BROADCAST`` of them, are broadcast; only rows
    of rarer terms are shuffled to theirs.
    """
    words = cut(_words(posts.filter("text <> ''").select("text").distinct(), ngram).select(F.monotonically_increasing_id().alias("id"), F.array_sort("terms").alias("s")))
    texts = words.count()
    found = _counted(words).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).filter((F.col("df") >= min_df) & (F.col("df") <= 0.5 * texts))
    if max_features is not None:
        found = found.orderBy(F.desc("n"), "term").limit(max_features)
    found = cut(found.withColumn("weight", F.log((1.0 + texts) / (1.0 + F.col("df"))) + 1.0))
    powers = [1 << i for i in range(63)]
    held = found.agg(*(F.count_if(F.col("df") >= m).alias(str(m)) for m in powers)).first()
    least = next(m for m, n in zip(powers, held) if n <= BROADCAST)
    table = found.select("term", "weight")
    often, rare = F.broadcast(table.filter(found.df >= least)), table.filter(found.df < least).hint("shuffle_merge")

    def weighted(words: DataFrame) -> DataFrame:
        """The rows of ``_counted`` for the vocabulary, with ``w``, the frequency times the weight."""
        each = _counted(words)
        rows = each.join(often, "term")
        if held[0] > held[powers.index(least)]:
            rows = rows.unionByName(each.join(often, "term", "left_anti").join(rare, "term"))
        return rows.select("id", "term", (F.col("tf") * F.col("weight")).alias("w"))

    norms = weighted(words).groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    parts = weighted(words.join(norms, "id").select(F.col("norm").alias("id"), "s"))
    mass = parts.groupBy("term").agg(F.round(F.sum(F.col("w") / F.col("id")), 6).alias("mass"))
    return found.join(mass, "term").select("term", F.round("weight", 9).alias("weight"), "n", "mass")


class Topics:
    """k-means over the TF-IDF vectors of the distinct texts.

    The vectors are those of ``tfidf``. Of ``n_init``
    fits with following seeds the closest is kept. A corpus without such terms has no topics.
    """

    def __init__(self, posts: DataFrame, k: int = 6, min_df: int = 5, max_features: int = 5000, ngram: int = 2, seed: int = 42, n_init: int = 3, dedupe: bool = True):
        self.posts = posts
        texts = representatives(posts) if dedupe else posts.filter("text <> ''").select("text", F.lit(1).cast("long").alias("weight"), "row_id")
        self.centres, self.texts = [], None
        scaled, self.vocabulary, _ = tfidf(texts, min_df, max_features, ngram)
        if scaled is None:
            return
        scaled = scaled.select("text", "weight", "row_id", "features").persist()
        models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(scaled) for i in range(n_init)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        self.centres = [c.tolist() for c in best.clusterCenters()]
        self.texts = cut(best.setPredictionCol("cluster").transform(scaled))
        scaled.unpersist()

    def assigned(self) -> DataFrame:
        """Every post with its cluster; posts without a text aren't there."""
        if self.texts is None:
            return self.posts.withColumn("cluster", F.lit(0)).limit(0)
        where = cut(self.texts.groupBy(text_key("text").alias("_k")).agg(F.min("cluster").alias("cluster"), F.sum("weight").alias("_n")))
        return lookup_join(self.posts.withColumn("_k", text_key("text")), where, ["_k"], "_n", "row_id").filter("cluster IS NOT NULL").drop("_k")

    def terms(self, k: int = 12) -> DataFrame:
        """The ``k`` heaviest terms of each cluster's centre."""
        rows = [(i, r, self.vocabulary[t], float(c[t])) for i, c in enumerate(self.centres) for r, t in enumerate(sorted(range(len(c)), key=lambda t: (-c[t], t))[:k]) if c[t] > 0]
        return self.posts.sparkSession.createDataFrame(rows, "cluster int, rank int, term string, weight double")

    def summary(self, samples: int = 3) -> DataFrame:
        """Size, share, distinct texts, top terms, nearest texts and sentiment mix of each cluster. The share is of posts with a text."""
        rows = self.assigned()
        mix = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_messages"), F.count_distinct("text").alias("n_texts"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in ("negative", "neutral", "positive")))
        whole = mix.agg(F.sum("n_messages").alias("_all"))
        top = self.terms().groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select("cluster", F.col("t.term").alias("top_terms"))
        found = mix.join(F.broadcast(whole)).withColumn("share_pct", pct(F.col("n_messages"), F.col("_all"))).drop("_all").join(top, "cluster", "left")
        if self.texts is None:
            return found.withColumn("samples", F.array().cast("array<string>"))
        centres = self.posts.sparkSession.createDataFrame([(i, c) for i, c in enumerate(self.centres)], "cluster int, c array<double>")
        near = self.texts.join(F.broadcast(centres), "cluster")
        like = F.aggregate(F.zip_with(vector_to_array("features"), "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        near = near.select("cluster", "row_id", "text", F.round(like, 9).alias("s"))
        order = [F.desc("s"), F.asc("row_id")]
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).filter(F.col("r") <= samples)
        near = near.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", F.substring("text", 1, 280).alias("text")))).alias("s")).select("cluster", F.col("s.text").alias("samples"))
        return found.join(near, "cluster", "left")

    def timelines(self, freq: str = "D") -> DataFrame:
        """Posts by cluster and bin, and each bin's part of the cluster's greatest one."""
        binned = series(self.assigned(), freq, keys=("cluster",))
        return binned.withColumn("of_peak", F.round(F.col("value") / F.max("value").over(Window.partitionBy("cluster")), 4))

    def drift(self, freq: str = "D", k: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
        """The course of the ``k`` largest clusters from ``start`` to ``end``, each bin as part of the cluster's greatest one in that time."""
        rows = self.assigned()
        largest = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(k)
        binned = series(window(rows, start, end), freq, keys=("cluster",)).join(F.broadcast(largest.select("cluster")), "cluster")
        return binned.withColumn("of_peak", F.round(F.col("value") / F.max("value").over(Window.partitionBy("cluster")), 4))

    def lead_lag(self, freq: str = "D") -> DataFrame:
        """The clusters in the order of their peaks."""
        peak = F.min(F.struct((-F.col("value")).alias("a"), "period"))
        found = series(self.assigned(), freq, keys=("cluster",)).groupBy("cluster").agg(peak.alias("p"))
        return found.select("cluster", F.col("p.period").alias("peak_period"), (-F.col("p.a")).alias("peak_value")).orderBy("peak_period", "cluster")


