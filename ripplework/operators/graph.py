"""Graphs as edge tables: groups of linked nodes, and the network of accounts that post one text almost at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ripplework.functions.text import text_key
from ripplework.operators.coordination import post_windows
from ripplework.operators.profile import accounts, pct
from ripplework.plans.cluster import cut, lookup_join, release


def hash_order(c: str) -> Column:
    """The order in which nodes become pivots."""
    return F.xxhash64(c)


def absorb(edges: DataFrame) -> DataFrame:
    """``node`` and ``pivot`` of the nodes that come before all their neighbours in hash order, and of the neighbours they absorb."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    least = ends.groupBy("node").agg(F.min(F.struct(hash_order("other").alias("h"), F.col("other").alias("id"))).alias("m"))
    pivots = least.filter(F.struct(hash_order("node"), F.col("node")) < F.col("m")).select(F.col("node").alias("pivot"))
    absorbed = ends.join(pivots, F.col("other") == F.col("pivot")).groupBy("node").agg(F.min(F.struct(hash_order("pivot").alias("h"), "pivot"))["pivot"].alias("pivot"))
    return absorbed.unionByName(pivots.select(F.col("pivot").alias("node"), "pivot"))


def linked_groups(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every end of an edge (``src``, ``dst``); two nodes have one label if edges lead from one to the other.

    Each round contracts every pivot with its neighbours and keeps the edges between what is left, so nodes at least halve in
    each component.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst"))
    labels = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        found = cut(absorb(edges))
        moved = edges
        for end in ("src", "dst"):
            moved = moved.join(found.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("pivot", end)).drop("pivot")
        left = cut(moved.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct())
        moved = cut(labels.join(found.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("pivot", "label").alias("label")))
        release(edges, labels, found)
        edges, labels = left, moved
    release(edges)
    return labels


#: Communities that a node sees in a large window, besides its own.
SEEN = 8


def _degrees(links: DataFrame, large: DataFrame) -> DataFrame:
    sizes = large.groupBy("win").agg(F.sum("m").alias("size"))
    met = large.join(sizes, "win").select("node", (F.col("w") * F.col("m") * (F.col("size") - F.col("m"))).alias("w"))
    return links.select(F.col("src").alias("node"), "w").unionByName(met).groupBy("node").agg(F.sum("w").cast("double").alias("k"))


def _settled(nodes: DataFrame, links: DataFrame, large: DataFrame, whole: float, settled: float, rounds: int) -> DataFrame:
    """``nodes`` (``node``, ``k``) with the ``label`` of each after local moves."""
    now, windows = cut(nodes.select("node", "k", F.col("node").alias("label"), F.lit(True).alias("moved"))), not large.isEmpty()
    for turn in range(rounds):
        own = now.select("node", "label")
        near = links.join(own.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label", "w")
        placed = large.join(own, "node")
        counts = placed.groupBy("win", "label").agg(F.sum("m").alias("n"))
        rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("n"), "label"))
        most = counts.withColumn("_r", rank).filter(F.col("_r") <= SEEN).drop("_r")
        seen = placed.withColumnRenamed("label", "_own").join(most, "win").select("node", "label", (F.col("w") * F.col("m") * (F.col("n") - F.when(F.col("label") == F.col("_own"), F.col("m")).otherwise(0))).alias("w"))
        kept = placed.join(counts, ["win", "label"]).join(most.select("win", "label"), ["win", "label"], "left_anti").select("node", "label", (F.col("w") * F.col("m") * (F.col("n") - F.col("m"))).alias("w"))
        near = (near.unionByName(seen).unionByName(kept) if windows else near).unionByName(own.withColumn("w", F.lit(0).cast("long"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        totals = now.groupBy("label").agg(F.sum("k").alias("_all"), F.count(F.lit(1)).alias("n"))
        near = lookup_join(near, totals, ["label"], "n", "node").join(now.select("node", "k", F.col("label").alias("_own")), "node")
        stays = F.col("label") == F.col("_own")
        gain = F.col("w") - F.col("k") * (F.col("_all") - F.when(stays, F.col("k")).otherwise(0.0)) / whole
        best = near.groupBy("node").agg(F.min(F.struct(F.round(-gain, 9).alias("a"), (~stays).alias("o"), hash_order("label").alias("h"), "label"))["label"].alias("best"))
        mine = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        after = now.join(best, "node").select("node", "k", F.when(mine, F.col("best")).otherwise(F.col("label")).alias("label"), F.when(mine, F.col("best") != F.col("label")).otherwise(F.col("moved")).alias("moved"))
        after = cut(after)
        release(now)
        now = after
        n, moved = now.agg(F.count(F.lit(1)), F.count_if("moved")).first()
        if turn and moved <= settled * n:
            break
    return now


class CoActivity:
    """Accounts linked by each window of ``delta`` seconds in which both post a duplicated text; a link's weight is the number of such windows,
    and links below ``min_edge_weight`` are left out.

    Windows are kept as incidences with accounts: one of m accounts is m rows, not m (m - 1) / 2 pairs. Pairs are formed
    only within windows of at most ``pair_window`` accounts. What larger windows link is found without pairs of accounts: accounts that are in
    the same large windows form a class, and classes are held against each other, so every figure is exact whatever the size of a window. What is counted by class
    costs as much as there are pairs of classes in a large window; components and communities of a ``min_edge_weight`` of 1 don't need it.
    """

    def __init__(self, posts: DataFrame, delta: int = 60, min_dup: int = 5, min_edge_weight: int = 1, pair_window: int = 500):
        self.posts, self.least = posts, min_edge_weight
        self.texts, rows = post_windows(posts, delta, min_dup)
        rows = rows.withColumn("win", F.xxhash64("k", "anchor"))
        sizes = rows.groupBy("win").agg(F.count(F.lit(1)).alias("size"), F.min("author").alias("first")).filter("size > 1")
        self.rows = cut(rows.join(sizes, "win").select("author", "win", "k", "size", "first"))
        self.large = self.rows.filter(F.col("size") > pair_window)
        self.small = self.rows.filter(F.col("size") <= pair_window)
        self._pairs = self._classes = None

    def account_links(self) -> DataFrame:
        """For each account: its windows and the weight of its links (accounts met, counted in every window), before any link is left out."""
        return self.rows.groupBy("author").agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.col("size") - 1).alias("link_weight"))

    def edges(self) -> DataFrame:
        """``src`` < ``dst`` and ``weight`` of the accounts that share a window of at most ``pair_window`` accounts. The weight counts larger windows too,
        as does ``large``."""
        if self._pairs is None:
            a, b = (self.small.select("win", F.col("author").alias(end)) for end in ("src", "dst"))
            pairs = a.join(b, "win").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
            wins = cut(self.large.groupBy("author").agg(F.collect_set("win").alias("w")))
            for end in ("src", "dst"):
                pairs = pairs.join(wins.select(F.col("author").alias(end), F.col("w").alias(f"_{end}")), end, "left")
            pairs = pairs.withColumn("large", F.coalesce(F.size(F.array_intersect("_src", "_dst")), F.lit(0)).cast("long"))
            self._pairs = cut(pairs.select("src", "dst", (F.col("weight") + F.col("large")).alias("weight"), "large").filter(F.col("weight") >= self.least))
        return self._pairs

    def _class_links(self) -> tuple[DataFrame, DataFrame]:
        """``author`` and ``class`` of the accounts in at least ``min_edge_weight`` large windows, and the pairs of classes (a class with itself too)
        that share so many."""
        if self._classes is None:
            sets = self.large.groupBy("author").agg(F.sort_array(F.collect_set("win")).alias("w")).filter(F.size("w") >= self.least)
            classes = cut(sets.select("author", F.xxhash64("w").alias("class"), "w"))
            inside = classes.groupBy("class").agg(F.first("w").alias("w")).select("class", F.explode("w").alias("win"))
            met = inside.select(F.col("class").alias("a"), "win").join(inside.select(F.col("class").alias("b"), "win"), "win").filter("a <= b")
            met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= self.least)
            self._classes = classes.select("author", "class"), cut(met.select("a", "b"))
        return self._classes

    def _heads(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The members of the classes, each class' ``size`` and least account ``first``, and links between the latter for classes that share
        enough windows."""
        members, met = self._class_links()
        heads = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min("author").alias("first"))
        a, b = (heads.select(F.col("class").alias(c), F.col("first").alias(end)) for c, end in (("a", "src"), ("b", "dst")))
        return members, heads, met.filter("a < b").join(a, "a").join(b, "b").select("src", "dst")

    def _spanning(self) -> DataFrame:
        """Links between accounts that join what all links join: in two steps from a window's or class's least account to the least of each of its
        parts, and on to the part's accounts, so that no account is an end of more than the root of their number."""
        if self.least == 1:
            rows, more = self.rows.select("author", F.col("win").alias("g"), "size", "first"), None
        else:
            members, heads, between = self._heads()
            rows = members.join(heads, "class").select("author", F.col("class").alias("g"), "size", "first")
            more = self.edges().select("src", "dst").unionByName(between)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("author"), F.ceil(F.sqrt("size"))))
        parts = rows.groupBy("g", "part", "first").agg(F.min("author").alias("sub"))
        links = rows.join(parts.drop("first"), ["g", "part"]).select(F.col("sub").alias("src"), F.col("author").alias("dst"))
        links = links.unionByName(parts.select(F.col("first").alias("src"), F.col("sub").alias("dst")))
        return (links if more is None else links.unionByName(more)).filter("src <> dst").distinct()

    def components(self) -> DataFrame:
        """``author`` and ``component`` (its least account) of each account with a link."""
        groups = linked_groups(self._spanning())
        least = cut(groups.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")))
        return lookup_join(groups, least, ["label"], "n", "node").select(F.col("node").alias("author"), "component")

    def _incidences(self) -> DataFrame:
        """``author``, ``win``, ``size`` and ``weight`` of the groups of linked accounts that communities come from: the windows, or with a higher
        ``min_edge_weight`` the links left, the classes, and a link between classes that share enough windows."""
        if self.least == 1:
            return self.rows.select("author", "win", "size", F.lit(1).cast("long").alias("weight"))
        members, heads, between = self._heads()
        links = self.edges().select("src", "dst", "weight").unionByName(between.withColumn("weight", F.lit(self.least).cast("long")))
        rows = links.select(F.explode(F.array("src", "dst")).alias("author"), F.xxhash64("src", "dst").alias("win"), F.lit(2).cast("long").alias("size"), "weight")
        return rows.unionByName(members.join(heads.filter("size > 1"), "class").select("author", F.col("class").alias("win"), "size", F.lit(self.least).cast("long").alias("weight")))

    def _weighted(self) -> tuple[DataFrame, DataFrame]:
        """The graph for communities: ``src``, ``dst`` and ``w`` in both directions, and ``node``, ``win``, ``m`` and ``w`` of the large windows (or
        classes), whose accounts are all linked to each other."""
        if self.least == 1:
            pairs, large = self.edges().select("src", "dst", (F.col("weight") - F.col("large")).alias("w")), self.large.withColumn("w", F.lit(1).cast("long"))
        else:
            members, heads, between = self._heads()
            members = members.join(heads.filter("size > 1").select("class"), "class")
            pairs = self.edges().select("src", "dst", F.col("weight").alias("w")).unionByName(between.withColumn("w", F.lit(self.least).cast("long")))
            large = members.withColumnRenamed("class", "win").withColumn("w", F.lit(self.least).cast("long"))
        both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        return cut(both), cut(large.select(F.col("author").alias("node"), "win", F.lit(1).cast("long").alias("m"), "w"))

    def communities(self, settled: float = 0.005, rounds: int = 12, levels: int = 8) -> DataFrame:
        """``author`` and ``community``, by local moves towards greater modularity. In each round one half of the nodes, by another hash, moves: each to that of its
        neighbours' communities which raises modularity most. When at most ``settled`` of the nodes moved at their last turn, or after ``rounds``
        rounds, communities become nodes and the same starts again, until none of them moves. Communities lie within components. In windows above ``pair_window``
        a node sees its own community and the ``SEEN`` largest ones."""
        links, large = self._weighted()
        nodes = cut(_degrees(links, large))
        placed, whole = cut(nodes.select(F.col("node").alias("author"), F.col("node").alias("community"))), nodes.agg(F.sum("k")).first()[0] or 0
        if not whole:
            return self.rows.select("author", F.col("author").alias("community")).distinct() if self.least == 1 else placed
        for _ in range(levels):
            found = _settled(nodes, links, large, whole, settled, rounds)
            if found.filter("label <> node").isEmpty():
                break
            to = found.select("node", "label", F.lit(1).cast("long").alias("n"))
            sizes = placed.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
            to = cut(to.drop("n").withColumnRenamed("node", "community").join(sizes, "community"))
            placed = cut(lookup_join(placed, to, ["community"], "n", "author").select("author", F.col("label").alias("community")))
            ends = found.select("node", "label")
            for end in ("src", "dst"):
                links = links.join(ends.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
            links = cut(links.filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")))
            large = cut(large.join(ends, "node").groupBy(F.col("label").alias("node"), "win", "w").agg(F.sum("m").alias("m")).select("node", "win", "m", "w"))
            nodes = cut(found.groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")))
        return placed

    def modularity(self, communities: DataFrame) -> DataFrame:
        """One row: the ``modularity`` of the communities (``author``, ``community``), over the windows' links or those left by ``min_edge_weight``."""
        rows = self._incidences().join(communities, "author")
        pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
        inner = rows.groupBy("win", "community", "weight").agg(F.count(F.lit(1)).alias("n")).groupBy("community").agg(F.sum(F.col("weight") * pairs("n")).alias("inner"))
        degree = rows.groupBy("community").agg(F.sum(F.col("weight") * (F.col("size") - 1)).alias("degree"))
        whole = degree.agg(F.sum("degree").alias("_all"))
        both = degree.join(inner, "community").join(F.broadcast(whole))
        return both.agg(F.round(F.coalesce(F.sum(2 * F.col("inner") / F.col("_all") - F.pow(F.col("degree") / F.col("_all"), 2)), F.lit(0.0)), 6).alias("modularity"))

    def _count_edges(self, groups: DataFrame) -> DataFrame:
        """``g`` and ``n_edges``: the links between accounts of one group (``author``, ``g``)."""
        a, b = (groups.select(F.col("author").alias(end), F.col("g").alias(g)) for end, g in (("src", "g"), ("dst", "g2")))
        pairs = self.edges().join(a, "src").join(b, "dst").filter("g = g2").groupBy("g").agg(F.count_if(F.col("large") < self.least).alias("n"))
        members, met = self._class_links()
        cells = members.join(groups, "author").groupBy("class", "g").agg(F.count(F.lit(1)).alias("m"))
        both = met.join(cells.select(F.col("class").alias("a"), "g", F.col("m").alias("ma")), "a").join(cells.select(F.col("class").alias("b"), F.col("g").alias("g2"), F.col("m").alias("mb")), "b").filter("g = g2")
        between = F.when(F.col("a") == F.col("b"), F.col("ma") * (F.col("ma") - 1) / 2).otherwise(F.col("ma") * F.col("mb")).cast("long")
        return pairs.unionByName(both.groupBy("g").agg(F.sum(between).alias("n"))).groupBy("g").agg(F.sum("n").alias("n_edges"))

    def summary(self) -> DataFrame:
        """One row: nodes, links, components and the largest one. The total weight of the windows' links counts those left out too."""
        parts = self.components()
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        weight = self.rows.groupBy("win").agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("long").alias("link_weight"))
        links = self._count_edges(parts.select("author", F.lit(0).alias("g"))).agg(F.coalesce(F.sum("n_edges"), F.lit(0)).alias("n_edges"))
        found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))
        return found.join(F.broadcast(weight)).join(F.broadcast(links))

    def community_summary(self, communities: DataFrame | None = None) -> DataFrame:
        """One row: communities of at least two accounts, the accounts in them, and the modularity of all."""
        found = cut(self.communities()) if communities is None else communities
        sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        figures = sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_accounts_in_clusters"))
        return figures.join(F.broadcast(self.modularity(found)))

    def clusters(self, k: int = 10, samples: int = 8, texts: int = 3, communities: DataFrame | None = None) -> DataFrame:
        """The ``k`` largest communities of at least two accounts: size, links inside, verified and single-post shares, the duplicated texts their
        accounts post most, with the posts of each, and the first accounts."""
        found = self.communities() if communities is None else communities
        table = cut(found.join(accounts(self.posts).select("author", "n_msgs", "any_verified"), "author"))
        n = F.count(F.lit(1))
        sized = table.groupBy("community").agg(n.alias("size"), pct(F.count_if("any_verified"), n).alias("verified_share_pct"), pct(F.count_if(F.col("n_msgs") == 1), n).alias("single_message_share_pct"))
        sized = cut(sized.filter("size > 1").orderBy(F.desc("size"), "community").limit(k))
        members = cut(table.select("author", "community").join(F.broadcast(sized.select("community")), "community"))
        inner = self._count_edges(members.select("author", F.col("community").alias("g"))).select(F.col("g").alias("community"), F.col("n_edges").alias("internal_edges"))
        posted = self.posts.filter("author IS NOT NULL AND text <> ''").groupBy("author", text_key("text").alias("k")).agg(n.alias("c"))
        copied = lookup_join(posted.join(members, "author"), self.texts.select("k", F.col("n").alias("_n"), F.lit(True).alias("_dup")), ["k"], "_n", "author").filter("_dup")
        copied = copied.groupBy("community", "k").agg(F.sum("c").alias("count")).join(self.texts.select("k", F.substring("text", 1, 120).alias("text")), "k")
        rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("count"), "text"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("a"), "text")))
        copied = copied.withColumn("_r", rank).filter(F.col("_r") <= texts).groupBy("community").agg(F.transform(listed, lambda x: F.struct((-x["a"]).alias("count"), x["text"].alias("text"))).alias("dominant_texts"))
        first = members.withColumn("_r", F.row_number().over(Window.partitionBy("community").orderBy("author"))).filter(F.col("_r") <= samples)
        first = first.groupBy("community").agg(F.sort_array(F.collect_list("author")).alias("sample_accounts"))
        return sized.join(inner, "community", "left").join(copied, "community", "left").join(first, "community").fillna(0, ["internal_edges"])
