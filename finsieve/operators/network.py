"""Network features of accounts: degrees, PageRank, clustering, hubs, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.session import cut_lineage


def connections(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs without self loops."""
    return edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) over distinct connections."""
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")
    )


def pagerank(pairs: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, pagerank), summing to one; rank of accounts that never send is spread.

    A step joins the ranks to the edges by sender and adds the parts up by receiver;
    both sums are partial before the shuffle, and a checkpoint ends each step.
    """
    pairs = cut_lineage(pairs)
    nodes = cut_lineage(degrees(pairs))
    total = nodes.count()
    if total == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    links = pairs.join(
        nodes.select(F.col("node").alias("src"), "out_degree"), "src"
    ).select("src", "dst", (1.0 / F.col("out_degree")).alias("share"))
    links = cut_lineage(links)
    ranks = nodes.select("node", "out_degree", F.lit(1.0 / total).alias("pagerank"))
    for _ in range(iterations):
        parts = (
            links.join(ranks.select(F.col("node").alias("src"), "pagerank"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("pagerank") * F.col("share")).alias("inflow"))
        )
        idle = ranks.where("out_degree = 0").agg(
            F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("idle")
        )
        base = (1 - damping) / total
        inflow = F.coalesce("inflow", F.lit(0.0)) + F.col("idle") / total
        ranks = cut_lineage(
            nodes.select("node", "out_degree").join(parts, "node", "left")
            .crossJoin(F.broadcast(idle))  # one row
            .select("node", "out_degree", (base + damping * inflow).alias("pagerank"))
        )
    return ranks.select("node", "pagerank")


def clustering(pairs: DataFrame) -> DataFrame:
    """(node, neighbours, triangles, clustering_coefficient), directions ignored.

    Every edge points from the end with fewer neighbours to the other one, so an
    account starts few edges however many neighbours it has.
    """
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    undirected = cut_lineage(pairs.select(a, b).distinct())
    size = (
        undirected.select(F.explode(F.array("a", "b")).alias("node"))
        .groupBy("node").agg(F.count("*").alias("neighbours"))
    )
    size = cut_lineage(size)
    both = undirected
    for end in ("a", "b"):
        both = both.join(
            size.select(F.col("node").alias(end), F.col("neighbours").alias(f"n_{end}")), end
        )
    rank_a, rank_b = F.struct("n_a", "a"), F.struct("n_b", "b")
    first = rank_a < rank_b
    pointed = cut_lineage(
        both.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"),
        )
    )
    second = pointed.select(F.col("low").alias("mid"), F.col("high").alias("top"))
    walks = pointed.withColumnRenamed("high", "mid").join(second, "mid")
    closing = pointed.select("low", F.col("high").alias("top"))
    found = walks.join(closing, ["low", "top"])
    triangles = (
        found.select(F.explode(F.array("low", "mid", "top")).alias("node"))
        .groupBy("node").agg(F.count("*").alias("triangles"))
    )
    n, t = F.col("neighbours"), F.coalesce("triangles", F.lit(0).cast("long"))
    return size.join(triangles, "node", "left").select(
        "node", "neighbours", t.alias("triangles"),
        F.when(n > 1, 2.0 * t / (n * (n - 1))).otherwise(0.0).alias("clustering_coefficient"),
    )


def communities(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, community): connected groups named by their smallest account.

    Alternating star steps link every account to the smallest one it has seen, which
    settles after a number of rounds logarithmic in the size of a group.
    """
    both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u != v")
    links = cut_lineage(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        # Large star: bigger neighbours of an account go to its smallest neighbour.
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        # Small star: an account and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        settled = least.select("u", F.col("m").alias("v"))
        step = cut_lineage(small.unionByName(settled).distinct())
        same = step.join(links, ["u", "v"], "left_anti").isEmpty() and (
            step.count() == links.count()
        )
        links = step
        if same:
            break
    else:
        raise RuntimeError("communities did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().select(
        "node", F.col("node").alias("community")
    )
    return links.select(F.col("u").alias("node"), F.col("v").alias("community")).unionByName(
        roots
    )


def network_features(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """All network features of every account; ``hub_score`` is degree centrality."""
    pairs = cut_lineage(connections(edges))
    base = degrees(pairs)
    n = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    hub = (F.col("out_degree") + F.col("in_degree")) / (2.0 * max(n - 1, 1))
    return (
        base.join(pagerank(pairs, iterations), "node")
        .join(clustering(pairs).select("node", "clustering_coefficient"), "node")
        .join(communities(pairs), "node")
        .withColumn("hub_score", hub)
    )
