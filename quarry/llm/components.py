"""Connected components of a graph given by its links: no component is gathered in one task, nor all links of a node.

A node's minimum is taken before links are shuffled. Nodes with very many links are few, whatever the graph, so their minima
are broadcast, and their links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import discard, files_for, written

#: Links from which a node is a hub, and the part of all links; there are at most 2 * HUB_PART hubs.
HUB, HUB_PART = 100_000, 1000


def _hubs(edges: DataFrame, n: int) -> list[int]:
    """The nodes of more than HUB links, and of more than one in HUB_PART of the n links."""
    least = max(HUB, n // HUB_PART)
    if n <= least:
        return []
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    return [r["node"] for r in ends.where(F.col("count") > least).collect()]


def _with_least(links: DataFrame, node: str, least: DataFrame, hubs: list[int]) -> DataFrame:
    """links with m of least(node, m), a row for each node."""
    if not hubs:
        return links.join(least, node)

    def hub(of: DataFrame) -> Column:
        return of[node].isin(hubs)

    return links.where(~hub(links)).join(least.where(~hub(least)), node).unionByName(links.where(hub(links)).join(F.broadcast(least.where(hub(least))), node))


def components(links: DataFrame, expected: int | None = None, rounds: int = 200) -> DataFrame:
    """(node, root) of each node of links(a, b): root is the smallest node of its component.

    Alternates two steps until all links are stars. Large star: each node links its larger neighbours to the smallest node it
    knows. Small star: each node links its smaller neighbours, and itself, to the smallest of them. Each step is one
    grouped minimum and one join. Self links count as nodes; nulls are left out. expected: about how many links there are.
    """
    given = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = links.sparkSession
    given = written(given, "links", expected and files_for(spark, expected))
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges, n = given, given.count()
    for _ in range(rounds):
        hubs = _hubs(edges, n)
        both = edges.where("a != b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both, "u", least, hubs).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, "a", small_least, hubs).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        old, edges = edges, written(small, "links", files_for(spark, n))
        if old is not given:
            discard(old)
        # stars: each node that points somewhere points to one node, and nothing points to it
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("points")), F.struct(F.col("b").alias("node"), F.lit(0).alias("points")))).alias("x")).select("x.*")
        nodes_ = ends.groupBy("node").agg(F.sum("points").alias("out"), F.count(F.lit(1)).alias("all"))
        n, other = nodes_.agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("all") > F.col("out")))), F.lit(False))).first()
        if not other:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
