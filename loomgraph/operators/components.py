"""Connected components of a table of links, by alternating stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ordering import joined_once, parts_of
from loomgraph.store import settled


def with_least(links: DataFrame, rows: int) -> DataFrame:
    """links (u, v: so many rows) with m, the smallest v of their u."""
    return joined_once(links, settled(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "least"), "u", rows)


def each_once(links: DataFrame, rows: int) -> DataFrame:
    """links (u, v: about so many rows), each once, as a table."""
    return settled(links.repartition(parts_of(rows), "u", "v").distinct(), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of a link; component is its smallest node.

    Each round hangs all larger neighbours of a node on the smallest node it knows (large star), then
    does the same among smaller neighbours (small star), until nothing changes; rounds grow with the
    logarithm of the longest path. A node's least neighbour is a partial aggregate and goes back to its
    links by a join in parts that grow with the links, that of a node with many to wherever they are (`joined_once`), so no node's links meet
    in one task. Links with a null end and links of a node with itself are left out; an empty table gives an empty one.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u != v"), "pairs")
    edges = each_once(edges, edges.count())
    n = edges.count()
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u != v")
        large = each_once(large, n)
        rows = large.count()
        joined = with_least(large, rows)
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        before, edges = edges, each_once(small, 2 * rows)
        # as many links as before, and no new one: nothing changed
        last, n = n, edges.count()
        parts = parts_of(n)
        if n == last and edges.repartition(parts, "u", "v").join(before.repartition(parts, "u", "v"), ["u", "v"], "left_anti").isEmpty():
            break
    parents = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return parents.unionAll(parents.select(F.col("component").alias("node"), "component").distinct())
