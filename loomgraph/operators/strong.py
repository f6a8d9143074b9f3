"""Strong components of directed graphs, and short cycles inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import settled

#: Times that nodes without a way in or out are trimmed before each colouring.
TRIMS = 3


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """edges (src, dst) without those of nodes that have no way in or no way out, looked for a few times; and how many are left."""
    n = edges.count()
    for _ in range(TRIMS):
        sources, targets = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
        kept = edges.join(targets, F.col("src") == F.col("node"), "left_semi").join(sources, F.col("dst") == F.col("node"), "left_semi")
        edges, before = settled(kept, "trimmed"), n
        n = edges.count()
        if n == before or not n:
            break
    return edges, n


def spread(edges: DataFrame) -> DataFrame:
    """node, colour: of each node the smallest node that leads to it, itself included. In a round only nodes whose colour has
    just changed pass it on."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = settled(nodes.select("node", F.col("node").alias("colour")), "colours")
    fresh = colours
    while True:
        given = edges.join(fresh, edges["src"] == fresh["node"]).groupBy("dst").agg(F.min("colour").alias("given"))
        joined = colours.join(given, colours["node"] == given["dst"], "left")
        less = F.coalesce(F.col("given") < F.col("colour"), F.lit(False))
        colours = settled(joined.select("node", F.when(less, F.col("given")).otherwise(F.col("colour")).alias("colour"), less.alias("new")), "colours")
        fresh = colours.where("new").select("node", "colour")
        colours = colours.select("node", "colour")
        if fresh.isEmpty():
            return colours


def back_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: what leads to one of roots (node) along edges, the roots included; a join a step, of the last step's nodes only."""
    seen = frontier = settled(roots.select("node"), "back")
    while True:
        step = edges.join(frontier, edges["dst"] == frontier["node"]).select(F.col("src").alias("node")).distinct()
        frontier = settled(step.join(seen, "node", "left_anti"), "back")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)


def strong_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component, size for every node that lies on a cycle of links; component is its smallest node.

    Each round trims nodes without a way in or out, colours every node with the smallest node that leads to it, and goes back
    from each colour's own node inside the colour: what is met is that node's component. All colours do so at once.
    Edges between colours and edges of what was met are left out of the next round, until none are left. Only
    joins and minima of edges; no path and no pair of nodes is kept. A node with nothing but a link to
    itself is no cycle. Null ends are left out, repeated links count once.
    """
    edges = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src != dst").distinct()
    edges = settled(edges, "links")
    found = None
    while True:
        edges, n = trimmed(edges)
        if not n:
            break
        colours = spread(edges)
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("colour")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("other"))
        inside = settled(edges.join(a, "src").join(b, "dst").where("colour = other").select("src", "dst", "colour"), "inside")
        met = back_from(inside, colours.where("node = colour"))
        part = settled(met.join(colours, "node").select("node", F.col("colour").alias("component")), "components")
        found = part if found is None else found.unionAll(part)
        gone = part.select(F.col("node").alias("gone"))
        left = inside.join(gone, inside["src"] == gone["gone"], "left_anti")
        edges = settled(left.join(gone, F.col("dst") == F.col("gone"), "left_anti").select("src", "dst"), "links")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"), F.lit(1).cast("long").alias("size"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(sizes, "component").select("node", "component", "size")


def shortest_cycles(ways: list[DataFrame], starts: DataFrame, max_depth: int) -> DataFrame:
    """start, length, cycle: for each of starts (node) a shortest cycle through it with 2 to max_depth
    nodes, smallest nodes first where several are as short; starts without one have no row. A step goes along all of ways (src, dst) one after
    the other, so that nodes may be linked over hubs that are not written out as pairs. All starts walk at once; of a start and a
    node only the first path is kept, so there are starts times nodes rows at most: give it a bounded number of starts."""
    first = starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.col("node").alias("at"))
    seen = frontier = settled(first, "walks")
    done = None
    for depth in range(1, max_depth + 1):
        step = frontier.select("start", "path", "at", F.col("at").alias("src"))
        for way in ways:
            step = step.join(way, "src").select("start", "path", "at", F.col("dst").alias("src"))
        step = settled(step.where("src != at").groupBy("start", F.col("src").alias("dst")).agg(F.min("path").alias("path")), "steps")
        closed = step.where("dst = start").select("start", F.lit(depth).alias("length"), F.col("path").alias("cycle"))
        done = closed if done is None else done.unionAll(closed)
        grown = step.where("dst != start").select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        grown = grown.join(seen.select("start", "at"), ["start", "at"], "left_anti").join(closed.select("start"), "start", "left_anti")
        frontier = settled(grown.select("start", "path", "at"), "walks")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    best = done.groupBy("start").agg(F.min(F.struct("length", "cycle")).alias("best"))
    return best.select("start", F.col("best.length").alias("length"), F.col("best.cycle").alias("cycle"))
