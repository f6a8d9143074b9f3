"""Walking a graph: layers, shortest and simple paths, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.lookup import limited, node_id
from loomgraph.operators.twins import among, twins
from loomgraph.store import GraphStore, settled


def steps(edges: DataFrame, direction: str = "both", by: str | None = None) -> DataFrame:
    """src, dst: the distinct steps that a walk may take, no loops. by: dealt by that column, so that groups of it hardly grow a later shuffle."""
    if direction not in ("both", "out", "in"):
        raise ValueError("direction is both, out or in")
    out = F.struct(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    into = F.struct(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    ways = {"out": [out], "in": [into], "both": [out, into]}[direction]  # one pass over the edges for both
    every = edges.where("source_id != target_id").select(F.inline(F.array(*ways)))
    return (every.repartition(by) if by else every).distinct()


def layers(walk: DataFrame, start: DataFrame, max_depth: int, until: int | None = None) -> DataFrame:
    """id, depth, parent: every node that walk (src, dst) reaches from start (id) in max_depth steps at most, at its
    least depth; of several parents there the smallest. One join a step, of the last layer only. Ends early
    where nothing is new or the node `until` is reached."""
    seen = settled(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct(), "layer")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = walk.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = settled(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), "layer")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
        if until is not None and not frontier.where(F.col("id") == until).isEmpty():
            break
    return seen


def single(store: GraphStore, node: int) -> DataFrame:
    return store.nodes.sparkSession.createDataFrame([(node,)], "id long")


def impact(store: GraphStore, node: int | str, max_depth: int = 3, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """id, depth, label, name of the nodes that a change of the node may touch, itself not included."""
    at = node_id(store, node)
    edges = store.edges if edge_type is None else store.edges.where(F.col("type") == edge_type)
    found = layers(settled(steps(edges, direction), "steps"), single(store, at), limited(max_depth, 5)).where("depth > 0").select("id", "depth")
    return found.join(store.nodes.select("id", "label", "name"), "id", "left")


def shortest_path(store: GraphStore, source: int | str, target: int | str, max_hops: int = 10) -> list[int] | None:
    """The ids of a shortest undirected path, parents smallest first; None if there is none within max_hops."""
    a, b = node_id(store, source), node_id(store, target)
    if a == b:
        return [a]
    tree = layers(settled(steps(store.edges), "steps"), single(store, a), limited(max_hops, 20), until=b)
    path = [b]
    while path[-1] != a:  # at most max_hops lookups
        row = tree.where(F.col("id") == path[-1]).select("parent").first()
        if row is None:
            return None
        path.append(row["parent"])
    return path[::-1]


def hops(store: GraphStore, source: int | str, max_hops: int = 10) -> DataFrame:
    """id, hops of every node within max_hops undirected steps."""
    tree = layers(settled(steps(store.edges), "steps"), single(store, node_id(store, source)), limited(max_hops, 20))
    return tree.select("id", F.col("depth").alias("hops"))


def simple_paths(store: GraphStore, source: int | str, target: int | str, max_paths: int | None = 3, max_hops: int = 8) -> DataFrame:
    """hops, path: undirected paths that visit no node twice, the shortest first, then by their ids; max_paths None:
    all. A path is only grown where the target still is within the hops left."""
    if max_paths is not None:
        return first_paths(store, source, target, limited(max_paths, 10), max_hops)
    a, b, most = node_id(store, source), node_id(store, target), limited(max_hops, 15)
    walk = settled(steps(store.edges), "steps")
    left = layers(walk, single(store, b), most).select(F.col("id").alias("dst"), F.col("depth").alias("left"))
    walk = settled(walk.join(left, "dst"), "steps")
    paths = single(store, a).select(F.array("id").alias("path"))
    done = [paths.where(F.lit(a == b))]
    if a != b:
        for depth in range(1, most + 1):
            grown = paths.select("path", F.element_at("path", -1).alias("src")).join(walk, "src")
            grown = grown.where(~F.array_contains("path", F.col("dst")) & (F.col("left") <= most - depth))
            grown = settled(grown.select(F.concat("path", F.array("dst")).alias("path"), "dst"), "paths")
            done.append(grown.where(F.col("dst") == b).select("path"))
            paths = grown.where(F.col("dst") != b).select("path")
            if grown.isEmpty():
                break
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)
    return every.select((F.size("path") - 1).alias("hops"), "path")


def simple_paths_by_hops(store: GraphStore, source: int | str, target: int | str, max_hops: int = 8) -> DataFrame:
    """hops, n: how many paths simple_paths has of each length, without writing them out.

    Nodes with the same neighbours can take each other's place in a path, so paths grow over one node for all of these (`twins`; both
    ends by themselves) with the number of paths that each stands for: a node that stands for s and is on the path u times can be
    taken in s - u ways. Beginnings over the same nodes in another order that end alike are added up.
    """
    a, b, most = node_id(store, source), node_id(store, target), limited(max_hops, 15)
    if a == b:
        return single(store, a).select(F.lit(0).alias("hops"), F.lit(1).cast("long").alias("n"))
    walk = settled(steps(store.edges), "steps")
    reps = settled(twins(walk, (a, b)).where("id = rep").select("id", "size"), "reps")
    walk = settled(among(walk, reps), "steps")
    left = layers(walk, single(store, b), most).select(F.col("id").alias("dst"), F.col("depth").alias("left"))
    walk = settled(walk.join(left, "dst").join(reps.withColumnRenamed("id", "dst"), "dst"), "steps")
    paths = single(store, a).select(F.col("id").alias("src"), F.array("id").alias("taken"), F.lit(1).cast("long").alias("n"))
    done = []
    for depth in range(1, most + 1):
        grown = paths.join(walk.where(F.col("left") <= most - depth), "src")
        used = F.size(F.filter("taken", lambda x: x == F.col("dst")))
        grown = grown.select("dst", F.array_sort(F.concat("taken", F.array("dst"))).alias("taken"), (F.col("n") * (F.col("size") - used)).alias("n")).where("n > 0")
        grown = settled(grown.groupBy("dst", "taken").agg(F.sum("n").alias("n")), "counts")
        done.append(grown.where(F.col("dst") == b).agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(depth).alias("hops"), "n"))
        paths = grown.where(F.col("dst") != b).select(F.col("dst").alias("src"), "taken", "n")
        if paths.isEmpty():
            break
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)
    return every


def first_paths(store: GraphStore, source: int | str, target: int | str, k: int = 3, max_hops: int = 8, chunk: int = 10_000) -> DataFrame:
    """hops, path: the first k of simple_paths, without growing all of them.

    How far each node is from the target comes first; a path goes only where the target still is within the hops left. Lengths are
    taken one by one from the shortest on. Of one length, paths grow in the order of their ids: the first `chunk` beginnings of a
    length are grown to their ends before the others, which wait in their tables, as all that comes of an earlier beginning
    comes earlier. It ends with the k-th path, so nothing is left out, and no table has more than chunk times a node's steps.
    """
    a, b, most = node_id(store, source), node_id(store, target), limited(max_hops, 15)
    spark = store.nodes.sparkSession
    schema = "hops int, path array<long>"
    if a == b:
        return spark.createDataFrame([(0, [a])], schema)
    walk = settled(steps(store.edges), "steps")
    left = settled(layers(walk, single(store, b), most).select(F.col("id").alias("dst"), F.col("depth").alias("left")), "left")
    walk = settled(walk.join(left, "dst"), "steps")
    nearest = left.where(F.col("dst") == a).select("left").first()
    found: list[list[int]] = []
    for length in range(nearest["left"], most + 1) if nearest else ():
        waiting = [(0, single(store, a).select(F.array("id").alias("path")))]
        while waiting and len(found) < k:
            depth, paths = waiting.pop()
            begun = paths.orderBy("path").limit(chunk + 1).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).first()
            if begun["n"] > chunk:
                edge = F.lit(begun["last"])
                waiting.append((depth, paths.where(F.col("path") >= edge)))
                paths = paths.where(F.col("path") < edge)
            grown = paths.select("path", F.element_at("path", -1).alias("src")).join(walk, "src")
            grown = grown.where(~F.array_contains("path", F.col("dst")) & (F.col("left") <= length - depth - 1))
            if depth + 1 == length:
                ends = grown.where(F.col("dst") == b).select(F.concat("path", F.array("dst")).alias("path")).orderBy("path").limit(k - len(found))
                found += [r["path"] for r in ends.collect()]  # at most k
                continue
            grown = settled(grown.where(F.col("dst") != b).select(F.concat("path", F.array("dst")).alias("path")), "paths")
            if not grown.isEmpty():
                waiting.append((depth + 1, grown))
        if len(found) == k:
            break
    return spark.createDataFrame([(len(p) - 1, p) for p in found], schema)


def cycles(walk: DataFrame, max_depth: int = 10) -> DataFrame:
    """cycle: the distinct node sets, sorted, of cycles of 2 to max_depth nodes of walk (src, dst). Each is grown from
    its smallest node through larger ones only, so no cycle is begun twice."""
    paths = walk.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = []
    for depth in range(2, max_depth + 1):
        paths = settled(paths, "paths")
        if paths.isEmpty():
            break
        last = paths.select("path", F.element_at("path", -1).alias("src"))
        closed = last.withColumn("dst", F.col("path")[0]).join(walk, ["src", "dst"], "left_semi")
        found.append(closed.select(F.array_sort("path").alias("cycle")))
        if depth == max_depth:
            break
        ends = last.join(walk, "src")
        paths = ends.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    if not found:
        return paths.select(F.col("path").alias("cycle")).limit(0)
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    return every.distinct()


