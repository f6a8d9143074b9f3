"""Centrality and communities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.apart import across, by_hubs, graph_of, parted
from loomgraph.operators.blocks import blocks_of, planned, spread
from loomgraph.operators.components import components
from loomgraph.operators.ordering import joined_once, numbered_rows, parts_of
from loomgraph.operators.traverse import steps
from loomgraph.operators.twins import among, twins
from loomgraph.store import GraphStore, dropped, settled, shared_place

#: Closeness: 64-bit words of sources that walk at once.
WORDS = 32
#: Steps of a graph that every task may hold (12 bytes each); betweenness: source-node rows of a block beyond that.
HELD_STEPS, PAIRS = 12_000_000, 50_000_000
#: Closeness in a task that holds the graph: words of sources that walk at once, bytes of their three tables at most, nodes of a step of the work.
HELD_WORDS, HELD_BYTES, ROWS = 16, 2**29, 2048
#: Betweenness: sources that walk at once there.
HELD_SOURCES = 16


def degree_centrality(store: GraphStore) -> DataFrame:
    """id, score: distinct undirected neighbours (a loop makes a node its own) over the other nodes, to 4 places."""
    out = F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    both = store.edges.select(F.inline(F.array(out, F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other"))))).distinct()
    near = both.groupBy("id").agg(F.count(F.lit(1)).alias("near"))
    others = store.nodes.agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1).alias("others"))
    joined = store.nodes.select("id").join(near, "id", "left").join(F.broadcast(others))  # a row
    return joined.select("id", F.round(F.coalesce("near", F.lit(0)) / F.col("others"), 4).alias("score"))


def distances(walk: DataFrame, sources: DataFrame) -> DataFrame:
    """s, v, d, sigma: from every source (id) the nodes that walk (src, dst, both ways) leads to, how far they
    are and over how many shortest paths. All sources walk at once, a layer a join; rows grow with sources times nodes."""
    start = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma"))
    seen = frontier = before = settled(start, "layer")
    depth = 0
    while True:
        depth += 1
        next_ = frontier.join(walk, frontier["v"] == walk["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        # undirected steps from a layer lead to the layer itself, the one before it or new nodes
        known = frontier.select("s", "v").unionAll(before.select("s", "v"))
        before, frontier = frontier, settled(next_.join(known, ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("d"), "sigma"), "layer")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)


def closeness(store: GraphStore, words: int = WORDS, held_steps: int = HELD_STEPS) -> DataFrame:
    """id, score: reached nodes over the sum of their distances, inside the node's component; 0 alone; to 4 places.

    Nodes with the same neighbours have the same score, so one stands for all of them (`twins`). If that leaves at most held_steps steps, which are
    counted first, the graph is sent to every task, as in betweenness, and each task walks from some sources, a bit each of up to 16 words a node (`layer_sums`), only
    in their part where it falls apart without some hubs (`reached`). On a larger one sources walk in blocks of 64 * words, a bit each: a node holds the bits of the sources that have come to it, a round ors
    those of its neighbours, and what is new counts with the round's number. As steps go both ways, how far the sources
    are from a node is how far the node is from them, so counts stay with the node: no row a pair of nodes, memory grows with
    the nodes times the words. Blocks follow each other; each adds to the nodes' sums.
    """
    if not 1 <= words <= 128:
        raise ValueError("words is 1 to 128")
    every = settled(store.nodes.select("id").distinct(), "ids")
    walk = settled(among(steps(store.edges), every), "steps")
    few = with_twins(walk, held_steps)
    if few:
        sums = reached(*few[:3])
        sums = few[3].join(sums.withColumnRenamed("id", "rep"), "rep").select("id", "near", "far")
        return every.join(sums, "id", "left").select("id", score_of("near", "far").alias("score"))
    ids = settled(numbered_rows(every, "nth", "id").withColumn("nth", F.col("nth") - 1), "numbers")
    n, wide = ids.count(), 64 * words
    seen, fresh = [f"s{k}" for k in range(words)], [f"f{k}" for k in range(words)]
    zero = F.lit(0).cast("long")
    sums = None
    for first in range(0, n, wide):
        mine = F.col("nth") - first
        bits = [F.when(F.floor(mine / 64) == k, F.expr(f"shiftleft(1L, cast((nth - {first}) % 64 as int))")).otherwise(zero) for k in range(words)]
        start = ids.where((mine >= 0) & (mine < wide))
        state = settled(start.select("id", zero.alias("near"), zero.alias("far"), *(b.alias(c) for b, c in zip(bits, seen)), *(b.alias(c) for b, c in zip(bits, fresh))), "bits")
        depth = 0
        while True:
            depth += 1
            moving = state.where(" or ".join(f"{c} != 0" for c in fresh)).select(F.col("id").alias("src"), *fresh)
            come = walk.join(moving, "src").groupBy(F.col("dst").alias("id")).agg(*(F.bit_or(c).alias(f"g{k}") for k, c in enumerate(fresh)))
            joined = state.drop(*fresh).join(come, "id", "full")
            had = {c: F.coalesce(c, zero) for c in ("near", "far", *seen)}
            new = [F.coalesce(F.col(f"g{k}"), zero).bitwiseAND(F.bitwise_not(had[c])) for k, c in enumerate(seen)]
            joined = joined.select("id", had["near"].alias("near"), had["far"].alias("far"), *(had[c].alias(c) for c in seen), *(x.alias(c) for x, c in zip(new, fresh)))
            count = sum((F.bit_count(c) for c in fresh), F.lit(0)).cast("long")
            either = [F.col(c).bitwiseOR(F.col(f)).alias(c) for c, f in zip(seen, fresh)]
            state = settled(joined.select("id", (F.col("near") + count).alias("near"), (F.col("far") + depth * count).alias("far"), *either, *fresh), "bits")
            if state.where(" or ".join(f"{c} != 0" for c in fresh)).isEmpty():
                break
        part = state.select("id", "near", "far")
        sums = part if sums is None else sums.unionAll(part)
    if sums is None:
        return store.nodes.select("id", F.lit(0.0).alias("score"))
    return closeness_of(ids, sums.groupBy("id").agg(F.sum("near").alias("near"), F.sum("far").alias("far")))


def score_of(near: str, far: str) -> Column:
    return F.round(F.when(F.col(far) > 0, F.col(near) / F.col(far)).otherwise(F.lit(0.0)), 4)


def closeness_of(ids: DataFrame, sums: DataFrame) -> DataFrame:
    return ids.join(sums, "id").select("id", score_of("near", "far").alias("score"))


def with_twins(walk: DataFrame, held_steps: int) -> tuple[DataFrame, DataFrame, int, DataFrame] | None:
    """The graph with one node for all of the same neighbours, if it then has at most held_steps steps: its steps, ids (id, nth, size: nodes that
    it stands for), number of nodes, and classes (id, rep, size). None if it is larger."""
    classes = settled(twins(walk), "classes")
    reps = classes.where("id = rep").select("id", "size")
    if reps.count() > held_steps:
        return None
    walk = settled(among(walk, reps), "steps")
    if walk.count() > held_steps:
        return None
    ids = settled(numbered_rows(reps, "nth", "id").withColumn("nth", F.col("nth") - 1), "numbers")
    return walk, ids, ids.count(), classes


def by_degree(first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Places of the nodes by their degree; and of the nodes of one degree, from one place to another, the places of their neighbours: a row a neighbour."""
    n = len(first) - 1
    degree = np.diff(first)
    order = np.argsort(degree, kind="stable")
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    kinds, starts = np.unique(degree[order], return_index=True)
    columns = []
    for k, start, end in zip(kinds, starts, [*starts[1:], n]):
        if k:
            columns.append((start, end, np.ascontiguousarray(place[to[first[order[start:end]][:, None] + np.arange(k)]].T)))
    return place, columns


def layer_sums(sources: np.ndarray, first: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of every node of how many sources it is reached, and how far they are in sum. size: how many nodes of the same neighbours each
    stands for, which count as so many sources; two such are two steps apart.

    Sources walk together, a bit each of some words a node, and the bits of a word are of one size. In a layer those nodes take the bits of
    their neighbours that some of the sources have not reached and that have a neighbour that the last layer has reached. Nodes lie by their
    degree, so that all k-th neighbours of many are one column."""
    n = len(first) - 1
    degree = np.diff(first)
    place, columns = by_degree(first, to)
    words = max(1, min(HELD_WORDS, HELD_BYTES // (24 * max(1, n))))
    sources = sources[np.argsort(size[sources], kind="stable")]
    packed = []  # sources of a word
    for group in np.split(sources, np.flatnonzero(np.diff(size[sources])) + 1):
        packed += [group[k : k + 64] for k in range(0, len(group), 64)]
    near, far = np.zeros(n), np.zeros(n)
    for at in range(0, len(packed), words):
        some = packed[at : at + words]
        weight = np.array([size[s[0]] for s in some])
        seen, fresh, come = (np.zeros((n, len(some)), np.uint64) for _ in range(3))
        for w, s in enumerate(some):
            fresh[place[s], w] = np.uint64(1) << np.arange(len(s), dtype=np.uint64)
        seen |= fresh
        every = np.bitwise_or.reduce(seen, axis=0)
        moved, depth = fresh.any(axis=1), 0
        missing = np.ones(n, bool)
        while moved.any():
            depth += 1
            now = np.zeros(n, bool)
            for start, end, neighbours in columns:
                for low in range(start, end, ROWS):
                    high = min(end, low + ROWS)
                    part = neighbours[:, low - start : high - start]
                    if len(part) > high - low:  # few nodes of many neighbours
                        rows = np.flatnonzero(missing[low:high] & moved[part].any(axis=0))
                        new = np.array([np.bitwise_or.reduce(fresh[part[:, k]], axis=0) for k in rows], np.uint64)
                    else:
                        hit = moved[part[0]]
                        for row in part[1:]:
                            hit |= moved[row]
                        rows = np.flatnonzero(hit & missing[low:high])
                        new = fresh.take(part[0, rows], axis=0)
                        for row in part[1:]:
                            new |= fresh.take(row[rows], axis=0)
                    if not len(rows):
                        continue
                    rows += low
                    had = seen[rows]
                    new &= ~had
                    come[rows] = new
                    had |= new
                    seen[rows] = had
                    now[rows] = new.any(axis=1)
                    missing[rows] = (had != every).any(axis=1)
                    count = np.bitwise_count(new) @ weight
                    near[rows] += count
                    far[rows] += depth * count
            fresh[moved] = 0
            fresh, come, moved = come, fresh, now
    out = np.stack([near[place], far[place]], axis=1)
    beside = sources[degree[sources] > 0]
    out[beside] += (size[beside] - 1)[:, None] * np.array([1, 2])
    return out


def dependencies(sources: np.ndarray, first: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Brandes' dependencies of all nodes, summed over the sources. first: where each node's neighbours begin in `to`. size: how many nodes of
    the same neighbours each stands for: a path can take any of them, and each is a source and an end. No path between others
    leads from one to another of them; those beside the source are ends two steps away.

    Up to HELD_SOURCES sources walk together, a column each; layers as in `layer_sums`, and back over the nodes that each layer had."""
    n = len(first) - 1
    place, columns = by_degree(first, to)
    sizes = np.empty(n)
    sizes[place] = size
    alike = bool((size == 1).all())
    total = np.zeros(n)
    at_once = max(1, min(HELD_SOURCES, HELD_BYTES // (33 * max(1, n))))
    for at in range(0, len(sources), at_once):
        some = sources[at : at + at_once]
        which = np.arange(len(some))
        sigma, fresh, come = (np.zeros((n, len(some))) for _ in range(3))
        depth = np.full((n, len(some)), -1, np.int16)
        sigma[place[some], which] = fresh[place[some], which] = 1
        depth[place[some], which] = 0
        moved, missing = np.zeros(n, bool), np.ones(n, bool)
        moved[place[some]] = True
        layers = []  # of every layer its nodes with their neighbours: a row a neighbour
        while moved.any():
            now, layer = np.zeros(n, bool), []
            for start, end, neighbours in columns:
                for low in range(start, end, ROWS):
                    high = min(end, low + ROWS)
                    part = neighbours[:, low - start : high - start]
                    hit = moved[part].any(axis=0) if len(part) > high - low else any_of(moved, part)
                    rows = np.flatnonzero(hit & missing[low:high])
                    if not len(rows):
                        continue
                    part = part[:, rows]
                    rows += low
                    new = gathered_sums(fresh, part)
                    had = depth[rows]
                    met = (had < 0) & (new > 0)
                    there = met.any(axis=1)
                    if there.sum() < 0.7 * len(rows):
                        rows, part, new, had, met = rows[there], part[:, there], new[there], had[there], met[there]
                        if not len(rows):
                            continue
                    new *= met
                    sigma[rows] += new
                    np.copyto(had, len(layers) + 1, where=met)
                    depth[rows] = had
                    if not alike:
                        new *= sizes[rows, None]
                    come[rows] = new
                    now[rows] = True
                    missing[rows] = (had < 0).any(axis=1)
                    layer.append((rows, part))
            fresh[moved] = 0
            fresh, come, moved = come, fresh, now
            if layer:
                layers.append(layer)
        delta, below = fresh, come  # both are 0 by now
        for d in range(len(layers) - 1, 0, -1):
            for rows, _ in layers[d]:
                share = delta[rows]
                share += 1
                share *= sizes[rows, None]
                here = depth[rows] == d + 1
                below[rows] = np.divide(share, sigma[rows], out=np.zeros(share.shape), where=here)
            for rows, part in layers[d - 1]:
                share = gathered_sums(below, part)
                share *= sigma[rows]
                share *= depth[rows] == d
                share += delta[rows]
                delta[rows] = share
            for rows, _ in layers[d]:
                below[rows] = 0
        for k, s in enumerate(some):
            near = place[to[first[s] : first[s + 1]]]
            if size[s] > 1 and len(near):
                delta[near, k] += (size[s] - 1) / sizes[near].sum()
        delta[place[some], which] = 0
        total += delta @ size[some]
    return total[place]


def any_of(moved: np.ndarray, part: np.ndarray) -> np.ndarray:
    hit = moved[part[0]]
    for row in part[1:]:
        hit |= moved[row]
    return hit


def gathered_sums(values: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The sums of the rows of values that each column of part names."""
    if len(part) > part.shape[1]:  # few nodes of many neighbours
        return np.array([values[part[:, k]].sum(axis=0) for k in range(part.shape[1])])
    out = values.take(part[0], axis=0)
    for row in part[1:]:
        out += values.take(row, axis=0)
    return out


def betweenness(store: GraphStore, held_steps: int = HELD_STEPS, pairs: int = PAIRS) -> DataFrame:
    """id, score: over ordered pairs of other nodes the share of shortest paths through the node, divided by the
    unordered pairs (so each pair counts twice), to 4 places.

    Nodes with the same neighbours have the same score, so one stands for all of them (`twins`). If that leaves at most held_steps steps, which are
    counted first, the graph is sent to every task, and each task takes some sources, up to 16 at once: layers
    forward, then dependencies back, in numpy, with a few numbers a node and source. A larger one stays where it is, and the sources
    take turns in blocks of about `pairs` source-node rows, whose layers are joins; a block leaves a sum a node.
    """
    every = settled(store.nodes.select("id").distinct(), "ids")
    walk = settled(among(steps(store.edges), every), "steps")
    n = every.count()
    few = with_twins(walk, held_steps)
    if few:
        sums = over_sources(*few[:3], dependencies, "sum double")
        sums = few[3].join(sums.withColumnRenamed("id", "rep"), "rep").select("id", "sum")
    else:
        ids = settled(numbered_rows(every, "nth", "id").withColumn("nth", F.col("nth") - 1), "numbers")
        sums = None
        for first in range(0, n, max(1, pairs // n)):
            some = ids.where((F.col("nth") >= first) & (F.col("nth") < first + max(1, pairs // n)))
            part = settled(back_pass(walk, settled(distances(walk, some), "distances")), "block-sums")
            sums = part if sums is None else sums.unionAll(part)
    ways = float(max(1, (n - 1) * (n - 2) / 2))
    if sums is None:
        return every.select("id", F.lit(0.0).alias("score"))
    sums = sums.groupBy("id").agg(F.sum("sum").alias("sum"))
    return every.join(sums, "id", "left").select("id", F.round(F.coalesce("sum", F.lit(0.0)) / ways, 4).alias("score"))


def gathered(walk: DataFrame, ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the neighbours of each node of ids (id, nth, size) begin, the neighbours, and the sizes."""
    a, b = ids.select(F.col("id").alias("src"), F.col("nth").alias("a")), ids.select(F.col("id").alias("dst"), F.col("nth").alias("b"))
    table = walk.join(a, "src").join(b, "dst").select(F.col("a").cast("int"), F.col("b").cast("int")).toArrow()  # at most held_steps rows
    graph = graph_of(table["a"].to_numpy(), table["b"].to_numpy(), n)
    table = ids.select("nth", "size").toArrow()  # at most held_steps rows
    size = np.zeros(n)
    size[table["nth"].to_numpy()] = table["size"].to_numpy()
    return *graph, size


def held(ids: DataFrame, n: int, shared: object, units: int, count: Callable[[object, int], tuple[np.ndarray, np.ndarray]], columns: str) -> DataFrame:
    """id and the columns (doubles) for every node of ids (id, nth), summed over units of the work; each task holds shared and takes some
    units. count: of a unit the places of nodes (each once) and what it adds to them."""
    spark = ids.sparkSession
    graph = spark.sparkContext.broadcast(shared)
    names = [c.split()[0] for c in columns.split(", ")]

    def work(batches):
        total = np.zeros((n, len(names)))
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                nodes, sums = count(graph.value, unit)
                total[nodes] += sums.reshape(len(nodes), -1)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(len(names)))], ["nth", *names])

    parts = spark.range(0, units, 1, max(1, units)).mapInArrow(work, f"nth long, {columns}")
    sums = parts.groupBy("nth").agg(*(F.sum(c).alias(c) for c in names))
    every = ids.join(sums, "nth", "left")
    return every.select("id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def shares(n: int, most: int) -> list[tuple[int, int]]:
    """n in about equal runs, most of them at most."""
    ends = np.linspace(0, n, max(1, min(n, most)) + 1).astype(int)
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


def over_sources(walk: DataFrame, ids: DataFrame, n: int, count: Callable[..., np.ndarray], columns: str) -> DataFrame:
    """As held: what count gives of some sources and the graph (`gathered`), summed over all sources."""
    return of_sources(ids, n, gathered(walk, ids, n), count, columns)


def of_sources(ids: DataFrame, n: int, graph: tuple, count: Callable[..., np.ndarray], columns: str) -> DataFrame:
    runs = shares(n, 4 * ids.sparkSession.sparkContext.defaultParallelism)
    return held(ids, n, graph, len(runs), lambda graph, unit: (np.arange(n), count(np.arange(*runs[unit]), *graph)), columns)


def reached(walk: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, near, far: of every node how many nodes (by size) reach it and how far they are in sum.

    Where the graph falls apart without some hubs (`apart`), sources only walk in their part; nodes of different parts are as far as the best way by a hub, which
    is found once for all that are equally far from all hubs."""
    graph = gathered(walk, ids, n)
    columns = "near double, far double"
    whole = parted(*graph)
    if whole is None:
        return of_sources(ids, n, graph, layer_sums, columns)
    tasks = 6 * ids.sparkSession.sparkContext.defaultParallelism
    work = [len(x[0]) * len(x[2]) for x in whole["inner"]]
    units = [(k, *run) for k, x in enumerate(whole["inner"]) for run in shares(len(x[0]), min(-(-len(x[0]) // (64 * HELD_WORDS)), 1 + int(tasks * work[k] / sum(work))))]
    units += [(-1, *run) for run in shares(len(whole["kinds"]), tasks)] + [(-2, 0, 0)]

    def count(shared: tuple, unit: int) -> tuple[np.ndarray, np.ndarray]:
        whole, size = shared
        k, low, high = units[unit]
        if k == -2:
            return np.arange(len(size)), by_hubs(whole["far"], whole["hubs"], size)
        if k == -1:
            nodes = np.flatnonzero((whole["kind"] >= low) & (whole["kind"] < high))
            sums = across(whole["kinds"], whole["weight"], low, high)
            kind = whole["kind"][nodes] - low
            return nodes, sums.sum(axis=1)[kind] - sums[kind, whole["part"][nodes]]
        nodes, first, to, local = whole["inner"][k]
        return nodes, layer_sums(np.arange(low, high), first, to, local)[: len(nodes)]

    return held(ids, n, (whole, graph[2]), len(units), count, columns)


def back_pass(walk: DataFrame, reach: DataFrame) -> DataFrame:
    """id, sum: the dependencies of some sources (reach: s, v, d, sigma), from the farthest layer back, a join a layer."""
    deepest = reach.agg(F.max("d")).first()[0] or 0
    delta = reach.where(F.col("d") == deepest).select("s", "v", "sigma", F.lit(0.0).alias("delta"))
    parts = reach.select(F.col("v").alias("id"), F.lit(0.0).alias("sum")).limit(0)
    for depth in range(deepest, 0, -1):
        delta = settled(delta, "dependencies")
        parts = parts.unionAll(delta.where("s != v").select(F.col("v").alias("id"), F.col("delta").alias("sum")))
        share = delta.join(walk, delta["v"] == walk["src"]).select("s", F.col("dst").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        above = reach.where(F.col("d") == depth - 1)
        sums = share.groupBy("s", "v").agg(F.sum("share").alias("share"))
        delta = above.join(sums, ["s", "v"], "left").select("s", "v", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
    return parts.groupBy("id").agg(F.sum("sum").alias("sum"))


def pagerank(store: GraphStore, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, at_once: int = 3) -> DataFrame:
    """id, score, to 6 places: undirected, without weights; what nodes without neighbours hold is spread over all. Ends
    with the first round that changes less than tolerance in sum.

    Nodes without neighbours all have one score, a number that needs no table. Where half of the nodes or more have the neighbours of another, which gives them its
    score in every round, one stands for all of them (`twins`) and counts as many times. The others' rounds go over blocks of nodes (`blocks`), whose steps
    are packed once: in a round a block sends its scores to the blocks of its neighbours, a row each, so one shuffle of a number a node and block and none of steps.
    A job has at_once rounds, whose shuffles the disk holds at the same time; they and the scores before them go when it ends.
    """
    spark = store.edges.sparkSession
    places = [shared_place(spark, "steps"), shared_place(spark, "degrees")]  # of tables that are of no use in the rounds
    walk = settled(steps(store.edges, by="src"), path=places[0])
    ids = settled(store.nodes.select("id").distinct(), "ids")
    n = max(1, ids.count())
    classes = twins(walk, worth=0.5, places=places).select("id", "rep").join(ids, "id", "left_semi")
    heads = classes.groupBy("rep").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size"))
    linked = settled(classes.join(heads, "rep").select("id", "head", "size"), "linked")
    loose = n - linked.count()
    out = settled(walk.groupBy("src").agg(F.count(F.lit(1)).alias("out")), path=places[1])
    reps = settled(linked.where("id = head").select("id", "size").join(out.withColumnRenamed("src", "id"), "id"), "reps")
    if rounds < 1 or reps.isEmpty():
        return ids.select("id", F.lit(round(1 / n, 6)).alias("score"))
    if reps.count() < out.count():
        walk = settled(among(walk, reps), "walk")
    # base is what a node without neighbours gets, and all others at least
    singles = [1 / n]
    for _ in range(rounds):
        singles.append((1 - damping) / n + damping * loose * singles[-1] / n)
    idle = [loose * abs(b - a) for a, b in zip(singles, singles[1:])]
    for place in places[1:]:
        dropped(spark, place)
    plans = planned(walk, reps, blocks_of(walk.count()))
    dropped(spark, places[0])
    ranks, done = spread(plans, 1 / n, singles[1:], damping, tolerance, at_once, idle)
    ranks = linked.select("id", "head").join(ranks.withColumnRenamed("id", "head"), "head")
    return ids.join(ranks, "id", "left").select("id", F.round(F.coalesce("score", F.lit(singles[done])), 6).alias("score"))


def numbered_parts(part: DataFrame) -> DataFrame:
    """part (node_id, least) with the parts numbered from 0 by their smallest ids. Numbers come from the parts, not from all nodes."""
    numbers = numbered_rows(part.groupBy("least").agg(F.count(F.lit(1)).alias("k")), "nth", "least").select("least", "k", (F.col("nth") - 1).alias("community_id"))
    return joined_once(part, settled(numbers, "numbers"), "least", part.count()).select("node_id", "community_id")


def connected_components(store: GraphStore) -> DataFrame:
    """node_id, community_id: the parts that edges join, numbered by their smallest ids; single nodes are parts."""
    found = components(store.edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    nodes = settled(store.nodes.select("id"), "ids")
    parts = parts_of(nodes.count())
    joined = nodes.repartition(parts, "id").join(found.repartition(parts, "node"), F.col("id") == F.col("node"), "left")
    return numbered_parts(settled(joined.select(F.col("id").alias("node_id"), F.coalesce("component", "id").alias("least")), "parts"))


def louvain(store: GraphStore, resolution: float = 1.0, passes: int = 20, strict: bool = False) -> DataFrame:
    """node_id, community_id, numbered by smallest member: one level of moves that raise modularity, in rounds of joins
    and sums over all nodes.

    In a round, the nodes whose id plus the round's number is even look at the communities of their
    neighbours, as these were before the round, and move at once to the one of highest gain (ties: the
    smallest number). So that two nodes do not swap, a node that is alone only joins another that is alone
    with a smaller number. Ends after two rounds without a move, or after `passes` rounds.
    strict: a node only moves where it gains over staying; else over nothing.
    """
    if resolution <= 0:
        raise ValueError("resolution must be over 0")
    walk = settled(steps(store.edges), "steps")
    m = walk.count() / 2
    home = settled(walk.groupBy("src").agg(F.count(F.lit(1)).alias("k")).select(F.col("src").alias("v"), "k", F.col("src").alias("c")), "homes")
    still = 0
    for round_ in range(passes):
        totals = home.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("members"))
        here = home.where(F.pmod(F.col("v") + round_, F.lit(2)) == 0).join(totals, "c").select("v", "k", F.col("c").alias("old"), F.col("total").alias("old_total"), F.col("members").alias("old_members"))
        into = walk.join(home.select(F.col("v").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("v"), "c").agg(F.count(F.lit(1)).alias("links"))
        sides = into.join(here, "v").join(totals, "c")
        own = F.col("c") == F.col("old")
        gain = F.col("links") - resolution * (F.col("total") - F.when(own, F.col("k")).otherwise(0)) * F.col("k") / (2 * m)
        alone = (F.col("members") == 1) & (F.col("old_members") == 1) & (F.col("c") > F.col("old"))
        best = sides.groupBy("v").agg(
            F.max(F.when(~own & ~alone, F.struct(gain.alias("gain"), (-F.col("c")).alias("minus")))).alias("best"),
            F.max(F.when(own, gain)).alias("stay"),
            F.first("k").alias("k"),
            F.first("old_total").alias("old_total"),
        )
        least = F.coalesce("stay", -resolution * (F.col("old_total") - F.col("k")) * F.col("k") / (2 * m)) if strict else F.lit(0.0)
        moves = best.where(F.col("best.gain") > least + 1e-12).select("v", (-F.col("best.minus")).alias("to"))
        home = settled(home.join(moves, "v", "left").select("v", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), "homes")
        still = still + 1 if home.where("moved").isEmpty() else 0
        if still == 2:
            break
    least = home.groupBy("c").agg(F.min("v").alias("least"))
    moved = home.select("v", "c").join(least, "c").select("v", "least")
    every = store.nodes.select(F.col("id").alias("node_id")).join(moved, F.col("node_id") == F.col("v"), "left").select("node_id", F.coalesce("least", "node_id").alias("least"))
    return numbered_parts(settled(every, "louvain"))


def community_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
