"""Rounds of sums over neighbours on a graph in blocks: numbers of nodes go from block to block as packed rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import dropped, settled, shared_place

#: Steps of a block, on average, and of one of a graph of more than MANY blocks: the fewer these are, the fewer copies of a score a round sends.
BLOCK_STEPS, MANY, MOST = 1_000_000, 24, 4
PLAN = "block int, n int, ids binary, share binary, size binary, degree binary, places binary, sent binary, to binary"
#: What of it a round reads.
KEPT = ("block", "n", "share", "size", "degree", "places", "sent", "to")
ROWS = "block int, source int, scores binary, changes array<double>"
#: Source of the row that a block keeps for itself.
OWN = -1


def array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def planned(walk: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """A row a block (PLAN) of the graph of walk (src, dst: both ways, each once, all among nodes) and nodes (id, size, out).

    A block has the nodes of one hash. As steps go both ways, the steps into a block name its neighbours in another block, and the same
    steps turned round lie with that one: so both know, without asking, which nodes one sends to the other, and in which order (by id).
    ids, size and share (size over out) are those of its nodes; sent: the places of the nodes whose scores go to other blocks, to: how many
    to which; places: for each step into the block, by its target, where its source lies in all that comes; degree: steps of a target.
    """

    def block(c: str):
        return F.pmod(F.xxhash64(c), F.lit(count)).cast("int")

    def plan(key: tuple, steps: pa.Table, nodes: pa.Table) -> pa.Table:
        order = np.argsort(nodes["id"].to_numpy())
        ids, size, out = (nodes[c].to_numpy()[order] for c in ("id", "size", "out"))
        if not len(ids):
            return table([], PLAN)
        from_, source, target = (steps[c].to_numpy() for c in ("source", "src", "dst"))
        place = np.searchsorted(ids, target)
        order = np.lexsort((source, from_))
        new = np.ones(len(order), bool)
        new[1:] = (from_[order[1:]] != from_[order[:-1]]) | (source[order[1:]] != source[order[:-1]])
        comes = np.empty(len(order), np.int32)
        comes[order] = np.cumsum(new) - 1
        comes = comes[np.argsort(place, kind="stable")]
        order = np.lexsort((place, from_))
        new[1:] = (from_[order[1:]] != from_[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
        sent = place[order][new].astype(np.int32)
        to = np.stack(np.unique(from_[order][new], return_counts=True), axis=1).astype(np.int32)
        degree = np.bincount(place, minlength=len(ids)).astype(np.int32)
        return table([(key[0].as_py(), len(ids), *(x.tobytes() for x in (ids, size / out, size.astype(float), degree, comes, sent, to)))], PLAN)

    steps = walk.select(block("dst").alias("block"), block("src").alias("source"), "src", "dst")
    rows = nodes.select(block("id").alias("block"), "id", "size", "out")
    return settled(steps.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(plan, PLAN), "plan")


def sending(key: int, plan: dict, scores: np.ndarray) -> list[tuple]:
    """The rows in which a block sends its nodes' scores, by their shares, to the blocks of their neighbours."""
    values = (scores * array(plan["share"], float))[array(plan["sent"], np.int32)]
    to = array(plan["to"], np.int32).reshape(-1, 2)
    ends = np.cumsum(to[:, 1])
    return [(int(b), key, values[e - k : e].tobytes(), None) for (b, k), e in zip(to, ends)]


def first_scores(plans: DataFrame, score: float) -> DataFrame:
    """A row (ROWS) a block before the first round: all nodes have the score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist()):
                yield from table([(key, OWN, np.full(n, score).tobytes(), [])], ROWS).to_batches()

    return plans.select("block", "n").mapInArrow(work, ROWS)


def first_rows(own: DataFrame, plans: DataFrame) -> DataFrame:
    """The rows that go into a round: those that blocks keep for themselves (own) and what they send."""

    def work(key: tuple, own: pa.Table, plans: pa.Table) -> pa.Table:
        block, scores = key[0].as_py(), array(own["scores"][0], float)
        return table([(block, OWN, scores.tobytes(), []), *sending(block, {c: plans[c][0] for c in plans.column_names}, scores)], ROWS)

    return own.groupBy("block").cogroup(plans.select(*KEPT).groupBy("block")).applyInArrow(work, ROWS)


def next_rows(rows: DataFrame, plans: DataFrame, base: float, damping: float, send: bool) -> DataFrame:
    """The rows after a round, in which a node gets base and what its neighbours hand on by damping; without send only those that blocks keep. These
    have their nodes' scores and how much each round of rows changed them in sum."""

    def work(key: tuple, rows: pa.Table, plans: pa.Table) -> pa.Table:
        plan = {c: plans[c][0] for c in plans.column_names}
        rows = rows.take(pc.sort_indices(rows, [("source", "ascending")]))
        came = [array(x, float) for x in rows["scores"]]
        degree, places = array(plan["degree"], np.int32), array(plan["places"], np.int32)
        given = np.zeros(plan["n"].as_py())
        if len(places):
            some = degree > 0
            given[some] = np.add.reduceat(np.concatenate(came[1:])[places], (np.cumsum(degree) - degree)[some])
        scores = base + damping * given
        change = float((array(plan["size"], float) * np.abs(scores - came[0])).sum())
        block = key[0].as_py()
        own = (block, OWN, scores.tobytes(), [*rows["changes"][0].as_py(), change])
        return table([own, *(sending(block, plan, scores) if send else [])], ROWS)

    return rows.groupBy("block").cogroup(plans.select(*KEPT).groupBy("block")).applyInArrow(work, ROWS)


def scores_of(own: DataFrame, plans: DataFrame) -> DataFrame:
    """id, score: of all nodes, by the rows that blocks keep."""

    def work(key: tuple, own: pa.Table, plans: pa.Table) -> pa.Table:
        return pa.table({"id": array(plans["ids"][0], np.int64), "score": array(own["scores"][0], float)})

    return own.select("block", "scores").groupBy("block").cogroup(plans.select("block", "ids").groupBy("block")).applyInArrow(work, "id long, score double")


def blocks_of(steps: int) -> int:
    return max(1, min(MANY, -(-steps // BLOCK_STEPS)), -(-steps // (MOST * BLOCK_STEPS)))


def spread(plans: DataFrame, score: float, bases: Sequence[float], damping: float, tolerance: float, at_once: int, idle: Sequence[float]) -> tuple[DataFrame, int]:
    """id, score of the nodes of plans after the rounds, a base each, and how many these were; ends with the first whose changes and idle (what
    changes elsewhere in that round) come to less than tolerance.

    Up to at_once rounds are one job, which only writes the scores; those before it go, so that the disk holds the shuffles of one job at most. How many rounds are
    left is guessed by how changes fell; a job that went too far is done again with as many as it should have had.
    """
    spark = plans.sparkSession
    place = shared_place(spark, "scores")
    own, done, some = settled(first_scores(plans, score), path=place), 0, at_once
    while True:
        rows = first_rows(own, plans)
        for k in range(some := min(some, len(bases) - done)):
            rows = next_rows(rows, plans, bases[done + k], damping, k + 1 < some)
        new = shared_place(spark, "scores")
        rows = settled(rows, path=new)
        sums = rows.agg(*(F.coalesce(F.sum(F.col("changes")[k]), F.lit(0.0)) for k in range(some))).first()
        changes = [sums[k] + idle[done + k] for k in range(some)]
        last = next((k + 1 for k in range(some) if changes[k] < tolerance), None)
        if last and last < some:
            dropped(spark, new)
            some = last
            continue
        dropped(spark, place)
        own, place, done = rows, new, done + some
        if last or done == len(bases):
            return scores_of(own, plans), done
        fell = changes[-1] / changes[-2] if some > 1 and changes[-2] else damping
        guess = math.ceil(math.log(tolerance / changes[-1]) / math.log(fell)) if 0 < tolerance <= changes[-1] and 0 < fell < 1 else at_once
        some = max(1, min(at_once, guess))
