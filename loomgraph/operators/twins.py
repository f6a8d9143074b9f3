"""Nodes with the same neighbours, of which one can stand for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import settled, shared_place, tidy


def twins(walk: DataFrame, apart: tuple[int, ...] = (), worth: float = 0.0, places: list[str] | None = None) -> DataFrame:
    """id, rep, size: for every node of walk (src, dst: distinct, both ways, no loops) the smallest node with the same
    neighbours, and how many such there are. Twins are never neighbours. The nodes of apart stand for themselves alone. Where
    less than the share `worth` of the nodes has others before it, all stand for themselves. Folders of tables that are of no use once the result is stored
    are added to places.

    Candidates meet by two 64-bit hashes over their neighbours, made without a list of them; a node only joins the one that
    stands for it once all its neighbours are found among that one's.
    """
    def kept(df: DataFrame) -> DataFrame:
        path = shared_place(walk.sparkSession, "twins")
        if places is not None:
            places.append(path)
        return settled(df, path=path)

    alone = F.col("src").isin(*apart) if apart else F.lit(False)
    mark = walk.groupBy("src").agg(F.bit_xor(F.xxhash64("dst")).alias("h"), F.bit_xor(F.xxhash64("dst", F.lit(1))).alias("g"), F.count(F.lit(1)).alias("k"))
    mark = kept(mark.withColumn("own", F.when(alone, F.col("src"))))
    by = ["h", "g", "k", "own"]
    none = mark.select(F.col("src").alias("id"), F.col("src").alias("rep"), F.lit(1).cast("long").alias("size"))
    with tidy(walk.sparkSession):
        if worth and mark.select(*by).distinct().count() > (1 - worth) * mark.count():
            return none
    groups = mark.groupBy(*by).agg(F.min("src").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 and own is null").drop("n", "own")
    likely = kept(mark.where("own is null").join(groups, ["h", "g", "k"]).where("src != rep").select("src", "rep", "k"))
    if likely.isEmpty():
        return none
    of_reps = walk.join(likely.select(F.col("rep").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("rep"), "dst")
    shared = walk.join(likely, "src").select("src", "rep", "k", "dst").join(of_reps, ["rep", "dst"], "left_semi")
    sure = shared.groupBy("src", "rep", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("src", "rep")
    found = kept(mark.select("src").join(sure, "src", "left").select(F.col("src").alias("id"), F.coalesce("rep", "src").alias("rep")))
    return found.join(found.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "rep").select("id", "rep", "size")


def among(walk: DataFrame, reps: DataFrame) -> DataFrame:
    """The steps of walk (src, dst) between nodes of reps (id)."""
    walk = walk.join(reps.select(F.col("id").alias("src")), "src", "left_semi")
    return walk.join(reps.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
