"""A stored full-text index: posting lists in blocks of ids, kept current by segments."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.commits import Commits
from loomgraph.functions.text import search_terms, tokens
from loomgraph.operators.lookup import limited
from loomgraph.store import GraphStore, settled

#: Ids of a block share all bits but the last so many; parts of the vocabulary, a folder each.
BLOCK_BITS, SHARDS = 12, 16
#: Blocks of the rarest term whose numbers go into the scan's filter; of more only their least and largest.
NAMED_BLOCKS = 512
#: Segments that a search reads at most; with one more, an update merges them.
SEGMENTS = 8
POSTINGS = "segment int, shard int, token string, block long, n int, first_id long, last_id long, offsets array<int>"
TERMS = "segment int, shard int, token string, n long, blocks long, first_block long, last_block long"


class TextIndex:
    """Which rows have which tokens, in a folder that all machines share.

    A segment is what one build or update has added: `postings` holds for each token and block of 4096 neighbouring ids
    the ids' places in the block, with how many they are and the first and last of them; `terms` holds for each token how many
    ids and blocks it has. Both lie by shards of the token's hash and are sorted by token, so a search reads a few
    row groups of a few folders. `gone` names ids whose postings in earlier segments no longer hold. A version lists its
    segments; versions appear whole or not at all (`Commits`), and a reader of one is not disturbed by later ones.

    Ids are numbers of 64 bits and not null; a row of a null id is left out. A null text has no tokens.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), Commits(spark, path)
        self.version = self.commits.latest() if version is None else version
        self.segments: list[int] = self.commits.read(self.version)["segments"] if self.version else []
        self.folders: dict[str, str] = self.commits.read(self.version)["folders"] if self.version else {}

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of all segments of this version; the segment and shard are folders."""
        parts = []
        for s in self.segments:
            base = f"{self.path}/{self.folders[str(s)]}/{name}"
            columns = ", ".join(c for c in schema.split(", ") if c.split()[0] != "segment")
            parts.append(self.spark.read.schema(columns).parquet(base).withColumn("segment", F.lit(s)))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def postings(self) -> DataFrame:
        return self.table("postings", POSTINGS)

    def terms(self) -> DataFrame:
        return self.table("terms", TERMS)

    def gone(self) -> DataFrame:
        return self.table("gone", "segment int, id long")

    def updated(self, rows: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """The next version: rows (id, text) in place of what the index has of their ids, ids of gone (id) without anything."""
        number = self.commits.claim(self.version)
        try:
            folder = f"segment-{number}-{uuid.uuid4().hex[:12]}"
            rows = rows.where("id is not null")
            self.write(folder, rows)
            void = rows.select("id") if gone is None else rows.select("id").unionAll(gone.select("id"))
            void = void if self.segments else void.limit(0)
            void.where("id is not null").distinct().write.parquet(f"{self.path}/{folder}/gone")
            self.commits.commit(number, {"segments": [*self.segments, number], "folders": {**self.folders, str(number): folder}})
        except BaseException:
            self.commits.abandon(number)
            raise
        new = TextIndex(self.spark, self.path, number)
        return new.merged() if len(new.segments) > SEGMENTS else new

    def write(self, folder: str, rows: DataFrame) -> None:
        self.write_postings(folder, rows.select(F.col("id").cast("long").alias("id"), F.explode(tokens(F.col("text"))).alias("token")))

    def write_postings(self, folder: str, found: DataFrame) -> None:
        """found (id, token; a pair may come again) as a segment's tables. Pairs meet in sets of a block, where each task's own have met before the
        shuffle; the blocks are written once, as the ranges below take a sample of them first."""
        place = F.shiftright("id", BLOCK_BITS)
        inside = (F.col("id") - F.shiftleft(place, BLOCK_BITS)).cast("int")
        blocks = found.groupBy("token", place.alias("block")).agg(F.array_sort(F.collect_set(inside)).alias("offsets"))  # of a block of ids
        blocks = settled(blocks, "blocks")
        start = F.shiftleft("block", BLOCK_BITS)
        first, last = start + F.element_at("offsets", 1), start + F.element_at("offsets", -1)
        blocks = blocks.select(shard_of(F.col("token")).alias("shard"), "token", "block", F.size("offsets").alias("n"), first.alias("first_id"), last.alias("last_id"), "offsets")
        # by ranges of token and block, so that a token of a third of all rows is not one task's work
        sorted_ = blocks.repartitionByRange("shard", "token", "block").sortWithinPartitions("shard", "token", "block")
        sorted_.write.partitionBy("shard").parquet(f"{self.path}/{folder}/postings")
        written = self.spark.read.schema(POSTINGS.replace("segment int, ", "")).parquet(f"{self.path}/{folder}/postings")
        terms = written.groupBy("shard", "token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))
        terms.repartitionByRange("shard", "token").sortWithinPartitions("shard", "token").write.partitionBy("shard").parquet(f"{self.path}/{folder}/terms")

    def merged(self) -> TextIndex:
        """The next version: the same in one segment."""
        number = self.commits.claim(self.version)
        try:
            folder = f"segment-{number}-{uuid.uuid4().hex[:12]}"
            self.write_postings(folder, self.pairs())
            self.spark.createDataFrame([], "id long").write.parquet(f"{self.path}/{folder}/gone")
            self.commits.commit(number, {"segments": [number], "folders": {str(number): folder}})
        except BaseException:
            self.commits.abandon(number)
            raise
        return TextIndex(self.spark, self.path, number)

    def pairs(self) -> DataFrame:
        """id, token: all that holds."""
        rows = self.postings().select("segment", "token", F.explode(F.transform("offsets", lambda o: F.shiftleft("block", BLOCK_BITS) + o)).alias("id"))
        return self.holding(rows).drop("segment")

    def holding(self, hits: DataFrame) -> DataFrame:
        """hits (segment, id) that no later segment has made void."""
        if len(self.segments) < 2:
            return hits
        void = self.gone().groupBy(F.col("id").alias("void_id")).agg(F.max("segment").alias("until"))
        return hits.join(void, (F.col("id") == F.col("void_id")) & (F.col("segment") < F.col("until")), "left_anti")

    def frequencies(self, terms: list[str]) -> dict[str, tuple[int, int, int, int]]:
        """Of each term: ids, blocks, first and last block, summed over the segments; a row a term and segment is read."""
        rows = self.terms().where(F.col("shard").isin(shards_of(self.spark, terms)) & F.col("token").isin(terms))
        by = rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), F.min("first_block").alias("first"), F.max("last_block").alias("last")).collect()
        return {r["token"]: (r["n"], r["blocks"], r["first"], r["last"]) for r in by}

    def matches(self, pattern: str) -> DataFrame | None:
        """id of the rows that have all tokens of the pattern; None where it has none, as then all rows match.

        The rarest term comes first: its blocks, or where they are many their range, are a filter on the scan of
        the others, next to the terms themselves. In each block the places of all terms are intersected.
        """
        terms = search_terms(pattern)
        if not terms:
            return None
        found = self.frequencies(terms)
        if len(found) < len(terms):
            return self.spark.createDataFrame([], "id long")
        rare, *others = sorted(terms, key=lambda t: (found[t][0], t))
        postings = self.postings()

        def lists(names: list[str]) -> DataFrame:
            return postings.where(F.col("shard").isin(shards_of(self.spark, names)) & F.col("token").isin(names))

        first = lists([rare])
        _, blocks, low, high = found[rare]
        if not others:
            wanted = first.select("segment", "block", "offsets")
        else:
            rest = lists(others)
            numbers = sorted({r["block"] for r in first.select("block").collect()}) if blocks <= NAMED_BLOCKS else None
            rest = rest.where(F.col("block").isin(numbers)) if numbers is not None else rest.where(F.col("block").between(low, high))
            both = first.select("segment", "block", "token", "offsets").unionAll(rest.select("segment", "block", "token", "offsets"))
            met = both.groupBy("segment", "block").agg(F.collect_list("offsets").alias("lists")).where(F.size("lists") == len(terms))  # a list a term
            common = F.aggregate(F.slice("lists", 2, len(terms)), F.col("lists")[0], lambda have, other: F.array_intersect(have, other))
            wanted = met.select("segment", "block", common.alias("offsets"))
        hits = wanted.select("segment", F.explode(F.transform("offsets", lambda o: F.shiftleft("block", BLOCK_BITS) + o)).alias("id"))
        return self.holding(hits).select("id")


def shard_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SHARDS)).cast("int")


def shards_of(spark: SparkSession, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(shard_of(F.col("t")).alias("s")).distinct().collect()
    return sorted(r["s"] for r in rows)


def node_text() -> Column:
    """What of a node is searched."""
    return F.concat_ws(" ", "name", "qualified_name", "properties")


def index_nodes(store: GraphStore, path: str) -> TextIndex:
    """A new index of all nodes; an index that is there gets a version with these nodes alone."""
    index = TextIndex(store.nodes.sparkSession, path)
    fresh = TextIndex(index.spark, path, 0)
    fresh.version = index.version
    return fresh.updated(store.nodes.select("id", node_text().alias("text")))


def index_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    index = TextIndex(docs.sparkSession, path)
    fresh = TextIndex(index.spark, path, 0)
    fresh.version = index.version
    return fresh.updated(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))


def follow(index: TextIndex, store: GraphStore, result: DataFrame) -> TextIndex:
    """The index after a change of nodes: store is the new one, result what add_nodes, upsert_nodes or delete_nodes gave beside
    it. Only the nodes that were created, updated or deleted are read."""
    if "deleted" in result.columns:
        gone = result.where("deleted = 1").select("id")
        return index.updated(index.spark.createDataFrame([], "id long, text string"), gone)
    touched = result.where(F.col("status").isin("created", "updated")).select("id").distinct()
    rows = store.nodes.join(touched, "id", "left_semi").select("id", node_text().alias("text"))
    return index.updated(rows)


def search(index: TextIndex, store: GraphStore, pattern: str = "", label: str | None = None, limit: int | None = 50) -> DataFrame:
    """As lookup.search, from the index: nodes with all the pattern's tokens, by id."""
    found = store.nodes if label is None else store.nodes.where(F.col("label") == label)
    hits = index.matches(pattern)
    if hits is not None:
        found = found.join(hits, "id", "left_semi")
    return found if limit is None else found.orderBy("id").limit(limited(limit, 1000))
