"""Exact duplicates: groups of one 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import free, stored


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", text: Column | None = None) -> DataFrame:
    """For every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of their UTF-8 text. Only hashes of more than one row have their texts
    compared: those rows are grouped by hash and text together, each task merging its own copies before
    the shuffle, so that a text of a third of all rows arrives as one row a task. Two texts under one MD5
    part there, and are told apart by SHA-256 when the groups are joined to the rows.

    keep: "smallest" or "largest", the id that stays. text: an expression to compare in place of
    text_col, such as a normal form. A null text counts as empty. A null id is never kept while its
    group has an id; a group without any has keep_id null and all rows kept. Rows that repeat an id and
    a text count in group_size and share the decision. An empty table gives an empty one. Other columns, of
    any name, play no part.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    body = F.coalesce(F.col(text_col) if text is None else text, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("text")).withColumn("hash", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    repeated = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    groups = (
        rows.join(repeated, "hash", "left_semi")
        .groupBy("hash", "text")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        .select("hash", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), "best", "n")
    )
    all_rows = rows.select("doc_id", "hash", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    same = (all_rows["hash"] == groups["hash"]) & (all_rows["sha"] == groups["sha"])
    keep_id = F.when(groups["n"].isNull(), all_rows["doc_id"]).otherwise(groups["best"])
    return all_rows.join(groups, same, "left").select(
        all_rows["doc_id"],
        keep_id.alias("keep_id"),
        F.coalesce(groups["n"], F.lit(1)).cast("long").alias("group_size"),
        all_rows["doc_id"].eqNullSafe(keep_id).alias("kept"),
        all_rows["sha"].alias("text_sha256"),
    )


def without_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows that exact_groups drops; the columns stay as they are. The decision holds for an id
    together with its text, and of rows that repeat both one stays. A null text is an empty one; rows of a null id stay."""
    groups = exact_groups(docs, id_col, text_col, keep).where("doc_id is not null")
    # ids with a row to drop or several rows, no texts: where all rows of an id go, the id decides
    by_id = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("gone"))
    name, sha, same = (free(docs.columns, n) for n in ("__id", "__sha", "__same"))
    by_id = stored(by_id.where("gone > 0 or n > 1").select(F.col("doc_id").alias(name), (F.col("gone") == F.col("n")).alias("all")), "exact-copies")
    out = docs.join(by_id, docs[id_col] == by_id[name], "left_anti")
    mixed = by_id.where("not all")
    if mixed.isEmpty():
        return out
    kept = groups.where("kept").join(mixed, F.col("doc_id") == F.col(name), "left_semi").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(same)).distinct()
    some = docs.join(mixed, docs[id_col] == mixed[name], "left_semi").withColumn(sha, F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256))
    some = some.join(kept, (F.col(id_col) == F.col(name)) & (F.col(sha) == F.col(same)), "left_semi")
    return out.unionAll(some.dropDuplicates([id_col, sha]).select(*docs.columns))
