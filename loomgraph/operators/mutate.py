"""Changes of a graph as merges: each gives the new store and a table of results, and appends to the audit log."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.text import qualified
from loomgraph.operators.lookup import allowed
from loomgraph.operators.ordering import numbered_rows
from loomgraph.store import GraphStore, settled


def now(as_of: dt.datetime | None) -> Column:
    return F.lit(as_of) if as_of else F.current_timestamp()


def with_columns(df: DataFrame, **defaults: Column) -> DataFrame:
    """df with these columns, where missing or null the defaults."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def checked_nodes(items: DataFrame, name_chars: int | None = schema.NAME_CHARS) -> DataFrame:
    """items (nth, label, name, and what else a node has) with an error where one may not become a node."""
    text = F.lit(None).cast("string")
    items = with_columns(items, qualified_name=text, properties=F.lit("{}"), provenance=F.lit("EXTRACTED"), source=text)
    error = (
        F.when(~allowed(F.col("label"), schema.LABELS), "unknown label")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "a name is needed")
        .when(F.lit(name_chars is not None) & (F.length("name") > (name_chars or 0)), "the name is too long")
        .when(~allowed(F.col("provenance"), schema.PROVENANCE), "unknown provenance")
        .when(F.length("properties") > schema.PROPERTY_CHARS, "the properties are too long")
        .when(F.coalesce(F.schema_of_variant(F.try_parse_json("properties")), F.lit("")).startswith("OBJECT") == F.lit(False), "the properties are no object")
    )
    name = F.coalesce(F.when(F.col("qualified_name") == "", None).otherwise(F.col("qualified_name")), qualified(F.col("label"), F.col("name")))
    return items.withColumn("error", error).withColumn("qualified_name", name)


def limited_batch(items: DataFrame, most: int = schema.BATCH_ITEMS) -> DataFrame:
    items = settled(items, "batch")
    if items.count() > most:
        raise ValueError(f"a batch has {most} items at most")
    return items


def audited(store: GraphStore, rows: DataFrame) -> GraphStore:
    names = [f.name for f in schema.AUDIT]
    return store.with_(audit_log=store.audit_log.unionByName(rows.select(*names)))


def numbered(rows: DataFrame, table: DataFrame, order: str = "nth") -> DataFrame:
    """rows with new ids after the table's largest, in their order."""
    first = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered_rows(rows.drop("id"), "id", order).withColumn("id", F.lit(first) + F.col("id"))


def add_nodes(store: GraphStore, items: DataFrame, as_of: dt.datetime | None = None, most: int | None = schema.BATCH_ITEMS) -> tuple[GraphStore, DataFrame]:
    """New nodes from items (nth, label, name, qualified_name?, properties?, provenance?, source?). A name that the
    graph has, or an earlier item, stays as it is. Result: nth, id, status (created, already_exists, error), error."""
    items = checked_nodes(limited_batch(items, most) if most else items)
    good = items.where("error is null")
    known = store.nodes.select(F.col("id").alias("known_id"), F.col("qualified_name").alias("known"))
    joined = good.join(known, good["qualified_name"] == known["known"], "left")
    fresh = joined.where("known is null").withColumn("copy", F.row_number().over(Window.partitionBy("qualified_name").orderBy("nth")))
    made = settled(numbered(fresh.where("copy = 1"), store.nodes).drop("known", "known_id", "copy"), "new-nodes")
    rows = made.withColumn("created_at", now(as_of)).withColumn("updated_at", now(as_of))
    new = store.with_(nodes=store.nodes.unionByName(rows.select(*(f.name for f in schema.NODES))))
    new = audited(new, made.select(F.lit("node_create").alias("event"), F.lit("node").alias("entity_type"), F.col("id").alias("entity_id"), "label", "qualified_name", "source", now(as_of).alias("timestamp")))
    ids = made.select(F.col("qualified_name").alias("made"), F.col("id").alias("made_id"), F.col("nth").alias("made_nth"))
    result = joined.join(ids, F.col("qualified_name") == F.col("made"), "left").select(
        "nth", F.coalesce("known_id", "made_id").alias("id"), F.when(F.col("nth") == F.col("made_nth"), "created").otherwise("already_exists").alias("status"), "error"
    )
    bad = items.where("error is not null").select("nth", F.lit(None).cast("long").alias("id"), F.lit("error").alias("status"), "error")
    return new, result.unionAll(bad)


def upsert_nodes(store: GraphStore, items: DataFrame, as_of: dt.datetime | None = None) -> tuple[GraphStore, DataFrame]:
    """As add_nodes, but a known node takes the item's values and keeps its id and created_at; of several items of
    a name the last holds. Result: nth, id, status (created, updated, error), error."""
    items = settled(checked_nodes(items, None), "batch")
    last = items.where("error is null").withColumn("copy", F.row_number().over(Window.partitionBy("qualified_name").orderBy(F.desc("nth")))).where("copy = 1").drop("copy")
    known = store.nodes.select(F.col("id").alias("known_id"), F.col("qualified_name").alias("known"), F.col("created_at").alias("known_created"))
    joined = last.join(known, last["qualified_name"] == known["known"], "left")
    made = numbered(joined.where("known is null"), store.nodes)
    kept = joined.where("known is not null").withColumn("id", F.col("known_id"))
    rows = settled(made.unionByName(kept), "upserts").withColumn("created_at", F.coalesce("known_created", now(as_of))).withColumn("updated_at", now(as_of))
    others = store.nodes.join(rows.select("id"), "id", "left_anti").select(*(f.name for f in schema.NODES))
    new = store.with_(nodes=others.unionByName(rows.select(*(f.name for f in schema.NODES))))
    event = F.when(F.col("known").isNull(), "node_create").otherwise("node_update")
    new = audited(new, rows.select(event.alias("event"), F.lit("node").alias("entity_type"), F.col("id").alias("entity_id"), "label", "qualified_name", "source", now(as_of).alias("timestamp")))
    status = rows.select(F.col("qualified_name").alias("done"), "id", F.when(F.col("known").isNull(), "created").otherwise("updated").alias("status"))
    result = items.where("error is null").join(status, F.col("qualified_name") == F.col("done")).select("nth", "id", "status", "error")
    bad = items.where("error is not null").select("nth", F.lit(None).cast("long").alias("id"), F.lit("error").alias("status"), "error")
    return new, result.unionAll(bad)


def add_edges(store: GraphStore, items: DataFrame, as_of: dt.datetime | None = None, most: int | None = schema.BATCH_ITEMS) -> tuple[GraphStore, DataFrame]:
    """Edges from items (nth, source, target: an id as text or a qualified name, type, properties?, provenance?,
    weight?). The last item of a (source, target, type) holds; an edge that is there keeps id and created_at.
    Result: nth, id, status (created, updated, error), error."""
    items = limited_batch(items, most) if most else items
    items = with_columns(items, properties=F.lit("{}"), provenance=F.lit("EXTRACTED"), weight=F.lit(1.0))
    items = items.withColumn("weight", F.col("weight").cast("double"))
    for end in ("source", "target"):
        names = store.nodes.select(F.col("qualified_name").alias(f"{end}_name"), F.col("id").alias(f"{end}_known"))
        given = items.withColumn(f"{end}_number", F.col(end).try_cast("long"))
        ids = store.nodes.select(F.col("id").alias(f"{end}_there"))
        items = given.join(names, given[end] == names[f"{end}_name"], "left").join(ids, F.col(f"{end}_number") == F.col(f"{end}_there"), "left")
        items = items.withColumn(f"{end}_id", F.coalesce(f"{end}_there", f"{end}_known")).drop(f"{end}_name", f"{end}_known", f"{end}_number", f"{end}_there")
    error = (
        F.when(~allowed(F.col("type"), schema.EDGE_TYPES), "unknown edge type")
        .when(~allowed(F.col("provenance"), schema.PROVENANCE), "unknown provenance")
        .when(~F.coalesce(F.col("weight") >= 0, F.lit(False)), "the weight is negative")
        .when(F.col("source_id").isNull(), "source not found")
        .when(F.col("target_id").isNull(), "target not found")
    )
    items = settled(items.withColumn("error", error), "batch")
    key = ["source_id", "target_id", "type"]
    good = items.where("error is null").withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("nth")))).where("copy = 1").drop("copy")
    known = store.edges.select(F.col("id").alias("known_id"), *key, F.col("created_at").alias("known_created"))
    joined = good.join(known, key, "left")
    rows = numbered(joined.where("known_id is null"), store.edges).unionByName(joined.where("known_id is not null").withColumn("id", F.col("known_id")))
    rows = settled(rows, "new-edges").withColumn("created_at", F.coalesce("known_created", now(as_of)))
    others = store.edges.join(rows.select("id"), "id", "left_anti").select(*(f.name for f in schema.EDGES))
    new = store.with_(edges=others.unionByName(rows.select(*(f.name for f in schema.EDGES))))
    text = F.lit(None).cast("string")
    new = audited(new, rows.select(F.lit("edge_upsert").alias("event"), F.lit("edge").alias("entity_type"), F.col("id").alias("entity_id"), F.col("type").alias("label"), text.alias("qualified_name"), text.alias("source"), now(as_of).alias("timestamp")))
    done = rows.select(*key, "id", F.when(F.col("known_id").isNull(), "created").otherwise("updated").alias("status"))
    result = items.where("error is null").join(done, key).select("nth", "id", "status", "error")
    bad = items.where("error is not null").select("nth", F.lit(None).cast("long").alias("id"), F.lit("error").alias("status"), "error")
    return new, result.unionAll(bad)


def delete_nodes(store: GraphStore, gone: DataFrame, as_of: dt.datetime | None = None) -> tuple[GraphStore, DataFrame]:
    """The store without the nodes gone (id) names, their edges and memberships. Result: id, deleted (0 or 1)."""
    gone = settled(gone.select("id").distinct(), "gone")
    edges = reduce(lambda e, end: e.join(gone.select(F.col("id").alias("gone")), e[end] == F.col("gone"), "left_anti"), ("source_id", "target_id"), store.edges)
    members = store.communities.join(gone.select(F.col("id").alias("gone")), F.col("node_id") == F.col("gone"), "left_anti")
    there = store.nodes.select(F.col("id").alias("there"), "label", "qualified_name", "source")
    found = gone.join(there, gone["id"] == there["there"], "left")
    new = store.with_(nodes=store.nodes.join(gone, "id", "left_anti").select(*(f.name for f in schema.NODES)), edges=edges, communities=members)
    new = audited(new, found.select(F.lit("node_delete").alias("event"), F.lit("node").alias("entity_type"), F.col("id").alias("entity_id"), "label", "qualified_name", "source", now(as_of).alias("timestamp")))
    return new, found.select("id", F.when(F.col("there").isNull(), 0).otherwise(1).alias("deleted"))


def set_communities(store: GraphStore, members: DataFrame, as_of: dt.datetime | None = None, audit: bool = True) -> GraphStore:
    """members (node_id, community_id, algorithm; nth where a pair repeats: the last holds) in place of what a node had
    under the algorithm."""
    members = with_columns(members, algorithm=F.lit("manual"), nth=F.lit(0))
    bad = members.where("node_id is null or node_id <= 0 or community_id is null or community_id < 0 or length(algorithm) > 64")
    if not bad.isEmpty():
        raise ValueError("node_id is over 0, community_id at least 0, algorithm of 64 characters at most")
    last = members.withColumn("copy", F.row_number().over(Window.partitionBy("node_id", "algorithm").orderBy(F.desc("nth")))).where("copy = 1")
    rows = last.select(F.col("node_id").cast("long").alias("node_id"), F.col("community_id").cast("long").alias("community_id"), "algorithm", now(as_of).alias("created_at"))
    new = store.with_(communities=store.communities.join(rows, ["node_id", "algorithm"], "left_anti").select(*(f.name for f in schema.COMMUNITIES)).unionByName(rows))
    text = F.lit(None).cast("string")
    event = rows.select(F.lit("community_set").alias("event"), F.lit("node").alias("entity_type"), F.col("node_id").alias("entity_id"), text.alias("label"), text.alias("qualified_name"), F.col("algorithm").alias("source"), now(as_of).alias("timestamp"))
    return audited(new, event) if audit else new
