"""Reading a graph: lookups, neighbourhoods, summaries, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions.text import has_tokens, redact_properties, search_terms, tokens
from loomgraph.store import GraphStore


def limited(limit: int, most: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be an integer of at least 1")
    return min(limit, most)


def node_id(store: GraphStore, node: int | str) -> int:
    """A number is an id as it is; a text is a qualified name, looked up at once; ValueError if no node has it."""
    if isinstance(node, bool) or not isinstance(node, int | str):
        raise ValueError("a node is an id or a qualified name")
    if isinstance(node, int):
        return node
    row = store.nodes.where(F.col("qualified_name") == node).select("id").first()
    if row is None:
        raise ValueError("no node has this name")
    return row["id"]


def ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with the named node columns of both ends, as source_x and target_x."""
    for end in ("source", "target"):
        side = nodes.select(F.col("id").alias(f"{end}_node"), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        edges = edges.join(side, edges[f"{end}_id"] == side[f"{end}_node"]).drop(f"{end}_node")
    return edges


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: edge ends at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def node_degrees(store: GraphStore) -> DataFrame:
    """id, out_degree, in_degree, degree of every node."""
    one, zero = F.lit(1), F.lit(0)
    out = F.struct(F.col("source_id").alias("id"), one.alias("o"), zero.alias("i"))
    ends_ = store.edges.select(F.inline(F.array(out, F.struct(F.col("target_id").alias("id"), zero.alias("o"), one.alias("i")))))
    sums = ends_.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    joined = store.nodes.select("id").join(sums, "id", "left")
    o, i = F.coalesce("out_degree", zero), F.coalesce("in_degree", zero)
    return joined.select("id", o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("degree"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_degree(store: GraphStore, limit: int = 10) -> DataFrame:
    """The nodes with most edge ends, ties to the smaller id."""
    top = degrees(store.edges).orderBy(F.desc("degree"), "id").limit(limit)
    return top.join(store.nodes.select("id", "label", "name"), "id").select("id", "label", "name", "degree")


def architecture(store: GraphStore) -> dict[str, DataFrame]:
    return {
        "labels": counts_by(store.nodes, "label"),
        "edge_types": counts_by(store.edges, "type"),
        "provenance": counts_by(store.edges, "provenance"),
        "top_degree": top_degree(store),
    }


def graph_schema(spark: SparkSession) -> DataFrame:
    """kind, value: what labels, edge types and provenance tags there may be."""
    rows = [("label", x) for x in schema.LABELS] + [("edge_type", x) for x in schema.EDGE_TYPES] + [("provenance", x) for x in schema.PROVENANCE]
    return spark.createDataFrame(rows, "kind string, value string")


def project_stats(store: GraphStore) -> DataFrame:
    """One row: nodes, edges, communities and the metadata as a map."""
    n = store.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = store.edges.agg(F.count(F.lit(1)).alias("edges"))
    c = store.communities.agg(F.count_distinct("community_id").alias("communities"))
    m = store.metadata.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    return n.join(e).join(c).join(m)  # a row each


def search(store: GraphStore, pattern: str = "", label: str | None = None, limit: int | None = 50) -> DataFrame:
    """Nodes with all the pattern's tokens among those of name, qualified name and properties, by id. A pattern
    without tokens matches all. limit None: all of them."""
    found = store.nodes if label is None else store.nodes.where(F.col("label") == label)
    terms = search_terms(pattern)
    if terms:
        found = found.where(has_tokens(F.concat_ws(" ", "name", "qualified_name", "properties"), terms))
    return found if limit is None else found.orderBy("id").limit(limited(limit, 1000))


def text_search(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Rows of docs whose text has all the pattern's tokens."""
    terms = search_terms(pattern)
    if not terms:
        return docs
    return docs.where(has_tokens(F.col(text_col), terms))


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, id: an index for repeated searches; index_search answers from it."""
    return docs.select(F.explode(tokens(F.col(text_col))).alias("token"), F.col(id_col).alias("id"))


def index_search(index: DataFrame, pattern: str) -> DataFrame:
    """id of what has all the pattern's tokens; without any, all that the index has."""
    terms = search_terms(pattern)
    if not terms:
        return index.select("id").distinct()
    hits = index.where(F.col("token").isin(*terms)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(terms)).select("id")


def node_edges(store: GraphStore, node: int | str, direction: str = "out") -> DataFrame:
    """The node's edges and the nodes at their other ends."""
    at = node_id(store, node)
    here, there = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    other = store.nodes.select(F.col("id").alias("neighbor_id"), F.col("label").alias("neighbor_label"), F.col("name").alias("neighbor_name"))
    found = store.edges.where(F.col(here) == F.lit(at).cast("long"))
    return found.join(other, F.col(there) == F.col("neighbor_id")).select("id", "type", "weight", "provenance", "neighbor_id", "neighbor_label", "neighbor_name")


def get_node(store: GraphStore, node: int | str) -> DataFrame:
    """The node, personal properties redacted."""
    at = node_id(store, node)
    return store.nodes.where(F.col("id") == F.lit(at).cast("long")).withColumn("properties", redact_properties(F.col("properties")))


def explain_neighbors(store: GraphStore, node: int | str, limit: int = 20) -> DataFrame:
    """Up to limit edges out and in, by edge id."""
    limit = limited(limit, 50)
    sides = [node_edges(store, node, d).withColumn("direction", F.lit(d)).orderBy("id").limit(limit) for d in ("out", "in")]
    return sides[0].unionAll(sides[1])


def explain_inner_edges(store: GraphStore, node: int | str, limit: int = 20) -> DataFrame:
    """The edges among the explained neighbours."""
    near = explain_neighbors(store, node, limit).select(F.col("neighbor_id").alias("n")).distinct()
    inner = store.edges.join(F.broadcast(near), F.col("source_id") == F.col("n"), "left_semi")  # at most twice the limit
    return inner.join(F.broadcast(near), F.col("target_id") == F.col("n"), "left_semi").select("id", "source_id", "target_id", "type")


def explain_summary(store: GraphStore, node: int | str) -> str:
    """A sentence on the node: what it is, how many edges lead out and in, and of which types most."""
    at = node_id(store, node)
    me = store.nodes.where(F.col("id") == at).select("label", "name").first()
    if me is None:
        raise ValueError("no node has this id")
    sides = []
    for here, word in (("source_id", "out"), ("target_id", "in")):
        by = counts_by(store.edges.where(F.col(here) == at), "type").orderBy(F.desc("n"), "type").collect()  # one row a type
        sides.append(f"{sum(r['n'] for r in by)} {word}" + (f" (most {by[0]['type']})" if by else ""))
    return f"{me['name']} is a {me['label']} with edges: {', '.join(sides)}."


def table_exists(store: GraphStore, name: str) -> bool:
    """Whether the graph has a table of this name with rows in it."""
    return name in store.views() and not store.views()[name].isEmpty()


def catalog(store: GraphStore) -> DataFrame:
    """table, column, type of every column of the graph's tables."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in store.views().items() for f in df.schema.fields]
    return store.nodes.sparkSession.createDataFrame(rows, "table string, column string, type string")


def what_if_isolated(store: GraphStore, node: int | str) -> DataFrame:
    """id, label, name of the neighbours that have no edge but to the node."""
    at = node_id(store, node)
    e = store.edges
    touching = e.where((F.col("source_id") == at) | (F.col("target_id") == at))
    near = touching.select(F.when(F.col("source_id") == at, F.col("target_id")).otherwise(F.col("source_id")).alias("id")).where(F.col("id") != at).distinct()
    others = e.where((F.col("source_id") != at) & (F.col("target_id") != at))
    still = others.select(F.col("source_id").alias("id")).unionAll(others.select("target_id"))
    return near.join(still, "id", "left_anti").join(store.nodes.select("id", "label", "name"), "id")


def what_if_remove(store: GraphStore, node: int | str) -> DataFrame:
    """One row: edges_lost (a loop once), neighbors, isolated, risk."""
    at = node_id(store, node)
    lost = store.edges.where((F.col("source_id") == at) | (F.col("target_id") == at))
    other = F.when(F.col("source_id") == at, F.col("target_id")).otherwise(F.col("source_id"))
    one = lost.agg(F.count(F.lit(1)).alias("edges_lost"), F.count_distinct(F.when(other != at, other)).alias("neighbors"))
    two = what_if_isolated(store, node).agg(F.count(F.lit(1)).alias("isolated"))
    risk = F.when((F.col("isolated") > 5) | (F.col("edges_lost") > 10), "high").when((F.col("isolated") > 0) | (F.col("edges_lost") > 0), "medium").otherwise("low")
    return one.join(two).withColumn("risk", risk)


def community_after_removal(store: GraphStore, node: int | str) -> DataFrame:
    """community_id, algorithm, size_before, size_after of the node's communities."""
    at = node_id(store, node)
    mine = store.communities.where(F.col("node_id") == at).select("community_id", "algorithm")
    sizes = store.communities.join(mine, ["community_id", "algorithm"], "left_semi").groupBy("community_id", "algorithm").agg(F.count(F.lit(1)).alias("size_before"))
    return sizes.withColumn("size_after", F.col("size_before") - 1)


def impact_summary(store: GraphStore, edge_type: str, end: str) -> DataFrame:
    """label, n of the nodes at that end of the edges of the type."""
    found = store.edges.where(F.col("type") == edge_type)
    return counts_by(found.join(store.nodes.select("id", "label"), found[f"{end}_id"] == store.nodes["id"]), "label")


def impact_summary_nodes(store: GraphStore, edge_type: str) -> DataFrame:
    """One row: the number of edges of the type, and of distinct nodes at their ends."""
    found = store.edges.where(F.col("type") == edge_type)
    nodes = found.select(F.col("source_id").alias("id")).union(found.select("target_id")).agg(F.count_distinct("id").alias("nodes"))
    return found.agg(F.count(F.lit(1)).alias("edges")).join(nodes)


def orphan_nodes(store: GraphStore, edges: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge touches."""
    e = store.edges if edges is None else edges
    touched = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return store.nodes.join(touched, "id", "left_anti").select("id", "label", "name", "qualified_name", "provenance")


def ambiguous_edges(store: GraphStore) -> DataFrame:
    found = ends(store.edges.where(F.col("provenance") == "AMBIGUOUS"), store.nodes, "label", "name")
    return found.select("id", "type", "provenance", "weight", "source_label", "source_name", "target_label", "target_name")


def integrity(store: GraphStore) -> DataFrame:
    """check, n: edges without a source, without a target, repeated (source, target, type) and qualified names, and
    values that are not allowed."""

    def count(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")

    ids = store.nodes.select(F.col("id").alias("node"))

    def missing(name: str, end: str) -> DataFrame:
        by = store.edges.groupBy(end).agg(F.count(F.lit(1)).alias("k"))  # edges meet the nodes as one row an end
        lost = by.join(ids, F.col(end) == F.col("node"), "left_anti").agg(F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("n"))
        return lost.select(F.lit(name).alias("check"), "n")

    checks = [
        missing("missing_source", "source_id"),
        missing("missing_target", "target_id"),
        count("repeated_edge", store.edges.groupBy("source_id", "target_id", "type").count().where("count > 1")),
        count("repeated_name", store.nodes.where("qualified_name is not null").groupBy("qualified_name").count().where("count > 1")),
        count("unknown_label", store.nodes.where(~allowed(F.col("label"), schema.LABELS))),
        count("unknown_type", store.edges.where(~allowed(F.col("type"), schema.EDGE_TYPES))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


def allowed(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def cross_label_edges(store: GraphStore, limit: int | None = 10) -> DataFrame:
    """Edges between nodes of different labels, by id."""
    found = ends(store.edges, store.nodes, "label", "name").where("source_label != target_label")
    found = found.select("id", "type", "source_label", "source_name", "target_label", "target_name")
    return found if limit is None else found.orderBy("id").limit(limit)
