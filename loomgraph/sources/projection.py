"""A star schema's tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import qualified
from loomgraph.store import GraphStore

HUB = ("Organization", "Department", "Tag", "Company")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provenance(key: Column) -> Column:
    return F.when(key % 25 == 0, "AMBIGUOUS").when(key % 10 == 0, "INFERRED").otherwise("EXTRACTED")


def brand_number(brand: Column) -> Column:
    return F.regexp_extract(brand, "([0-9]+)", 1).cast("long")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(df: DataFrame, first: int, key: Column, label: str, name: Column, source: str, named: Column | None = None, properties: Column | None = None) -> DataFrame:
        return df.select(
            (F.lit(first) + key).cast("long").alias("id"),
            F.lit(label).alias("label"),
            name.alias("name"),
            qualified(F.lit(label), name if named is None else named, ascii_only=True).alias("qualified_name"),
            (F.lit("{}") if properties is None else properties).alias("properties"),
            provenance(key).alias("provenance"),
            F.lit(source).alias("source"),
        )

    customer = table(spark, sf_dir, "customer")
    segment = F.concat(F.lit('{"mktsegment":"'), "c_mktsegment", F.lit('"}'))
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return (
        kind(table(spark, sf_dir, "region"), 1, F.col("r_regionkey"), "Organization", F.col("r_name"), "region")
        .unionAll(kind(table(spark, sf_dir, "nation"), 1000, F.col("n_nationkey"), "Department", F.col("n_name"), "nation"))
        .unionAll(kind(brands, 5000, brand_number(F.col("p_brand")), "Tag", F.col("p_brand"), "part"))
        .unionAll(kind(table(spark, sf_dir, "supplier"), 100_000, F.col("s_suppkey"), "Company", F.col("s_name"), "supplier"))
        .unionAll(kind(customer, 1_000_000, F.col("c_custkey"), "Customer", F.col("c_name"), "customer", properties=segment))
        .unionAll(kind(table(spark, sf_dir, "part"), 10_000_000, F.col("p_partkey"), "Product", F.col("p_name"), "part", named=F.concat_ws("-", "p_name", "p_partkey")))
        .unionAll(kind(table(spark, sf_dir, "orders"), 100_000_000, F.col("o_orderkey"), "Deal", F.concat(F.lit("order "), F.col("o_orderkey")), "orders"))
    )


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows of a table as it lies in its files, by the columns, in numbers of parts that grow with the files, so that what a task holds
    does not: a part has about an eighth of what is read at once."""
    return rows.repartition(8 * rows.rdd.getNumPartitions(), *by)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(df: DataFrame, edge_id: Column, source: Column, target: Column, name: str, key: Column, weight: Column | None = None) -> DataFrame:
        return df.select(
            edge_id.cast("long").alias("id"),
            source.cast("long").alias("source_id"),
            target.cast("long").alias("target_id"),
            F.lit(name).alias("type"),
            F.lit("{}").alias("properties"),
            provenance(key).alias("provenance"),
            (F.lit(1.0) if weight is None else weight).alias("weight"),
        )

    c, big = F.col, 10**12
    lines = table(spark, sf_dir, "lineitem")
    # nearly all pairs of order and part are of one line, so they are not grouped before they are dealt
    about = dealt(lines.select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    # a supplier sells few brands, so pairs are made distinct after the parts are joined
    sells = dealt(lines.select("l_suppkey", "l_partkey"), "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    sells = sells.select("l_suppkey", brand_number(c("p_brand")).alias("brand")).distinct()
    return (
        kind(table(spark, sf_dir, "nation"), c("n_nationkey") + big, 1000 + c("n_nationkey"), 1 + c("n_regionkey"), "part_of", c("n_nationkey"))
        .unionAll(kind(table(spark, sf_dir, "supplier"), c("s_suppkey") + 2 * big, 100_000 + c("s_suppkey"), 1000 + c("s_nationkey"), "belongs_to", c("s_suppkey")))
        .unionAll(kind(table(spark, sf_dir, "customer"), c("c_custkey") + 3 * big, 1_000_000 + c("c_custkey"), 1000 + c("c_nationkey"), "belongs_to", c("c_custkey")))
        .unionAll(kind(table(spark, sf_dir, "orders"), c("o_orderkey") + 4 * big, 100_000_000 + c("o_orderkey"), 1_000_000 + c("o_custkey"), "proposed_to", c("o_orderkey")))
        .unionAll(kind(sells, c("l_suppkey") * 1000 + c("brand") + 5 * big, 100_000 + c("l_suppkey"), 5000 + c("brand"), "related_to", c("l_suppkey") + c("brand")))
        .unionAll(kind(about, F.lit(10**16) + c("l_orderkey") * 10**8 + c("l_partkey"), 100_000_000 + c("l_orderkey"), 10_000_000 + c("l_partkey"), "about", c("l_orderkey") + c("l_partkey"), c("weight")))
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the spans of users' traces; each span's parent is the one before."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        before.cast("string").alias("parent_id"),
        F.col("event_type").alias("tool"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("ts").alias("timestamp"),
    )


def core(spark: SparkSession, sf_dir: str) -> GraphStore:
    return GraphStore.of(spark, nodes=nodes(spark, sf_dir), edges=edges(spark, sf_dir))


def hub(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Regions, nations, brands and suppliers, and the edges among them."""
    few = nodes(spark, sf_dir).where(F.col("label").isin(*HUB))
    among = edges(spark, sf_dir).where("type in ('part_of', 'related_to') or type = 'belongs_to' and source_id < 1000000")
    return GraphStore.of(spark, nodes=few, edges=among)


def telemetry(spark: SparkSession, sf_dir: str) -> GraphStore:
    return GraphStore.of(spark, telemetry_spans=spans(spark, sf_dir))


def code(spark: SparkSession, sf_dir: str) -> GraphStore:
    """A code graph: nations as projects, suppliers as files, brands as imports, parts as functions, which call each
    other in the order of an order's lines."""
    from pyspark.sql import Window

    def relabel(df: DataFrame) -> DataFrame:
        names = {"Department": "Project", "Company": "File", "Tag": "Import", "Product": "Function"}
        label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        return df.where(F.col("label").isin(*names)).withColumn("label", label[F.col("label")])

    lines = table(spark, sf_dir, "lineitem")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    calls = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").select(F.col("l_partkey").alias("a"), following.alias("b")).where("a != b")
    calls = calls.repartition(8 * lines.rdd.getNumPartitions(), "a", "b").distinct()
    e = edges(spark, sf_dir)
    contains = e.where("type = 'belongs_to' and source_id < 1000000").select(F.col("id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("CONTAINS").alias("type"))
    imports = e.where("type = 'related_to'").select("id", "source_id", "target_id", F.lit("IMPORTS_FROM").alias("type"), F.concat(F.lit('{"names":["n'), F.col("target_id"), F.lit('"]}')).alias("properties"))
    defines = lines.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct().select(
        (F.lit(6 * 10**12) + F.col("s") * 10**8 + F.col("p")).alias("id"), (100_000 + F.col("s")).alias("source_id"), (10_000_000 + F.col("p")).alias("target_id"), F.lit("DEFINES_FUNC").alias("type")
    )
    calls = calls.select((F.lit(10**17) + F.col("a") * 10**8 + F.col("b")).alias("id"), (10_000_000 + F.col("a")).alias("source_id"), (10_000_000 + F.col("b")).alias("target_id"), F.lit("CALLS_FUNC").alias("type"))
    every = contains.unionByName(imports, allowMissingColumns=True).unionByName(defines, allowMissingColumns=True).unionByName(calls, allowMissingColumns=True)
    return GraphStore.of(spark, nodes=relabel(nodes(spark, sf_dir)), edges=every)
