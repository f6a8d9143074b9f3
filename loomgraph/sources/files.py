"""A directory tree as a graph of a project, folders and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The label of a file by the ending of its name.
LABEL_OF = {"py": "Module", "sql": "Module", "sh": "Module", "md": "Document", "txt": "Document", "json": "Config", "yml": "Config", "yaml": "Config", "toml": "Config", "html": "File", "csv": "File"}


def below(root: str) -> Column:
    """The column path of a file without its scheme and the folder root, which is text and no pattern."""
    whole = F.regexp_replace("path", "^[a-z]+:/*", "/")
    first = re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"
    return F.when(whole.startswith(first), F.substring(whole, len(first) + 1, 1 << 20)).otherwise(whole)


def tree(spark: SparkSession, root: str, project: str, max_depth: int = 3, ignore: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> tuple[DataFrame, DataFrame]:
    """Items for add_nodes and add_edges: project, folders and files down to max_depth, with sizes and line counts."""
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(root)
    path = below(root)
    lines = F.length(F.regexp_replace(F.decode(F.col("content"), "ISO-8859-1"), "[^\n]", ""))
    files = files.select(path.alias("path"), F.col("length").alias("size"), lines.alias("lines"))
    for part in ignore:
        files = files.where(~F.concat(F.lit("/"), "path", F.lit("/")).contains(f"/{part}/"))
    parts = F.split("path", "/")
    files = files.where(F.size(parts) <= max_depth + 1)
    label = F.create_map(*(F.lit(x) for kv in LABEL_OF.items() for x in kv))[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    files = files.withColumn("label", label).where("label is not null")
    slug = f"{project.lower()}:"
    folders = files.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).where(F.col("path") != "").distinct()
    named = lambda df, kind: df.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("qualified_name", F.concat(F.lit(kind + ":" + slug), F.replace("path", F.lit("/"), F.lit(":"))))
    first = spark.createDataFrame([("Project", project, f"project:{project.lower()}", "{}")], "label string, name string, qualified_name string, properties string")
    about = F.concat(F.lit('{"size":'), "size", F.lit(',"lines":'), "lines", F.lit("}"))
    f = named(files, "file").withColumn("properties", about)
    d = named(folders, "folder").withColumn("label", F.lit("Folder")).withColumn("properties", F.lit("{}"))
    columns = ["label", "name", "qualified_name", "properties"]
    nodes = first.unionAll(d.select(*columns)).unionAll(f.select(*columns)).withColumn("nth", F.xxhash64("qualified_name"))
    parent = F.regexp_replace("path", "/?[^/]+$", "")
    up = F.when(parent == "", F.lit(f"project:{project.lower()}")).otherwise(F.concat(F.lit("folder:" + slug), F.replace(parent, F.lit("/"), F.lit(":"))))
    edges = d.select(up.alias("source"), F.col("qualified_name").alias("target")).unionAll(f.select(up.alias("source"), F.col("qualified_name").alias("target")))
    return nodes, edges.withColumn("type", F.lit("CONTAINS")).withColumn("nth", F.xxhash64("target"))
