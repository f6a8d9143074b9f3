"""Python source trees as code graphs: files are parsed in tasks, the graph is merged as batches."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomgraph.functions.text import last_segment
from loomgraph.operators.mutate import add_edges, add_nodes
from loomgraph.sources.files import below
from loomgraph.store import GraphStore, settled

FACTS = "path string, kind string, name string, owner string, line int, names array<string>"


class Facts(ast.NodeVisitor):
    """What a file defines, imports and calls."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.functions: list[str] = []
        self.classes: list[str] = []

    def function(self, node):
        self.rows.append(("function", node.name, self.classes[-1] if self.classes else None, node.lineno, [a.arg for a in node.args.args]))
        self.functions.append(node.name)
        self.generic_visit(node)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node):
        self.rows.append(("class", node.name, None, node.lineno, [ast.unparse(b) for b in node.bases]))
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_Import(self, node):
        for a in node.names:
            self.rows.append(("import", a.name, None, node.lineno, []))

    def visit_ImportFrom(self, node):
        self.rows.append(("import", node.module or "", None, node.lineno, [a.name for a in node.names]))

    def visit_Call(self, node):
        if self.functions:
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                self.rows.append(("call", name, self.functions[-1], node.lineno, []))
        self.generic_visit(node)


def source_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("__pycache__", ".git", "node_modules", ".venv")) -> DataFrame:
    """path (below root), text of every .py file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").format("binaryFile").load(root)
    path = below(root)
    files = files.select(path.alias("path"), F.col("content"))
    for part in exclude:
        files = files.where(~F.concat(F.lit("/"), "path").contains(f"/{part}/"))
    return files


def facts_of(path: str, content: bytes) -> list[tuple]:
    """The facts of a file, first that it is there; one that is no Python gives a row of kind `unparsed`."""
    facts = Facts()
    try:
        facts.visit(ast.parse((content or b"").decode("utf-8", "replace")))
    except (SyntaxError, ValueError, RecursionError):
        facts.rows = [("unparsed", path, None, 0, [])]
    return [(path, "file", path, None, 0, []), *((path, *r) for r in facts.rows)]


def parse(files: DataFrame) -> DataFrame:
    """The facts of every file (path, content)."""

    def work(frames):
        for pdf in frames:
            rows = [r for path, content in zip(pdf.path, pdf.content) for r in facts_of(path, content)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "owner", "line", "names"])

    return files.mapInPandas(work, FACTS)


class ParsePython:
    """A table function: the facts of the file that its arguments, or a row of its table argument, give as path and content."""

    def eval(self, path, content=None):
        if isinstance(path, Row):
            path, content = path["path"], path["content"]
        yield from facts_of(path, bytes(content or b""))


def register_parse(spark: SparkSession, name: str = "parse_python") -> None:
    """parse_python for the session's SQL: `FROM files, LATERAL parse_python(path, content)` beside each file's columns, or
    `FROM parse_python(TABLE(files) PARTITION BY path)`, which deals the files out by their paths first."""
    spark.udtf.register(name, udtf(ParsePython, returnType=FACTS))


def scan(store: GraphStore, root: str, project: str, max_files: int | None = None) -> tuple[GraphStore, DataFrame]:
    """The store with the tree's project, files, functions, classes and imports and their edges; and the facts. What the
    graph has stays as it is. A call is an edge to the functions of its name, in the same file if it defines
    one, else to the one of the smallest qualified name."""
    spark = store.nodes.sparkSession
    files = source_files(spark, root)
    if max_files is not None:
        files = files.orderBy("path").limit(max_files)
    facts = settled(parse(files), "facts")
    lower = F.lit(project.lower())
    at = F.replace("path", F.lit("/"), F.lit(":"))
    file_name = F.concat_ws(":", F.lit("file"), lower, at)
    function_name = F.concat_ws(":", F.lit("func"), lower, at, F.col("name"))
    class_name = F.concat_ws(":", F.lit("class"), lower, at, F.col("name"))
    module_name = F.concat(F.lit("import:"), F.col("name"))

    def kind(name: str, label: str, q) -> DataFrame:
        line = F.concat(F.lit('{"lineno":'), F.min("line"), F.lit("}"))
        rows = facts.where(F.col("kind") == name).select(F.lit(label).alias("label"), "name", q.alias("qualified_name"), "line")
        return rows.groupBy("label", "name", "qualified_name").agg(line.alias("properties"))

    first = spark.createDataFrame([("Project", project, f"project:{project.lower()}", "{}")], "label string, name string, qualified_name string, properties string")
    nodes = first.unionAll(kind("file", "File", file_name)).unionAll(kind("function", "Function", function_name)).unionAll(kind("class", "Class", class_name)).unionAll(kind("import", "Import", module_name))
    nodes = nodes.where("name != ''").withColumn("source", F.lit("scan")).withColumn("nth", F.xxhash64("qualified_name"))
    store, _ = add_nodes(store, nodes, most=None)

    def edge(name: str, source, target, type_: str, properties=None, provenance: str = "EXTRACTED") -> DataFrame:
        return facts.where(F.col("kind") == name).where("name != ''").select(source.alias("source"), target.alias("target"), F.lit(type_).alias("type"), (F.lit("{}") if properties is None else properties).alias("properties"), F.lit(provenance).alias("provenance"))

    names = F.concat(F.lit('{"names":'), F.to_json("names"), F.lit("}"))
    edges = edge("file", F.concat(F.lit("project:"), lower), file_name, "CONTAINS")
    edges = edges.unionAll(edge("function", file_name, function_name, "DEFINES_FUNC")).unionAll(edge("class", file_name, class_name, "DEFINES_CLASS"))
    edges = edges.unionAll(edge("import", file_name, module_name, "IMPORTS_FROM", names))
    functions = facts.where("kind = 'function'").select("path", "name", function_name.alias("callee")).distinct()
    anywhere = functions.groupBy("name").agg(F.min("callee").alias("anywhere"))
    calls = facts.where("kind = 'call'").select("path", F.col("name"), F.concat_ws(":", F.lit("func"), lower, at, F.col("owner")).alias("source")).distinct()
    calls = calls.join(functions, ["path", "name"], "left").join(anywhere, "name", "left").select("source", F.coalesce("callee", "anywhere").alias("target")).where("target is not null and source != target")
    edges = edges.unionAll(calls.select("source", "target", F.lit("CALLS_FUNC").alias("type"), F.lit("{}").alias("properties"), F.lit("EXTRACTED").alias("provenance")))
    classes = facts.where("kind = 'class'")
    by_name = classes.select(F.col("name").alias("base"), class_name.alias("target")).groupBy("base").agg(F.min("target").alias("target"))
    bases = classes.select(class_name.alias("source"), F.explode("names").alias("base")).select("source", last_segment(F.col("base")).alias("base")).join(by_name, "base")
    edges = edges.unionAll(bases.where("source != target").select("source", "target", F.lit("INHERITS_FROM").alias("type"), F.lit("{}").alias("properties"), F.lit("INFERRED").alias("provenance")))
    edges = edges.withColumn("nth", F.xxhash64("source", "target", "type"))
    store, _ = add_edges(store, edges, most=None)
    return store, facts
