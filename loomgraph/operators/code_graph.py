"""Queries over code graphs: calls, imports, cycles, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import components
from loomgraph.operators.lookup import limited, node_id
from loomgraph.operators.strong import shortest_cycles, strong_components
from loomgraph.operators.traverse import cycles, impact
from loomgraph.store import GraphStore, settled


def functions_of(store: GraphStore, project: int | str | None) -> DataFrame | None:
    """The functions that the node defines: a file's, or those of all files that a project contains."""
    if project is None:
        return None
    at = node_id(store, project)
    defines = store.edges.where("type = 'DEFINES_FUNC'")
    files = store.edges.where("type = 'CONTAINS'").where(F.col("source_id") == at).select(F.col("target_id").alias("file"))
    files = files.unionAll(store.nodes.where(F.col("id") == at).select(F.col("id").alias("file")))
    return defines.join(files, F.col("source_id") == F.col("file"), "left_semi").select(F.col("target_id").alias("function")).distinct()


def call_graph(store: GraphStore, direction: str = "out", project: int | str | None = None) -> DataFrame:
    """id, others: of each function the sorted functions that it calls (out) or that call it (in)."""
    here, there = ("source_id", "target_id") if direction == "out" else ("target_id", "source_id")
    calls = store.edges.where("type = 'CALLS_FUNC'")
    mine = functions_of(store, project)
    if mine is not None:
        calls = calls.join(mine, calls[here] == mine["function"], "left_semi")
    return calls.groupBy(F.col(here).alias("id")).agg(F.array_sort(F.collect_set(there)).alias("others"))


def import_graph(store: GraphStore, project: int | str | None = None) -> DataFrame:
    """file, modules: of each file its imports as (module, names), by module."""
    imports = store.edges.where("type = 'IMPORTS_FROM'")
    if project is not None:
        files = store.edges.where("type = 'CONTAINS'").where(F.col("source_id") == node_id(store, project)).select(F.col("target_id").alias("file"))
        imports = imports.join(files, F.col("source_id") == F.col("file"), "left_semi")
    names = F.coalesce(F.from_json(F.get_json_object("properties", "$.names"), "array<string>"), F.array().cast("array<string>"))
    modules = store.nodes.select(F.col("id").alias("module_id"), F.col("name").alias("module"))
    rows = imports.join(modules, imports["target_id"] == modules["module_id"]).select(F.col("source_id").alias("file"), F.struct("module", names.alias("names")).alias("m"))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("modules"))


def file_links(store: GraphStore, mode: str = "co_import", module_path: Column | None = None) -> DataFrame:
    """src, dst: co_import: files that import one module, both ways; resolved: a file and the file that its module is,
    where module_path, an expression over the module's name, gives the file's name."""
    imports = store.edges.where("type = 'IMPORTS_FROM'")
    if mode == "co_import":
        a = imports.select(F.col("source_id").alias("src"), F.col("target_id").alias("module"))
        b = imports.select(F.col("source_id").alias("dst"), F.col("target_id").alias("module"))
        return a.join(b, "module").where("src != dst").select("src", "dst").distinct()
    if mode != "resolved":
        raise ValueError("mode is co_import or resolved")
    path = F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".py")) if module_path is None else module_path
    modules = store.nodes.where("label = 'Import'").select(F.col("id").alias("module"), path.alias("path"))
    files = store.nodes.where("label = 'File'").select(F.col("id").alias("dst"), F.col("name").alias("path"))
    resolved = modules.join(files, "path").select("module", "dst")
    return imports.join(resolved, imports["target_id"] == resolved["module"]).select(F.col("source_id").alias("src"), "dst").where("src != dst").distinct()


def circular_imports(store: GraphStore, max_depth: int = 10, mode: str = "co_import") -> DataFrame:
    """cycle: the node sets of import cycles of 2 to max_depth files."""
    if not 2 <= max_depth <= 20:
        raise ValueError("max_depth is 2 to 20")
    if mode == "co_import" and max_depth == 2:
        pairs = co_import_pairs(store.edges.where("type = 'IMPORTS_FROM'").select(F.col("source_id").alias("file"), F.col("target_id").alias("module")))
        return pairs.select(F.array("a", "b").alias("cycle"))
    return cycles(file_links(store, mode), max_depth)


def co_import_pairs(imports: DataFrame, parts: int = 128) -> DataFrame:
    """a, b: each two files (a < b) that import one module (file, module), once.

    Files with the same modules are a class. Classes that share a module are found over one row a class and module; their members
    are then paired without a row a shared module and without making pairs distinct. A class's members are dealt into parts, each of which meets all
    of the other class, so that no class is one task's work.
    """
    lists = imports.where("file is not null and module is not null").groupBy("file").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    lists = settled(lists, "imports")  # a file's own imports
    classes = lists.groupBy("modules").agg(F.min("file").alias("class"))
    members = settled(lists.join(classes, "modules").select("file", "class"), "members")
    rows = settled(classes.select("class", F.explode("modules").alias("module")), "class-modules")
    met = rows.join(rows.select(F.col("class").alias("other"), "module"), "module").where("class <= other").select("class", "other").distinct()
    part = F.pmod(F.xxhash64("file"), F.lit(parts))
    left = met.join(members, "class").select("class", "other", F.col("file").alias("x"), part.alias("part"))
    right = members.select(F.col("class").alias("other"), F.col("file").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    # few bytes make many pairs, so adaptive execution may not put parts together
    left, right = (rows.repartition(2 * parts, "other", "part") for rows in (left, right))
    met = left.join(right, ["other", "part"]).where("class != other or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def import_links(store: GraphStore, mode: str = "co_import", module_path: Column | None = None) -> DataFrame:
    """src, dst: the imports as links of files and modules, a row each and never a pair of files. co_import: both ways between a file and
    what it imports; resolved: from a file to what it imports, and from that to the file that it is. Modules are nodes as
    -1 - id, so that they differ from all files."""
    imports = store.edges.where("type = 'IMPORTS_FROM'").select(F.col("source_id").alias("file"), (-1 - F.col("target_id")).alias("module"))
    if mode == "co_import":
        ways = F.array(F.struct(F.col("file").alias("src"), F.col("module").alias("dst")), F.struct(F.col("module").alias("src"), F.col("file").alias("dst")))
        return imports.select(F.inline(ways)).distinct()
    if mode != "resolved":
        raise ValueError("mode is co_import or resolved")
    path = F.concat(F.replace(F.col("name"), F.lit("."), F.lit("/")), F.lit(".py")) if module_path is None else module_path
    modules = store.nodes.where("label = 'Import'").select((-1 - F.col("id")).alias("src"), path.alias("path"))
    files = store.nodes.where("label = 'File'").select(F.col("id").alias("dst"), F.col("name").alias("path"))
    return imports.select(F.col("file").alias("src"), F.col("module").alias("dst")).unionAll(modules.join(files, "path").select("src", "dst")).distinct()


def import_components(store: GraphStore, mode: str = "co_import", module_path: Column | None = None) -> DataFrame:
    """file, component, files: of every file in an import cycle its strong component (the smallest file) and how many files that has.
    A module that all files import is one node with a link each."""
    links = import_links(store, mode, module_path)
    if mode == "co_import":  # both ways, so connected is strongly connected
        found = components(links.where("src >= 0"), "src", "dst").select("node", "component")
    else:
        found = strong_components(links).select("node", "component")
    files = found.where("node >= 0")
    by = files.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("files")).where("files > 1")
    return files.join(by, "component").select(F.col("node").alias("file"), F.col("least").alias("component"), "files")


def import_cycles(store: GraphStore, max_depth: int = 10, mode: str = "resolved", limit: int = 50, module_path: Column | None = None) -> DataFrame:
    """component, files, cycle: for up to `limit` files, those of the smallest ids of the cycles' components, a shortest cycle of 2 to
    max_depth files that the file is on. Each cycle is given once, by its smallest such file; components are whole however large."""
    if not 2 <= max_depth <= 20:
        raise ValueError("max_depth is 2 to 20")
    parts = settled(import_components(store, mode, module_path), "import-components")
    starts = parts.orderBy("component", "file").limit(limited(limit, 1000)).select(F.col("file").alias("node"))
    links = import_links(store, mode, module_path)
    mine = parts.select(F.col("file").alias("f"), F.col("component").alias("c"))
    inside = links.where("src >= 0").join(mine, F.col("src") == F.col("f"), "left_semi")
    into = links.where("src < 0").join(mine, F.col("dst") == F.col("f"), "left_semi")
    if mode == "co_import":
        walks = co_import_cycles(inside, starts)
    else:  # a step goes from a file over a module to another file
        walks = shortest_cycles([settled(inside, "imports"), settled(into, "modules")], starts, max_depth)
    files = walks.select("start", "cycle")
    once = files.groupBy(F.array_sort("cycle").alias("nodes")).agg(F.min_by("cycle", "start").alias("cycle"), F.min("start").alias("start"))
    return once.join(parts, F.col("start") == F.col("file")).select("component", "files", "cycle")


def co_import_cycles(links: DataFrame, starts: DataFrame) -> DataFrame:
    """start, cycle: two files that import one module are a cycle; of each start with the smallest other such file. Of a module only its
    two smallest files are needed."""
    links = settled(links, "co-imports")
    small = links.groupBy("dst").agg(F.min("src").alias("one"))
    second = links.join(small, "dst").where("src != one").groupBy("dst").agg(F.min("src").alias("two"))
    near = links.join(starts, F.col("src") == F.col("node"), "left_semi").join(small, "dst").join(second, "dst")
    other = F.when(F.col("src") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    best = near.groupBy(F.col("src").alias("start")).agg(F.min(other).alias("other"))
    return best.select("start", F.array("start", "other").alias("cycle"))


def code_impact(store: GraphStore, function: int | str, max_depth: int = 3) -> DataFrame:
    """The functions within max_depth calls of the function, either way."""
    at = node_id(store, function)
    if store.nodes.where((F.col("id") == F.lit(at).cast("long")) & (F.col("label") == "Function")).isEmpty():
        raise ValueError("no such function")
    return impact(store, at, max_depth, "both", "CALLS_FUNC")
