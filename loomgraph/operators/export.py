"""Exports: JSON, viewer data and page, report, snapshots."""

from __future__ import annotations

import datetime as dt
import html
import json
import pathlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import html_escape, redact_properties
from loomgraph.operators.centrality import community_sizes
from loomgraph.operators.lookup import counts_by, cross_label_edges, degrees, top_degree
from loomgraph.schema import LABELS
from loomgraph.store import GraphStore

PAGE_NODES, PAGE_EDGES = 5000, 50_000
#: A hue for each label, far from its neighbours' hues, in three shades.
COLORS = {label: f"hsl({k * 137 % 360}, 55%, {40 + k % 3 * 12}%)" for k, label in enumerate(LABELS)}
# The shape and dashes of each provenance.
SHAPES = {"EXTRACTED": "dot", "INFERRED": "triangle", "AMBIGUOUS": "diamond"}
DASHES = {"EXTRACTED": "false", "INFERRED": "[10,10]", "AMBIGUOUS": "[2,8]"}


def lookup(values: dict[str, str], column: str, other: str):
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col(column)], F.lit(other))


def export_json(store: GraphStore) -> tuple[DataFrame, DataFrame]:
    """Every node and every edge as a line of JSON, nothing redacted."""
    return tuple(df.select("id", F.to_json(F.struct(*df.columns)).alias("json")) for df in (store.nodes, store.edges))


def vis_nodes(store: GraphStore) -> DataFrame:
    """id, label, name, color, shape, size (15 and up to 25 more by the logarithm of the degree), degree, tooltip: label, name, provenance,
    source, communities by algorithm, degree and properties, personal ones redacted; all as HTML text."""
    degree = degrees(store.edges)
    most = degree.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("most"))
    n = store.nodes.join(degree, "id", "left").join(F.broadcast(most)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    size = F.round(15 + 25 * F.ln(F.col("degree") + 1.0) / F.greatest(F.ln(F.col("most") + 1.0), F.lit(1e-9)), 1)
    groups = store.communities.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "algorithm", "community_id"))), ", ").alias("groups"))  # one an algorithm
    n = n.join(groups, F.col("id") == F.col("node_id"), "left")
    about = [(word, F.col(c)) for word, c in (("provenance", "provenance"), ("source", "source"), ("community", "groups"), ("degree", "degree"))]
    lines = [F.concat_ws(": ", "label", "name"), *(F.when(c.isNotNull(), F.concat(F.lit(f"{word} "), c.cast("string"))) for word, c in about), F.coalesce(redact_properties(F.col("properties")), F.lit(""))]
    tip = F.concat_ws("\n", *(html_escape(x) for x in lines))
    return n.select("id", "label", "name", lookup(COLORS, "label", "hsl(0, 0%, 60%)").alias("color"), lookup(SHAPES, "provenance", "dot").alias("shape"), size.alias("size"), "degree", tip.alias("tooltip"))


def vis_edges(store: GraphStore, *more: str) -> DataFrame:
    """id, source_id, target_id, type, dashes, width (the weight, 1 to 4), and more columns of the edges."""
    width = F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.col("weight")))
    return store.edges.select("id", "source_id", "target_id", "type", lookup(DASHES, "provenance", "false").alias("dashes"), width.alias("width"), *more)


def density(store: GraphStore) -> DataFrame:
    n, e = store.nodes.agg(F.count(F.lit(1)).alias("nodes")), store.edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e).withColumn("density", F.round(2 * F.col("edges") / F.greatest(F.col("nodes"), F.lit(1)), 3))


def allowed_path(path: str, inside: str, endings: tuple[str, ...]) -> pathlib.Path:
    """path, if it lies inside the folder, with an ending that is allowed and no link on the way."""
    base, given = pathlib.Path(inside).resolve(), pathlib.Path(path)
    whole = given if given.is_absolute() else base / given
    if not whole.resolve().is_relative_to(base) or whole.suffix not in endings:
        raise ValueError("this output path is not allowed")
    step = base
    for part in whole.resolve().relative_to(base).parts:
        step = step / part
        if step.is_symlink():
            raise ValueError("this output path is not allowed")
    return whole.resolve()


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title>
<meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'nonce-{nonce}'; script-src 'nonce-{nonce}'">
<style nonce="{nonce}">body{{font:14px sans-serif;margin:1em}}canvas{{border:1px solid #ccc}}</style></head>
<body><h1>{title}</h1><p>{nodes} nodes, {edges} edges, density {density}</p>
<input id="find" placeholder="name"><select id="label"></select><select id="by"><option>community</option><option>label</option></select><select id="layout"><option>groups</option><option>circle</option><option>levels</option></select>
<select id="provenance"><option></option><option>EXTRACTED</option><option>INFERRED</option><option>AMBIGUOUS</option></select>
<canvas id="view" width="1000" height="700"></canvas><pre id="detail"></pre>
<script nonce="{nonce}">
const data = {data};
const byId = new Map(data.nodes.map((n, k) => [n.id, Object.assign(n, {{k}})]));
const el = x => document.getElementById(x), ctx = el("view").getContext("2d");
for (const l of ["", ...new Set(data.nodes.map(n => n.label))]) el("label").add(new Option(l, l));
function place() {{
  const key = n => el("by").value === "label" ? n.label : n.community ?? n.label, groups = [...new Set(data.nodes.map(key))];
  const layout = el("layout").value, all = data.nodes.length, rows = new Map();
  for (const n of data.nodes) {{
    if (layout === "circle") {{ n.x = 500 + 330 * Math.cos(n.k / all * 2 * Math.PI); n.y = 350 + 330 * Math.sin(n.k / all * 2 * Math.PI); continue; }}
    if (layout === "levels") {{
      const row = groups.indexOf(key(n)), nth = rows.get(row) ?? 0; rows.set(row, nth + 1);
      n.x = 20 + nth * 24 % 960; n.y = 30 + row * 640 / groups.length + Math.floor(nth / 40) * 6; continue;
    }}
    const g = groups.indexOf(key(n)) / groups.length * 2 * Math.PI, a = n.k * 2.4, r = 4 * Math.sqrt(n.k);
    n.x = 500 + 250 * Math.cos(g) + r * Math.cos(a); n.y = 350 + 220 * Math.sin(g) + r * Math.sin(a);
  }}
}}
function draw() {{
  place(); ctx.clearRect(0, 0, 1000, 700);
  const word = el("find").value.toLowerCase(), label = el("label").value;
  const shown = n => n.name.toLowerCase().includes(word) && (!label || n.label === label);
  for (const e of data.edges) {{
    const a = byId.get(e.source_id), b = byId.get(e.target_id);
    if (!a || !b || !shown(a) || !shown(b) || (el("provenance").value && e.provenance !== el("provenance").value)) continue;
    ctx.setLineDash(JSON.parse(e.dashes) || []); ctx.lineWidth = e.width / 4; ctx.strokeStyle = "#999";
    ctx.beginPath(); ctx.moveTo(a.x, a.y); ctx.lineTo(b.x, b.y); ctx.stroke();
  }}
  for (const n of data.nodes.filter(shown)) {{ ctx.fillStyle = n.color; ctx.beginPath(); ctx.arc(n.x, n.y, n.size / 5, 0, 7); ctx.fill(); }}
}}
for (const x of ["find", "label", "by", "layout", "provenance"]) el(x).addEventListener("input", draw);
el("view").addEventListener("click", m => {{
  const near = data.nodes.reduce((a, n) => Math.hypot(n.x - m.offsetX, n.y - m.offsetY) < Math.hypot(a.x - m.offsetX, a.y - m.offsetY) ? n : a);
  el("detail").textContent = new DOMParser().parseFromString(near.tooltip, "text/html").documentElement.textContent;
}});
draw();
</script></body></html>
"""


def page(store: GraphStore, title: str = "Graph", most: int = PAGE_NODES, most_edges: int = PAGE_EDGES) -> str:
    """The graph as one HTML file without anything from outside; more than most nodes or most_edges edges are refused."""
    import secrets

    totals = density(store).first()
    if totals["nodes"] > most:
        raise ValueError(f"a page shows {most} nodes at most; filter the graph first")
    if totals["edges"] > most_edges:
        raise ValueError(f"a page shows {most_edges} edges at most; filter the graph first")
    one = store.communities.withColumn("nth", F.row_number().over(Window.partitionBy("node_id").orderBy("algorithm"))).where("nth = 1")
    nodes = vis_nodes(store).join(one.select(F.col("node_id").alias("id"), F.col("community_id").alias("community")), "id", "left")
    data = {"nodes": [json.loads(x) for x in nodes.toJSON().collect()], "edges": [json.loads(x) for x in vis_edges(store, "provenance").toJSON().collect()]}
    text = json.dumps(data, ensure_ascii=False).replace("<", "\\u003C").replace(">", "\\u003E").replace("/", "\\/")
    return PAGE.format(title=html.escape(title), nonce=secrets.token_urlsafe(12), data=text, **totals.asDict())


def report(store: GraphStore, as_of: dt.datetime) -> str:
    """Markdown: totals, most connected nodes, edges across labels, communities, distributions, questions to ask."""
    totals = density(store).first()
    lines = ["# Graph report", "", f"{as_of:%Y-%m-%d %H:%M} UTC: {totals['nodes']} nodes, {totals['edges']} edges, density {totals['density']}", "", "## Most connected"]
    top = top_degree(store, 5).orderBy(F.desc("degree"), "id").collect()
    lines += [f"- {r['name']} ({r['label']}): {r['degree']}" for r in top]
    lines += ["", "## Across labels"] + [f"- {r['source_name']} {r['type']} {r['target_name']}" for r in cross_label_edges(store, 10).collect()]
    sizes = community_sizes(store.communities).orderBy(F.desc("size"), "community_id").limit(5).collect()
    lines += ["", "## Communities"] + [f"- {r['community_id']}: {r['size']}" for r in sizes]
    for title, df, column in (("Labels", store.nodes, "label"), ("Edge types", store.edges, "type"), ("Provenance", store.edges, "provenance")):
        lines += ["", f"## {title}"] + [f"- {r[column]}: {r['n']}" for r in counts_by(df, column).orderBy(F.desc("n"), column).collect()]
    lines += ["", "## Questions"] + [f"- {question(r['label'], r['name'])}" for r in top]
    return "\n".join(lines) + "\n"


def export_all(store: GraphStore, folder: str, as_of: dt.datetime) -> dict[str, str]:
    """Each artefact by itself: its path, or why it failed."""
    out = pathlib.Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    nodes, edges = export_json(store)
    made = {
        "graph.html": lambda p: p.write_text(page(store), encoding="utf-8"),
        "report.md": lambda p: p.write_text(report(store, as_of), encoding="utf-8"),
        "nodes.json": lambda p: nodes.select("json").write.text(str(p)),
        "edges.json": lambda p: edges.select("json").write.text(str(p)),
        "communities.json": lambda p: community_sizes(store.communities).write.json(str(p)),
        "snapshot": lambda p: store.save(str(p), f"{as_of:%Y%m%d%H%M%S}"),
    }
    results = {}
    for name, write in made.items():
        try:
            write(out / name)
            results[name] = str(out / name)
        except Exception as e:  # noqa: BLE001  one artefact must not keep the others from being made
            results[name] = f"failed: {type(e).__name__}"
    return results


#: What to ask about the most connected nodes, by their labels; others are asked what depends on them.
QUESTIONS = {
    ("Customer", "Company", "Organization", "Lead", "Contact", "Person"): "Which products, tickets and deals hang on {}?",
    ("Product", "Service", "Contract", "Deal", "Opportunity"): "Who would be hit by a change of {}, and how soon?",
    ("Ticket", "Issue", "Feedback"): "What do the customers behind {} have in common?",
    ("Agent", "Department", "Channel"): "What would stop without {}?",
    ("Article", "Topic", "Keyword", "Document", "Note", "Tag"): "What is about {}, and is it up to date?",
    ("Project", "Module", "Folder", "File", "Config"): "Which files would have to change with {}?",
    ("Function", "Class", "Import", "Variable", "Decorator"): "Which callers would break if {} changed?",
}


def question(label: str, name: str) -> str:
    return next((q for labels, q in QUESTIONS.items() if label in labels), "What depends on {}, and what happens without it?").format(name)


def remove_expired(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    """Removes the snapshots under path that have expired and returns their versions; the newest always stays."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    versions = sorted(n.removeprefix("version=") for n in names if re.fullmatch(r"version=\d{14}", n))
    gone = [v for v in expired(versions, as_of, days) if v != versions[-1]]
    for v in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)
    return gone


def expired(versions: list[str], as_of: dt.datetime, days: int = 30) -> list[str]:
    """The snapshots to remove: those older than so many days, and of each day all but the last."""
    stamp = {v: dt.datetime.strptime(v, "%Y%m%d%H%M%S") for v in versions}
    last: dict[dt.date, str] = {}
    for v in sorted(versions):
        last[stamp[v].date()] = v
    return sorted(v for v in versions if stamp[v] < as_of - dt.timedelta(days=days) or last[stamp[v].date()] != v)
