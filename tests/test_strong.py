"""Components, cycles, paths, centrality, replay, parsing and redaction against plain Python."""

import datetime as dt
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import apart, blocks, centrality, code_graph, export, lookup, strong, telemetry, traverse
from loomgraph.operators.traverse import steps
from loomgraph.sources import code, files
from loomgraph.store import GraphStore


def graph(r, n, m):
    return {(r.randrange(n), r.randrange(n)) for _ in range(m)}


def reachable(links, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in links:
            if a == todo[-1] and b not in seen:
                break
        else:
            todo.pop()
            continue
        seen.add(b)
        todo.append(b)
    return seen


def strong_parts(links):
    nodes = {x for e in links for x in e}
    to = {v: reachable(links, v) for v in nodes}
    parts = {v: frozenset({w for w in to[v] if v in to[w]} | {v}) for v in nodes}
    return {v: (min(p), len(p)) for v, p in parts.items() if len(p) > 1}


@pytest.mark.parametrize("seed, n, m", [(1, 30, 45), (3, 12, 40)])
def test_strong_components(spark, seed, n, m):
    links = graph(random.Random(seed), n, m)
    df = spark.createDataFrame([*links, (None, 1), (2, None), next(iter(links))], "src long, dst long")
    got = {r["node"]: (r["component"], r["size"]) for r in strong.strong_components(df).collect()}
    assert got == strong_parts(links)


def test_strong_cases(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert strong.strong_components(none).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(3, 3)], "src long, dst long")
    assert strong.strong_components(chain).count() == 0
    ring = spark.createDataFrame([(k, (k + 1) % 9) for k in range(9)] + [(20, 0), (8, 30), (30, 31), (31, 30)], "src long, dst long")
    got = {r["node"]: r["component"] for r in strong.strong_components(ring).collect()}
    assert got == {**{k: 0 for k in range(9)}, 30: 30, 31: 30}


def shortest(links, start, most, least):
    """The length of a shortest cycle through start."""
    frontier, seen = {(start,)}, {start}
    for length in range(1, most + 1):
        if length >= least and any((p[-1], start) in links for p in frontier):
            return length
        frontier = {p + (b,) for p in frontier for a, b in links if a == p[-1] and b not in p}
        best = {}
        for p in sorted(frontier):
            best.setdefault(p[-1], p)
        frontier = {p for v, p in best.items() if v not in seen}
        seen |= {p[-1] for p in frontier}
    return None


def test_shortest_cycles(spark):
    links = {(a, b) for a, b in graph(random.Random(7), 25, 50) if a != b}
    df = spark.createDataFrame(sorted(links), "src long, dst long")
    starts = spark.createDataFrame([(k,) for k in range(25)], "node long")
    got = {r["start"]: r for r in strong.shortest_cycles([df], starts, 10).collect()}
    expected = {v: c for v in range(25) if (c := shortest(links, v, 10, 2))}
    assert {v: r["length"] for v, r in got.items()} == expected
    for v, r in got.items():
        assert r["cycle"][0] == v and len(set(r["cycle"])) == r["length"] and all(e in links for e in zip(r["cycle"], r["cycle"][1:] + [v]))


def code_store(spark, imports, files):
    names = {k: f"m{k}.py" for k in range(files)}
    modules = sorted({m for _, m in imports})
    nodes = [(k, "File", n) for k, n in names.items()] + [(10_000 + m, "Import", f"m{m}") for m in modules]
    edges = [(n, f, 10_000 + m, "IMPORTS_FROM") for n, (f, m) in enumerate(sorted(imports))]
    return GraphStore.of(spark, nodes=spark.createDataFrame(nodes, "id long, label string, name string"), edges=spark.createDataFrame(edges, "id long, source_id long, target_id long, type string"))


def test_resolved_imports(spark):
    """Files that import files: m3 is the module of m3.py, m77 of none; files may import themselves."""
    r = random.Random(9)
    imports = {(r.randrange(30), r.choice([r.randrange(30), 77])) for _ in range(55)} | {(k, 77) for k in range(30)} | {(4, 4)}
    links = {(f, m) for f, m in imports if m != 77 and f != m}
    store = code_store(spark, imports, 30)
    got = {x["file"]: (x["component"], x["files"]) for x in code_graph.import_components(store, "resolved").collect()}
    assert got == strong_parts(links) and got
    cycles = code_graph.import_cycles(store, 10).collect()
    assert {min(c["cycle"]) in got for c in cycles} == {True}
    on = {f for c in cycles for f in c["cycle"]}
    assert {v for v in got if shortest(links, v, 10, 2)} == on
    for c in cycles:
        assert 2 <= len(c["cycle"]) <= 10 and all(e in links for e in zip(c["cycle"], c["cycle"][1:] + c["cycle"][:1])) and (c["component"], c["files"]) == got[c["cycle"][0]]
    assert len({frozenset(c["cycle"]) for c in cycles}) == len(cycles)
    assert code_graph.import_cycles(store, 2).count() == len({frozenset(e) for e in links if e[::-1] in links})


def test_module_that_all_import(spark):
    """A hub of all files: links by imports, not by pairs of files."""
    n = 3000
    store = code_store(spark, {(k, 1) for k in range(n)} | {(k, 2 + k % 7) for k in range(n)} | {(n, 99)}, n + 1)
    links = code_graph.import_links(store)
    assert links.count() == 2 * (2 * n + 1)
    parts = code_graph.import_components(store).collect()
    assert len(parts) == n and {(p["component"], p["files"]) for p in parts} == {(0, n)}
    cycles = code_graph.import_cycles(store, 10, "co_import", limit=20).collect()
    assert sorted(tuple(c["cycle"]) for c in cycles) == [(0, k) for k in range(1, 20)] or sorted(min(c["cycle"]) for c in cycles) == [0] * 19
    with pytest.raises(ValueError):
        code_graph.import_cycles(store, 1)


def brandes(nodes, links):
    near = {v: sorted({b for a, b in links if a == v and b != v} | {a for a, b in links if b == v and a != v}) for v in nodes}
    between, close = {v: 0.0 for v in nodes}, {}
    for s in nodes:
        depth, sigma, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], sigma[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
        far = sum(depth.values())
        close[s] = round((len(order) - 1) / far, 4) if far else 0.0
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
    pairs = max(1, (len(nodes) - 1) * (len(nodes) - 2) / 2)
    return {v: b / pairs for v, b in between.items()}, close


@pytest.mark.parametrize("seed, n, m", [(1, 90, 130), (2, 30, 20)])
def test_centralities(spark, seed, n, m):
    """Blocks of 64 sources, the path for graphs that tasks hold and the one for larger graphs."""
    links = graph(random.Random(seed), n, m)
    store = GraphStore.of(
        spark,
        nodes=spark.createDataFrame([(k,) for k in range(n)], "id long"),
        edges=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sorted(links))], "id long, source_id long, target_id long"),
    )
    between, close = brandes(range(n), links)
    for held in (10**6, 0):
        assert {r["id"]: r["score"] for r in centrality.closeness(store, words=1, held_steps=held).collect()} == pytest.approx(close, abs=1e-9)
        got = {r["id"]: r["score"] for r in centrality.betweenness(store, held_steps=held, pairs=60 * n).collect()}
        assert got == pytest.approx(between, abs=6e-5)


def test_layer_sums(monkeypatch):
    """Of every node how many sources reach it and how far they are, with more sources than two words a node hold at once."""
    monkeypatch.setattr(centrality, "HELD_WORDS", 2)
    monkeypatch.setattr(centrality, "ROWS", 7)
    r, n = random.Random(9), 400
    links = graph(r, n, 380) | {(0, v) for v in range(1, 60)}
    near = {v: sorted({b for a, b in links if a == v} | {a for a, b in links if b == v}) for v in range(n)}
    first = np.cumsum([0, *(len(near[v]) for v in range(n))])
    to, size = np.array([w for v in range(n) for w in near[v]], np.int32), np.array([r.choice((1, 1, 1, 4)) for _ in range(n)], float)
    sources, want = np.array(r.sample(range(n), 390)), np.zeros((n, 2))
    for s in map(int, sources):
        depth, order = {s: 0}, [s]
        for v in order:
            order += [w for w in near[v] if depth.setdefault(w, depth[v] + 1) == depth[v] + 1 and w not in order]
        for v, d in depth.items():
            want[v] += (size[s], d * size[s]) if v != s else ((size[s] - 1, 2 * (size[s] - 1)) if near[s] else (0, 0))
    assert (centrality.layer_sums(sources, first, to, size) == want).all()


def test_dependencies_together(monkeypatch):
    """Five sources at once, whose layers differ: as one by one, and a node of size 3 as three nodes of the same neighbours."""
    r, n = random.Random(10), 120
    links = {(a, b) for a, b in graph(r, n, 150) | {(0, v) for v in range(1, 50)} if a != b}
    near = {v: sorted({b for a, b in links if a == v} | {a for a, b in links if b == v}) for v in range(n)}
    first, to = np.cumsum([0, *(len(near[v]) for v in range(n))]), np.array([w for v in range(n) for w in near[v]], np.int32)
    size = np.array([3.0 if v % 10 == 3 else 1.0 for v in range(n)])
    more = {(v, k): v if k == 0 else n + 2 * v + k for v in range(n) for k in range(int(size[v]))}
    copies = {(more[a, i], more[b, j]) for a, b in links for i in range(int(size[a])) for j in range(int(size[b]))}
    between, _ = brandes(sorted(more.values()), copies)
    pairs = (len(more) - 1) * (len(more) - 2) / 2
    monkeypatch.setattr(centrality, "ROWS", 7)
    for at_once in (1, 5):
        monkeypatch.setattr(centrality, "HELD_SOURCES", at_once)
        assert centrality.dependencies(np.arange(n), first, to, size) == pytest.approx([between[v] * pairs for v in range(n)])


def bunches(r, count, each):
    """Steps of bunches of nodes (some of more pieces) that meet only in nodes 0 to 2."""
    links = set()
    for first in range(3, 3 + count * each, each):
        links |= {(first + r.randrange(each), first + r.randrange(each)) for _ in range(int(each * r.uniform(0.6, 1.6)))}
        links |= {(r.randrange(3), first + r.randrange(each)) for _ in range(each)}
    return links


@pytest.mark.parametrize("seed", range(6))
def test_parts_of_hubs(monkeypatch, seed):
    """Where three hubs part the graph, sources walk in their part alone; sums are those of walks through all of it, also where a way leaves a part and comes back."""
    monkeypatch.setattr(apart, "PAIRS", 10**9)
    r, n = random.Random(seed), 3 + 4 * 25 + 5
    links = bunches(r, 4, 25)
    near = {v: sorted({b for a, b in links if a == v != b} | {a for a, b in links if b == v != a}) for v in range(n)}
    first = np.cumsum([0, *(len(near[v]) for v in range(n))])
    to, size = np.array([w for v in range(n) for w in near[v]], np.int32), np.array([r.choice((1, 1, 1, 4)) for _ in range(n)], float)
    whole = apart.parted(first, to, size)
    assert max(len(x[0]) for x in whole["inner"]) <= n / 2
    got = apart.by_hubs(whole["far"], whole["hubs"], size)
    nodes = np.flatnonzero(whole["kind"] >= 0)
    sums, kind = apart.across(whole["kinds"], whole["weight"], 0, len(whole["kinds"]), 7, 11), whole["kind"][nodes]
    got[nodes] += sums.sum(axis=1)[kind] - sums[kind, whole["part"][nodes]]
    for nodes, *inner in whole["inner"]:
        got[nodes] += centrality.layer_sums(np.arange(len(nodes)), *inner)[: len(nodes)]
    assert (got == centrality.layer_sums(np.arange(n), first, to, size)).all()


def test_closeness_in_parts(spark, monkeypatch):
    monkeypatch.setattr(apart, "PAIRS", 10**9)
    links = bunches(random.Random(8), 3, 30)
    store = GraphStore.of(
        spark,
        nodes=spark.createDataFrame([(k,) for k in range(95)], "id long"),
        edges=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sorted(links))], "id long, source_id long, target_id long"),
    )
    whole = []
    monkeypatch.setattr(centrality, "parted", lambda *graph: whole.append(apart.parted(*graph)) or whole[-1])
    assert {r["id"]: r["score"] for r in centrality.closeness(store).collect()} == pytest.approx(brandes(range(95), links)[1], abs=1e-9)
    assert whole[0] is not None


def test_pagerank_rounds(spark):
    r = random.Random(3)
    links = [(k, a, b) for k, (a, b) in enumerate(sorted(graph(r, 40, 60)))]
    store = GraphStore.of(spark, nodes=spark.createDataFrame([(k,) for k in range(50)], "id long"), edges=spark.createDataFrame(links, "id long, source_id long, target_id long"))
    walk = {(a, b) for a, b in map(tuple, steps(store.edges).collect())}
    rank = {v: 1 / 50 for v in range(50)}
    out = {v: sum(a == v for a, _ in walk) for v in range(50)}
    for rounds in range(1, 101):
        loose = sum(rank[v] for v in rank if not out[v])
        new = {v: 0.15 / 50 + 0.85 * (sum(rank[a] / out[a] for a, b in walk if b == v) + loose / 50) for v in rank}
        change = sum(abs(new[v] - rank[v]) for v in rank)
        rank = new
        if rounds in (3, 10):
            assert {x["id"]: x["score"] for x in centrality.pagerank(store, rounds=rounds, at_once=4).collect()} == pytest.approx(rank, abs=1e-6)
        if change < 1e-6:
            break
    assert {x["id"]: x["score"] for x in centrality.pagerank(store).collect()} == pytest.approx(rank, abs=1e-6)


def test_pagerank_blocks(spark, monkeypatch):
    """A graph of many blocks, some of whose nodes no edge has and one of whose edges leads to no node; the rounds read packed blocks, not the steps."""
    monkeypatch.setattr(blocks, "BLOCK_STEPS", 9)
    links = sorted(graph(random.Random(4), 60, 90)) + [(3, 999)]
    store = GraphStore.of(spark, nodes=spark.createDataFrame([(k,) for k in range(66)], "id long"), edges=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(links)], "id long, source_id long, target_id long"))
    walk = {(a, b) for a, b in map(tuple, steps(store.edges).collect())}
    rank, out = dict.fromkeys(range(66), 1 / 66), {v: sum(a == v for a, _ in walk) for v in range(66)}
    for _ in range(6):
        loose = sum(rank[v] for v in rank if not out[v])
        rank = {v: 0.15 / 66 + 0.85 * (sum(rank[a] / out[a] for a, b in walk if b == v and a in rank) + loose / 66) for v in rank}
    assert blocks.blocks_of(len(walk)) > 10
    assert {x["id"]: x["score"] for x in centrality.pagerank(store, rounds=6, at_once=4).collect()} == pytest.approx(rank, abs=6e-7)


def test_pagerank_leaves_no_rounds(spark):
    """Of all rounds the disk keeps the last scores, and no shuffle of theirs; whether a job guessed the last round or went too far, the scores are that round's."""
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    kept = lambda: {p.name for p in folder.iterdir()}
    shuffles = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}
    links = [(k, a, b) for k, (a, b) in enumerate(sorted(graph(random.Random(5), 40, 60)))]
    store = GraphStore.of(spark, nodes=spark.createDataFrame([(k,) for k in range(44)], "id long"), edges=spark.createDataFrame(links, "id long, source_id long, target_id long"))
    results = []
    for at_once in (4, 20):
        tables, files = kept(), shuffles()
        ranks = centrality.pagerank(store, tolerance=0.05, at_once=at_once)
        left = [name for name in kept() - tables if not name.startswith((".", "ids", "linked", "reps", "plan"))]
        assert len(left) == 1 and left[0].startswith("scores")
        assert len(shuffles() - files) < 40
        results.append({x["id"]: x["score"] for x in ranks.collect()})
    assert results[0] == results[1]


@pytest.mark.parametrize("seed, n, m", [(1, 11, 20)])
def test_first_paths(spark, seed, n, m):
    links = graph(random.Random(seed), n, m)
    store = GraphStore.of(
        spark,
        nodes=spark.createDataFrame([(k,) for k in range(n)], "id long"),
        edges=spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sorted(links))], "id long, source_id long, target_id long"),
    )
    both = {(a, b) for a, b in links if a != b} | {(b, a) for a, b in links if a != b}
    todo, every = [[0]], []
    while todo:
        p = todo.pop()
        if p[-1] == n - 1:
            every.append((len(p) - 1, p))
        elif len(p) <= 6:
            todo += [[*p, b] for a, b in both if a == p[-1] and b not in p]
    every.sort()
    for k, chunk in ((3, 10_000), (10, 3)):
        assert [(r["hops"], r["path"]) for r in traverse.first_paths(store, 0, n - 1, k, 6, chunk).collect()] == every[:k]


def test_replay_nested(spark):
    """Trees of spans against recursion; rings, repeated ids and long chains."""
    rows = [("t", "1", "2"), ("t", "2", "3"), ("t", "3", "1"), ("t", "4", "3"), ("t", "5", "4"), ("t", "6", None), ("t", "7", "6"), ("t", "8", "8"), ("t", "9", "gone"), ("t", "10", "6"), ("u", "1", None), ("t", None, "6")]
    rows = [(k, *r, "tool", float(k), "é" if k == 3 else None, dt.datetime(2024, 1, 1, 0, 0, k)) for k, r in enumerate(rows)] + [(99, "t", "7", "9", "tool", 1.0, None, dt.datetime(2024, 1, 2))]
    rows += [(1000 + k, "c", f"c{k}", f"c{k - 1}" if k else None, "x", None, None, dt.datetime(2024, 1, 3)) for k in range(3000)]
    spans = spark.createDataFrame(rows, "id long, trace_id string, span_id string, parent_id string, tool string, duration_ms double, error string, timestamp timestamp")
    got = {(r["trace_id"], r["span_id"]): r for r in telemetry.replay_nested(spans).collect()}
    parent = {"1": None, "2": "3", "3": "1", "4": "3", "5": "4", "6": None, "7": "6", "8": None, "9": None, "10": "6"}

    def tree(s):
        n = {"1": 0, "2": 1, "3": 2, "4": 3, "5": 4, "6": 5, "7": 6, "8": 7, "9": 8, "10": 9}[s]
        below = sorted((c for c in parent if parent[c] == s), key=lambda c: rows[[r[2] for r in rows].index(c)][0])
        return {"span_id": s, "tool": "tool", "duration_ms": float(n)} | ({"error": "é"} if n == 3 else {}) | {"children": [tree(c) for c in below]}

    def way(s):
        return ([*way(parent[s])] if parent[s] else []) + [s]

    for s, p in parent.items():
        r = got["t", s]
        assert r["path"] == way(s) and r["depth"] == len(way(s)) - 1 and r["root"] == way(s)[0]
        assert (json.loads(r["tree"]) if p is None else r["tree"]) == (tree(s) if p is None else None)
    assert len(got) == len(parent) + 1 + 3000 and got["c", "c2999"]["depth"] == 2999 and got["c", "c0"]["tree"].count("children") == 3000
    one = {r["span_id"]: (r["root"], r["depth"]) for r in telemetry.replay_tree(spans, "t").collect()}
    assert one == {s: (got["t", s]["root"], got["t", s]["depth"]) for s in parent}


def test_parse_in_sql(spark):
    given = [("a.py", b"import os\nclass A(B.C):\n  def f(self, x): return g(x)\n"), ("b.py", b"def ("), ("c.py", b""), ("d.py", None), ("e.py", b"from . import (x, y)\ndef g(): os.f()\n" * 3)]
    df = spark.createDataFrame([(p, b, 1) for p, b in given], "path string, content binary, kind int")
    df.createOrReplaceTempView("source_files")
    code.register_parse(spark)
    expected = sorted(map(repr, code.parse(df).collect()))
    one = spark.sql("SELECT f.* FROM source_files s, LATERAL parse_python(s.path, s.content) f")
    two = spark.sql("SELECT * FROM parse_python(TABLE(SELECT path, content FROM source_files) PARTITION BY path)")
    assert sorted(map(repr, one.collect())) == expected == sorted(map(repr, two.collect()))


def test_redaction_of_all_keys(spark):
    texts = {
        """{"it's":1,"a.b":[1,{"email":"x"}],"c[0]":null,"$":"d","Email":"p@q.rs","phone":{"n":[5]},"big":12345678901234567890,"f":1.25,"t":true,"é\\"":"q"}""":
        """{"it's":1,"a.b":[1,{"email":"x"}],"c[0]":null,"$":"d","Email":"[REDACTED]","phone":"[REDACTED]","big":12345678901234567890,"f":1.25,"t":true,"é\\"":"q"}""",
        "{}": "{}", "[1]": "[1]", "7": "7", "": "", "no json": "no json", '{"token":"s", "token":"u"}': '{"token":"[REDACTED]", "token":"[REDACTED]"}', '{"cpf":"1",': '{"cpf":"[REDACTED]",',
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "id long, properties string")
    got = {r["id"]: r["p"] for r in df.select("id", text.redact_properties(F.col("properties")).alias("p")).collect()}
    assert got == {**dict(enumerate(texts.values())), 99: None}
    store = GraphStore.of(spark, nodes=df)
    assert export.vis_nodes(store).count() == len(texts) + 1 and lookup.get_node(store, 0).first()["properties"] == texts[next(iter(texts))]


def test_roots_are_no_patterns(spark, tmp_path):
    root = tmp_path / "c++ (x).d" / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "m.py").write_text("x = 1")
    assert [r["path"] for r in code.source_files(spark, str(root)).select("path").collect()] == ["pkg/m.py"]
    nodes, _ = files.tree(spark, str(root), "P")
    assert "file:p:pkg:m.py" in {r["qualified_name"] for r in nodes.collect()}


def test_community_after_removal(spark):
    store = GraphStore.of(spark, nodes=spark.createDataFrame([(1,), (2,)], "id long"), communities=spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (1, 6, "b"), (2, 7, "b")], "node_id long, community_id long, algorithm string"))
    got = {(r["algorithm"], r["community_id"]): (r["size_before"], r["size_after"]) for r in lookup.community_after_removal(store, 1).collect()}
    assert got == {("a", 5): (2, 1), ("b", 6): (1, 0)}


def test_tooltips_and_page_limits(spark):
    nodes = [(1, "Tag", "a<b", "EXTRACTED", "scan", '{"email":"x@y.zz"}'), (2, "Tag", "b", None, None, None)]
    members = [(1, 4, "louvain"), (1, 2, "components")]
    store = GraphStore.of(
        spark,
        nodes=spark.createDataFrame(nodes, "id long, label string, name string, provenance string, source string, properties string"),
        edges=spark.createDataFrame([(1, 1, 2, "about"), (2, 1, 2, "targets")], "id long, source_id long, target_id long, type string"),
        communities=spark.createDataFrame(members, "node_id long, community_id long, algorithm string"),
    )
    tips = {r["id"]: r["tooltip"] for r in export.vis_nodes(store).collect()}
    assert tips[1] == "Tag: a&lt;b\nprovenance EXTRACTED\nsource scan\ncommunity components 2, louvain 4\ndegree 2\n{&quot;email&quot;:&quot;[REDACTED]&quot;}"
    assert tips[2] == "Tag: b\ndegree 2\n"
    assert "x@y.zz" not in export.page(store)
    with pytest.raises(ValueError):
        export.page(store, most_edges=1)
    rows = spark.createDataFrame([("a.b.C", "</script>"), ("C", None)], "n string, s string")
    got = rows.select(text.last_segment(F.col("n")).alias("n"), text.script_escape(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("C", "\\u003C\\/script\\u003E"), ("C", None)]
