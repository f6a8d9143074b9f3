"""Operators on a graph of five nodes with answers worked out by hand, and on random graphs against plain Python."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.ordering import numbered_rows, running_sum
from loomgraph.operators import centrality, code_graph, export, lookup, mutate, telemetry, traverse
from loomgraph.plans import gate
from loomgraph.sources import code, files
from loomgraph.store import GraphStore
from loomgraph.streaming import spans as streams

NOW = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(1, "Customer", "Acme Corp"), (2, "Product", "Plano Enterprise"), (3, "Ticket", "TKT-0001"), (4, "Article", "Guia de Migracao"), (5, "Agent", "Ana")]
    n = spark.createDataFrame(nodes, "id long, label string, name string")
    n = n.withColumn("qualified_name", text.qualified(F.col("label"), F.col("name"))).withColumn("properties", F.lit("{}")).withColumn("provenance", F.lit("EXTRACTED"))
    edges = [(1, 1, 2, "bought", "EXTRACTED"), (2, 1, 3, "complained_about", "EXTRACTED"), (3, 3, 5, "assigned_to", "EXTRACTED"), (4, 4, 2, "about", "INFERRED")]
    e = spark.createDataFrame(edges, "id long, source_id long, target_id long, type string, provenance string").withColumn("weight", F.lit(1.0))
    return GraphStore.of(spark, nodes=n, edges=e)


def pairs(df, *columns):
    return {tuple(r) if len(columns) != 2 else (r[0], r[1]) for r in df.select(*columns).collect()}


def test_centrality(small):
    assert pairs(centrality.degree_centrality(small), "id", "score") == {(4, 0.25), (5, 0.25), (2, 0.5), (1, 0.5), (3, 0.5)}
    assert pairs(centrality.closeness(small), "id", "score") == {(4, 0.4), (2, 0.5714), (1, 0.6667), (3, 0.5714), (5, 0.4)}
    assert pairs(centrality.betweenness(small), "id", "score") == {(1, 1.3333), (2, 1.0), (3, 1.0), (4, 0.0), (5, 0.0)}
    near = {1: {2, 3}, 2: {1, 4}, 3: {1, 5}, 4: {2}, 5: {3}}
    for rounds in (1, 6, 100):
        rank = {v: 0.2 for v in near}
        for _ in range(rounds):
            new = {v: 0.03 + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
            change, rank = sum(abs(new[v] - rank[v]) for v in near), new
            if change < 1e-6:
                break
        assert dict(pairs(centrality.pagerank(small, rounds=rounds), "id", "score")) == pytest.approx(rank, abs=1e-6)


def test_walks(small):
    assert traverse.shortest_path(small, 1, 5) == [1, 3, 5]
    assert traverse.shortest_path(small, "article:guia-de-migracao", 5) == [4, 2, 1, 3, 5]
    assert traverse.shortest_path(small, 999, 999) == [999]
    assert traverse.shortest_path(small, 1, 999) is None
    assert pairs(traverse.impact(small, 1, 2), "id", "depth") == {(2, 1), (3, 1), (4, 2), (5, 2)}
    assert pairs(traverse.impact(small, 1, 3, "out"), "id", "depth") == {(2, 1), (3, 1), (5, 2)}
    assert [r["path"] for r in traverse.simple_paths(small, 4, 5).collect()] == [[4, 2, 1, 3, 5]]
    with pytest.raises(ValueError):
        traverse.impact(small, 1, 0)


def test_removal(small):
    one = lookup.what_if_remove(small, 1).first()
    assert (one["edges_lost"], one["isolated"], one["risk"]) == (2, 0, "medium")
    three = lookup.what_if_remove(small, 3).first()
    assert (three["edges_lost"], three["isolated"], three["risk"]) == (2, 1, "medium")
    assert pairs(lookup.what_if_isolated(small, 3), "id", "name") == {(5, "Ana")}


def test_search(small):
    assert lookup.search(small, "acme").count() == 1
    assert lookup.search(small, "acm").count() == 0
    assert lookup.search(small, ".*").count() == 5
    assert lookup.search(small, '.*"; DROP TABLE nodes;--').count() == 0
    assert lookup.search(small, "customer acme", "Product").count() == 0
    with pytest.raises(ValueError):
        lookup.search(small, "x", limit=-1)


def test_text(spark):
    names = ["São João Ñ Ü", "Straße", "Þór", "  ", "a__b", None]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", text.normalize_name(F.col("n")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == ["sao-joao-n-u", "stra-e", "or", "node", "a-b", None]
    one = spark.createDataFrame([('{"email": "a@b.co", "note": "write joão@x.com"}', '{"Email": "x", "mrr": 5000, "tags": [1, "a"], "ok": true, "n": null}')], "a string, b string")
    r = one.select(text.redact_text(F.col("a")).alias("a"), text.redact_properties(F.col("b")).alias("b"), text.safe_error(F.lit("no /etc/x, y")).alias("c")).first()
    assert r["a"] == '{"email":"[REDACTED]", "note": "write [EMAIL]"}'
    assert r["b"] == '{"Email":"[REDACTED]","mrr":5000,"tags":[1,"a"],"ok":true,"n":null}'
    assert r["c"] == "no [PATH], y"


@pytest.mark.parametrize(
    "query",
    [
        "SELECT * FROM sqlite_master", "INSERT INTO nodes VALUES (1)", "PRAGMA x", "SELECT * FROM other", "SELECT id FROM nodes UNION SELECT id FROM edges", "SELECT id FROM nodes, secret",
        "SELECT id FROM nodes WHERE id IN (SELECT source_id FROM edges)", "SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM edges)", "SELECT (\n SELECT max(id) FROM edges) FROM nodes", "", "SELECT", "WITH a AS (SELECT 1) SELECT * FROM a",
        "SELECT * FROM parquet.`/etc`", "SELECT * FROM range(3)", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM nodes", "SELECT id FROM nodes ORDER BY java_method('java.lang.System', 'nanoTime')",
        "SELECT label, count(*) FROM nodes GROUP BY label HAVING max(try_reflect('a', 'b')) > 1", "SELECT /*" + "x" * 10_000 + "*/ 1",
    ],
)
def test_gate_refuses(small, query):
    with pytest.raises(ValueError):
        gate.query(small, query)


def test_gate(small):
    assert gate.query(small, "SELECT n.name, e.updated FROM nodes n JOIN (SELECT source_id, count(*) AS updated FROM edges GROUP BY source_id) e ON n.id = e.source_id").count() == 3
    spark = small.nodes.sparkSession
    spark.range(3).createOrReplaceTempView("nodes")
    assert gate.query(small, "SELECT normalize_name(name) AS n, redact('a@b.co') AS r FROM nodes ORDER BY id").first() == ("acme-corp", "[EMAIL]")
    assert spark.table("nodes").count() == 3 and not spark.catalog.tableExists("edges")
    spark.catalog.dropTempView("nodes")
    with pytest.raises(ValueError):
        gate.query(small, "SELECT updated_at FROM nodes", strict=True)
    with pytest.raises(ValueError):
        gate.query(small, "SELECT 1 AS x FROM nodes", limit=10_001)


def test_merges(spark, small):
    items = spark.createDataFrame(
        [(1, "Product", "New"), (2, "Product", "New"), (3, "Customer", "Acme Corp"), (4, "Nothing", "x"), (5, "Product", " "), (6, "Product", "y" * 513)], "nth int, label string, name string"
    )
    new, result = mutate.add_nodes(small, items, NOW)
    assert [(r["status"], r["id"]) for r in result.orderBy("nth").collect()] == [("created", 6), ("already_exists", 6), ("already_exists", 1), ("error", None), ("error", None), ("error", None)]
    assert new.nodes.count() == 6 and new.audit_log.count() == 1
    up, result = mutate.upsert_nodes(new, spark.createDataFrame([(1, "Product", "New", "INFERRED"), (2, "Agent", "Bo", "EXTRACTED")], "nth int, label string, name string, provenance string"), NOW)
    assert [(r["status"], r["id"]) for r in result.orderBy("nth").collect()] == [("updated", 6), ("created", 7)]
    edges = spark.createDataFrame(
        [(1, "1", "product:new", "bought", 2.0), (2, "1", "6", "bought", 3.0), (3, "1", "2", "bought", 7.0), (4, "x", "1", "bought", 1.0), (5, "1", "2", "hates", 1.0), (6, "1", "2", "about", -1.0), (7, "1", "99", "about", 1.0)],
        "nth int, source string, target string, type string, weight double",
    )
    linked, result = mutate.add_edges(up, edges, NOW)
    status = {r["nth"]: (r["status"], r["id"]) for r in result.collect()}
    assert status[1] == status[2] == ("created", 5) and status[3] == ("updated", 1) and all(status[k][0] == "error" for k in (4, 5, 6, 7))
    assert pairs(linked.edges.where("id in (1, 5)"), "id", "weight") == {(1, 7.0), (5, 3.0)}
    members = mutate.set_communities(linked, spark.createDataFrame([(1, 4, 0), (1, 5, 1), (3, 5, 0)], "node_id long, community_id long, nth int"), NOW)
    assert pairs(members.communities, "node_id", "community_id") == {(1, 5), (3, 5)}
    with pytest.raises(ValueError):
        mutate.set_communities(linked, spark.createDataFrame([(0, 4)], "node_id long, community_id long"), NOW)
    gone, result = mutate.delete_nodes(members, spark.createDataFrame([(1,), (77,)], "id long"), NOW)
    assert pairs(result, "id", "deleted") == {(1, 1), (77, 0)}
    assert gone.nodes.count() == 6 and gone.edges.count() == 2 and gone.communities.count() == 1
    assert {r["event"] for r in gone.audit_log.collect()} == {"node_create", "node_update", "edge_upsert", "community_set", "node_delete"}


def test_batch_limit(spark, small):
    with pytest.raises(ValueError):
        mutate.add_nodes(small, spark.range(10_001).selectExpr("id AS nth", "'Tag' AS label", "cast(id AS string) AS name"), NOW)
    new, result = mutate.add_nodes(small, spark.range(0).selectExpr("id AS nth", "'Tag' AS label", "cast(id AS string) AS name"), NOW)
    assert result.count() == 0 and new.nodes.count() == 5


def random_graph(spark, seed, n=14, m=18):
    r = random.Random(seed)
    links = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))}
    nodes = spark.createDataFrame([(k, "Tag", str(k)) for k in range(n)], "id long, label string, name string")
    edges = spark.createDataFrame([(k, a, b, "about") for k, (a, b) in enumerate(sorted(links))], "id long, source_id long, target_id long, type string")
    near = {k: set() for k in range(n)}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return GraphStore.of(spark, nodes=nodes, edges=edges), near


def test_random_graphs(spark):
    store, near = random_graph(spark, 3)
    reach = {}
    for s in near:
        reach[s], layer = {s: 0}, [s]
        while layer:
            layer = sorted({v for u in layer for v in near[u]} - reach[s].keys())
            reach[s].update({v: max(reach[s].values()) + 1 for v in layer})
    assert pairs(traverse.hops(store, 0), "id", "hops") == set(reach[0].items())
    parts = {min(r) for r in reach.values()}
    number = {p: k for k, p in enumerate(sorted(parts))}
    assert pairs(centrality.connected_components(store), "node_id", "community_id") == {(s, number[min(r)]) for s, r in reach.items()}
    paths = {p for k in range(1, 6) for p in itertools.permutations(near, k) if p[0] == 0 and p[-1] == max(reach[0]) and all(b in near[a] for a, b in zip(p, p[1:]))}
    got = traverse.simple_paths(store, 0, max(reach[0]), None, 4).collect()
    assert {tuple(r["path"]) for r in got} == paths
    walk = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long")
    rings = {tuple(sorted(p)) for k in range(2, 5) for p in itertools.permutations(near, k) if all(b in near[a] for a, b in zip(p, p[1:] + p[:1]))}
    assert {tuple(r["cycle"]) for r in traverse.cycles(walk, 4).collect()} == rings


def test_louvain(spark):
    clique = [(a, b) for a in range(5) for b in range(a)] + [(a, b) for a in range(5, 10) for b in range(5, a)] + [(0, 9)]
    nodes = spark.createDataFrame([(k, "Tag", str(k)) for k in range(11)], "id long, label string, name string")
    edges = spark.createDataFrame([(k, a, b, "about") for k, (a, b) in enumerate(clique)], "id long, source_id long, target_id long, type string")
    found = dict(pairs(centrality.louvain(GraphStore.of(spark, nodes=nodes, edges=edges), strict=True), "node_id", "community_id"))
    assert len({found[k] for k in range(5)}) == 1 and len({found[k] for k in range(5, 10)}) == 1 and len(set(found.values())) == 3


def moved_in_rounds(near: dict[int, set[int]], passes: int, strict: bool) -> dict[int, int]:
    """The rounds of louvain's docstring in plain Python."""
    home, m, still = {v: v for v in near}, sum(map(len, near.values())) / 2, 0
    for r in range(passes):
        total, members = Counter(), Counter(home.values())
        for v, c in home.items():
            total[c] += len(near[v])
        new = dict(home)
        for v in near:
            if (v + r) % 2:
                continue
            old, k = home[v], len(near[v])
            into = Counter(home[u] for u in near[v])

            def gain(c: int) -> float:
                return into[c] - (total[c] - (k if c == old else 0)) * k / (2 * m)

            options = [(gain(c), -c) for c in into if c != old and not (members[c] == 1 and members[old] == 1 and c > old)]
            if options and max(options)[0] > (gain(old) if strict else 0) + 1e-12:
                new[v] = -max(options)[1]
        still, home = still + 1 if new == home else 0, new
        if still == 2:
            break
    least = {}
    for v in sorted(home):
        least.setdefault(home[v], v)
    return {v: least[home[v]] for v in home}


@pytest.mark.parametrize("strict", [True, False])
def test_louvain_rounds(spark, strict):
    r = random.Random(3)
    links = {tuple(sorted(r.sample(range(30), 2))) for _ in range(60)} | {(a, b) for g in (40, 50) for a in range(g, g + 6) for b in range(g, a)} | {(45, 50)}
    nodes = spark.createDataFrame([(k, "Tag", str(k)) for k in range(60)], "id long, label string, name string")
    edges = spark.createDataFrame([(k, a, b, "about") for k, (a, b) in enumerate(sorted(links))], "id long, source_id long, target_id long, type string")
    near = {v: {b if a == v else a for a, b in links if v in (a, b)} for v in sorted({x for e in links for x in e})}
    least = moved_in_rounds(near, 12, strict) | {v: v for v in range(60) if v not in near}
    number = {v: k for k, v in enumerate(sorted(set(least.values())))}
    got = dict(pairs(centrality.louvain(GraphStore.of(spark, nodes=nodes, edges=edges), passes=12, strict=strict), "node_id", "community_id"))
    assert got == {v: number[c] for v, c in least.items()}

    def modularity(home: dict[int, int]) -> float:
        m, inside, degree = len(links), Counter(home[a] for a, b in links if home[a] == home[b]), Counter()
        for v in near:
            degree[home[v]] += len(near[v])
        return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)

    assert modularity(got) > (0.4 if strict else 0.2) > modularity({v: v for v in near})


def test_numbers_over_ranges(spark):
    values = [(k * 37 % 101, k) for k in range(500)]
    df = spark.createDataFrame(values, "a long, b long").repartition(7)
    expected = {v: k + 1 for k, v in enumerate(sorted(values))}
    assert {(r["a"], r["b"]): r["nth"] for r in numbered_rows(df, "nth", "a", "b").collect()} == expected
    sums = {r["a"]: r["upto"] for r in running_sum(df.groupBy("a").count(), F.col("count"), "upto", "a").collect()}
    assert sums == {a: sum(x <= a for x, _ in values) for a in {x for x, _ in values}}
    assert numbered_rows(df.limit(0), "nth", "a").count() == 0


def test_replay_rings(spark):
    """Spans that are each other's parents, and others that hang on them."""
    rows = [("t", "1", "2"), ("t", "2", "3"), ("t", "3", "1"), ("t", "4", "3"), ("t", "5", "4"), ("t", "6", None), ("t", "7", "6"), ("t", "8", "8"), ("t", "9", "gone"), ("u", "1", None)]
    rows = [(k, *r, dt.datetime(2024, 1, 1, 0, 0, k)) for k, r in enumerate(rows)] + [(99, "t", "7", "9", dt.datetime(2024, 1, 2))]
    spans = spark.createDataFrame(rows, "id long, trace_id string, span_id string, parent_id string, timestamp timestamp")
    got = {r["span_id"]: (r["root"], r["depth"]) for r in telemetry.replay_tree(spans, "t").collect()}
    assert got == {"1": ("1", 0), "2": ("1", 2), "3": ("1", 1), "4": ("1", 2), "5": ("1", 3), "6": ("6", 0), "7": ("6", 1), "8": ("8", 0), "9": ("9", 0)}


def test_breaker_slices(spark):
    """Slices of a few seconds against one walk over each tool's calls."""
    r, rows, expected, state = random.Random(5), [], {}, {}
    for k in range(900):
        tool, at = r.choice("abc"), k * r.choice([1, 1, 1, 2])
        rows.append((tool, f"{k:04}", dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=at), r.random() < {"a": 0.95, "b": 0.6, "c": 0.2}[tool]))
    for tool, name, at, failed in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        state[tool], blocked, errors = streams.advance(state.get(tool, (0, 0.0)), at.timestamp(), failed)
        expected[name] = (blocked, errors)
    spans = spark.createDataFrame([(t, n, a, "boom" if f else None) for t, n, a, f in rows], "tool string, span_id string, timestamp timestamp, error string")
    for seconds in (7, 100, 86_400):
        assert {x["span_id"]: (x["blocked"], x["errors"]) for x in streams.breaker(spans, seconds).collect()} == expected
    as_of = dt.datetime(2024, 1, 1, 0, 10, tzinfo=dt.UTC)
    now = {}
    for tool, _, at, failed in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        if at <= as_of:
            now[tool], _, _ = streams.advance(now.get(tool, (0, 0.0)), at.timestamp(), failed)
    now = {t: 0 if as_of.timestamp() - first >= 60 else e for t, (e, first) in now.items()}
    assert {x["tool"]: (x["errors"], x["open"]) for x in streams.breaker_states(spans, as_of, 50).collect()} == {t: (e, e >= 5) for t, e in now.items()}


def test_empty(spark):
    store = GraphStore.of(spark)
    assert centrality.connected_components(store).count() == 0
    assert lookup.top_degree(store).count() == 0
    assert export.vis_nodes(store).count() == 0
    assert centrality.betweenness(store).count() == 0
    assert "0 nodes" in export.page(store)
    assert telemetry.health(store.telemetry_spans, NOW).first()["status"] == "healthy"


def test_breaker(spark):
    at = [0, 1, 2, 3, 4, 5, 59, 60, 61]
    rows = [("t", str(k), NOW + dt.timedelta(seconds=s), "bad" if k < 8 else None) for k, s in enumerate(at)] + [("u", "x", NOW, None)]
    spans = spark.createDataFrame(rows, "tool string, span_id string, timestamp timestamp, error string")
    got = {r["span_id"]: r["blocked"] for r in streams.breaker(spans).collect()}
    assert [got[str(k)] for k in range(9)] == [False] * 5 + [True, True, False, False] and not got["x"]


def test_breaker_stream(spark, tmp_path):
    rows = [("t", str(k), NOW + dt.timedelta(seconds=k), "bad") for k in range(7)]
    spans = spark.createDataFrame(rows, "tool string, span_id string, timestamp timestamp, error string")
    spans.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in"))
    q = streams.breaker_stream(stream).writeStream.format("memory").queryName("breaker_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["span_id"] for r in spark.table("breaker_out").where("blocked").collect()) == ["5", "6"]


def test_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nfrom pkg import b\n\nclass A(b.Base):\n    def run(self, x):\n        return helper(x)\n\ndef helper(x):\n    return x\n")
    (tmp_path / "pkg" / "b.py").write_text("class Base:\n    pass\n\ndef other():\n    return helper(1)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    store, facts = code.scan(GraphStore.of(spark), str(tmp_path), "Demo")
    assert facts.where("kind = 'unparsed'").count() == 1
    assert pairs(lookup.counts_by(store.nodes, "label"), "label", "n") == {("Project", 1), ("File", 3), ("Function", 3), ("Class", 2), ("Import", 2)}
    kinds = dict(pairs(lookup.counts_by(store.edges, "type"), "type", "n"))
    assert kinds == {"CONTAINS": 3, "DEFINES_FUNC": 3, "DEFINES_CLASS": 2, "IMPORTS_FROM": 2, "CALLS_FUNC": 2, "INHERITS_FROM": 1}
    again, _ = code.scan(store, str(tmp_path), "Demo")
    assert again.nodes.count() == store.nodes.count() and again.edges.count() == store.edges.count()
    assert code_graph.call_graph(store, "out", "project:demo").count() == 2
    assert code_graph.call_graph(store, "out", "file:demo:pkg:b.py").count() == 1


def test_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.py").write_text("1\n2\n")
    (tmp_path / "readme.md").write_text("hi\n")
    (tmp_path / "skip.bin").write_text("x")
    nodes, edges = files.tree(spark, str(tmp_path), "P")
    store, _ = mutate.add_nodes(GraphStore.of(spark), nodes, NOW, most=None)
    store, result = mutate.add_edges(store, edges, NOW, most=None)
    assert pairs(lookup.counts_by(store.nodes, "label"), "label", "n") == {("Project", 1), ("Folder", 2), ("Module", 1), ("Document", 1)}
    assert store.edges.count() == 4 and result.where("error is not null").count() == 0


def test_exports(spark, small, tmp_path):
    done = export.export_all(small, str(tmp_path / "out"), NOW)
    assert not [v for v in done.values() if v.startswith("failed")]
    back = GraphStore.load(spark, done["snapshot"], "20240501000000")
    assert back.nodes.count() == 5 and back.edges.count() == 4
    with pytest.raises(ValueError):
        export.page(small, most=4)
    inside = tmp_path / "base"
    inside.mkdir()
    (tmp_path / "base-other").mkdir()
    (inside / "link").symlink_to(tmp_path)
    assert export.allowed_path("x.md", str(inside), (".md",)).name == "x.md"
    for bad in ("/etc/cron.d/evil.html", "evil.sh", "/tmp/evil.md", str(tmp_path / "base-other" / "x.md"), "link/x.md", "../x.md"):
        with pytest.raises(ValueError):
            export.allowed_path(bad, str(inside), (".html", ".md"))
    old = ["20240301000000", "20240430010000", "20240430020000", "20240501000000"]
    assert export.expired(old, NOW) == ["20240301000000", "20240430010000"]


def test_snapshots_are_removed(spark, small, tmp_path):
    for v in ("20240101000000", "20240102000000", "20240501010000", "20240501020000"):
        GraphStore.of(spark).save(str(tmp_path / "s"), v)
    (tmp_path / "s" / "other").mkdir()
    assert export.remove_expired(spark, str(tmp_path / "s"), dt.datetime(2024, 5, 2)) == ["20240101000000", "20240102000000", "20240501010000"]
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["other", "version=20240501020000"]
    assert export.remove_expired(spark, str(tmp_path / "s"), dt.datetime(2030, 1, 1)) == [] == export.remove_expired(spark, str(tmp_path / "none"), NOW)


def test_explained_and_catalog(small):
    assert lookup.explain_summary(small, 1) == "Acme Corp is a Customer with edges: 2 out (most bought), 0 in."
    assert lookup.table_exists(small, "nodes") and not lookup.table_exists(small, "metadata") and not lookup.table_exists(small, "other")
    assert ("edges", "weight", "double") in pairs(lookup.catalog(small), "table", "column", "type")
    assert "Which products" in export.report(small, NOW)
    for call in (lambda: lookup.explain_summary(small, 77), lambda: lookup.get_node(small, "tag:none"), lambda: traverse.shortest_path(small, "tag:a", "tag:b")):
        with pytest.raises(ValueError):
            call()


def test_emitted_spans(spark):
    _, spans = telemetry.emitted(None, spark, "count", lambda: 3, "t", '{"email": "a@b.co"}')

    def fails():
        raise ValueError("no /etc/passwd for a@b.co")

    result, spans = telemetry.emitted(spans, spark, "read", fails, "t")
    rows = {r["tool"]: r for r in spans.collect()}
    assert result is None and rows["read"]["error"] == "no [PATH] for [EMAIL]" and rows["count"]["error"] is None
    assert rows["count"]["args_summary"] == '{"email":"[REDACTED]"}' and telemetry.replay_summary(spans, "t").first()["errors"] == 1


def test_health_with_breakers(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("t", str(k), "up" if k % 2 else "down", 5.0, None if k % 2 else "boom", at + dt.timedelta(seconds=k)) for k in range(12)] + [("t", f"x{k}", "up", 5.0, None, at + dt.timedelta(seconds=12)) for k in range(60)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, tool string, duration_ms double, error string, timestamp timestamp")
    r = telemetry.health_with_breakers(spans, at + dt.timedelta(seconds=13)).first()
    assert (r["n"], r["status"], r["open_breakers"]) == (72, "degraded", ["down"])
