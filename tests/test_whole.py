"""Queries on tables where caps, pairs and copies would show, and the operators that came of it against plain Python."""

import random

import itertools
import random
from collections import Counter

import pytest
from oracle import TABLES, connect, rows

from loomgraph.operators import centrality, code_graph, lookup, ordering, traverse
from loomgraph.operators.twins import twins
from loomgraph.plans.queries import QUERIES, SQL
from loomgraph.sources import projection
from loomgraph.store import GraphStore

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_parts(tmp_path_factory):
    """The smallest tables, but with 12,000 parts that no line names, all of one name."""
    base = tmp_path_factory.mktemp("many")
    con = connect(SF)
    for t in TABLES:
        more = " UNION ALL SELECT * EXCLUDE i REPLACE (100000 + i AS p_partkey, 'red widget' AS p_name) FROM (SELECT * FROM part LIMIT 1), range(12000) r(i)" if t == "part" else ""
        con.execute(f"COPY (SELECT * FROM {t}{more}) TO '{base}/{t}.parquet' (FORMAT parquet)")
    return str(base)


@pytest.mark.parametrize("name", ["sql_except", "sql_fts"])
def test_gate_gives_all_rows(spark, many_parts, name):
    got, expected = QUERIES[name](spark, many_parts).toPandas(), connect(many_parts).execute(SQL[name]).df()
    assert len(expected) > 10_000 and rows(got) == rows(expected)


@pytest.fixture(scope="module")
def doubled(spark):
    """A random graph of which many nodes have copies with the same neighbours, and its neighbours in plain Python."""
    r = random.Random(5)
    links = {(a, b) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(11)) if a != b}
    copies = {k: [k, *range(20 + 10 * k, 20 + 10 * k + (0, 1, 3)[k % 3])] for k in range(9)}
    every = sorted({(x, y) for a, b in links for x in copies[a] for y in copies[b]} | {(200, 201), (202, 202)})
    nodes = spark.createDataFrame([(k, "Tag", str(k)) for k in [*itertools.chain(*copies.values()), 200, 201, 202]], "id long, label string, name string")
    edges = spark.createDataFrame([(k, a, b, "about") for k, (a, b) in enumerate(every)], "id long, source_id long, target_id long, type string")
    near = {n["id"]: set() for n in nodes.collect()}
    for a, b in every:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return GraphStore.of(spark, nodes=nodes, edges=edges), near


def reached(near, s):
    depth, ways, layer = {s: 0}, Counter({s: 1}), [s]
    while layer:
        after = Counter()
        for u in layer:
            for v in near[u]:
                if v not in depth:
                    after[v] += ways[u]
        depth.update({v: depth[layer[0]] + 1 for v in after})
        ways.update(after)
        layer = list(after)
    return depth, ways


def test_twins(spark, doubled):
    store, near = doubled
    of = {r["id"]: (r["rep"], r["size"]) for r in twins(traverse.steps(store.edges)).collect()}
    assert of.keys() == {v for v in near if near[v]}
    for v, (rep, size) in of.items():
        alike = [u for u in of if near[u] == near[v]]
        assert (rep, size) == (min(alike), len(alike))
    assert len({rep for rep, _ in of.values()}) < len(of) / 2
    assert {r["id"]: r["size"] for r in twins(traverse.steps(store.edges), tuple(of)).collect()} == dict.fromkeys(of, 1)


def test_centrality_with_twins(doubled):
    store, near = doubled
    reach = {s: reached(near, s) for s in near}
    close = {s: (len(d) - 1) / sum(d.values()) if len(d) > 1 else 0 for s, (d, _) in reach.items()}
    assert {r["id"]: r["score"] for r in centrality.closeness(store).collect()} == pytest.approx(close, abs=6e-5)
    n, between = len(near), dict.fromkeys(near, 0.0)
    for s, t in itertools.permutations(near, 2):
        (d, w), (e, u) = reach[s], reach[t]
        for v in d.keys() & e.keys() - {s, t}:
            if d[v] + e[v] == d[t]:
                between[v] += w[v] * u[v] / w[t]
    got = {r["id"]: r["score"] for r in centrality.betweenness(store).collect()}
    assert got == pytest.approx({v: b / ((n - 1) * (n - 2) / 2) for v, b in between.items()}, abs=6e-5)
    for rounds in (3, 100):
        rank = dict.fromkeys(near, 1 / n)
        for _ in range(rounds):
            loose = sum(rank[v] for v in near if not near[v])
            new = {v: (0.15 + 0.85 * loose) / n + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
            change, rank = sum(abs(new[v] - rank[v]) for v in near), new
            if change < 1e-6:
                break
        assert {r["id"]: r["score"] for r in centrality.pagerank(store, rounds=rounds).collect()} == pytest.approx(rank, abs=6e-7)


def test_paths_by_hops(doubled):
    store, _ = doubled
    for source, target, most in ((1, 8, 5), (30, 8, 4), (2, 40, 4), (7, 7, 3), (1, 201, 4)):
        paths = traverse.simple_paths(store, source, target, None, most).collect()
        got = {r["hops"]: r["n"] for r in traverse.simple_paths_by_hops(store, source, target, most).collect()}
        assert got == Counter(r["hops"] for r in paths)


def test_co_import_pairs(spark):
    r = random.Random(2)
    kinds = [r.sample(range(6), k) for k in (1, 1, 2, 2, 3)]
    imports = {(f, m) for f in range(40) for m in r.choice(kinds)} | {(50, 99), (51, None)}
    pairs = {(a, b) for (a, m), (b, n) in itertools.product(imports, imports) if m == n and m is not None and a < b}
    rows = spark.createDataFrame([*imports, *list(imports)[:30]], "file long, module long")
    got = [tuple(x) for x in code_graph.co_import_pairs(rows, 3).collect()]
    assert sorted(got) == sorted(pairs)
    store = GraphStore.of(spark, nodes=spark.createDataFrame([], "id long"), edges=rows.selectExpr("file as source_id", "module as target_id", "'IMPORTS_FROM' as type"))
    for most in (2, 3):
        cycles = [tuple(x["cycle"]) for x in code_graph.circular_imports(store, most).collect()]
        assert len(cycles) == len(set(cycles)) and {c for c in cycles if len(c) == 2} == pairs


def test_parts_grow_with_the_files(spark):
    """Lines are grouped in parts whose number follows the files, not a fixed setting."""
    plan = projection.edges(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    splits = spark.read.parquet(f"{SF}/lineitem.parquet").rdd.getNumPartitions()
    assert plan.count("RepartitionByExpression [l_orderkey") == 1 and f", {8 * splits}" in plan


def test_missing_ends(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 1, 9), (2, 1, 9), (3, 8, 2), (4, 1, 2), (5, None, 2)], "id long, source_id long, target_id long")
    got = {r["check"]: r["n"] for r in lookup.integrity(GraphStore.of(spark, nodes=nodes, edges=edges)).collect()}
    assert (got["missing_source"], got["missing_target"]) == (2, 2)
    assert lookup.integrity(GraphStore.of(spark)).where("n != 0").count() == 0


def test_components_in_parts(spark, monkeypatch):
    """Links of a node with many neighbours do not meet in one part, and parts grow with the links."""
    monkeypatch.setattr(ordering, "PART_ROWS", 40)
    monkeypatch.setattr(ordering, "MANY", 6)
    assert [ordering.parts_of(k) for k in (0, 40, 41, 400)] == [1, 1, 2, 10]
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(7, v) for v in range(0, 300, 9)] + [(301 + k, 300 + k) for k in range(20)]
    least = {v: v for v in range(330)}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    number = {p: k for k, p in enumerate(sorted(set(least.values())))}
    store = GraphStore.of(spark, nodes=spark.range(330), edges=spark.createDataFrame(links, "source_id long, target_id long"))
    assert {x["node_id"]: x["community_id"] for x in centrality.connected_components(store).collect()} == {v: number[p] for v, p in least.items()}
