"""The stored index against the scan, and the SQL gate's table for it."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.commits import Commits
from loomgraph.operators import fulltext, lookup, mutate
from loomgraph.operators.fulltext import TextIndex
from loomgraph.plans import gate
from loomgraph.store import GraphStore, settled

WORDS = ["red", "Blue", "gréen", "x1", "Zug", "日本", "a_b", "mail@host", "THE", "ß"]
PATTERNS = ["red", "the AND x1", "green zug", "nothing here", "日本", ".*", "zug red blue the"]
FEW = PATTERNS[:3]


def store_of(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(k * 37 - 5000, "Product", " ".join(r.choices(WORDS, k=r.randint(0, 6))), f"product:{k}", "{}" if k % 3 else '{"c":"%s"}' % r.choice(WORDS)) for k in range(n)]
    return GraphStore.of(spark, nodes=spark.createDataFrame(rows, "id long, label string, name string, qualified_name string, properties string"))


def same(index, store, patterns=PATTERNS):
    for p in patterns:
        expected = sorted(r["id"] for r in lookup.search(store, p, None, None).collect())
        assert sorted(r["id"] for r in fulltext.search(index, store, p, None, None).collect()) == expected, p


def test_pairs_that_come_again(spark, tmp_path):
    """A segment holds each id of a token once, however often its pair comes; the first and last are ids, negative ones too."""
    r = random.Random(7)
    pairs = [(r.randint(-9000, 9000), r.choice("abc")) for _ in range(600)]
    pairs += pairs[::2] + [(5000, "a")] * 50
    TextIndex(spark, str(tmp_path / "fts")).write_postings("segment", spark.createDataFrame(pairs, "id long, token string"))
    got = spark.read.parquet(str(tmp_path / "fts" / "segment" / "postings")).collect()
    expected = {}
    for i, t in set(pairs):
        expected.setdefault((t, i >> 12), []).append(i)
    assert {(x["token"], x["block"]): (x["n"], x["first_id"], x["last_id"], x["offsets"]) for x in got} == {(t, b): (len(ids), min(ids), max(ids), sorted(i - (b << 12) for i in ids)) for (t, b), ids in expected.items()}
    terms = spark.read.parquet(str(tmp_path / "fts" / "segment" / "terms")).collect()
    assert {x["token"]: x["n"] for x in terms} == {t: len({i for i, u in pairs if u == t}) for t in "abc"}


def test_index_follows_changes(spark, tmp_path):
    store = store_of(spark)
    index = fulltext.index_nodes(store, str(tmp_path / "fts"))
    same(index, store)
    first = index
    items = spark.createDataFrame([(0, "Topic", "red blue zug", None), (1, "Topic", "", None), (2, "Product", "x", "product:3"), (3, "Topic", "red blue zug", None)], "nth long, label string, name string, qualified_name string")
    new, result = mutate.add_nodes(store, items)
    index = fulltext.follow(index, new, result)
    new = new.with_(nodes=settled(new.nodes))
    same(index, new, FEW)
    items = spark.createDataFrame([(0, "Product", "the x1", "product:5"), (1, "Product", "green", "product:6"), (2, "Topic", "fresh red", None), (3, "Product", "blue", "product:5")], "nth long, label string, name string, qualified_name string")
    new, result = mutate.upsert_nodes(new, items)
    index = fulltext.follow(index, new, result)
    same(index, new)
    new, result = mutate.delete_nodes(new, spark.range(-5000, -4000, 37).unionAll(spark.range(99_990, 99_999)))
    index = fulltext.follow(index, new, result)
    same(index, new)
    same(first, store, FEW)  # who reads an earlier version is not disturbed
    assert len(index.segments) == 4
    one = index.merged()
    assert len(one.segments) == 1 and one.gone().isEmpty()
    same(one, new, FEW)
    same(TextIndex(spark, str(tmp_path / "fts")), new, FEW)


def test_many_updates_are_merged(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} all") for k in range(20)], "doc_id long, text string")
    index = fulltext.index_documents(docs, str(tmp_path / "fts"))
    for k in range(fulltext.SEGMENTS):
        index = index.updated(spark.createDataFrame([(k, f"new{k} all"), (k, "twice")], "id long, text string"), spark.createDataFrame([(19 - k,)], "id long"))
    assert len(index.segments) == 1
    assert sorted(r["id"] for r in index.matches("all").collect()) == [*range(12)]
    assert [r["id"] for r in index.matches("new3 twice").collect()] == [3] and index.matches("word3").isEmpty()


def test_blocks_and_edges(spark, tmp_path, monkeypatch):
    rows = [(k, "common " + ("rare" if k % 4000 == 7 else "")) for k in range(13_000)] + [(None, "common"), (20_000, None), (20_001, ""), (-1, "common rare"), (2**40, "common rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit("x")).withColumn("block", F.lit(1)).withColumn("shard", F.lit(1))
    index = fulltext.index_documents(docs, str(tmp_path / "fts"))
    assert index.frequencies(["common", "rare"])["rare"][:2] == (6, 5)
    expected = [-1, 7, 4007, 8007, 12_007, 2**40]
    assert sorted(r["id"] for r in index.matches("rare common").collect()) == expected
    plan = index.matches("rare common")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "EqualTo(token,rare)" in plan and "In(block" in plan
    monkeypatch.setattr(fulltext, "NAMED_BLOCKS", 1)
    assert sorted(r["id"] for r in index.matches("rare common").collect()) == expected
    empty = fulltext.index_documents(docs.limit(0), str(tmp_path / "none"))
    assert empty.matches("common").isEmpty() and empty.matches("..") is None


def test_commits(spark, tmp_path):
    c = Commits(spark, str(tmp_path / "c"))
    assert c.latest() == 0 and c.versions() == []
    with pytest.raises(ValueError):
        c.read()
    n = c.claim(0)
    with pytest.raises(ValueError):  # another writer at work
        c.claim(0)
    assert c.versions() == []  # a claim is no version
    c.abandon(n)
    n = c.claim(0)
    c.commit(n, {"a": "ü"})
    assert c.read() == {"a": "ü"} and c.latest() == 1
    for wrong in (lambda: c.claim(0), lambda: c.commit(1, {}), lambda: c.abandon(1), lambda: c.read(2)):
        with pytest.raises(ValueError):
            wrong()


def test_stopped_update_leaves_the_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    index = fulltext.index_documents(docs, str(tmp_path / "fts"))
    monkeypatch.setattr(TextIndex, "write_postings", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.updated(spark.createDataFrame([(1, "c")], "id long, text string"))
    monkeypatch.undo()
    again = TextIndex(spark, str(tmp_path / "fts"))
    assert again.version == 1 and sorted(r["id"] for r in again.matches("b").collect()) == [1, 2]
    assert sorted(r["id"] for r in again.updated(spark.createDataFrame([(1, "c")], "id long, text string")).matches("c").collect()) == [1, 2]


@pytest.fixture(scope="module")
def people(spark):
    nodes = [(1, "Customer", "Exists Ltd", "customer:exists-ltd", '{"size": 7, "city": "Ulm"}'), (2, "Customer", "ACME corp", "customer:acme-corp", '{"size": 9}'), (3, "Tag", "red list#", "tag:red-list", "{}"), (4, "Tag", None, None, None)]
    edges = [(1, 1, 3, "about", 1.0), (2, 2, 3, "about", 2.5)]
    return GraphStore.of(
        spark, nodes=spark.createDataFrame(nodes, "id long, label string, name string, qualified_name string, properties string"), edges=spark.createDataFrame(edges, "id long, source_id long, target_id long, type string, weight double")
    )


ACCEPTED = [
    ("SELECT id FROM nodes WHERE id BETWEEN 2 AND 3", [(2,), (3,)]),
    ("SELECT id FROM nodes WHERE id NOT BETWEEN 2 AND 3", [(1,), (4,)]),
    ("SELECT id FROM nodes WHERE name = 'Exists Ltd'", [(1,)]),
    ("SELECT id FROM nodes WHERE name = 'red list#' -- scalar-subquery#", [(3,)]),
    ("SELECT id FROM nodes WHERE name LIKE 'acme%'", [(2,)]),
    ("SELECT id FROM nodes WHERE name NOT LIKE '%LTD' AND name IS NOT NULL", [(2,), (3,)]),
    ("SELECT 'x like y' AS t FROM nodes LIMIT 1", [("x like y",)]),
    ("SELECT id FROM nodes WHERE id IN (1, 4)", [(1,), (4,)]),
    ("SELECT json_extract(properties, '$.city') AS c FROM nodes WHERE id = 1", [("Ulm",)]),
    ("SELECT group_concat(label) AS g FROM nodes WHERE label = 'Tag'", [("Tag,Tag",)]),
    ("SELECT group_concat(DISTINCT label) AS g FROM nodes WHERE label = 'Tag'", [("Tag",)]),
    ("SELECT group_concat(upper(label), ' (,) ') AS g FROM nodes WHERE label = 'Tag'", [("TAG (,) TAG",)]),
    ("SELECT strftime('%d/%m/%Y %H:%M:%S', TIMESTAMP '2024-02-29 13:05:09') AS t FROM nodes LIMIT 1", [("29/02/2024 13:05:09",)]),
    ("SELECT strftime('%Y-%m-%d', datetime('2024-02-29', '+1 year')) AS t FROM nodes LIMIT 1", [("2025-02-28",)]),
    ("SELECT datetime('now', '-1 hour') < current_timestamp AS t FROM nodes LIMIT 1", [(True,)]),
    ("SELECT extract(YEAR FROM DATE '2024-05-01') AS y FROM nodes LIMIT 1", [(2024,)]),
    ("SELECT name FROM nodes ORDER BY name LIMIT 1", [(None,)]),
    ("SELECT id FROM nodes ORDER BY id LIMIT 2 OFFSET 1", [(2,), (3,)]),
    ("SELECT rowid FROM nodes_fts WHERE nodes_fts MATCH 'customer acme'", [(2,)]),
    ("SELECT f.rowid, n.label FROM nodes_fts f JOIN nodes n ON f.rowid = n.id WHERE f.nodes_fts MATCH 'red' OR f.rowid = 1", [(1, "Customer"), (3, "Tag")]),
    ("SELECT qualified_name FROM nodes_fts WHERE rowid = 4", [("",)]),
    ("SELECT CASE WHEN weight > 2 THEN 'big' ELSE 'small' END AS w FROM edges ORDER BY id", [("small",), ("big",)]),
    ("SELECT label, count(*) AS n FROM nodes GROUP BY label HAVING count(*) > 1 ORDER BY label", [("Customer", 2), ("Tag", 2)]),
    ("SELECT DISTINCT type FROM edges", [("about",)]),
    ("SELECT redact(concat('to ', 'a@b.co')) AS r FROM nodes LIMIT 1", [("to [EMAIL]",)]),
]
REFUSED = [
    "SELECT id FROM nodes WHERE id IN (SELECT source_id FROM edges)",
    "SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM edges)",
    "SELECT (SELECT max(id) FROM edges) AS m FROM nodes",
    "SELECT id FROM nodes UNION SELECT id FROM edges",
    "WITH a AS (SELECT 1) SELECT * FROM a",
    "INSERT INTO nodes VALUES (1)",
    "DROP TABLE nodes",
    "SELECT reflect('java.lang.System', 'exit', 1) FROM nodes",
    "SELECT * FROM range(3)",
    "SELECT * FROM parquet.`/etc`",
    "SELECT id FROM other",
    "SELECT nme FROM nodes",
    "SELECT properties:a FROM nodes",
    "SELECT rowid FROM nodes_fts WHERE name MATCH 'x'",
    "SELECT rowid FROM nodes_fts WHERE nodes_fts MATCH 'x OR y'",
    "SELECT rowid FROM nodes_fts WHERE nodes_fts MATCH 'x*'",
    "SELECT group_concat(name FROM nodes",
    "SELECT fts_match(rowid, 0) FROM nodes_fts",
    "",
    "SELEC 1",
]


@pytest.mark.parametrize("text, expected", ACCEPTED)
def test_accepted(people, text, expected):
    got = [tuple(r) for r in gate.query(people, text).collect()]
    assert (got if "ORDER" in text else sorted(got)) == expected


@pytest.mark.parametrize("text", REFUSED)
def test_refused(people, text):
    with pytest.raises(ValueError):
        gate.query(people, text).collect()


def test_gate_reads_the_index(people, spark, tmp_path):
    index = fulltext.index_nodes(people, str(tmp_path / "fts"))
    found = gate.query(people, "SELECT rowid, name FROM nodes_fts WHERE nodes_fts MATCH 'exists' AND rowid < 3", index=index)
    assert [tuple(r) for r in found.collect()] == [(1, "Exists Ltd")]
    assert "EqualTo(token,exists)" in found._jdf.queryExecution().toString()
