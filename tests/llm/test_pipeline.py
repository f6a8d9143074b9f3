import corpus_pipeline
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F
from test_dedup import linked, removed

from loomgraph.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [{r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert new.columns == docs.columns
            seen.append({r["doc_id"]: r["text"] for r in new.select("doc_id", "text").collect()})
        docs = new
    start, good, exact, near, left = seen
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()} & start.keys()
    assert len(good.keys() & bad) < 0.5 * len(bad) and len(good) > 0.75 * len(start)
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(exact) == set(first.values())
    assert set(near) == {i for i, _, _, kept in linked(sorted(exact.items()), 80) if kept}
    expected = removed(list(near.items()), 100)
    assert {i: t.encode() for i, t in left.items()} == {i: kept.decode("utf-8", "ignore").encode() for i, (kept, _) in expected.items()}
    pieces = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).count()
    assert pieces == len(left)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(SQL[name]).df())
