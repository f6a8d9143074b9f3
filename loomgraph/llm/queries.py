"""The queries of this subpackage: a name, the query, and SQL for it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.collocations import collocations
from loomgraph.llm.common import documents, held_out
from loomgraph.llm.exact_dedup import exact_groups
from loomgraph.llm.html_extract import extracted
from loomgraph.llm.language import fit_languages, predicted_languages
from loomgraph.llm.lm_score import language_scores
from loomgraph.llm.near_dedup import near_groups
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.pieces import codec_summary
from loomgraph.llm.quality import fit_quality, quality_scores
from loomgraph.llm.repeats import without_repeats
from loomgraph.llm.token_counts import token_counts
from loomgraph.llm.topk import top_k
from loomgraph.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


@query(r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
    ), sets AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS same, s FROM s
    ), reps AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM sets WHERE n > 0 GROUP BY same
    ), shingles AS (SELECT rep, n, unnest(s) AS x FROM reps
    ), links AS (
        SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links
    ), reach(id, least) USING KEY (id) AS (
        SELECT rep, rep FROM reps UNION SELECT b, min(r.least) FROM reach r JOIN steps ON a = r.id JOIN recurring.reach k ON k.id = b WHERE r.least < k.least GROUP BY b
    ), named AS (SELECT sets.doc_id, sets.n, CASE WHEN sets.n = 0 THEN sets.doc_id ELSE (min(doc_id) OVER (PARTITION BY same)) END AS rep FROM sets)
    SELECT doc_id, n AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept FROM named LEFT JOIN reach ON named.n > 0 AND reach.id = named.rep""")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), percent=85)


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(documents(spark, sf_dir).select("doc_id", "text"), 100)
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return left.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predicted_languages(docs, fit_languages(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query("""
    WITH v AS (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), parts=7)


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_summary(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@query(r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
    ), runs AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM words, range(1, 5) t(k) WHERE len(w) >= k
    ), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30
    ), cuts AS (
        SELECT lang, k, phrase, a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS tail
        FROM f, range(1, 4) t(j) WHERE j < k
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, c.j, h.a AS l, t.a AS r, CAST(2000000::HUGEINT * c.a // (h.a + t.a) AS BIGINT) AS score
        FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
    ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
    ), inner_runs AS (
        SELECT lang, a, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS part FROM f, range(1, 4) t(i), range(2, 4) u(m) WHERE m < k AND i + m - 1 <= k
    ), around AS (SELECT lang, part, max(a) AS most FROM inner_runs GROUP BY ALL
    ), kept AS (SELECT s.* FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.part = s.phrase WHERE most IS NULL OR 100 * most < 80 * s.a
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op12_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
