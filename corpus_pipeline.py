"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and is the next
stage's docs. All but the last return the columns of documents; each works on all that the one before
kept. In every stage a null text is an empty one, an empty table gives an empty one, and columns of any
name are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, stored
from loomgraph.llm.exact_dedup import without_exact_copies
from loomgraph.llm.near_dedup import without_near_copies
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality import good_documents
from loomgraph.llm.repeats import text_without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores at 0.7 or more; it learns from those of docs that labels marks.
    A row of a null or repeated id is judged by its own text."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one of the smallest id; of rows that repeat id and text one. Rows of a null id stay."""
    return without_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a similarity of 0.8 or more join, the one of the smallest id. Rows of a null id and
    texts without words stay; rows that repeat an id share its decision."""
    return without_near_copies(docs, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 bytes that also start earlier; n_chars follows the text.
    A row of a null id is left as it is and is no earlier place of anything; a null text stays null."""
    left = text_without_repeats(docs, 100)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences; rows of a null or repeated id are packed one by one."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]

#: The quality network and the MinHash links have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
