"""The corpus pipeline: five stages over documents, each by one operator of marram.llm.

Any column may be null, ids may repeat, rows may be repeated and documents may have more columns: a null or empty text has too
few words and goes at the first stage; of equal texts, and of near ones, exactly one row stays; null sources are a source of
their own. All stages but the last return the columns of documents. An empty table passes as an empty table.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from marram.llm import exact_dedup, jaccard, mixing, packing, quality
from marram.llm.common import shared_folder
from marram.llm.queries import tokenizer


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: one document of each group of near duplicates stays."""
    return jaccard.keep_one(docs, n=5, threshold=Fraction(8, 10))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pfair mixing: documents in the order of the schedule of their sources' blocks."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 2048 tokens, which follow the order of the mix."""
    return packing.packed(docs, **tokenizer(), in_order=True)


STAGES = [
    ("quality_rules", good),
    ("exact_dedup", distinct),
    ("ngram_jaccard", different),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokenisation and shingle similarity are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
