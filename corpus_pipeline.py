"""A corpus pipeline of five stages: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written
as Parquet and read again as the next one's docs. All stages but the last return the columns of documents. Deduplication tells
rows apart by id and text together, so a repeated or null doc_id neither loses a text nor keeps a copy. Of null and empty texts
none passes the first stage; an empty table gives empty results; very long texts are read whole; further columns are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, exact_dedup, language, packing, simhash_dedup
from gristmill.llm.common import shared_dir, table
from gristmill.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no known language: null, without a letter, or far less like any profile than documents of known language are.

    Profiles and the least score are those of all documents of known language that are not held out, not of a sample.
    """
    return language.like_known(docs.select(COLUMNS), language.learn(docs, sample=None))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of rows with that doc_id, one."""
    return exact_dedup.one_of_each(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by SimHash prints and then five-word shingles (similarity 0.8 or more), the row with the smallest doc_id stays."""
    return simhash_dedup.one_of_each(docs.select(COLUMNS))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Language profiles, fingerprints and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
