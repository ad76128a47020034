"""Inverted index as tables: postings, term statistics, document lengths, corpus statistics.

Where no document id repeats, the documents' tokens are kept, a row each, and all tables are made from these without a shuffle of tokens.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stemmed, stemmed_words
from ..functions.text import analyze, exploded
from . import scoring
from .shared import children, delete, stored


def token_table(docs: DataFrame, words: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, term)."""
    words = analyze(F.col("text"), None) if words is None else words
    return exploded(docs, words, id_col)


def postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions): counts and sorted positions; partial aggregation does what merging partial indexes would."""
    return tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf) without positions, for the models that need none."""
    return tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))


def stemmed_frequencies(tf: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions if there are any) with stems as terms; the distinct vocabulary is stemmed, then counts and positions are put together."""
    more = [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if "positions" in tf.columns else []
    return stemmed(tf).groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"), *more)


def field_text(docs: DataFrame, head: bool) -> DataFrame:
    """The documents with the text to be indexed: with ``head`` the head line before the text, where there is one."""
    return docs.withColumn("text", F.concat_ws("\n", "head", "text")) if head else docs


def term_stats(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.sum("tf").alias("ttf"), F.count("*").alias("df"))


def doc_lengths(tf: DataFrame, distinct: bool = False) -> DataFrame:
    """(doc_id, dl): tokens, or distinct terms, of every document that has a term."""
    return tf.groupBy("doc_id").agg((F.count("*") if distinct else F.sum("tf")).alias("dl"))


def corpus_stats(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """One row: n_docs (empty documents too), vocabulary, avg_dl."""
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.count_distinct("term").alias("vocabulary"))
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(total)).select("n_docs", "vocabulary", F.try_divide(F.col("tokens").cast("double"), "n_docs").alias("avg_dl"))


@dataclass
class Index:
    """The tables that ranking reads. ``tf`` is used several times; keep it (``build(..., keep=True)``) or write it as a table."""

    tf: DataFrame
    terms: DataFrame
    lengths: DataFrame
    n_docs: int
    vocabulary: int
    avg_dl: float
    postings: DataFrame | None = None
    #: (doc_id, words): all tokens of each document in order, every id once; what ranks a document at a time reads these.
    words: DataFrame | None = None
    #: Whether lengths count distinct terms.
    distinct: bool = False

    @classmethod
    def build(cls, docs: DataFrame, words: Column | None = None, distinct_dl: bool = False, positions: bool = False, keep: bool = True, stem: bool = False) -> Index:
        if keep:
            rows = stored(docs.select("doc_id", (analyze(F.col("text"), None) if words is None else words).alias("words")))
            if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
                return cls.of_words(stored(stemmed_words(rows)) if stem else rows, distinct_dl, positions)
        own = token_table(docs, words)
        own = postings(own) if positions else frequencies(own)
        own = stemmed_frequencies(own) if stem else own
        own = own.persist() if keep else own
        stats = corpus_stats(docs, own).first()
        return cls(own.select("term", "doc_id", "tf"), term_stats(own), doc_lengths(own, distinct_dl), stats.n_docs, stats.vocabulary, stats.avg_dl or 0.0, own if positions else None)

    @classmethod
    def of_words(cls, words: DataFrame, distinct_dl: bool = False, positions: bool = False) -> Index:
        """The index of (doc_id, words), each id once."""
        terms = stored(scoring.partial_stats(words).groupBy("term").agg(F.sum("ttf").alias("ttf"), F.sum("df").alias("df")))
        held = words.where(F.size("words") > 0)
        lengths = held.select("doc_id", F.size(F.array_distinct("words") if distinct_dl else "words").cast("bigint").alias("dl"))
        n_docs, tokens = words.count(), held.agg(F.sum(F.size("words"))).first()[0] or 0
        own = scoring.postings(words, positions)
        return cls(own.select("term", "doc_id", "tf"), terms, lengths, n_docs, terms.count(), tokens / n_docs if n_docs else 0.0, own if positions else None, words, distinct_dl)

    def save(self, path: str, compression: str = "zstd") -> str:
        """Writes all tables below a new version folder, then the catalogue row that names it; returns the version.

        Readers see the index before or after, never a mixture; what a failed write leaves is not named by any row.
        """
        spark, version = self.tf.sparkSession, uuid.uuid4().hex
        at = f"{path}/{version}"
        write_index(self.postings if self.postings is not None else self.tf, f"{at}/postings", compression)
        write_index(self.terms, f"{at}/terms", compression)
        self.lengths.write.option("compression", compression).parquet(f"{at}/lengths")
        if self.words is not None and not self.distinct:
            self.words.write.option("compression", compression).parquet(f"{at}/words")
        row = [(version, self.n_docs, self.vocabulary, float(self.avg_dl), self.postings is not None)]
        spark.createDataFrame(row, CATALOG).withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/catalog")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Index:
        """The latest version, or a named one."""
        rows = spark.read.parquet(f"{path}/catalog")
        rows = rows.where(F.col("version") == version) if version else rows
        at = rows.orderBy(F.desc("written"), "version").first()
        if at is None:
            raise ValueError(f"no index at {path}")
        base = f"{path}/{at.version}"
        own = spark.read.parquet(f"{base}/postings")
        words = spark.read.parquet(f"{base}/words") if "words" in children(spark, base) else None
        return cls(own.select("term", "doc_id", "tf"), spark.read.parquet(f"{base}/terms"), spark.read.parquet(f"{base}/lengths"), at.n_docs, at.vocabulary, at.avg_dl, own if at.positions else None, words)

    def merged(self, other: Index) -> Index:
        """This index and that of further documents (other ids) as one; partial sums are put together, nothing is analysed again."""
        both = lambda a, b: a.unionByName(b)
        terms = both(self.terms, other.terms).groupBy("term").agg(F.sum("ttf").alias("ttf"), F.sum("df").alias("df"))
        n = self.n_docs + other.n_docs
        average = (self.avg_dl * self.n_docs + other.avg_dl * other.n_docs) / n if n else 0.0
        places = both(self.postings, other.postings) if self.postings is not None and other.postings is not None else None
        words = both(self.words, other.words) if self.words is not None and other.words is not None and self.distinct == other.distinct else None
        return Index(both(self.tf, other.tf), terms, both(self.lengths, other.lengths), n, terms.count(), average, places, words, self.distinct)


CATALOG = "version string, n_docs bigint, vocabulary bigint, avg_dl double, positions boolean"


def remove_superseded(spark: SparkSession, path: str) -> list[str]:
    """Deletes all versions but the latest of the catalogue, also those that no row names; returns their names."""
    last = spark.read.parquet(f"{path}/catalog").orderBy(F.desc("written"), "version").first().version
    gone = [v for v in children(spark, path) if v not in (last, "catalog")]
    for v in gone:
        delete(spark, f"{path}/{v}")
    return gone


def delete_index(spark: SparkSession, path: str) -> bool:
    return delete(spark, path)


def write_index(index_postings: DataFrame, path: str, compression: str = "zstd", files: int | None = None) -> None:
    """Postings sorted by term, so that a term's read prunes row groups by their statistics."""
    df = index_postings.repartitionByRange(files, "term") if files else index_postings.repartitionByRange("term")
    df.sortWithinPartitions("term").write.mode("overwrite").option("compression", compression).parquet(path)


def read_terms(spark, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms; the filter is pushed to the scan."""
    return spark.read.parquet(path).where(F.col("term").isin(terms))


def term_vectors(tf: DataFrame, terms: DataFrame, ids: DataFrame) -> DataFrame:
    """Term vectors of some documents with the terms' corpus statistics."""
    return tf.join(ids, "doc_id", "left_semi").join(terms, "term")
