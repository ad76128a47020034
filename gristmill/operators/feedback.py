"""Pseudo-relevance feedback: expansion of queries by top documents, or by significantly co-occurring terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scoring
from .index import Index
from .ranking import MOST_TERMS, best, bm25, small
from .shared import written


def expansion_terms(index: Index, terms: DataFrame, model=bm25, docs: int = 10, most: int = 10) -> DataFrame:
    """(query_id, term, ttf, df, weight, rank): the heaviest terms of each query's best documents.

    Over the best ``docs`` documents: term frequencies are summed, and so are the terms' corpus df (once per document that
    holds the term); the weight is ttf ln(N / df) and may be negative. Ties go to the term that sorts first.
    """
    first = small(best(index, terms, model, docs).select("query_id", "doc_id"))
    # Where the documents' tokens are kept, only those of these documents are counted.
    tf = index.tf if index.words is None else scoring.postings(index.words.join(F.broadcast(first.select("doc_id").distinct()), "doc_id", "left_semi"))
    held = tf.join(first, "doc_id").join(index.terms.select("term", "df"), "term")
    sums = held.groupBy("query_id", "term").agg(F.sum("tf").alias("ttf"), F.sum("df").alias("df"))
    weighed = sums.withColumn("weight", F.round(F.col("ttf") * F.ln(F.lit(float(index.n_docs)) / F.col("df")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _appended(terms: DataFrame, more: DataFrame) -> DataFrame:
    """The queries with more terms (query_id, term, rank) after their own; queries are values, nothing is changed in place."""
    return terms.unionByName(more.select("query_id", (F.lit(1_000_000) + F.col("rank")).cast("int").alias("pos"), "term"))


def custom_feedback(index: Index, terms: DataFrame, model=bm25, docs: int = 10, most: int = 10) -> DataFrame:
    return _appended(terms, expansion_terms(index, terms, model, docs, most))


def significant_terms(index: Index, terms: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, token, term, score, rank): terms that occur in the token's documents, by Google-normalised-distance similarity.

    score = exp(-(max(ln f(x), ln f(y)) - ln f(xy)) / (ln N - min(ln f(x), ln f(y)))), f being document frequencies.
    Co-occurrence is counted for the distinct query tokens only, from each document's distinct terms; where the documents' tokens are kept,
    by parts of the vocabulary (``scoring.associates``), and no pair is shuffled.
    """
    order = Window.partitionBy("token").orderBy(F.desc("score"), "term")
    if index.words is not None:
        wanted = written(terms.select("term").distinct())
        if wanted.count() <= MOST_TERMS:
            own = index.terms.join(F.broadcast(wanted), "term").select("term", "df").toArrow().combine_chunks()
            if not own.num_rows:
                return terms.limit(0).select(F.col("term").alias("token"), "term", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
            postings = index.terms.agg(F.sum("df")).first()[0]
            rows = scoring.associates(index.words, own["term"].combine_chunks(), own["df"].to_numpy(), index.n_docs, postings, most)
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    wanted = small(terms.select(F.col("term").alias("token")).distinct())
    held = index.tf.select("doc_id", F.col("term").alias("token")).join(wanted, "token")
    both = held.join(index.tf.select("doc_id", "term"), "doc_id").where("term <> token").groupBy("token", "term").agg(F.count("*").alias("fxy"))
    df = index.terms.select("term", "df")
    rows = both.join(df.withColumnRenamed("df", "fy"), "term").join(small(df.select(F.col("term").alias("token"), F.col("df").alias("fx")).join(wanted, "token")), "token")
    top, low = F.ln(F.greatest("fx", "fy")), F.ln(F.least("fx", "fy"))
    under = F.ln(F.lit(float(index.n_docs))) - low
    score = F.round(F.when(under > 0, F.exp(-(top - F.ln("fxy")) / under)).otherwise(F.lit(0.0)), 6)
    return rows.select("token", "term", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def significant_expansion(index: Index, terms: DataFrame, least: float = 0.7, per_token: int = 2, most: int = 10) -> DataFrame:
    """(query_id, pos, token, term, rank): per query token at most two terms outside the query that score 0.7 or more."""
    found = small(significant_terms(index, terms, most).where(F.col("score") >= least))
    rows = terms.select("query_id", "pos", F.col("term").alias("token")).join(found, "token").join(terms.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")
    order = Window.partitionBy("query_id", "pos").orderBy("rank")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_token).select("query_id", "pos", "token", "term", F.col("n").alias("rank"))


def significant_feedback(index: Index, terms: DataFrame, model=bm25) -> DataFrame:
    return _appended(terms, significant_expansion(index, terms).select("query_id", "term", (F.col("pos") * 10 + F.col("rank")).alias("rank")))
