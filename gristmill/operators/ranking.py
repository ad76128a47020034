"""Ranking models over the index: every model is DataFrame in, DataFrame out.

Query terms are few and known in size, so they are broadcast to the postings; idf and other term constants are
computed once per term, not per posting. A query's scores are ranked by row_number() <= k, which is cut to k rows
per partition before the shuffle.

Of an index that keeps its documents' tokens, the models named in ``KERNELS`` and the spans are worked out a document at a time (``scoring``):
scores and spans are not shuffled, only each partition's k best of a query. The functions of the models give all scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import analyze, exploded
from . import scoring
from .index import Index
from .shared import written

#: Query terms in all that are broadcast; more are joined by shuffling.
MOST_TERMS = 2_000_000
#: Best documents of all queries together that a task keeps; more queries are taken in several passes.
MOST_KEPT = 1_000_000
#: Words of an n-gram whose spans are worked out a document at a time.
MOST_GRAM = 6


def topic_terms(topics: DataFrame, words: Column | None = None, id_col: str = "query_id") -> DataFrame:
    """(query_id, pos, term), duplicates kept."""
    return exploded(topics, analyze(F.col("text"), None) if words is None else words, id_col)


def query_weights(terms: DataFrame) -> DataFrame:
    """(query_id, term, qtf)."""
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def small(df: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Written, counted, and broadcast if it has at most ``most`` rows."""
    df = written(df)
    return F.broadcast(df) if df.count() <= most else df


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, term, qtf, doc_id, tf, dl, ttf, df) of every query term that a document holds."""
    own = small(query_weights(terms).join(index.terms, "term"))
    return index.tf.join(own, "term").join(index.lengths, "doc_id")


def query_arrays(index: Index, terms: DataFrame, k: int = 1000, grams: DataFrame | None = None) -> list[scoring.Queries] | None:
    """The queries as arrays for ``scoring``, with the grams (query_id, pos, gram) if given, so many at once that ``k`` results of each fit; None where they are too many for the driver."""
    own = written(query_weights(terms))
    if own.count() > MOST_TERMS:
        return None
    rows = own.toArrow()
    stats = index.terms.join(F.broadcast(own.select("term").distinct()), "term").select("term", "ttf", "df").toArrow().combine_chunks()
    ids = pc.unique(rows["query_id"])
    ids = ids.take(pc.sort_indices(ids))
    words = pc.unique(rows["term"])
    at = pc.fill_null(pc.index_in(words, value_set=stats["term"].combine_chunks() if stats.num_rows else pa.array([], pa.string())), -1).to_numpy()
    numbers = lambda c: np.append(stats[c].to_numpy().astype(float), 0.0)[at]
    ttf, df = numbers("ttf"), numbers("df")
    code = lambda x, of: pc.index_in(x, value_set=of).to_numpy().astype(np.int64)
    query, term, qtf = code(rows["query_id"], ids), code(rows["term"], words), rows["qtf"].to_numpy().astype(float)
    order = np.argsort(term, kind="stable")
    query, term, qtf = query[order], term[order], qtf[order]
    found = grams.toArrow() if grams is not None else None
    gram = code(found["gram"].combine_chunks().flatten(), words).reshape(found.num_rows, -1) if found is not None and found.num_rows else np.zeros((0, 2), np.int64)
    gram_query, gram_pos = (code(found["query_id"], ids), found["pos"].to_numpy()) if len(gram) else (np.zeros(0, np.int64),) * 2
    each, out = max(1, MOST_KEPT // k), []
    for a in range(0, len(ids), each):
        on, grams_on = (query >= a) & (query < a + each), (gram_query >= a) & (gram_query < a + each)
        count = np.bincount(term[on], minlength=len(words))
        out.append(scoring.Queries(ids.slice(a, each), words, ttf, df, np.cumsum(count) - count, count, query[on] - a, qtf[on], index.n_docs, index.vocabulary, index.avg_dl, gram[grams_on], gram_query[grams_on] - a, gram_pos[grams_on]))
    return out


def ranked(scores: DataFrame, k: int = 1000, group: str = "query_id", score: str = "score") -> DataFrame:
    """The k best of each query, rank from 1; ties go to the larger doc_id."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col("doc_id").desc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _summed(rows: DataFrame, per_term: Column) -> DataFrame:
    """Adds qtf times the term's part, as a query's list of tokens counts duplicates."""
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * per_term), 6).alias("score"))


def _tf_part(index: Index) -> Column:
    return F.col("tf") / (F.col("tf") + 0.5 + 1.5 * F.col("dl") / index.avg_dl)


def okapi_tf(index: Index, terms: DataFrame) -> DataFrame:
    return _summed(matches(index, terms), _tf_part(index))


def tf_idf(index: Index, terms: DataFrame) -> DataFrame:
    return _summed(matches(index, terms), _tf_part(index) * F.ln(F.lit(float(index.n_docs)) / F.col("df")))


def bm25(index: Index, terms: DataFrame, k1: float = 1.2, k2: float = 500.0, b: float = 0.75) -> DataFrame:
    n, tf, qtf = float(index.n_docs), F.col("tf"), F.col("qtf")
    idf = F.ln((n + 0.5) / (F.col("df") + 0.5))
    doc = (tf + k1 * tf) / (tf + k1 * ((1 - b) + b * F.col("dl") / index.avg_dl))
    return _summed(matches(index, terms), idf * doc * (qtf + k2 * qtf) / (qtf + k2))


def lucene_bm25(index: Index, terms: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    n, tf = float(index.n_docs), F.col("tf")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _summed(matches(index, terms), idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / index.avg_dl)))


def _gains(rows: DataFrame, part: Column, fill: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, dl, gain): the sums of the parts, and 0 for the documents of ``fill`` that hold no query term, in one aggregation."""
    none = fill.crossJoin(queries.select("query_id")).select("query_id", "doc_id", "dl", F.lit(0.0).alias("part"))
    return rows.select("query_id", "doc_id", "dl", part.alias("part")).unionByName(none).groupBy("query_id", "doc_id").agg(F.first("dl").alias("dl"), F.sum("part").alias("gain"))


def lm_laplace(index: Index, terms: DataFrame, k: int | None = None) -> DataFrame:
    """-|Q| ln(dl + V) plus ln(tf + 1) for each query term held, of all documents that have a term.

    With ``k`` only what can be among a query's k best: the documents that hold a query term, and the k best without regard to
    the query, which are the k shortest (of equal ones those with the larger ids), since holding a term only adds. Without it the scores of all
    documents for all queries. Ties beyond the sixth digit aside, the k best are the same.
    """
    v = float(index.vocabulary)
    sizes = small(terms.groupBy("query_id").agg(F.count("*").alias("q")))
    every = index.lengths if k is None else F.broadcast(index.lengths.orderBy("dl", F.desc("doc_id")).limit(k))
    gained = _gains(matches(index, terms), F.col("qtf") * F.ln(F.col("tf") + 1.0), every, sizes).join(sizes, "query_id")
    return gained.select("query_id", "doc_id", F.round(F.col("gain") - F.col("q") * F.ln(F.col("dl") + v), 6).alias("score"))


def lm_jelinek_mercer(index: Index, terms: DataFrame, lam: float = 0.9, k: int | None = None) -> DataFrame:
    """Sum of ln(lam tf / dl + (1 - lam) ttf / V); a term the corpus lacks adds 0. As a baseline of the query plus gains.

    With ``k`` only what can be among a query's k best: documents without a query term are all equal, so the k with the largest ids are enough.
    """
    v = float(index.vocabulary)
    base = F.ln((1 - lam) * F.col("ttf") / v)
    base_of = query_weights(terms).join(index.terms, "term").groupBy("query_id").agg(F.sum(F.col("qtf") * base).alias("base"))
    queries = small(terms.select("query_id").distinct().join(base_of, "query_id", "left"))
    every = index.lengths if k is None else F.broadcast(index.lengths.orderBy(F.desc("doc_id")).limit(k))
    part = F.col("qtf") * (F.ln(lam * F.col("tf") / F.col("dl") + (1 - lam) * F.col("ttf") / v) - base)
    gained = _gains(matches(index, terms), part, every, queries).join(queries, "query_id")
    return gained.select("query_id", "doc_id", F.round(F.coalesce("base", F.lit(0.0)) + F.col("gain"), 6).alias("score"))


def ngrams(terms: DataFrame, n: int) -> DataFrame:
    """(query_id, pos, gram): every run of n consecutive query terms."""
    after = Window.partitionBy("query_id").orderBy("pos")
    gram = F.array(*[F.lead("term", k).over(after) for k in range(n)])
    return terms.select("query_id", "pos", gram.alias("gram")).where(F.forall("gram", lambda w: w.isNotNull()))


def bigrams(terms: DataFrame) -> DataFrame:
    """(query_id, pos, a, b): consecutive query terms."""
    after = F.lead("term").over(Window.partitionBy("query_id").orderBy("pos"))
    return terms.select("query_id", "pos", F.col("term").alias("a"), after.alias("b")).where("b is not null")


def min_span(a: Column, b: Column, cap: int = 500, compat: bool = True) -> Column:
    """Least distance of two sorted position lists, below ``cap``; in compat mode ``cap`` where the first does not begin before the second.

    The nearest pair is found by merging the two lists once.
    """
    marked = F.array_sort(F.concat(F.transform(a, lambda p: F.struct(p.alias("p"), F.lit(0).alias("s"))), F.transform(b, lambda p: F.struct(p.alias("p"), F.lit(1).alias("s")))))
    start = F.struct(F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.lit(cap).alias("m"))

    def step(acc, e):
        other = F.when(e["s"] == 0, acc["y"]).otherwise(acc["x"])
        gap = F.coalesce(e["p"] - other, F.lit(cap))
        return F.struct(F.when(e["s"] == 0, e["p"]).otherwise(acc["x"]).alias("x"), F.when(e["s"] == 1, e["p"]).otherwise(acc["y"]).alias("y"), F.least(acc["m"], F.when(gap > 0, gap).otherwise(F.lit(cap))).alias("m"))

    least = F.aggregate(marked, start, step)["m"]
    return F.when(F.element_at(a, 1) >= F.element_at(b, 1), F.lit(cap)).otherwise(least) if compat else least


def covering_span(lists: Column, cap: int = 500) -> Column:
    """Of n sorted position lists (an array of arrays) the least distance between the first and last of n positions, one of each; at most ``cap``.

    One pass over all positions in order, keeping each list's latest: the span that ends at a position starts at the earliest of these.
    """
    n = F.size(lists)
    marked = F.array_sort(F.flatten(F.transform(lists, lambda own, k: F.transform(own, lambda p: F.struct(p.alias("p"), k.alias("k"))))))
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), n).alias("last"), F.lit(cap).alias("m"))

    def step(acc, e):
        last = F.transform(acc["last"], lambda x, k: F.when(k == e["k"], e["p"]).otherwise(x))
        full = F.forall(last, lambda x: x.isNotNull())
        return F.struct(last.alias("last"), F.when(full, F.least(acc["m"], e["p"] - F.array_min(last))).otherwise(acc["m"]).alias("m"))

    return F.when(F.exists(lists, lambda own: F.size(own) == 0), F.lit(cap)).otherwise(F.aggregate(marked, start, step)["m"])


def ngram_spans(index: Index, terms: DataFrame, n: int, cap: int = 500) -> DataFrame:
    """(query_id, pos, doc_id, span) of query n-grams of n different words that a document holds all of."""
    grams = ngrams(terms, n).where(F.size(F.array_distinct("gram")) == n)
    if index.words is not None and n <= MOST_GRAM and (found := query_arrays(index, terms, 1, grams)):
        return reduce(DataFrame.unionByName, [scoring.spans(index.words, q, terms.schema["query_id"], cap) for q in found])
    wanted = small(grams.select("query_id", "pos", F.explode("gram").alias("term")))
    found = index.postings.join(wanted, "term").groupBy("query_id", "pos", "doc_id").agg(F.collect_list("positions").alias("lists"))
    return found.where(F.size("lists") == n).select("query_id", "pos", "doc_id", covering_span(F.col("lists"), cap).alias("span"))


def _pairs(terms: DataFrame) -> DataFrame:
    return bigrams(terms).where("a <> b").select("query_id", "pos", F.array("a", "b").alias("gram"))


def spans(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, pos, doc_id, span) of query bigrams of two different words that a document holds both of."""
    if index.words is not None and (found := query_arrays(index, terms, 1, _pairs(terms))):
        return reduce(DataFrame.unionByName, [scoring.spans(index.words, q, terms.schema["query_id"], ordered=True) for q in found])
    pairs = small(bigrams(terms).where("a <> b"))
    left = index.postings.join(pairs.withColumnRenamed("a", "term"), "term").select("query_id", "pos", "doc_id", "b", F.col("positions").alias("pa"))
    right = index.postings.select(F.col("term").alias("b"), "doc_id", F.col("positions").alias("pb")).join(small(bigrams(terms).select("b").distinct()), "b", "left_semi")
    return left.join(right, ["b", "doc_id"]).select("query_id", "pos", "doc_id", min_span(F.col("pa"), F.col("pb")).alias("span"))


def proximity(index: Index, terms: DataFrame, alpha: float = 1.3, missing: int = 287) -> DataFrame:
    """TF-IDF plus ln(alpha + exp(-span)) for every query bigram; one that a document lacks has the span ``missing``."""
    n = small(terms.groupBy("query_id").agg((F.count("*") - 1).alias("n")))
    none = F.ln(F.lit(alpha) + F.exp(F.lit(-float(missing))))
    found = spans(index, terms).groupBy("query_id", "doc_id").agg(F.sum(F.ln(alpha + F.exp(-F.col("span"))) - none).alias("gain"))
    raw = matches(index, terms).groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * _tf_part(index) * F.ln(F.lit(float(index.n_docs)) / F.col("df"))).alias("s"))
    score = F.col("s") + F.col("n") * none + F.coalesce("gain", F.lit(0.0))
    return raw.join(n, "query_id").join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(score, 6).alias("score"))


MODELS = {"okapi_tf": okapi_tf, "tf_idf": tf_idf, "bm25": bm25, "lucene_bm25": lucene_bm25, "lm_laplace": lm_laplace, "lm_jelinek_mercer": lm_jelinek_mercer, "proximity": proximity}


#: Models that score every document; they can be asked for what can be among the k best.
WHOLE = {lm_laplace, lm_jelinek_mercer}


#: Models that are also worked out a document at a time.
KERNELS = {okapi_tf: scoring.okapi_tf, tf_idf: scoring.tf_idf, bm25: scoring.bm25, lucene_bm25: scoring.lucene_bm25, lm_laplace: scoring.lm_laplace, lm_jelinek_mercer: scoring.lm_jelinek_mercer, proximity: scoring.proximity}


def best(index: Index, terms: DataFrame, model, k: int, **options) -> DataFrame:
    """The k best documents of each query by a model."""
    if index.words is not None and model in KERNELS:
        found = query_arrays(index, terms, k, _pairs(terms) if model is proximity else None)
        if found:
            tops = [scoring.top(index.words, q, terms.schema["query_id"], KERNELS[model](**options), k, index.distinct) for q in found]
            # Few rows, of which evaluation makes several tables.
            return written(ranked(reduce(DataFrame.unionByName, tops), k))
    return ranked(model(index, terms, **options, **({"k": k} if model in WHOLE else {})), k)


def rank(index: Index, terms: DataFrame, model=bm25, k: int = 1000, feedback=None, **options) -> DataFrame:
    """The parametrised driver: a model (a name or any function of index and terms), optionally with query expansion."""
    score = MODELS[model] if isinstance(model, str) else model
    if feedback is not None:
        terms = feedback(index, terms, score)
    return best(index, terms, score, k, **options)


def run_lines(run: DataFrame, tag: str = "Exp") -> DataFrame:
    """The lines of a run file: query, Q0, document, rank, score, tag."""
    return run.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag)).alias("line"))
