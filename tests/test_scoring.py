"""What is worked out a document at a time: the same rows as by joins, and little that is shuffled."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gristmill.operators import feedback, ranking, scoring
from gristmill.operators.index import Index


def texts(spark, n, seed, words="abcdefgh", length=25):
    r = random.Random(seed)
    return spark.createDataFrame([(d * 7 - 50, " ".join(r.choice(words) * r.choice((1, 1, 2)) for _ in range(r.randint(0, length)))) for d in range(n)] + [(10**6, None)], "doc_id long, text string").repartition(3)


def topics(spark, rows):
    return ranking.topic_terms(spark.createDataFrame(rows, "query_id long, text string"))


def shuffled(spark, run):
    """Rows that a call shuffles."""
    sc = spark.sparkContext
    gw = sc._gateway

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def case(spark):
    index = Index.build(texts(spark, 80, 3), positions=True)
    return index, replace(index, words=None), topics(spark, [(1, "a b b zz c"), (2, "zz"), (3, "hh h"), (4, "a")])


@pytest.mark.parametrize("name", sorted(ranking.MODELS))
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_documents(case, name, k):
    index, joined, terms = case
    model = ranking.MODELS[name]
    assert rows(ranking.best(index, terms, model, k)) == rows(ranking.best(joined, terms, model, k))


def test_queries_in_several_passes(case, monkeypatch):
    index, joined, terms = case
    monkeypatch.setattr(ranking, "MOST_KEPT", 10)
    monkeypatch.setattr(scoring, "CELLS", 64)
    assert rows(ranking.best(index, terms, ranking.proximity, 7)) == rows(ranking.best(joined, terms, ranking.proximity, 7))


def test_ranking_shuffles_no_scores(spark):
    """F20 and the other rankings: every document holds a term of every topic, and only partitions' best rows move."""
    index = Index.build(texts(spark, 900, 5))
    terms = topics(spark, [(q, "a b c d e f g h") for q in range(40)])
    assert shuffled(spark, lambda: ranking.best(index, terms, ranking.bm25, 10).collect()) < 8_000


def test_index_shuffles_no_postings(spark):
    """some 11,000 postings of 900 documents, of which only partial statistics and the ids move."""
    docs = texts(spark, 900, 6, "abcdefghijklmnopqrstuvwxyz", 40).persist()
    docs.count()
    assert shuffled(spark, lambda: Index.build(docs)) < 2_500


def test_spans(spark, case):
    index, joined, terms = case
    assert rows(ranking.spans(index, terms)) == rows(ranking.spans(joined, terms))
    for n in (2, 3, 4):
        assert rows(ranking.ngram_spans(index, terms, n)) == rows(ranking.ngram_spans(joined, terms, n))
    assert shuffled(spark, lambda: ranking.spans(index, terms).collect()) < 200


def test_significant_terms(spark, case, monkeypatch):
    index, joined, terms = case
    want = rows(feedback.significant_terms(joined, terms, 5))
    assert rows(feedback.significant_terms(index, terms, 5)) == want
    monkeypatch.setattr(scoring, "TILE_TOKENS", 50)
    assert rows(feedback.significant_terms(index, terms, 5)) == want
    monkeypatch.undo()
    more = Index.build(texts(spark, 400, 8, "abcdefghijklmnopqrstuvwxyz", 60))
    assert shuffled(spark, lambda: feedback.significant_terms(more, terms).collect()) < 1_000


def test_term_vectors(case, monkeypatch):
    """no row holds more than a chunk's documents, and all together hold the postings."""
    from gristmill.sources import codecs

    monkeypatch.setattr(scoring, "CELLS", 200)
    own = codecs.from_delimited(codecs.to_delimited(codecs.from_json(codecs.to_json(codecs.in_chunks(case[0])))))
    assert own.agg(F.max(F.size("tf"))).first()[0] < 40
    flat = own.select("term", "ttf", F.explode("tf").alias("d", "v")).select("term", "ttf", F.col("d").cast("bigint").alias("doc_id"), F.col("v.tf").alias("tf"), F.col("v.pos").alias("positions"))
    assert rows(flat) == rows(case[0].postings.join(case[0].terms.select("term", "ttf"), "term"))


def test_repeated_ids_are_put_together(spark):
    docs = texts(spark, 30, 4)
    index = Index.build(docs.unionByName(docs))
    assert index.words is None and {r.term: r.ttf for r in index.terms.collect()} == {r.term: 2 * r.ttf for r in Index.build(docs).terms.collect()}
