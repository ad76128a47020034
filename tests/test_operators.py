"""Hand-computed cases for the retrieval, evaluation, link and frontier operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gristmill.operators import edges, evaluation, feedback, frontier, index, learning, links, ranking
from gristmill.operators.index import Index


@pytest.fixture(scope="module")
def small_index(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c d"), (3, "a"), (4, "")], "doc_id long, text string")
    return index.Index.build(docs, positions=True)


def topics(spark, *texts):
    return ranking.topic_terms(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id long, text string"))


def test_index(spark, small_index):
    assert (small_index.n_docs, small_index.vocabulary, small_index.avg_dl) == (4, 4, 2.0)
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in small_index.postings.collect()}[("a", 1)] == (2, [1, 3])
    assert {r.term: (r.ttf, r.df) for r in small_index.terms.collect()}["a"] == (3, 2)


def test_bm25_by_hand(spark, small_index):
    got = {r.doc_id: r.score for r in ranking.bm25(small_index, topics(spark, "a a"), 1.2, 500.0, 0.75).collect()}
    idf, qtf = math.log(4.5 / 2.5), 2 * 501 / 502
    want = {d: round(2 * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / 2)) * qtf, 6) for d, tf, dl in ((1, 2, 4), (3, 1, 1))}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("lam", [0.8, 0.9])
def test_language_models_by_definition(spark, small_index, lam):
    tf = {1: {"a": 2, "b": 1, "c": 1}, 2: {"b": 1, "c": 1, "d": 1}, 3: {"a": 1}}
    ttf = {"a": 3, "b": 2, "c": 2, "d": 1}
    query = ["a", "d", "d", "zz"]
    laplace = {d: sum(math.log((t.get(w, 0) + 1) / (sum(t.values()) + 4)) for w in query) for d, t in tf.items()}
    mercer = {d: sum(math.log(lam * t.get(w, 0) / sum(t.values()) + (1 - lam) * ttf[w] / 4) if w in ttf else 0 for w in query) for d, t in tf.items()}
    q = topics(spark, " ".join(query))
    assert {r.doc_id: r.score for r in ranking.lm_laplace(small_index, q).collect()} == pytest.approx(laplace, abs=1e-6)
    assert {r.doc_id: r.score for r in ranking.lm_jelinek_mercer(small_index, q, lam).collect()} == pytest.approx(mercer, abs=1e-6)


@pytest.mark.parametrize("a,b,compat,exact", [([5, 20], [10], 5, 5), ([10], [5], 500, 5), ([10], [5, 30], 500, 5), ([1], [900], 500, 500)])
def test_min_span(spark, a, b, compat, exact):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(ranking.min_span(F.col("a"), F.col("b")), ranking.min_span(F.col("a"), F.col("b"), compat=False)).first() == (compat, exact)


def test_ties_go_to_the_larger_document(spark):
    s = spark.createDataFrame([(1, d, 1.0) for d in range(10)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r.rank) for r in ranking.ranked(s, 3).orderBy("rank").collect()] == [(9, 1), (8, 2), (7, 3)]


def test_feedback_appends_terms(spark, small_index):
    q = topics(spark, "d")
    assert {r.term for r in feedback.expansion_terms(small_index, q).collect()} == {"b", "c", "d"}
    assert feedback.custom_feedback(small_index, q).count() == 4 and q.count() == 1


def run_and_qrels(spark, ranking_, rel, n_rel):
    run = spark.createDataFrame([("1", str(k), 10.0 - k) for k in range(len(ranking_))], "query_id string, doc_id string, score double")
    q = [("1", str(k), r) for k, r in enumerate(rel)] + [("1", f"x{k}", 1) for k in range(n_rel - sum(rel))]
    return run, spark.createDataFrame(q, "query_id string, doc_id string, rel int")


def test_average_precision(spark):
    rows = evaluation.judged(*run_and_qrels(spark, "abc", [1, 0, 1], 2))
    assert evaluation.average_precision(rows).first().ap == 0.833333
    assert evaluation.r_precision(rows).first().r_prec == 0.5
    assert {r.level: r.precision for r in evaluation.interpolated(rows).collect()}[1.0] == 0.666667
    cut = {r.k: (r.precision, r.recall) for r in evaluation.cutoffs(rows, (5,), compat=False).collect()}
    assert cut[5] == (0.4, 1.0)
    assert {r.k: r.precision for r in evaluation.cutoffs(rows, (5,)).collect()}[5] == 0.5
    assert 0 < evaluation.ndcg(rows, compat=False).first().ndcg <= 1


def test_topics_without_relevant_documents_are_skipped(spark):
    run, qrels = run_and_qrels(spark, "ab", [0, 0], 0)
    assert evaluation.judged(run, qrels).count() == 0


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    assert evaluation.auc(df).first().auc == 0.625


def test_pagerank(spark):
    pair = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b")], "src string, dst string")
    assert {r.id: r.rank for r in links.pagerank(pair).collect()} == pytest.approx({"a": 0.5, "b": 0.5})
    assert links.perplexity(links.pagerank(pair, 1)) == pytest.approx(2.0)
    sink = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r.id: r.rank for r in links.pagerank(sink, 1).collect()} == pytest.approx({"a": 0.2875, "b": 0.7125})
    assert [r.id for r in links.sinks(sink).collect()] == ["b"]
    ring = spark.createDataFrame([(k, (k * 7 + 1) % 23) for k in range(23)] + [(0, 5)], "src long, dst long")
    assert links.pagerank(ring).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_hits(spark):
    e = spark.createDataFrame([("a", "c"), ("b", "c"), ("a", "d")], "src string, dst string")
    auth, hub = links.hits(e, missing=0.0, iterations=1)
    assert auth.count() == 2 and hub.count() == 2
    auth, hub = (dict(x.collect()) for x in links.hits(e))
    assert auth["c"] > auth["d"] and hub["a"] > hub["b"] and sum(v * v for v in auth.values()) == pytest.approx(1.0)


def test_urls(spark):
    df = spark.createDataFrame([("HTTP://Ex.com:80/a//b/c.html?x=1#f", h) for h in ("d.html", "/r?q", "//o.org", "https://z.de/", "#top")], "base string, href string")
    got = [r[0] for r in df.select(links.resolve(F.col("base"), F.col("href"))).collect()]
    assert got == ["http://ex.com/a/b/d.html", "http://ex.com/r?q", "http://o.org/", "https://z.de/", "http://ex.com/a/b/"]
    assert df.select(links.canonical(F.col("base"))).first()[0] == "http://ex.com/a/b/c.html?x=1"


def test_adjacency_round_trip(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a")], "src string, dst string")
    assert {tuple(r) for r in links.parse_adjacency(links.adjacency(e)).collect()} == {("a", "b"), ("a", "c"), ("d", "a")}


def test_page_parts(spark):
    page = '<html><head><title> T </title><meta name="keywords" content="A, b,a"><meta name="description" content="D"><script>x<y</script></head><body>Hi <b>you</b><a class="k" href="/x">Go <i>on</i></a></body></html>'
    df = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    h = F.col("html")
    assert df.select(links.title(h), links.plain_text(h), links.meta_keywords(h), links.meta_description(h)).first() == ("T", "T Hi you Go on", ["a", "b"], "D")
    assert [tuple(r) for r in links.outlinks(df).collect()] == [(1, "http://h/", 1, "/x", "go on")]


def test_base_set_is_capped_and_repeatable(spark):
    e = spark.createDataFrame([(f"s{k}", "r") for k in range(50)] + [("r", "o")], "src string, dst string")
    root = spark.createDataFrame([("r",)], "id string")
    one, two = (sorted(r.id for r in links.base_set(e, root, 10).collect()) for _ in range(2))
    assert one == two and len(one) == 12


def test_rate_limit_and_keep_first(spark):
    t = dt.datetime(2024, 1, 1)
    hits = spark.createDataFrame([("d", k, t + dt.timedelta(seconds=s)) for k, s in enumerate((0, 0.5, 1.4, 2.4))], "key string, id long, ts timestamp")
    assert [r.limited for r in frontier.rate_limited(hits, "key", "ts", "id").orderBy("id").collect()] == [False, True, True, False]
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "n int, k string")
    assert [(r.k, r.kept) for r in frontier.keep_first(rows, "k", "n").orderBy("n").collect()] == [("x", True), ("y", True), ("x", False)]


def test_frontier_cascade(spark):
    batch = spark.createDataFrame([("u1", "d1", 0, None), ("u2", "d1", 5, True), ("u3", "d2", 5, False), ("u4", "d2", 5, None), ("u5", "d3", 5, None), ("u6", "d3", 0, None)], "url string, domain string, wave int, rate_limited boolean")
    named = lambda rows, s: spark.createDataFrame(rows, s)
    got = dict(frontier.cascade(batch, named([("u6",)], "url string"), named([("u3",)], "url string"), named([("u5", 9)], "url string, inlinks long"), named([("d2", 3), ("d3", 1)], "domain string, inlinks long"), named([("d2", 1), ("d1", 4)], "domain string, rank int"), best=1).collect())
    assert got == {"u1": "early", "u2": "early", "u3": "relevant", "u4": "requeue", "u5": "scored"}


def test_filters_never_match_upper_case_parts(spark):
    df = spark.createDataFrame([("BookSources here",), ("a wiki",)], "t string")
    assert [r[0] for r in df.select(frontier.contains_any(F.col("t"), ["BookSources", "wiki"])).collect()] == [False, True]


def test_edge_tables(spark):
    e = spark.createDataFrame([(1, "http://a/?x=1&y=<2>", "b"), (1, "c", "d"), (1, "c", "d")], "batch int, src string, dst string")
    back = edges.from_xml(edges.to_xml(e, "batch"), "batch")
    assert sorted((r.src, r.dst) for r in back.collect()) == sorted((r.src, r.dst) for r in e.collect())
    rows = edges.edge_rows(e)
    assert [(r.src, r.n) for r in edges.duplicate_edges(rows).collect()] == [("c", 2)] and edges.distinct_edge_count(rows).first() == (2, 3)
    ids = {r.url: r.id for r in edges.allocate_ids(spark.createDataFrame([("n1",), ("n2",), ("old",)], "url string"), spark.createDataFrame([("old", 5)], "url string, id long")).collect()}
    assert ids["old"] == 5 and len(set(ids.values())) == 3 and min(ids["n1"], ids["n2"]) > 5


def test_learning_to_rank_set(spark):
    run = spark.createDataFrame([("q", f"d{k}", float(k)) for k in range(8)], "query_id string, doc_id string, score double")
    labels = learning.labels(spark.createDataFrame([("q", "d7", 2), ("q", "d0", 0), ("q", "d9", -1)], "query_id string, doc_id string, rel int"))
    got = {r.doc_id: r.label for r in learning.negative_fill(run, labels, total=4).collect()}
    assert got == {"d7": 1, "d0": 0, "d9": 0, "d1": 0}


def test_all_rank_models_fit(spark):
    import random

    r = random.Random(0)
    rows = [(q, d, *(r.random() for _ in range(5))) for q in range(10) for d in range(8)]
    feats = spark.createDataFrame(rows, "query_id long, doc_id long, " + ", ".join(f"{n} double" for n in learning.FEATURES))
    labels = feats.select("query_id", "doc_id", (F.col("okapi_bm25") > 0.5).cast("int").alias("label"))
    table = learning.training_table(feats, labels).persist()
    models = learning.rank_models()
    assert len(models) == 10
    models["boosted"].setMaxIter(5)
    with pytest.raises(Exception, match="without label"):
        learning.checked(table.limit(2).withColumn("label", F.lit(None).cast("int"))).collect()
    maps = learning.train_and_evaluate(table, labels.withColumnRenamed("label", "rel"), {k: models[k] for k in ("linear", "logistic", "elastic_net", "tree_20", "boosted")}, draws=2)
    out = [tuple(r) for r in maps.collect()]
    assert len(out) == 10 and learning.mean_over_draws(maps).count() == 5
    assert {n for n, *_ in out} == {"linear", "logistic", "elastic_net", "tree_20", "boosted"} and {a for n, _, a, _ in out if n == "tree_20"} == {1.0}


def test_gates_use_all_rules(spark):
    """Robots rules past the first million hold too, and those joined by shuffle as those broadcast."""
    rows = [(f"u{k}", f"h{k % 40}" if k % 3 else "hot", f"/{'ab'[k % 2]}/{k}", "text/html" if k % 5 else "text/plain", f"r{k}") for k in range(600)] + [("none", None, "/a", "text/html", "r")]
    pages = spark.createDataFrame(rows, "url string, host string, path string, content_type string, redirected_url string")
    crawled = spark.createDataFrame([("r7",)], "url string")
    own = spark.createDataFrame([("hot", "/a/"), ("h1", "/b"), ("h2", "/"), ("h2", "/a"), (None, "/")], "host string, prefix string")
    bans = {"hot": ("/a/",), "h1": ("/b",), "h2": ("/",)}
    want = sorted(u for u, h, p, c, r in rows if c == "text/html" and r != "r7" and not p.startswith(bans.get(h, ("#",))))
    many = spark.range(1_000_001).select(F.concat(F.lit("x"), "id").alias("host"), F.lit("/").alias("prefix")).unionByName(own)
    for robots, options in ((own, {}), (many, {}), (own, {"most": 3}), (own, {"most": 0})):
        assert sorted(r.url for r in frontier.gates(pages, robots, crawled, **options).collect()) == want


def test_graph_with_split_nodes(spark, monkeypatch):
    """Nodes whose edges are dealt to several partitions have the same ranks and scores."""
    edges = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(k, 0) for k in range(1, 9)] + [(3, 4), (4, 5)], "src long, dst long")
    side = lambda rows: sorted((r.id, round(r[1], 9)) for r in rows.collect())
    want = side(links.pagerank(edges, 4)), *map(side, links.hits(edges, iterations=3))
    monkeypatch.setattr(links, "PART_EDGES", 4)
    assert (side(links.pagerank(edges, 4)), *map(side, links.hits(edges, iterations=3))) == want
    base = spark.createDataFrame([(0,), (3,), (4,)], "id long")
    auth, hub = links.hits(edges, base, iterations=2)
    assert {r.id for r in auth.collect()} == {0, 3, 4} == {r.id for r in hub.collect()}


def test_language_models_need_no_product(spark):
    """The k best are those of the scores of all documents, also where fewer than k documents hold a query term."""
    import random

    r = random.Random(2)
    docs = spark.createDataFrame([(d, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))) for d in range(60)], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "a b zz"), (2, "zz"), (3, "h h")], "query_id long, text string")
    index, terms = Index.build(docs), ranking.topic_terms(topics)
    for model in (ranking.lm_laplace, ranking.lm_jelinek_mercer):
        rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
        for k in (1, 7, 100):
            assert rows(ranking.best(index, terms, model, k)) == rows(ranking.ranked(model(index, terms), k))


def test_index_saved_loaded_merged_and_stemmed(spark, tmp_path):
    from gristmill.operators import index as ix

    rows = [(1, "running runs easily", "Heads"), (2, "he runs; she ran", None), (3, None, None), (4, "runner running", "The head")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head string")
    at = str(tmp_path / "index")
    whole = Index.build(docs, positions=True)
    first = whole.save(at)
    part = [Index.build(docs.where(c), positions=True) for c in ("doc_id < 3", "doc_id >= 3")]
    part[0].merged(part[1]).save(at)
    got = Index.load(spark, at)
    tables = lambda i: [sorted(map(str, d.collect())) for d in (i.tf.select("term", "doc_id", "tf"), i.terms.select("term", "ttf", "df"), i.lengths.select("doc_id", "dl"), i.postings.select("term", "doc_id", "tf", "positions"))]
    assert tables(got) == tables(whole) == tables(Index.load(spark, at, first)) and (got.n_docs, got.vocabulary, round(got.avg_dl, 9)) == (whole.n_docs, whole.vocabulary, round(whole.avg_dl, 9))
    assert ix.remove_superseded(spark, at) == [first] and tables(Index.load(spark, at)) == tables(whole)
    assert ix.delete_index(spark, at) and not (tmp_path / "index").exists()
    stemmed = Index.build(docs, stem=True, positions=True)
    assert {r.term: r.ttf for r in stemmed.terms.collect()} == {"run": 4, "easili": 1, "he": 1, "she": 1, "ran": 1, "runner": 1}
    assert [list(r.positions) for r in stemmed.postings.where("term = 'run' and doc_id = 1").collect()] == [[1, 2]]
    with_head = Index.build(ix.field_text(docs, True))
    assert {r.term for r in with_head.terms.collect()} >= {"heads", "the", "head"} and whole.vocabulary < with_head.vocabulary
    assert Index.build(ix.field_text(docs, False)).vocabulary == whole.vocabulary


def test_ngrams_and_covering_spans(spark):
    import itertools
    import random

    r = random.Random(1)
    docs = spark.createDataFrame([(d, " ".join(r.choice("abcde") for _ in range(25))) for d in range(30)], "doc_id long, text string")
    terms = ranking.topic_terms(spark.createDataFrame([(1, "a b c a"), (2, "d"), (3, "a a b")], "query_id long, text string"))
    assert [tuple(x.gram) for x in ranking.ngrams(terms, 3).orderBy("query_id", "pos").collect()] == [("a", "b", "c"), ("b", "c", "a"), ("a", "a", "b")]
    got = {(x.pos, x.doc_id): x.span for x in ranking.ngram_spans(Index.build(docs, positions=True), terms, 3).collect()}
    texts = {d.doc_id: d.text.split() for d in docs.collect()}
    want = {}
    for pos, gram in ((1, "abc"), (2, "bca")):
        for d, w in texts.items():
            places = [[k for k, x in enumerate(w) if x == g] for g in gram]
            if all(places):
                want[pos, d] = min(max(c) - min(c) for c in itertools.product(*places))
    assert got == want


def test_report_has_all_parts(spark):
    run = spark.createDataFrame([(1, d, 10.0 - d) for d in range(6)] + [(2, d, 5.0 - d) for d in range(3)], "query_id long, doc_id long, score double")
    qrels = spark.createDataFrame([(1, 0, 1), (1, 3, 1), (1, 99, 1), (2, 1, 1)], "query_id long, doc_id long, rel int")
    rows = evaluation.report_lines(evaluation.judged(run, qrels)).orderBy("query_id", "n").collect()
    text = {q: [x.line for x in rows if x.query_id == q] for q in ("1", "2", None)}
    assert len({len(v) for v in text.values()}) == 1 and len(text["1"]) == 5 + 11 + 2 + 9 + 2
    assert text["1"][:4] == ["Queryid: 1", "Retrieved: 6", "Relevant: 3", "Rel_ret: 2"] and "at 5 docs: 0.4000 0.6667 0.5000" in text["1"] and "Average precision: 0.5000" in text["1"]
    assert text["2"][16] == "Average precision: 0.5000" and text[None][:4] == ["Queryid: all", "Retrieved: 9", "Relevant: 4", "Rel_ret: 3"] and "at 0.00 0.7500" in text[None]
