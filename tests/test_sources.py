import pytest
from pyspark.sql import functions as F

from gristmill.operators import index
from gristmill.sources import codecs, corpus


def write(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_text(text, encoding=encoding)
    return str(tmp_path / name)


def test_trec(spark, tmp_path):
    doc = "<DOC>\n<DOCNO> AP1 </DOCNO>\n<HEAD>Title é</HEAD>\n<HEAD>Two</HEAD>\n<TEXT>\nfirst line\nsecond\n</TEXT>\n<TEXT>\nthird one\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO> AP2 </DOCNO>\n</DOC>\n"
    rows = {r.doc_id: r for r in corpus.read_trec(spark, write(tmp_path, "c", doc, "latin-1")).collect()}
    assert rows["AP1"].text == "first line\nsecond\nthird one" and rows["AP1"].head == "Title é\nTwo" and rows["AP1"].length == 2 and rows["AP2"].text is None
    with pytest.raises(Exception, match="without id or text"):
        corpus.sane(corpus.read_trec(spark, str(tmp_path / "c"))).collect()


def test_topics(spark, tmp_path):
    p = write(tmp_path, "t", "89.    Investment by Opec\n\n51.   Airbus.   Lost tail\n")
    assert sorted(tuple(r) for r in corpus.read_topics(spark, p).collect()) == [("51", "airbus"), ("89", " investment by opec")]


def test_qrels_and_runs(spark, tmp_path):
    q = write(tmp_path, "q", "﻿1\tx\td1\t2\n1 x d2 0\n")
    assert sorted(tuple(r) for r in corpus.read_qrels(spark, q).collect()) == [("1", "d1", 1, 2), ("1", "d2", 0, 0)]
    r = write(tmp_path, "r", "1 Q0 d1 1 3.5 Exp\n1 Q0 d1 2 2.5 Exp\n")
    assert [tuple(x) for x in corpus.read_run(spark, r).collect()] == [("1", "d1", 2.5)]


def test_small_files(spark, tmp_path):
    assert corpus.read_words(spark, write(tmp_path, "s", " The \nand\n\n")) == ["and", "the"]
    ranks = corpus.read_domain_ranks(spark, write(tmp_path, "d.csv", "GlobalRank,TldRank,Domain\n9,1,wikipedia.org\n1,1,facebook.com\n"))
    assert {r.domain: (r.rank, r.tld_rank) for r in ranks.collect()} == {"wikipedia.org": (9, 1), "facebook.com": (1, 1)}
    e = corpus.read_edges(spark, write(tmp_path, "e.csv", "a,h,b\nc,h,d\n"), write(tmp_path, "e.json", '["a","b"]\n["x","y"]\n'))
    assert {tuple(r) for r in e.collect()} == {("a", "b"), ("c", "d"), ("x", "y")}
    urls = corpus.read_crawled_urls(spark, {write(tmp_path, "u1", "u,1\nv,2\n"): 0, write(tmp_path, "u2", "1,v\n2,w\n"): 1})
    assert sorted(r.url for r in urls.collect()) == ["u", "v", "w"]
    assert corpus.random_user_agent(spark, write(tmp_path, "ua", "A\nB\n")).count() == 1


def test_spam_labels(spark, tmp_path):
    p = write(tmp_path, "l", "spam ../data/inmail.1\nham ../data/inmail.2\n")
    assert sorted(tuple(r) for r in corpus.read_spam_labels(spark, p).collect()) == [(0, "inmail.2"), (1, "inmail.1")]
    with pytest.raises(Exception, match="unknown label"):
        corpus.read_spam_labels(spark, write(tmp_path, "l2", "maybe x/y\n")).collect()


def test_mail(spark, tmp_path):
    raw = "Subject: =?utf-8?q?H=C3=A9llo?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nplain part\n--B\nContent-Type: text/html\n\n<p>rich &amp; <b>bold</b></p>\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\n\nsecret\n--B--\n"
    write(tmp_path, "m1", raw)
    r = corpus.read_mail(spark, str(tmp_path)).first()
    assert (r.file_name, r.subject) == ("m1", "Héllo") and "plain part" in r.body and "rich & bold" in r.body and "secret" not in r.body


def test_crawled_pages(spark, tmp_path):
    write(tmp_path, "p.json", '{"url": "http://a/", "crawled_time": "01-02-2020-03:04:05.000006", "headers": {"k": "v"}, "meta_keywords": ["x"], "wave": 1}')
    r = corpus.read_crawled(spark, str(tmp_path)).first()
    assert r.crawled_at.month == 2 and r.headers == {"k": "v"} and r.wave == 1


def test_codecs(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    p = index.postings(index.token_table(docs))
    v = codecs.nested(p)
    lines = {r.term: r.line for r in codecs.to_delimited(v).collect()}
    assert lines["a"] == "2!1,2,1@3" and lines["b"] == "2!1,1,2!2,1,1"
    for write_, read in codecs.SERIALIZERS.values():
        assert {r.term: (r.ttf, r.tf["1"].pos) for r in read(write_(v)).collect()} == {"a": (2, [1, 3]), "b": (2, [2])}
    with pytest.raises(ValueError):
        codecs.component(codecs.TOKENIZERS, "none such")


def test_lines_and_features(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "line string")
    for c in ("none", "gzip"):
        corpus.write_lines(df, str(tmp_path / c), c)
        assert spark.read.text(str(tmp_path / c)).first()[0] == "x"
    from pyspark.ml.linalg import Vectors

    corpus.write_features(spark.createDataFrame([(1, Vectors.sparse(3, [0, 2], [1.0, 2.0]))], ["label", "features"]), str(tmp_path / "f"))
    assert corpus.read_features(spark, str(tmp_path / "f"), 3).first().features.toArray().tolist() == [1.0, 0.0, 2.0]


def test_robots_rules_and_delays(spark):
    body = "User-agent: x\nUser-agent: *\nDisallow: /a # no\nDisallow: /b\nAllow: /b\nCrawl-delay: 2.5\n\nUser-Agent: mine\nDisallow:\nDisallow: /m\ncrawl-delay: soon\n"
    files = spark.createDataFrame([("h", body), ("empty", ""), ("none", None)], "host string, body string")
    rules, delays = corpus.parse_robots(files)
    assert [(r.host, r.prefix) for r in rules.collect()] == [("h", "/a")]
    assert {r.host: r.delay for r in delays.collect()} == {"h": 2.5, "empty": 1.0, "none": 1.0}
    rules, delays = corpus.parse_robots(files, "Mine", 3.0)
    assert [(r.host, r.prefix) for r in rules.collect()] == [("h", "/m")] and {r.delay for r in delays.collect()} == {3.0}


def test_batches_names_and_sets(spark):
    rows = spark.range(23).select(F.col("id").alias("k")).repartition(5)
    for args, want in (({"batches": 4}, [6, 6, 6, 5]), ({"size": 10}, [10, 10, 3]), ({"batches": 30}, [1] * 23)):
        got = corpus.batch_number(rows, "k", **args).collect()
        sizes = {}
        for r in sorted(got):
            sizes.setdefault(r.batch, []).append(r.k)
        assert [len(sizes[b]) for b in range(len(want))] == want and sum((sizes[b] for b in range(len(want))), []) == list(range(23))
    assert corpus.batch_number(rows.limit(0), "k", 3).count() == 0
    corpus.disjoint(rows.where("k < 3"), rows.where("k > 5"))
    with pytest.raises(ValueError):
        corpus.disjoint(rows, rows)
    assert len({corpus.stamped_name(".json") for _ in range(50)}) == 50


def test_pages_are_written_and_indexed(spark, tmp_path):
    pages = spark.createDataFrame([("http://a", "red fox", 1), ("http://b", "red dog", 2)], "url string, cleaned_text string, wave int")
    corpus.write_crawled(pages, str(tmp_path / "p"), "1")
    corpus.write_crawled(pages, str(tmp_path / "p"), "1")
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    first = corpus.index_crawled(pages.limit(1), str(tmp_path / "i"))
    both = corpus.index_crawled(pages.where("wave = 2"), str(tmp_path / "i"), str(tmp_path / "i"))
    assert (first.n_docs, both.n_docs, both.vocabulary) == (1, 2, 3) and {r.term: r.df for r in both.terms.collect()} == {"red": 2, "fox": 1, "dog": 1}


def test_features_mail_and_scores(spark, tmp_path):
    f = spark.createDataFrame([(1, 2, 0.5, 1.0, 2.0, -3.0, -4.0)], "query_id long, doc_id long, " + ", ".join(f"{n} double" for n in corpus.FEATURES))
    lab = spark.createDataFrame([(1, 2, 1)], "query_id long, doc_id long, label int")
    corpus.write_feature_json(f, lab, str(tmp_path / "f"))
    back = corpus.read_feature_json(spark, str(tmp_path / "f"))
    assert [x.collect() for x in back] == [f.collect(), lab.collect()]
    mail = spark.createDataFrame([("a", "s", "b"), ("c", "s", "b")], "file_name string, subject string, body string")
    assert [(r.file_name, r.label) for r in corpus.labelled_mail(mail, spark.createDataFrame([(1, "a")], "label int, file_name string")).collect()] == [("a", 1)]
    corpus.write_scores_csv(spark.createDataFrame([("x", 1.5)], "id string, score double"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["id", "score"]


def test_outside_calls_are_tried_again(capsys):
    from gristmill.operators.shared import retried, timed

    seen = []

    @timed
    @retried(3, 0)
    def call(n):
        seen.append(n)
        if len(seen) < n:
            raise OSError("not yet")
        return len(seen)

    assert call(3) == 3 and "call took 0:00:00." in capsys.readouterr().out
    seen.clear()
    with pytest.raises(OSError):
        call(9)
    assert len(seen) == 3
