import pandas as pd

from gristmill.streaming import crawl
from pyspark.sql import functions as F


def test_limit_rows_moves_the_clock_on_every_hit():
    rows = pd.DataFrame({"key": 1, "id": [0, 1, 2], "ts_us": [0, 500_000, 1_400_000]})
    last, out = crawl.limit_rows(None, rows, 1_000_000)
    assert out.limited.tolist() == [False, True, True] and last == 1_400_000
    assert crawl.limit_rows(last, rows.assign(ts_us=[2_400_000, 2_400_001, 9_000_000]), 1_000_000)[1].limited.tolist() == [False, True, False]


def test_mapper_routes_and_requeues(spark, tmp_path):
    src = str(tmp_path / "in")
    crawl.seed(spark, ["http://a/1", "http://b/2", "http://a/3"]).write.text(src)
    stream = spark.readStream.text(src)
    q = crawl.start_mapper(stream, str(tmp_path / "out"), str(tmp_path / "back"), str(tmp_path / "ck"), lambda df: df.withColumn("kept", ~F.col("url").endswith("3")))
    q.awaitTermination()
    assert crawl.status(q)["batch"] is not None
    out = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.url for r in out.collect()) == ["http://a/1", "http://b/2"] and spark.read.text(str(tmp_path / "back")).count() == 1


def test_pages_that_cannot_be_parsed_are_set_aside(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<title>x</title>"), (2, "no url", "x"), (3, "http://b/", None)], "page_id long, url string, html string")
    good, bad = crawl.process_pages(pages)
    assert [r.title for r in good.collect()] == ["x"] and sorted(r.page_id for r in bad.collect()) == [2, 3]


def test_stream_with_watermark_and_stop(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(5).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    assert crawl.drain(crawl.deduplicated_stream(stream, "k", "ts"), "t_wm").count() == 2
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start()
    crawl.run_until(q, lambda: 10, 5)
    assert not q.isActive


def test_mapper_carries_over_and_holds_back(spark, tmp_path):
    """A micro-batch of limited size; one message a domain within the delay, the others back to the frontier, held-back ones first."""
    src, out, back = (str(tmp_path / n) for n in ("in", "out", "back"))
    crawl.seed(spark, [f"http://a/{k}" for k in range(4)] + ["http://b/1", "http://c/1"]).coalesce(1).write.text(src)
    q = crawl.start_mapper(spark.readStream.text(src), out, back, str(tmp_path / "ck"), lambda df: df.withColumn("kept", F.lit(True)), batch_size=5, delay_seconds=60, last_access=str(tmp_path / "last"))
    q.awaitTermination()
    done = sorted(r.url for r in spark.read.json(out).collect())
    again = [r.m for r in spark.read.text(back).select(crawl.parse_message(F.col("value")).alias("m")).collect()]
    assert done == ["http://a/0", "http://b/1"]
    assert sorted((m.url, bool(m.rate_limited)) for m in again) == [("http://a/1", True), ("http://a/2", True), ("http://a/3", True), ("http://c/1", False)]
    first = [r.value for r in crawl.requeued(spark.createDataFrame([("u", 1, False), ("v", 1, True)], "url string, wave int, rate_limited boolean")).collect()]
    assert '"v"' in first[0]


def test_processor_parses_filters_and_marks(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "crawl")
    page = '<title>T</title><a href="/next">good</a> <a href="http://bad.example/x">y</a> <a href="/skip">spam word</a>'
    pages = spark.createDataFrame([(1, "http://a/", page), (2, "http://b/", None), (3, "http://c/", page)], "page_id long, url string, html string")
    crawl.seed(spark, ["http://a/", "http://b/", "http://zz/"]).write.text(src)
    run = lambda: crawl.start_processor(crawl.route(spark.readStream.text(src)), pages, folder, str(tmp_path / "ck"), ["bad.example"], ["spam"]).awaitTermination()
    run()
    crawl.seed(spark, ["http://a/", "http://c/"]).write.mode("append").text(src)
    run()
    read = lambda n: spark.read.json(f"{folder}/{n}")
    assert sorted((r.url, r.title) for r in read("pages").collect()) == [("http://a/", "T"), ("http://c/", "T")] and [r.url for r in read("quarantine").collect()] == ["http://b/"]
    assert sorted({(r.src, r.dst) for r in read("edges").collect()}) == sorted((f"http://{h}/", d) for h in "ac" for d in (f"http://{h}/next", "http://bad.example/x", f"http://{h}/skip"))
    fresh = [r.m for r in spark.read.text(f"{folder}/frontier").select(crawl.parse_message(F.col("value")).alias("m")).collect()]
    assert sorted((m.url, m.wave) for m in fresh) == [("http://a/next", 1), ("http://c/next", 1)]
    assert sorted(r.url for r in spark.read.parquet(f"{folder}/crawled").collect()) == ["http://a/", "http://b/", "http://c/"]
    crawl.refresh(spark, [folder], ["http://s/"], str(tmp_path / "q"))
    assert not (tmp_path / "crawl").exists() and spark.read.text(str(tmp_path / "q")).count() == 1
