"""Crawl streams: rate limiting with state per domain, running counts, deduplication, routing and requeueing."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.frontier import RATE_SLACK_US, queue_of
from ..operators.shared import children, delete, shared_folder, written
from ..sources.corpus import message, parse_message

HITS = "key bigint, id bigint, ts_us bigint"


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def limit_rows(last: int | None, rows: pd.DataFrame, delay_us: int) -> tuple[int | None, pd.DataFrame]:
    """(new last access, rows with limited): rows of one domain in time order; every hit resets the clock."""
    rows = rows.sort_values(["ts_us", "id"], kind="stable")
    before = rows["ts_us"].shift(1)
    if last is not None and len(rows):
        before.iloc[0] = last
    limited = (rows["ts_us"] - before) < delay_us - RATE_SLACK_US
    return (int(rows["ts_us"].iloc[-1]) if len(rows) else last), rows.assign(limited=limited.fillna(False).astype(bool))


def rate_limited_stream(hits: DataFrame, delay_seconds: float = 1.0) -> DataFrame:
    """(key, id, ts_us, limited) of a stream (key, id, ts_us) whose files arrive in time order.

    State is kept with applyInPandasWithState, one timestamp per key; needs no state-store column families. A micro-batch's hits of a
    key are put in order together, which the size of micro-batches (files per trigger) bounds; without a stream, ``frontier.rate_limited``
    has no such bound.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    delay = int(delay_seconds * 1_000_000)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        last, out = limit_rows(last, pd.concat(list(parts), ignore_index=True), delay)
        if last is not None:
            state.update((last,))
        yield out[["key", "id", "ts_us", "limited"]]

    return hits.groupBy("key").applyInPandasWithState(run, HITS + ", limited boolean", "ts_us bigint", "append", GroupStateTimeout.NoTimeout)


def counts_stream(links: DataFrame, key: str) -> DataFrame:
    """Running in-link counts, for outputMode("update") or "complete"."""
    return links.groupBy(key).agg(F.count("*").alias("inlinks"))


def deduplicated_stream(rows: DataFrame, key: str, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key once; with an event time the state is bounded by a watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts else rows.dropDuplicates([key])


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns its rows, which are written as Parquet below the shared folder.

    In mode "complete" every micro-batch replaces the rows; a batch that is run again replaces its own.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch_id}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = children(spark, f"{path}/rows")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows") if found else spark.createDataFrame([], stream.schema)


def route(messages: DataFrame, queues: int = 10) -> DataFrame:
    """Frontier messages with their queue (by domain) and priority: rate-limited ones go first."""
    m = messages.select(parse_message(F.col("value")).alias("m")).select("m.*")
    domain = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return m.withColumn("domain", domain).withColumn("queue", queue_of(domain, queues)).withColumn("priority", F.coalesce("rate_limited", F.lit(False)).cast("int"))


def requeued(rows: DataFrame) -> DataFrame:
    """Messages of rows (url, wave, rate_limited), those that a rate limit held back first, so that they are read first."""
    return rows.orderBy(F.coalesce("rate_limited", F.lit(False)).desc()).select(message(F.col("url"), F.col("wave"), F.col("rate_limited")).alias("value"))


def start_mapper(messages: DataFrame, out: str, requeue: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame], queues: int = 10, batch_size: int | None = None, delay_seconds: float | None = None, last_access: str | None = None) -> StreamingQuery:
    """The mapper: every micro-batch is routed, what ``keep`` flags as kept goes to its queue's folder, the rest back to the frontier.

    With ``batch_size`` at most that many messages of a micro-batch are worked on, held-back ones first; the others are carried over through
    the frontier. With ``delay_seconds`` a message is held back if its domain was accessed less than that before; last accesses per domain
    are a Parquet table at ``last_access``, and all times are those of the micro-batch. Everything is written after the work (at least once).
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = route(batch, queues)
        if batch_size is not None:
            first = rows.orderBy(F.desc("priority"), "wave", "url").withColumn("_n", F.monotonically_increasing_id())
            rows = written(first)
            inside = written(rows.orderBy("_n").limit(batch_size))
            carried, rows = rows.join(inside.select("_n"), "_n", "left_anti").drop("_n"), inside.drop("_n")
            requeued(carried).write.mode("append").text(requeue)
        if delay_seconds is not None:
            now = F.unix_micros(F.current_timestamp())
            order = Window.partitionBy("domain").orderBy(F.desc("priority"), "url")
            seen = spark.read.parquet(last_access) if children(spark, last_access) else spark.createDataFrame([], "domain string, ts_us bigint, batch bigint")
            last = seen.groupBy("domain").agg(F.max("ts_us").alias("last_us"))
            rows = written(rows.join(last, "domain", "left").withColumn("_turn", F.row_number().over(order)).withColumn("rate_limited", (F.col("_turn") > 1) | F.coalesce(now - F.col("last_us") < int(delay_seconds * 1_000_000) - RATE_SLACK_US, F.lit(False))).drop("_turn", "last_us"))
            rows.where("NOT rate_limited").select("domain", now.alias("ts_us"), F.lit(batch_id).cast("bigint").alias("batch")).write.mode("append").parquet(last_access)
            requeued(rows.where("rate_limited")).write.mode("append").text(requeue)
            rows = rows.where("NOT rate_limited")
        rows = written(keep(rows))
        rows.where("kept").drop("kept").write.mode("append").partitionBy("queue").json(out)
        requeued(rows.where("NOT kept")).write.mode("append").text(requeue)

    return messages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_processor(messages: DataFrame, pages: DataFrame, folder: str, checkpoint: str, domains: list[str] = (), keywords: list[str] = ()) -> StreamingQuery:
    """The processor: a stream of routed messages (url, wave) against a table of pages (page_id, url, html), micro-batch by micro-batch.

    Messages of URLs that are in ``folder``/crawled are dropped; the pages of the others are parsed, and written are: parsed pages (pages), those that
    cannot be parsed (quarantine), edges (edges), messages of the filtered out-links with the next wave (frontier), and at last the URLs as
    crawled. A batch that fails before that is run again (at least once); its files carry the batch number and are replaced.
    """
    from ..operators.frontier import filtered_outlinks
    from ..operators.links import canonical, host, outlinks, resolve

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = children(spark, f"{folder}/crawled")
        crawled = spark.read.parquet(f"{folder}/crawled") if names else spark.createDataFrame([], "url string")
        if f"batch={batch_id}" in names:
            crawled = crawled.where(F.col("batch") != batch_id)
        due = batch.groupBy("url").agg(F.min("wave").alias("wave")).join(crawled.select("url"), "url", "left_anti")
        fetched = written(pages.join(due, "url"))
        good, bad = process_pages(fetched)
        put = lambda df, name: df.write.mode("overwrite").json(f"{folder}/{name}/batch={batch_id}")
        put(good, "pages")
        put(bad, "quarantine")
        links = written(outlinks(good.select("page_id", "url", "html")).join(due, "url").select("page_id", canonical(F.col("url")).alias("src"), resolve(F.col("url"), F.col("href")).alias("url"), "anchor", "wave"))
        put(links.select("src", F.col("url").alias("dst")).distinct(), "edges")
        fresh = filtered_outlinks(links.withColumn("domain", host(F.col("url"))), domains, keywords).groupBy("url").agg(F.min("wave").alias("wave"))
        fresh.select(message(F.col("url"), F.col("wave") + 1).alias("value")).write.mode("overwrite").text(f"{folder}/frontier/batch={batch_id}")
        fetched.select("url").distinct().write.mode("overwrite").parquet(f"{folder}/crawled/batch={batch_id}")

    return messages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed pages with links, quarantined pages): a page that cannot be parsed is set aside instead of stopping the rest."""
    from ..operators.links import meta_description, meta_keywords, plain_text, title

    html = F.col("html")
    good = html.isNotNull() & F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    parsed = pages.where(good).select("*", title(html).alias("title"), plain_text(html).alias("cleaned_text"), meta_keywords(html).alias("meta_keywords"), meta_description(html).alias("meta_description"))
    return parsed, pages.where(~F.coalesce(good, F.lit(False)))


def seed(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Seed messages of wave 0."""
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return rows.select(message(F.col("url"), F.lit(0)).alias("value"))


def status(query: StreamingQuery) -> dict:
    """Progress of a stream in brief."""
    p = query.lastProgress
    return {"active": query.isActive, "batch": p["batchId"] if p else None, "rows": p["numInputRows"] if p else 0}


def refresh(spark: SparkSession, folders: list[str], urls: list[str], queue: str) -> None:
    """Empties the folders of queues and state and seeds the queue anew."""
    for f in folders:
        delete(spark, f)
    seed(spark, urls).write.mode("append").text(queue)


def give_back(rows: DataFrame, requeue: str) -> None:
    """On stopping: what a mapper still holds back goes to the frontier."""
    requeued(rows).write.mode("append").text(requeue)


def stop_on_signal(query: StreamingQuery, after: Callable[[], None] = lambda: None) -> None:
    """Interrupt and termination signals stop the stream after the batch in hand, then run ``after``; progress stays in the checkpoint."""

    def stop(signum, frame) -> None:
        query.stop()
        after()

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, stop)


def run_until(query: StreamingQuery, crawled: Callable[[], int], most: int, poll_seconds: float = 1.0) -> None:
    """Stops the stream, after the batch in hand, once ``crawled()`` reaches ``most``; progress stays in the checkpoint."""
    while query.isActive and crawled() < most:
        query.awaitTermination(poll_seconds)
    query.stop()
