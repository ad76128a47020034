"""Crawl frontier: link filters, similarity to topics, in-link counts, scores and the keep-or-requeue cascade."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard
from .ranking import small

RATE_SLACK_US = 100
MOST_RULES = 1_000_000


def contains_any(column: Column, parts: Iterable[str]) -> Column:
    """Whether the lower-cased column contains one of the parts, as they are written (an upper-case part never matches)."""
    low = F.lower(column)
    hit = F.lit(False)
    for p in parts:
        hit = hit | low.contains(p)
    return hit


def domain_kept(domain: Column, blacklist: Iterable[str]) -> Column:
    return ~contains_any(domain, blacklist)


def keywords_kept(anchor: Column, url: Column, blacklist: Iterable[str]) -> Column:
    return ~(contains_any(anchor, blacklist) | contains_any(url, blacklist))


def filtered_outlinks(links: DataFrame, domains: Iterable[str], keywords: Iterable[str]) -> DataFrame:
    return links.where(domain_kept(F.col("domain"), domains)).where(keywords_kept(F.col("anchor"), F.col("url"), keywords))


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds kept: whether the row is the first of its key in the given order (of rows equal in it, each is).

    The first of a key is a partial aggregate, joined back as a row of its own, so a hot key is in no task as a whole.
    """
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_f")).select(F.col(key).alias("_key"), *[F.col(f"_f.{c}").alias(f"_{c}") for c in order])
    same = F.col(key).eqNullSafe(F.col("_key"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(first, same, "left").withColumn("kept", F.col(f"_{order[0]}").isNotNull()).drop("_key", *[f"_{c}" for c in order])


def not_crawled(rows: DataFrame, crawled: DataFrame, key: str = "url") -> DataFrame:
    """Exact membership test by anti-join, which Spark may speed up by a runtime Bloom filter."""
    return rows.join(crawled.select(key).distinct(), key, "left_anti")


def anchor_similarity(anchor: Column, topics: Iterable[str], exact: bool = False) -> Column:
    return jaccard(F.split(anchor, " "), F.array(*map(F.lit, topics)), exact)


def url_similarity(url: Column, topics: Iterable[str], exact: bool = False) -> Column:
    """Tokens of a URL are what lies between signs and underscores, lower-cased (empty ones count, as in a plain split)."""
    return jaccard(F.split(F.lower(url), r"[^\p{L}\p{N}]"), F.array(*map(F.lit, topics)), exact)


def relevance_counts(links: DataFrame, topics: Iterable[str]) -> DataFrame:
    """(url, relevance): links whose anchor or URL similarity, in whole tenths, is above one."""
    topics = list(topics)
    best = F.greatest(anchor_similarity(F.col("anchor"), topics), url_similarity(F.col("url"), topics))
    return links.where((best * 10).cast("int") > 1).groupBy("url").agg(F.count("*").alias("relevance"))


def in_link_counts(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg(F.count("*").alias("inlinks"))


def frontier_scores(urls: DataFrame, url_counts: DataFrame, domain_counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds score: url in-links + normalised domain in-links + normalised 1 / domain rank; unknown domains have the largest rank.

    The norms are over the whole batch: sums of squares, aggregated once and broadcast as one row.
    """
    most = ranks.agg(F.coalesce(F.max("rank"), F.lit(1)).alias("max_rank"))
    rows = urls.join(url_counts.select("url", F.col("inlinks").alias("url_in")), "url", "left").join(domain_counts.select("domain", F.col("inlinks").alias("domain_in")), "domain", "left").join(ranks.select("domain", "rank"), "domain", "left").crossJoin(F.broadcast(most))
    rows = rows.withColumn("url_in", F.coalesce("url_in", F.lit(0))).withColumn("domain_in", F.coalesce("domain_in", F.lit(0))).withColumn("inverse", 1.0 / F.coalesce("rank", "max_rank"))
    norms = rows.agg(F.sqrt(F.sum(F.col("domain_in") * F.col("domain_in"))).alias("nd"), F.sqrt(F.sum(F.col("inverse") * F.col("inverse"))).alias("nr"))
    unit = lambda x, n: F.when(F.col(n) == 0, F.col(x).cast("double")).otherwise(F.col(x) / F.col(n))
    scored = rows.crossJoin(F.broadcast(norms))
    return scored.withColumn("score", F.round(F.col("url_in") + unit("domain_in", "nd") + unit("inverse", "nr"), 6)).drop("nd", "nr", "max_rank")


def cascade(batch: DataFrame, crawled: DataFrame, relevance: DataFrame, url_counts: DataFrame, domain_counts: DataFrame, ranks: DataFrame, best: int = 400) -> DataFrame:
    """(url, reason) of every uncrawled URL of a batch (url, domain, wave, rate_limited): early, relevant, scored, or requeue.

    Early are waves 0 and 1 and rate-limited URLs; of the rest, those with a relevance entry stay, then the ``best`` by score
    (ties: the larger URL). What is left goes back to the queue.
    """
    rows = not_crawled(batch, crawled)
    early = (F.col("wave") <= 1) | F.coalesce(F.col("rate_limited"), F.lit(False))
    known = relevance.select("url", F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, "url", "left").withColumn("reason", F.when(early, F.lit("early")).when(F.col("_known"), F.lit("relevant"))).drop("_known")
    rest = frontier_scores(rows.where("reason is null").select("url", "domain"), url_counts, domain_counts, ranks)
    chosen = rest.orderBy(F.desc("score"), F.desc("url")).limit(best).select("url", F.lit(True).alias("_best")).distinct()
    return rows.join(chosen, "url", "left").select("url", F.coalesce("reason", F.when(F.col("_best"), F.lit("scored")).otherwise(F.lit("requeue"))).alias("reason"))


def queue_of(domain: Column, queues: int = 10) -> Column:
    """Sticky: a domain always has the same queue."""
    return F.pmod(F.xxhash64(domain), F.lit(queues)).cast("int")


def round_robin(position: Column, queues: int = 10) -> Column:
    return F.pmod(position - 1, F.lit(queues)).cast("int")


def rate_limited(hits: DataFrame, key: str, ts: str, order: str, delay_seconds: float = 1.0, span_seconds: int = 86_400) -> DataFrame:
    """Adds limited: less than the delay (minus 0.1 ms) since the key's previous hit, limited or not.

    Hits are ordered within spans of time, so a key with very many hits is dealt to many tasks; the first hit of a span
    takes the last time of the key's span before, from one row per key and span.
    """
    rows = hits.withColumn("_span", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / span_seconds))
    last = rows.groupBy(key, "_span").agg(F.max(ts).alias("_last"))
    last = last.select(key, "_span", F.lag("_last").over(Window.partitionBy(key).orderBy("_span")).alias("_before"))
    own = F.lag(ts).over(Window.partitionBy(key, "_span").orderBy(ts, order))
    gap = F.timestamp_diff("MICROSECOND", F.coalesce("_own", "_before"), F.col(ts))
    joined = rows.withColumn("_own", own).join(last, [key, "_span"])
    return joined.withColumn("limited", F.coalesce(gap < int(delay_seconds * 1_000_000) - RATE_SLACK_US, F.lit(False))).drop("_span", "_own", "_before")


def gates(rows: DataFrame, robots: DataFrame, crawled: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Rows that may be processed: allowed by robots (host, prefix), HTML, and not redirected to a crawled URL.

    Robots rules are broadcast, if there are at most ``most``. Of more, only those of hosts with at least a 500th of the rows
    are (in turn if at most ``most``), as such hosts would fill a task; the others are joined by shuffle.
    """
    hits = rows.select("host", "path", "url")
    if robots.limit(most + 1).count() <= most:
        ruled = hits.join(F.broadcast(robots), "host")
    else:
        hosts = hits.where("host is not null").groupBy("host").count()
        hot = F.broadcast(hosts.crossJoin(F.broadcast(hosts.agg(F.sum("count").alias("total")))).where("count * 500 >= total").select("host"))
        ruled = hits.join(small(robots.join(hot, "host", "left_semi"), most), "host").unionByName(hits.join(hot, "host", "left_anti").join(robots, "host"))
    banned = ruled.where(F.col("path").startswith(F.col("prefix"))).select("url").distinct()
    return rows.where(F.lower("content_type").startswith("text/html")).join(banned, "url", "left_anti").join(crawled.select(F.col("url").alias("redirected_url")).distinct(), "redirected_url", "left_anti")
