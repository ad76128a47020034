"""Edge and crawled-URL tables: batched inserts, look-ups and reports, as the relational store has them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_rows(edges: DataFrame) -> DataFrame:
    """(src, src_hash, dest, dest_hash, is_active)."""
    return edges.select("src", F.md5("src").alias("src_hash"), F.col("dst").alias("dest"), F.md5("dst").alias("dest_hash"), F.lit(1).alias("is_active"))


def to_xml(edges: DataFrame, batch: str) -> DataFrame:
    """(batch, xml): a batch of edges as <edges><edge><src/><dest/></edge></edges>."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    edge = F.concat(F.lit("<edge><src>"), esc(F.col("src")), F.lit("</src><dest>"), esc(F.col("dst")), F.lit("</dest></edge>"))
    return edges.groupBy(batch).agg(F.concat(F.lit("<edges>"), F.array_join(F.sort_array(F.collect_list(edge)), ""), F.lit("</edges>")).alias("xml"))


def from_xml(batches: DataFrame, batch: str) -> DataFrame:
    """(batch, src, dst) of such batches."""
    both = F.arrays_zip(F.xpath("xml", F.lit("/edges/edge/src/text()")).alias("src"), F.xpath("xml", F.lit("/edges/edge/dest/text()")).alias("dst"))
    return batches.select(batch, F.inline(both))


def with_crawled_flag(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    known = crawled.select(F.md5("url").alias("dest_hash"), F.lit(True).alias("k")).distinct()
    return edges.join(known, "dest_hash", "left").withColumn("is_crawled", F.col("k").isNotNull()).drop("k")


def in_link_ranking(edges: DataFrame, crawled: DataFrame) -> DataFrame:
    """(url, inlinks) of crawled URLs, most linked first."""
    counts = edges.groupBy("dest").agg(F.count("*").alias("inlinks"))
    return crawled.select(F.col("url").alias("dest")).distinct().join(counts, "dest").select(F.col("dest").alias("url"), "inlinks").orderBy(F.desc("inlinks"), "url")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dest").agg(F.count("*").alias("n")).where("n > 1")


def distinct_edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("src", "dest").alias("n_edges"), F.count("*").alias("n_rows"))


def insert_new(urls: DataFrame, existing: DataFrame) -> DataFrame:
    """URLs that the table lacks, with their hash, ready to be appended."""
    return urls.select("url").distinct().join(existing.select("url"), "url", "left_anti").select("url", F.md5("url").alias("url_hash"), F.lit(1).alias("is_active"))


def allocate_ids(urls: DataFrame, existing: DataFrame, start: int | None = None) -> DataFrame:
    """(url, id): known ids, and ids above the largest for URLs that have none.

    New ids ascend within partitions of a range-partitioned table, so no single task numbers all URLs.
    """
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if start is None else start
    new = urls.select("url").distinct().join(existing, "url", "left_anti").repartitionByRange("url").sortWithinPartitions("url")
    return existing.select("url", "id").unionByName(new.select("url", (F.monotonically_increasing_id() + last + 1).alias("id")))
