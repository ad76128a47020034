"""The registered queries' inputs from the driver's tables, and the parameters they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import links, ranking
from ..operators.index import Index
from ..operators.shared import written

# Parameters of the frontier queries.
KEYWORDS = "the and of to in is that for are with was this from by at on or be it as an a".split()
URL_TOPICS = "http https com en example".split()
DOMAIN_BLACKLIST = ("m.", "example.org", "www.")
KEYWORD_BLACKLIST = ("tion", "ing", "BookSources")
DELAY_SECONDS = 3600.0
DAMPING = 0.85

_kept: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, distinct_dl: bool = False, positions: bool = False) -> Index:
    """The index of documents, built once per session and folder, as a search system keeps its index."""
    key = (spark.sparkContext.applicationId, sf_dir, distinct_dl, positions)
    if key not in _kept:
        docs = table(spark, sf_dir, "documents")
        cores = spark.sparkContext.defaultParallelism
        # Fewer files than cores: the long texts are dealt out before they are analysed.
        docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
        _kept[key] = Index.build(docs, distinct_dl=distinct_dl, positions=positions)
    return _kept[key]


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, pos, term): every benchmark item is a topic, with all its tokens."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ranking.topic_terms(items)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel): every labelled document is judged for the topic that its id falls to."""
    n = table(spark, sf_dir, "benchmark").count()
    return table(spark, sf_dir, "labels").select(F.pmod("doc_id", F.lit(n)).alias("query_id"), "doc_id", F.col("quality").alias("rel"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(index(spark, sf_dir), topics(spark, sf_dir), "bm25")


def outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, src, dst, domain, anchor) of every anchor."""
    found = links.outlinks(table(spark, sf_dir, "pages"))
    return found.select("page_id", "pos", links.canonical(F.col("url")).alias("src"), links.resolve(F.col("url"), F.col("href")).alias("dst"), "href", "anchor").withColumn("domain", links.host(F.col("dst")))


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(links.canonical(F.col("url")).alias("url")).distinct()


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): page URL to link target as written; every target is a sink."""
    return links.outlinks(table(spark, sf_dir, "pages")).select(F.col("url").alias("src"), F.col("href").alias("dst")).distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): part to the next part of the same order."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null").distinct()


def domain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, rank): hosts of pages by number of pages, then name; hosts of a single page have no rank."""
    hosts = table(spark, sf_dir, "pages").select(links.host(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    # Numbered within range partitions; their sizes, one number each, come to the driver.
    order = [F.desc("n"), F.asc("domain")]
    parts = written(hosts.where("n > 1").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in parts.groupBy("_p").count().collect()}
    before = F.lit(0)
    for p in sorted(sizes):
        before = F.when(F.col("_p") == p, F.lit(sum(n for q, n in sizes.items() if q < p))).otherwise(before)
    return parts.select("domain", (before + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).alias("rank"))
