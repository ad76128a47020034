"""Readers and writers of corpora, topics, judgements, runs and crawled pages."""

from __future__ import annotations

import email
import email.policy
import html as html_lib
import re
import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import space_count
from ..operators.index import Index
from ..operators.learning import FEATURES
from ..operators.shared import written


def read_trec(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(doc_id, text, head, length) of SGML-like files, split at </DOC> by the scan itself.

    Text on the lines of the TEXT and HEAD tags is dropped; several elements are joined by line ends; length counts
    spaces. Documents without an id or a text are left to ``sane``.
    """
    raw = spark.read.option("lineSep", "</DOC>").option("encoding", encoding).text(path)
    raw = raw.select(F.decode(F.col("value").cast("binary"), encoding).alias("d") if encoding.upper() not in ("UTF-8", "UTF8") else F.col("value").alias("d")).where(F.col("d").contains("<DOC>"))

    def element(tag: str) -> Column:
        bodies = F.regexp_extract_all("d", F.lit(rf"(?s)<{tag}>[^\n]*\n(.*?)\n?[^\n]*</{tag}>"), F.lit(1))
        return F.array_join(F.transform(bodies, lambda b: F.trim(b)), "\n")

    head = F.array_join(F.transform(F.regexp_extract_all("d", F.lit(r"(?s)<HEAD>(.*?)</HEAD>"), F.lit(1)), lambda b: F.trim(b)), "\n")
    rows = raw.select(F.nullif(F.trim(F.regexp_extract("d", r"(?s)<DOCNO>(.*?)</DOCNO>", 1)), F.lit("")).alias("doc_id"), F.nullif(element("TEXT"), F.lit("")).alias("text"), F.nullif(head, F.lit("")).alias("head"))
    return rows.withColumn("length", F.coalesce(space_count(F.col("text")), F.lit(0)))


def sane(docs: DataFrame) -> DataFrame:
    """The same rows; a missing id or text raises an error when they are read."""
    ok = F.assert_true(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.lit("document without id or text")).isNull()
    return docs.where(ok)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, raw) of lines "<id>.   <text>", trimmed and lower-cased; blank lines are skipped, a second separator ends the text."""
    line = F.lower(F.trim("value"))
    parts = F.split(line, r"\.   ")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("query_id"), F.get(parts, F.lit(1)).alias("raw"))


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A stop list, one word a line."""
    return sorted({r[0] for r in spark.read.text(path).select(F.lower(F.trim("value"))).where("value <> ''").collect()})


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    clean = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(F.split(clean, r"\s+").alias("f"), F.monotonically_increasing_id().alias("line_no")).where(F.size("f") >= n)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel, grade): white-space separated lines; rel is 1 for grades of 1 and more."""
    grade = F.col("f")[3].cast("int")
    return _fields(spark, path, 4).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), (grade >= 1).cast("int").alias("rel"), grade.alias("grade"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score); of repeated lines the last one holds."""
    rows = _fields(spark, path, 6).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[4].cast("double").alias("score"), "line_no")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("score", "line_no").alias("score"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """One text column as files; gzip or none."""
    lines.write.mode("overwrite").option("compression", compression).text(path)


def read_domain_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank, tld_rank) of a CSV with header."""
    rows = spark.read.option("header", True).schema("GlobalRank INT, TldRank INT, Domain STRING").option("enforceSchema", False).csv(path)
    return rows.select(F.col("Domain").alias("domain"), F.col("GlobalRank").alias("rank"), F.col("TldRank").alias("tld_rank"))


def random_user_agent(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").orderBy(F.rand(seed)).limit(1)


PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "cleaned_text", "raw_html", "url", "org_url", "redirected_url", "redirected_org_url", "crawled_time", "meta_description")] + [T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("is_redirected", T.BooleanType()), T.StructField("meta_keywords", T.ArrayType(T.StringType())), T.StructField("wave", T.IntegerType())])


def read_crawled(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages (one JSON object per file), crawl time as a timestamp."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    return pages.withColumn("crawled_at", F.try_to_timestamp("crawled_time", F.lit("dd-MM-yyyy-HH:mm:ss.SSSSSS")))


def read_crawled_urls(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """(url) distinct, from CSV files whose URL column differs: path -> position."""
    out = None
    for p, at in paths.items():
        own = spark.read.csv(p)
        own = own.select(F.col(own.columns[at]).alias("url"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def read_edges(spark: SparkSession, csv: str | None = None, json_lines: str | None = None) -> DataFrame:
    """(src, dst) distinct, of CSV files (columns 0 and 2) and files of JSON arrays [src, dst]."""
    parts = []
    if csv:
        rows = spark.read.csv(csv)
        parts.append(rows.select(F.col(rows.columns[0]).alias("src"), F.col(rows.columns[2]).alias("dst")))
    if json_lines:
        pair = F.from_json("value", "array<string>")
        parts.append(spark.read.text(json_lines).select(pair[0].alias("src"), pair[1].alias("dst")).where("src is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def message(url: Column, wave: Column, rate_limited: Column | None = None) -> Column:
    """A frontier message as JSON."""
    fields = [url.alias("url"), wave.alias("wave")] + ([rate_limited.alias("rate_limited")] if rate_limited is not None else [])
    return F.to_json(F.struct(*fields))


def parse_message(json: Column) -> Column:
    return F.from_json(json, "url string, wave int, rate_limited boolean")


def read_spam_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, file_name) of lines "spam|ham path"; another label raises an error."""
    parts = F.split(F.trim("value"), r"\s+")
    label = F.when(F.lower(parts[0]) == "spam", 1).when(F.lower(parts[0]) == "ham", 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), parts[0])).cast("int"))
    return spark.read.text(path).where(F.trim("value") != "").select(label.alias("label"), F.element_at(F.split(parts[1], "/"), -1).alias("file_name"))


def _visible(markup: str) -> str:
    bare = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", markup)
    return re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"(?s)<[^>]*>", " ", bare))).strip()


def parse_mail(raw: bytes) -> tuple[str, str]:
    """(subject, body): text parts as they are, HTML parts as text, attachments skipped."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    subject = str(email.header.make_header(email.header.decode_header(m.get("Subject", "")))) if m.get("Subject") else ""
    parts = []
    for part in m.walk():
        if part.is_multipart() or "attachment" in str(part.get("Content-Disposition", "")):
            continue
        data = part.get_payload(decode=True)
        if data is None or part.get_content_type() not in ("text/plain", "text/html"):
            continue
        text = data.decode("ISO-8859-1")
        parts.append(_visible(text) if part.get_content_type() == "text/html" else text)
    return subject, "\n".join(parts)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, subject, body) of MIME files."""

    @F.pandas_udf("subject string, body string")
    def parse(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_mail(c) for c in contents], columns=["subject", "body"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), parse("content").alias("m")).select("file_name", "m.*")


def labelled_mail(mail: DataFrame, spam_labels: DataFrame) -> DataFrame:
    """(file_name, subject, body, label): mail that has a label, by file name."""
    return mail.join(spam_labels, "file_name")


def write_crawled(pages: DataFrame, path: str, batch: str) -> None:
    """Crawled pages as JSON lines below a folder of the batch, which a repeated write replaces; columns as in ``PAGE`` where there are any."""
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PAGE.fields if f.name in pages.columns]
    pages.select(*known).write.mode("overwrite").json(f"{path}/batch={batch}")


def index_crawled(pages: DataFrame, path: str, known: str | None = None) -> Index:
    """Indexes crawled pages (url, cleaned_text) by URL and saves the index at ``path``; with ``known`` the index there is extended by them."""
    new = Index.build(pages.select(F.col("url").alias("doc_id"), F.col("cleaned_text").alias("text")))
    both = Index.load(pages.sparkSession, known).merged(new) if known else new
    both.save(path)
    return Index.load(pages.sparkSession, path)


ROBOTS_RULE = r"(?im)^[ \t]*(user-agent|disallow|allow|crawl-delay)[ \t]*:[ \t]*([^#\r\n]*)"


def parse_robots(files: DataFrame, agent: str = "*", default_delay: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rules (host, prefix), delays (host, delay)) of robots files (host, body): what is disallowed for the agent, and its crawl delay.

    Rules of groups that name the agent, or * if none does. An empty Disallow forbids nothing; a delay that is no number, or none, counts as
    ``default_delay``. Allow lines that repeat a forbidden prefix lift it; no file is cached, as the table is read by each query.
    """
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(ROBOTS_RULE), F.lit(1)).alias("field"), F.regexp_extract_all("body", F.lit(ROBOTS_RULE), F.lit(2)).alias("value"))
    lines = F.transform(pairs, lambda p: F.struct(F.lower(p["field"]).alias("field"), F.trim(p["value"]).alias("value")))
    # A group starts where an agent line follows another kind of line; the lines below it hold for all agents of the group.
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("open"), F.array().cast("array<struct<agent:string,field:string,value:string>>").alias("rows"))

    def step(acc, x):
        is_agent = x["field"] == "user-agent"
        agents = F.when(is_agent & acc["open"], F.concat(acc["agents"], F.array(F.lower(x["value"])))).when(is_agent, F.array(F.lower(x["value"]))).otherwise(acc["agents"])
        rows = F.when(is_agent, acc["rows"]).otherwise(F.concat(acc["rows"], F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), x["field"].alias("field"), x["value"].alias("value")))))
        return F.struct(agents.alias("agents"), is_agent.alias("open"), rows.alias("rows"))

    every = files.select("host", F.aggregate(lines, start, step)["rows"].alias("rows"))
    own = F.filter("rows", lambda r: r["agent"] == agent.lower())
    held = every.select("host", F.when(F.size(own) > 0, own).otherwise(F.filter("rows", lambda r: r["agent"] == "*")).alias("rows"))
    values = lambda field: F.transform(F.filter("rows", lambda r: r["field"] == field), lambda r: r["value"])
    rules = held.select("host", F.explode(F.array_except(F.array_distinct(values("disallow")), values("allow"))).alias("prefix")).where("prefix <> ''")
    delay = F.coalesce(F.get(values("crawl-delay"), F.lit(0)).try_cast("double"), F.lit(default_delay))
    return rules, held.select("host", delay.alias("delay"))


def batch_number(rows: DataFrame, order: str, batches: int | None = None, size: int | None = None) -> DataFrame:
    """Adds batch (from 0): ``batches`` sub-lists of equal size (the last may be shorter), or sub-lists of ``size``, in the given order.

    Rows are numbered within range partitions, whose sizes come to the driver, so no task orders all rows.
    """
    parts = written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in parts.groupBy("_p").count().collect()}
    n, before, first = sum(sizes.values()), {}, {r[0]: r[1] for r in parts.groupBy("_p").agg(F.min("_k")).collect()}
    at = 0
    for p in sorted(sizes):
        before[p], at = at - first[p], at + sizes[p]
    if size is None:
        size = -(-n // max(1, batches or 1))
    if not n:
        return parts.drop("_p", "_k").withColumn("batch", F.lit(0).cast("bigint"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_p")]
    return parts.withColumn("batch", F.floor((F.col("_k") + offset) / max(1, size)).cast("bigint")).drop("_p", "_k")


def disjoint(a: DataFrame, b: DataFrame) -> None:
    """Raises an error if the two tables of equal columns share a row."""
    shared = a.intersect(b).limit(1).collect()
    if shared:
        raise ValueError(f"not disjoint: {shared[0]}")


def stamped_name(suffix: str = "") -> str:
    """A file name that no other call gives: a random part and the time."""
    return f"{uuid.uuid4().hex}-{datetime.now().strftime('%d-%m-%Y-%H-%M-%S-%f')}{suffix}"


def write_feature_json(features: DataFrame, labels: DataFrame, path: str) -> None:
    """Features (query_id, doc_id, one column per model) and labels as JSON lines, to be used again by ``read_feature_json``."""
    features.write.mode("overwrite").json(f"{path}/features")
    labels.write.mode("overwrite").json(f"{path}/labels")


def read_feature_json(spark: SparkSession, path: str, features: tuple[str, ...] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(features, labels) as they were written."""
    key = "query_id bigint, doc_id bigint, "
    return spark.read.schema(key + ", ".join(f"{f} double" for f in features)).json(f"{path}/features"), spark.read.schema(key + "label int").json(f"{path}/labels")


def write_scores_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, in as many files as the rows have partitions."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_features(table: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    table.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")).write.mode("overwrite").format("libsvm").save(path)


def read_features(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    r = spark.read.format("libsvm")
    return (r.option("numFeatures", n) if n else r).load(path)
