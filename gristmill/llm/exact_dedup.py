"""Exact deduplication by progressive refinement (DataFrame functions only).

Length, then a hash of a prefix, then the full hash; each step only looks further at rows whose key so far is
shared. Which keys are shared is handed to the next scan as a bitmap of fixed size (``bits``), so what is
broadcast does not grow with the data; a collision in the bitmap only sends a row on to the next step, where
the full hash decides. The shuffles of ``exact_duplicates`` carry lengths, hashes and ids, never texts, and every
grouping is pre-aggregated; ``one_of_each`` sends each task's one row of every text that may have copies.

A bitmap of 2**26 bits tells keys apart up to some 10**7 shared ones; with far more it is full, every row then goes on to
the next step, and the results stay right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, attach, bitmap, cut, flagged


def _shared(keys: DataFrame, bits: int) -> DataFrame:
    """Bitmap of the keys (_k) that two rows or more have."""
    return bitmap(keys.groupBy("_k").count().where("count > 1"), bits)


def _surviving(rows: DataFrame, prefix: int, bits: int) -> DataFrame:
    """Adds to rows (_t, ...) whether a text shares length and hash of a prefix with another, as _survives."""
    base = rows.withColumn("_n", F.octet_length("_t").cast("long"))
    step = flagged(base, "_n", _shared(base.select(F.col("_n").alias("_k")), bits), "_same_length", bits)
    step = step.withColumn("_h", F.when(F.col("_same_length"), F.xxhash64("_n", F.substring("_t", 1, prefix))))
    step = flagged(step, "_h", _shared(step.where("_same_length").select(F.col("_h").alias("_k")), bits), "_same_head", bits)
    return step.withColumn("_survives", F.col("_same_length") & F.col("_same_head"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, bits: int = BITS, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id
    stays. text_sha256 is filled for rows that share length and prefix hash with another row, and for all rows
    with ``digest_all``. Rows repeated with the same id and text are one document: each counts in group_size
    and, where that id is the largest, each is marked kept. A null id is smaller than any other; a group of
    null ids only has a null keep_id and its rows stay. Very long texts are hashed whole. Other columns are ignored; an
    empty table gives an empty result.
    """
    step = _surviving(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")), prefix, bits)
    survives = F.col("_survives")
    full = F.sha2(F.col("_t").cast("binary"), 256)
    rows = step.select("_id", F.when(survives, full).alias("_sha"), (full if digest_all else F.when(survives, full)).alias("text_sha256"))
    groups = rows.where("_sha is not null").groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    # Rows that no other can equal get a key of their own, so that they do not meet in one partition.
    keyed = rows.withColumn("_sha", F.coalesce("_sha", F.concat(F.lit("#"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    groups = cut(groups)
    out = attach(keyed, groups, "_sha", "_size", "_id", groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0])
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` (all columns, which must be sortable) without copies: of equal texts one row stays.

    That is the row with the largest id, null being smaller than any other; of rows with that id, the last in the order of all
    columns. A null text counts as empty. Very long texts are compared whole. An empty table gives an empty result.
    """
    packed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    step = _surviving(packed, prefix, bits)
    alone = step.where("NOT _survives").select("_doc.*")
    best = step.where("_survives").groupBy(F.sha2(F.col("_t").cast("binary"), 256).alias("_sha")).agg(F.max(F.struct("_id", "_doc")).alias("_best"))
    return alone.unionByName(best.select("_best._doc.*"))
