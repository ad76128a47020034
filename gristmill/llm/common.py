"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. Where none is set, a local one, but only with a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that losing an executor recomputes nothing above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def per_row(rows: DataFrame, schema: str, make: Callable[[], Callable[[list], tuple]], slice_rows: int = 512) -> DataFrame:
    """mapInArrow over ``rows`` in small slices.

    ``make()`` runs once per task and returns a function from the columns of a slice (Python lists) to the
    output columns (lists or numpy arrays) in the order of ``schema``. Slices keep the Python worker's memory
    bounded by ``slice_rows`` texts, however many rows a partition holds.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = work(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return rows.mapInArrow(run, schema)


def crc32_mod(column: str, n: int):
    """crc32 of the id written as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has two bigint columns u, v. Returns (node, root) for every node that has an edge, where root is
    the smallest node of its component. Neighbour minima are aggregated (partial sums first) and joined back,
    so a node with very many neighbours is split by the skew-join rule. Only two numbers per round reach the
    driver. An empty input gives an empty result.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, total: int, share: int = 500) -> DataFrame:
    """Left join of rows with one row per key of groups (key, size, ...), safe from hot keys.

    Keys with at least total / share rows, of which there are at most ``share`` whatever the data, are
    broadcast; their rows, already answered, are spread over all partitions of the join for the others (by row number, so that
    null and repeated ids do not meet; rows must come from files or a checkpoint, whose order is fixed).
    """
    more = [c for c in groups.columns if c not in (key, size)]
    hot = groups.where(F.col(size) * share >= total)
    cold = groups.where(F.col(size) * share < total)
    first = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"), F.col(size).alias("_s0"), *[F.col(c).alias(f"_h_{c}") for c in more])), F.col(key) == F.col("_hot"), "left")
    salted = first.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread, F.monotonically_increasing_id()), F.lit(1 << 20))).cast("int"))
    other = cold.select(F.col(key).alias("_cold"), F.lit(0).alias("_zero"), F.col(size).alias("_s1"), *[F.col(c).alias(f"_c_{c}") for c in more])
    out = salted.join(other, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_zero")), "left")
    return out.select(*rows.columns, F.coalesce("_s0", "_s1").alias(size), *[F.when(F.col("_hot").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in more])


#: Bits of a bitmap of keys: at most 2**20 words of 64 bits are broadcast, whatever the data.
BITS = 1 << 26
M = np.uint64(0x9E3779B97F4A7C15)


def _spot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The keys (column _k) as (word number, 64 bits) in at most bits / 64 rows."""
    spots = keys.select(_spot(F.col("_k"), bits).alias("_s"))
    return cut(spots.groupBy(F.shiftright("_s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(_s % 64)))").alias("_bits")))


def flagged(rows: DataFrame, key: str, keys: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Adds whether the bitmap ``keys`` has the row's key: true for all keys in it and, by collision, for some others.

    ``bits`` bounds the bitmap's size, so it is broadcast.
    """
    at = rows.withColumn("_s", _spot(F.col(key), bits)).withColumn("_word", F.shiftright("_s", 6))
    joined = at.join(F.broadcast(keys), "_word", "left")
    return joined.withColumn(name, F.coalesce(F.expr("getbit(_bits, int(_s % 64)) = 1"), F.lit(False))).drop("_word", "_s", "_bits")


def shingle_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """One code per shingle of ``width`` words, from the words' codes; of fewer words there is one shingle, the whole."""
    width = max(1, min(width, len(codes)))
    n = len(codes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(width if n > 0 else 0):
        out = (out ^ (out >> np.uint64(31))) * M + codes[i : i + n]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of the longest word that is coded with the others at once.
LONGEST = 64


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of the words data[start:end], eight bytes of all words at a time; equal words have equal codes, in whatever text."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    code = mixed(size.astype(np.uint64) * M ^ (at[starts] & _HEAD[np.minimum(size, 8)]))
    rest, done = np.flatnonzero((size > 8) & (size <= LONGEST)), 8
    while len(rest):
        code[rest] = mixed(code[rest] ^ (at[starts[rest] + done] & _HEAD[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    for k in np.flatnonzero(size > LONGEST).tolist():
        code[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return code


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true values."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]
