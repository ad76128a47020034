"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document's ids (and an end id) are cut only where they exceed a sequence. Pieces that fill a sequence are
placed at once; the others are dealt to groups of bounded size, which pack in parallel: each piece goes where
the sum over residual gaps of the squared number of open sequences with that gap becomes smallest. Sequences
that a group could not fill are opened again, and their pieces go to the next round, with fewer groups, until
one group holds what is left. Only ids, lengths and checksums are shuffled, never texts or token ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row
from .tokens import crc32, encoder

CAPACITY = 4096
END_ID = 1
GROUP = 20_000
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null or empty text is one piece that holds the end id only. Repeated rows give repeated pieces, a null id stays null.
    """
    end = np.array([end_id], "<u4")

    def make():
        known = encoder(tokenizer)

        def work(ids, texts):
            owner, number, start, length, crc = [], [], [], [], []
            for doc, own in zip(ids, known.encode(texts)):
                own = np.concatenate([own, end])
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    owner.append(doc)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(crc32(part))
            return owner, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())

        return work

    return per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), PIECES.format(dict(docs.dtypes)[id_col]), make, 128)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the sequence that each length (in the order given) is put in.

    Putting a length s into a sequence with gap g changes the sum of squares by 2 (N[g - s] - N[g] + 1), where
    gaps of 0 do not count; a new sequence changes it by 2 N[capacity - s] + 1. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_ = [[] for _ in range(capacity + 1)]
    where, new = np.empty(len(lengths), np.int64), 0
    huge = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        after = count[: capacity + 1 - s]
        cost = 2 * (after - count[s:]) + 2
        cost[0] -= 1 + 2 * count[0]
        cost[count[s:] == 0] = huge
        cost[capacity - s] = 2 * count[capacity - s] * (s < capacity) + 1
        gap = int(cost.argmin()) + s
        if gap == capacity:
            bin_ = new
            new += 1
        else:
            bin_ = open_[gap].pop()
            count[gap] -= 1
        where[i] = bin_
        if gap > s:
            open_[gap - s].append(bin_)
            count[gap - s] += 1
    return where


def _pack_group(rows: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Packs one group; what is in sequences that are not full comes back with a null sequence unless ``last``."""
    rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    size = rows["length"].to_numpy()
    where = sum_of_squares(size, capacity)
    by = np.argsort(where, kind="stable")
    sums = np.cumsum(size[by]) - size[by]
    first = np.flatnonzero(np.diff(where[by], prepend=-1))
    offset = np.empty(len(rows), np.int64)
    offset[by] = sums - np.repeat(sums[first], np.diff([*first, len(by)]))
    full = np.bincount(where, size)[where] == capacity
    seq = pd.Series(where).astype("Int64")
    return rows.assign(seq=seq if last else seq.where(full), offset=offset)


def _packer(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(rows, capacity, last)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 4) -> DataFrame:
    """Places pieces (columns of ``pieces``): adds sequence_id and offset.

    ``parts`` must be written rows (a checkpoint): their numbers choose the groups. After ``rounds`` rounds what is left is packed as it is, in groups
    still, so that at most a few sequences a group stay open. Of null ids and repeated rows each gets a place of its own. An empty table
    gives an empty result.
    """
    kind = dict(parts.dtypes)["doc_id"]
    columns = PIECES.format(kind)
    whole = parts.where(F.col("length") == capacity)
    # Full pieces need no packing: a number of their own, apart from those of the groups (whose lowest bits are not 7).
    out = [whole.withColumn("sequence_id", (F.monotonically_increasing_id() * 8 + 7)).withColumn("offset", F.lit(0).cast("long"))]
    left = parts.where(F.col("length") < capacity)
    n = left.count()
    for round_ in range(rounds):
        groups = max(1, -(-n // group))
        last = groups == 1 or round_ == rounds - 1
        # By row numbers of written rows: null and repeated ids are spread like any other.
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups)).cast("int")
        packed = cut(left.withColumn("grp", spread).groupBy("grp").applyInPandas(_packer(capacity, last), columns + ", grp int, seq long, offset long"))
        done = packed if last else packed.where("seq is not null")
        number = ((F.col("seq") * groups + F.col("grp")) * 8 + round_).alias("sequence_id")
        out.append(done.select("doc_id", "piece", "start", "length", "ids_crc32", number, "offset"))
        if last:
            break
        left = packed.where("seq is null").select("doc_id", "piece", "start", "length", "ids_crc32")
        n = left.count()
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Cuts and packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id; a very long text is cut into full pieces and a last one. Repeated rows and null ids
    are each packed; other columns are ignored; an empty table gives an empty result.
    """
    return pack(cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity, group)
