"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent n-grams in rank order; a document is given the language whose
profile is the least out of place: the sum, over the document's own most frequent n-grams, of how far the ranks
are apart, with the profile's length where the profile lacks the n-gram. N-grams of 1 to 3 letters are taken
from lower-cased words between blanks, over the whole text.
"""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut, per_row, shared_dir

PROFILE = 400
#: At most about this many training documents per language are read for the profiles, unless all are asked for.
SAMPLE = 3000
#: N-grams that are counted at once; one text's are never divided.
AT_ONCE = 1 << 22
#: Bins that a round of ``least_reached`` counts.
BINS = 1 << 12
#: Profiles are made of so many values of lang at most, those with the most documents (the column may hold anything).
LANGUAGES = 1000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (Unicode category L). What is no letter here has no n-gram, so this alone decides on ``und``."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """64-bit codes of all n-grams of 1 to 3 characters in the words of a text, blanks around words included."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, np.uint32(32))
    blank = points == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[0] = True
    c = points[keep].astype(np.uint64)
    word = c != 32
    one = (c + np.uint64(1)) * MULTIPLIER
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * MULTIPLIER + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * MULTIPLIER + c[2:]
    return np.concatenate([one[word], two[word[:-1] | word[1:]], three[word[1:-1]]])


def ranked(text: str, n: int) -> np.ndarray:
    """Codes of the n most frequent n-grams, the most frequent first; ties by code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    if len(codes) > n:
        floor = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= floor
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")[:n]]


def profiles(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int | None = SAMPLE, seed: int = 7) -> dict[str, np.ndarray]:
    """Profile (n-gram codes in rank order) of each language of ``training``.

    Fitted on about ``sample`` documents of each language, chosen by a hash of id and text; a language with fewer
    has all of them. With ``sample`` None all documents count. What reaches the driver are ``size`` codes per language.
    """
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit(seed)).alias("draw"))
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not there:
        return {}
    rows = rows.where(F.col("lang").isin(*there))
    if sample is not None:
        share = F.create_map(*[F.lit(x) for k, n in sorted(there.items()) for x in (k, min(1.0, sample / n))])
        rows = rows.where(F.pmod("draw", F.lit(1 << 20)) / F.lit(float(1 << 20)) < share[F.col("lang")])

    def make():
        def work(langs, texts):
            out_l, out_c, out_n = [], [], []
            for lang in sorted(set(langs)):
                held, n = [], 0
                for text in [t for k, t in zip(langs, texts) if k == lang] + [None]:
                    if text is not None:
                        held.append(grams(text))
                        n += len(held[-1])
                    if held and (text is None or n >= AT_ONCE):
                        codes, counts = np.unique(np.concatenate(held), return_counts=True)
                        out_l += [lang] * len(codes)
                        out_c.append(codes.view(np.int64))
                        out_n.append(counts)
                        held, n = [], 0
            return out_l, np.concatenate(out_c), np.concatenate(out_n)

        return work

    counted = per_row(rows.drop("draw"), "lang string, code long, n long", make).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The best of each of 64 shares first, so that no task sees all n-grams of a language.
    order = [F.desc("n"), F.asc("code")]
    part = counted.withColumn("share", F.pmod(F.xxhash64("code"), F.lit(64)))
    for keys in (["lang", "share"], ["lang"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= size)
    top: dict[str, list] = {lang: [] for lang in sorted(there)}
    for r in part.select("lang", "rank", "code").orderBy("lang", "rank").collect():
        top[r["lang"]].append(r["code"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in top.items() if v}


class Ranker:
    """Out-of-place distances of a text to every profile."""

    def __init__(self, models: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(models), size
        self.codes = np.unique(np.concatenate([models[k] for k in self.langs])) if models else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, models[k])] = np.arange(len(models[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 (no n-gram of any profile) to 1 (the very profile)."""
        own = ranked(text or "", self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes)
        known = np.append(self.codes, np.uint64(0))[at] == own
        ranks = self.rank[:, np.where(known, at, len(self.codes))]
        apart = np.where(ranks < 0, self.size, np.minimum(self.size, np.abs(ranks - np.arange(len(own))))).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def predict(docs: DataFrame, models: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """One row per input row: id, lang_pred, score.

    ``und`` with score 0 where the text is null, empty or has no letter, or where nothing could be learned. Ties go to the language
    that sorts first. Repeated rows and null ids are predicted like any other, very long texts whole; other columns are ignored; an
    empty table gives an empty result.
    """

    def make():
        ranker = Ranker(models, size)

        def work(ids, texts):
            found = [ranker.predict(t) for t in texts]
            return ids, [x for x, _ in found], np.array([s for _, s in found], float)

        return work

    return per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double", make).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_score(docs: DataFrame, models: dict[str, np.ndarray], name: str, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` and, as column ``name``, the score of each text: null where it has no letter, 1 for all others where nothing could be learned."""
    text_at = docs.columns.index(text_col)

    def run(batches):
        ranker = Ranker(models, size)

        def score(text):
            if not models:
                return 1.0 if len(grams(text or "")) else None
            found, score = ranker.predict(text)
            return None if found == UNKNOWN and not score else score

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = pa.array(map(score, part.column(text_at).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def least_reached(values: DataFrame, column: str) -> float | None:
    """The exact 0.001 quantile of a column, the least value that a thousandth of all do not exceed; nulls do not count, None without any value.

    Every value is counted, in at most ``BINS`` + 1 bins a round, which alone reach the driver; the next round divides the bin that holds the number.
    """
    values = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    before = (n - 1) // 1000
    while low < high:
        # Rounding keeps the order, and the ends lie in the first and the last bin, so each round divides.
        spot = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS)))
        inside = values.where(F.col("v").between(low, high))
        for _, n, low, high in inside.groupBy(spot.alias("bin")).agg(F.count("*"), F.min("v"), F.max("v")).orderBy("bin").collect():
            if before < n:
                break
            before -= n
    return low


def _known(id_col: str, lang_col: str) -> Column:
    return ~held_out(id_col) & F.col(lang_col).isNotNull()


def least_score(docs: DataFrame, models: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """Half the score that 999 of 1000 documents of known language reach, of all that are not held out and have a letter; 0 without any."""
    if not models:
        return 0.0
    known = docs.where(_known(id_col, lang_col)).select(F.col(text_col).alias("text"))
    return (least_reached(cut(with_score(known, models, "score").select("score")), "score") or 0.0) / 2


def _reaching(scored: DataFrame, name: str, least: float) -> DataFrame:
    return scored.where((F.col(name) > 0) & (F.col(name) >= least)).drop(name)


def _free(docs: DataFrame, name: str = "_score") -> str:
    """A column name that ``docs`` does not have."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def known_language(docs: DataFrame, models: dict[str, np.ndarray], least: float = 0.0, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has a known language: a score of ``least`` or more, and above 0.

    Texts that are null, empty or without a letter go. Where no language could be learned, all texts with a letter stay. Repeated rows
    are treated alike, very long texts read whole; an empty table gives an empty result.
    """
    name = _free(docs)
    return _reaching(with_score(docs, models, name, text_col, size), name, least if models else 0.0)


def like_known(docs: DataFrame, models: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``known_language`` with the ``least_score`` of the same ``docs``; rows and scores are written in between, so that each text is scored once."""
    name = _free(docs)
    path = f"{shared_dir(docs.sparkSession)}/scored-{uuid.uuid4().hex}"
    scored = with_score(docs, models, name, text_col)
    scored.write.parquet(path)
    scored = docs.sparkSession.read.schema(scored.schema).parquet(path)
    least = (least_reached(scored.where(_known(id_col, lang_col)), name) or 0.0) / 2 if models else 0.0
    return _reaching(scored, name, least)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int | None = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles from the rows that are not held out; with ``sample`` None from all of them."""
    return profiles(docs.where(~held_out(id_col)).select(id_col, text_col, lang_col), id_col, text_col, lang_col, sample=sample)
