"""Toxicity by non-negative positive-unlabelled learning with numpy.

Confirmed toxic documents are the positives; the training part as a whole is the unlabelled set. A linear
classifier on which words and word beginnings a text holds is trained with the class-prior-corrected risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

taking a step back where the second term is negative. The prior is the share of positives among the labelled.
Scoring reads every whole text and looks up the classifier's words, a vocabulary of bounded size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row

#: At most about so many documents are drawn for fitting.
POSITIVES = 3000
UNLABELLED = 6000
#: More terms did not help: with 20,000 the area under the curve on held-out rows was lower, as rare terms are fitted by chance.
VOCABULARY = 2_000
WORD = re.compile(r"[^\W\d_]+")
HEADS = (4, 5)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text and, marked with *, the first letters of the longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in HEADS))


class Linear:
    """sigmoid(bias + sum of the weights of the vocabulary's terms that a text holds)."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = {t: i for i, t in enumerate(vocabulary)}
        self.weights, self.bias = np.zeros(len(vocabulary)), 0.0

    def known(self, text: str | None) -> list[int]:
        """Numbers of the vocabulary's terms that a text holds."""
        return sorted(self.vocabulary[t] for t in terms(text) if t in self.vocabulary)

    def raw(self, cols: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(rows, self.weights[cols], n)

    def fit(self, positive: list[list[int]], unlabelled: list[list[int]], prior: float, epochs: int = 300, rate: float = 0.05, decay: float = 2e-4) -> Linear:
        """``positive`` and ``unlabelled`` are texts as the numbers of their terms."""
        flat = lambda x: (np.fromiter((i for f in x for i in f), np.int64), np.repeat(np.arange(len(x)), [len(f) for f in x]), len(x))
        sets = [flat(positive), flat(unlabelled)]
        size = len(self.weights) + 1
        self.bias = float(np.log(prior / (1 - prior)))
        m, v = np.zeros(size), np.zeros(size)
        for step in range(1, epochs + 1):
            g = self.gradient(*sets, prior)
            g[:-1] += decay * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]
        return self

    def risk(self, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float]:
        """(prior * R_p(+1), R_u(-1) - prior * R_p(-1)) of the logistic loss: log(1 + exp(-z)) for +1, log(1 + exp(z)) for -1."""
        zp, zu = self.raw(*positive), self.raw(*unlabelled)
        return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    def gradient(self, positive: tuple, unlabelled: tuple, prior: float) -> np.ndarray:
        """Of both terms of the risk, weights first and bias last; where the second is negative, of its opposite alone (the step back)."""
        sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
        (pc, pr, pn), (uc, ur, un) = positive, unlabelled
        zp, zu = self.raw(*positive), self.raw(*unlabelled)
        if self.risk(positive, unlabelled, prior)[1] >= 0:
            dp, du = -prior * sigmoid(-zp) / pn - prior * sigmoid(zp) / pn, sigmoid(zu) / un
        else:
            dp, du = prior * sigmoid(zp) / pn, -sigmoid(zu) / un
        size = len(self.weights)
        return np.append(np.bincount(pc, dp[pr], size) + np.bincount(uc, du[ur], size), dp.sum() + du.sum())

    def score(self, text: str | None) -> float:
        get = self.vocabulary.get
        z = self.bias + sum(self.weights[i] for t in terms(text) if (i := get(t)) is not None)
        return float(0.5 * (1 + np.tanh(z / 2)))


def _telling(sample: DataFrame, most: int) -> list[str]:
    """The terms whose document shares differ most between the positive and the other texts of (text, positive), in standard errors."""

    def make():
        def work(texts, positive):
            own = [terms(t) for t in texts]
            return [t for x in own for t in x], np.repeat(np.array(positive, bool), [len(x) for x in own])

        return work

    n, k = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    n, k = max(1, n), max(1, k)
    counts = per_row(sample.select("text", "positive"), "term string, positive boolean", make).groupBy("term").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    p = (F.col("a") + F.col("b")) / (n + k)
    gap = F.abs(F.col("a") / n - F.col("b") / k) / F.sqrt(p * (1 - p) * (1 / n + 1 / k) + 1e-12)
    return [r[0] for r in counts.where("a + b >= 5").orderBy(gap.desc(), "term").limit(most).select("term").collect()]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear | None:
    """Fits the classifier on a sample drawn by a hash of id and text from rows that are not held out.

    The driver receives the vocabulary and, of about ``positives`` and ``unlabelled`` texts, the numbers of its terms that they hold; terms
    are counted by Spark. A document labelled
    more than once counts as toxic if any label says so. None where no toxic document is known.
    """
    own = labels.where(~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    prior, n_pos = own.where("_y is not null").agg(F.avg((F.col("_y") == 1).cast("double")), F.count_if(F.col("_y") == 1)).first()
    if not n_pos:
        return None
    train = docs.where(~held_out(id_col)).select(id_col, text_col).withColumn("_draw", F.pmod(F.xxhash64(id_col, text_col, F.lit(3)), F.lit(1 << 20)) / float(1 << 20))
    n_all = train.count()
    known = own.where("_y = 1").select(id_col)
    share_p, share_u = min(1.0, positives / n_pos), min(1.0, unlabelled / max(1, n_all))
    toxic = known.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 20)) / float(1 << 20) < share_p)
    # About ``positives`` ids, however many there are: they are broadcast, and no text is shuffled.
    sample = cut(train.join(F.broadcast(toxic), id_col, "left_semi").select(F.col(text_col).alias("text"), F.lit(True).alias("positive")).unionByName(train.where(F.col("_draw") < share_u).select(F.col(text_col).alias("text"), F.lit(False).alias("positive"))))
    model = Linear(_telling(sample, VOCABULARY))

    def make():
        def work(texts, positive):
            return positive, pa.array([model.known(t) for t in texts], pa.list_(pa.int32()))

        return work

    found = sorted((r.positive, list(r.known)) for r in per_row(sample, "positive boolean, known array<int>", make).collect())
    own = [[x for p, x in found if p == side] for side in (True, False)]
    return model.fit(own[0], own[1] or [[]], min(0.9, max(1e-4, prior)))


def scores(docs: DataFrame, model: Linear | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 where score >= 0.5).

    Null and empty texts get the score of a text without known terms; without a model the score is 0. Repeated rows are scored
    each, very long texts whole; a null id stays null. Other columns are ignored; an empty table gives an empty result.
    """

    def make():
        def work(ids, texts):
            s = np.array([model.score(t) if model else 0.0 for t in texts], float)
            return ids, s, (s >= 0.5).astype(np.int32)

        return work

    kind = dict(docs.dtypes)[id_col]
    return per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, score double, predicted int", make).withColumnRenamed("id", id_col)

