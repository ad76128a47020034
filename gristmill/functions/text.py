"""Analysis of text as column expressions: tokens, stop words, stems, set similarity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a token is a run of digits and full stops, or else of word characters.
TOKEN = r"([\p{Nd}.]+|[\p{L}\p{N}_]+)"
# Fixed value: the 33 English stop words of the search library behind the reference's analyzer.
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null for a null text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), F.lower)


def standard_tokens(text: Column) -> Column:
    """As a standard tokenizer gives them: runs of letters and digits only, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def drop_stop_words(words: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Without stop words; what stays is numbered anew from 1 by whoever explodes it."""
    stop = list(stop)
    return F.filter(words, lambda w: ~w.isin(stop))


def analyze(text: Column, stop: Iterable[str] | None = STOP_WORDS) -> Column:
    return tokens(text) if stop is None else drop_stop_words(tokens(text), stop)


def exploded(docs: DataFrame, words: Column, *keys: str) -> DataFrame:
    """keys, pos (from 1), term."""
    return docs.select(*keys, F.posexplode(words).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)


def space_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def clean_words(text: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Mail cleaning: split at white space, lower-case, drop ASCII punctuation, keep purely alphabetic words, drop stop words."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[!-/:-@\[-`{-~]", ""))
    return drop_stop_words(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")), stop)


def mail_tokens(text: Column) -> Column:
    """Words as a word tokenizer gives them: white space and punctuation part them, a contraction's ending is a word of its own."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"(?i)('s|'m|'d|'ll|'re|'ve|n't)\b", " $1"), r"([!-&(-,/:-@\[-`{-~]|\.(?=\s|$))", " $1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def mail_words(text: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Mail cleaning over ``mail_tokens``: lower-cased, ASCII punctuation dropped, purely alphabetic words that are no stop words."""
    words = F.transform(mail_tokens(text), lambda w: F.regexp_replace(F.lower(w), r"[!-/:-@\[-`{-~]", ""))
    return drop_stop_words(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")), stop)


def jaccard(a: Column, b: Column, exact: bool = False) -> Column:
    """|a and b| over |a| + |b| plus (as the reference has it) or minus (exact) the intersection; 0 where that is 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    under = F.size(a) + F.size(b) + (-both if exact else both)
    return F.when(under > 0, both / under).otherwise(F.lit(0.0))


def safe_int(x: Column, default: int) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def human_time(seconds: Column) -> Column:
    """Seconds as h:mm:ss.mmm."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60, F.round((seconds - whole) * 1000).cast("long"))
