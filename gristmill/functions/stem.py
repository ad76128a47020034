"""English stemming (the published Porter2 definition), for the distinct vocabulary only.

``stemmed`` stems each distinct term once in an Arrow batch and joins the stems back, so the cost follows the
vocabulary, not the corpus.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
# Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"), ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousness", "ous"), ("ousli", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less"))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start):
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str) -> bool:
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$", w) or re.fullmatch(rf"[{VOWELS}][^{VOWELS}]", w))


def porter2(word: str) -> str:
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in INVARIANT:
        return w
    w = re.sub(rf"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m[0] in ("eedly", "eed"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(f"[{VOWELS}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in sorted(STEP2, key=lambda x: -len(x[0])):
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and w[-4:-3] == "l" and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple(LI):
            w = w[:-2]
    for end, new in STEP3:
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(tokens: DataFrame, column: str = "term") -> DataFrame:
    """The rows with the column's values stemmed."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter2)

    table = tokens.select(column).distinct().withColumn("_stem", stem(column))
    return tokens.join(table, column).withColumn(column, F.col("_stem")).drop("_stem")


#: Words whose stems a worker remembers.
REMEMBERED = 200_000


def stemmed_words(rows: DataFrame) -> DataFrame:
    """(doc_id, words) with the words stemmed in place; each distinct word of a batch once, frequent ones once a worker."""

    def of(batches):
        known: dict[str, str] = {}
        for batch in batches:
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            found = []
            for word in coded.dictionary.to_pylist():
                stem = known.get(word)
                if stem is None:
                    stem = porter2(word)
                    if len(known) < REMEMBERED:
                        known[word] = stem
                found.append(stem)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0)
            ends = pa.compute.cumulative_sum(sizes).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *ends], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(found, pa.string()).take(coded.indices))], names=["doc_id", "words"])

    return rows.select("doc_id", "words").mapInArrow(of, rows.schema)
