from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions.stem import porter2, stemmed


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_tokens_and_positions(spark):
    df = spark.createDataFrame([(1, "In 1990 U.S. abc12"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.pos, r.term) for r in tx.exploded(df, tx.tokens(F.col("text")), "doc_id").collect()]
    assert got == [(1, k + 1, w) for k, w in enumerate("in 1990 u . s . abc12".split())]


def test_stop_words_renumber(spark):
    df = spark.createDataFrame([(1, "the cat sat")], "doc_id long, text string")
    assert [(r.term, r.pos) for r in tx.exploded(df, tx.analyze(F.col("text"), ["the"]), "doc_id").collect()] == [("cat", 1), ("sat", 2)]


def test_scalars(spark):
    assert one(spark, tx.space_count(F.col("a")), a=" a b ") == 3
    assert one(spark, tx.safe_int(F.col("a"), 7), a="x") == 7 and one(spark, tx.safe_int(F.col("a"), 7), a="12") == 12
    assert one(spark, tx.human_time(F.col("a")), a=3723.5) == "1:02:03.500"
    assert one(spark, tx.clean_words(F.col("a")), a="Buy now, the CHEAP! stuff 24h don't") == ["buy", "now", "cheap", "stuff", "dont"]
    a, b = F.split("a", " "), F.split("b", " ")
    assert one(spark, tx.jaccard(a, b), a="x y", b="y z") == 1 / 5 and one(spark, tx.jaccard(a, b, True), a="x y", b="y z") == 1 / 3


def test_stemmer(spark):
    # Fixed values from the published vocabulary of the algorithm.
    pairs = {"consign": "consign", "consigned": "consign", "consistency": "consist", "consolation": "consol", "knightly": "knight", "knives": "knive", "kindness": "kind", "hopping": "hop", "hoping": "hope", "flies": "fli", "ties": "tie", "generate": "generat", "generously": "generous", "skies": "sky", "relational": "relat", "happy": "happi", "says": "say", "dying": "die", "national": "nation", "luxuriated": "luxuri"}
    assert {w: porter2(w) for w in pairs} == pairs
    df = spark.createDataFrame([(1, "hopping"), (2, "hoping"), (3, "hopping")], "doc_id long, term string")
    assert sorted((r.doc_id, r.term) for r in stemmed(df).collect()) == [(1, "hop"), (2, "hope"), (3, "hop")]
