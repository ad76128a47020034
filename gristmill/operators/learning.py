"""Learning to rank and text classification on Spark ML."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizer, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import average_precision, judged
from .ranking import ranked, small
from .shared import written

# Fixed value: the order of features.
FEATURES = ("okapi_bm25", "okapi_tf", "okapi_tf_idf", "unigram_lm_jm", "unigram_lm_laplace")


PARALLEL_FITS = 8
#: Rows of a partition of a training table.
TRAINING_ROWS = 100_000


def pivoted(runs: DataFrame, models: tuple[str, ...] = FEATURES) -> DataFrame:
    """(query_id, doc_id, one column per model) of (query_id, doc_id, model, score); 0 where a run lacks the document."""
    wide = runs.groupBy("query_id", "doc_id").pivot("model", list(models)).agg(F.first("score"))
    return wide.na.fill(0.0, list(models))


def labels(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id", "doc_id").agg(F.max(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("label"))


def negative_fill(bm25_run: DataFrame, judged_labels: DataFrame, total: int = 1000) -> DataFrame:
    """(query_id, doc_id, label): judged documents, and of the others that do not count as relevant the worst by BM25,
    until ``total`` are non-relevant. Fill rows that were judged non-relevant already count and collapse."""
    have = judged_labels.groupBy("query_id").agg(F.sum(1 - F.col("label")).alias("n"))
    relevant = judged_labels.where("label = 1").select("query_id", "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.asc("score"), F.asc("doc_id"))
    worst = bm25_run.join(relevant, ["query_id", "doc_id"], "left_anti").withColumn("ix", F.row_number().over(order)).where(F.col("ix") <= total)
    fill = worst.join(small(have), "query_id", "left").where(F.col("ix") <= total - F.coalesce("n", F.lit(0))).select("query_id", "doc_id", F.lit(0).alias("label"))
    return judged_labels.select("query_id", "doc_id", "label").unionByName(fill).distinct()


def training_table(features: DataFrame, labelled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features.join(labelled, ["query_id", "doc_id"]))


def in_test(key: Column, draw: int = 0, share: float = 0.2) -> Column:
    """Deterministic split by a hash of the key; ``draw`` gives independent splits."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(draw)), F.lit(1000)) < int(share * 1000)


def rank_models(seed: int = 1234) -> dict:
    """The reference's ten regressors by name."""
    out = {"linear": LinearRegression(standardization=True), "logistic": LogisticRegression(), "elastic_net": LinearRegression(regParam=1.0, elasticNetParam=0.5)}
    out |= {f"tree_{d}": DecisionTreeRegressor(maxDepth=d, seed=seed) for d in (2, 5, 7, 10, 15, 20)}
    return out | {"boosted": GBTRegressor(maxIter=400, maxDepth=3, stepSize=0.01, minInstancesPerNode=1, seed=seed)}


def ranked_by(model, table: DataFrame, probability: bool = False) -> DataFrame:
    """Predictions as a run; a logistic model ranks by class unless its probability is asked for."""
    scored = model.transform(table)
    score = vector_to_array("probability")[1] if probability else F.col("prediction")
    return ranked(scored.select("query_id", "doc_id", "label", score.alias("score")))


def mean_average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return average_precision(judged(run, qrels)).agg(F.round(F.avg("ap"), 6).alias("map"))


def checked(table: DataFrame, features: int = len(FEATURES)) -> DataFrame:
    """The training table; a row without a label, or whose vector has another length, raises an error when it is read."""
    good = F.col("label").isNotNull() & (F.size(vector_to_array("features")) == features)
    return table.where(F.assert_true(good, F.lit("training row without label or of wrong length")).isNull())


def train_and_evaluate(table: DataFrame, qrels: DataFrame, models: dict, draws: int = 5) -> DataFrame:
    """(model, draw, map_train, map_test): MAP on the training and the test queries of every model and draw.

    The predictions of all models and draws are one run, whose topics are (model, draw, side, query), so that they are judged in one pass.
    """
    table = written(checked(table))
    # Boosting runs several jobs a round: no more partitions than the rows need.
    table = written(table.coalesce(max(1, -(-table.count() // TRAINING_ROWS))))
    splits = [table.where(~in_test(F.col("query_id"), draw)).persist() for draw in range(draws)]

    def run(draw: int, name: str) -> DataFrame:
        side = F.when(in_test(F.col("query_id"), draw), F.lit("test")).otherwise(F.lit("train"))
        scored = models[name].copy().fit(splits[draw]).transform(table)
        return scored.select(F.concat_ws("/", F.lit(name), F.lit(str(draw)), side, "query_id").alias("query_id"), F.col("query_id").alias("topic"), "doc_id", F.col("prediction").cast("double").alias("score"))

    # The slow fits first; each is a row of small jobs, so several run side by side.
    jobs = [(draw, name) for name in reversed(models) for draw in range(draws)]
    with ThreadPool(min(PARALLEL_FITS, len(jobs))) as pool:
        runs = pool.starmap(inheritable_thread_target(table.sparkSession)(run), jobs, chunksize=1)
    for rows in splits:
        rows.unpersist()
    every = written(reduce(DataFrame.unionByName, runs))
    # Judgements for every topic of that name, by a join on the topic itself.
    topics = every.select("query_id", "topic").distinct()
    own = topics.join(qrels.withColumnRenamed("query_id", "topic"), "topic").select("query_id", "doc_id", "rel")
    ap = average_precision(judged(ranked(every.drop("topic")), own))
    part = F.split("query_id", "/")
    sides = ap.select(part[0].alias("model"), part[1].cast("int").alias("draw"), part[2].alias("side"), "ap").groupBy("model", "draw").pivot("side", ["train", "test"]).agg(F.round(F.avg("ap"), 6))
    return sides.select("model", "draw", F.col("train").alias("map_train"), F.col("test").alias("map_test"))


def mean_over_draws(maps: DataFrame) -> DataFrame:
    """(model, map_train, map_test): means over the draws."""
    return maps.groupBy("model").agg(F.round(F.avg("map_train"), 6).alias("map_train"), F.round(F.avg("map_test"), 6).alias("map_test"))


def df_range(tokens: DataFrame, n_docs: int, low: float = 0.02, high: float = 0.95) -> DataFrame:
    """(term, df) strictly between the two whole-numbered shares of the documents."""
    df = tokens.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") > int(low * n_docs)) & (F.col("df") < int(high * n_docs)))


def only_words(words: Column, listed: list[str] | None) -> Column:
    return words if listed is None else F.filter(words, lambda w: w.isin(listed))


def text_pipeline(classifier, n: int = 1, min_df: float = 0.02, max_df: float = 0.95, binary: bool = False) -> Pipeline:
    """Tokens -> n-grams -> counts in the document-frequency range -> classifier."""
    stages = [NGram(n=n, inputCol="tokens", outputCol="grams"), CountVectorizer(inputCol="grams", outputCol="counts", minDF=min_df, maxDF=max_df, binary=binary)]
    return Pipeline(stages=[*stages, classifier.setFeaturesCol("counts")])


def text_classifiers(seed: int = 1234) -> dict:
    """Logistic regression, decision tree and Bernoulli naive Bayes (on presence)."""
    return {
        "logistic": text_pipeline(LogisticRegression(maxIter=50, regParam=0.01)),
        # 30 is the deepest tree that the library grows.
        "tree": text_pipeline(DecisionTreeClassifier(maxDepth=30, seed=seed, maxMemoryInMB=512)),
        "bernoulli": text_pipeline(NaiveBayes(modelType="bernoulli"), binary=True),
    }

