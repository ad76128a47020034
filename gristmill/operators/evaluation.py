"""Evaluation of runs against judgements: all measures are windows over (query, rank) and one aggregation per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import small

CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(i / 10 for i in range(11))


def relevant_counts(qrels: DataFrame) -> DataFrame:
    """(query_id, num_rel): judgement lines with rel >= 1, each line counted; queries without any are left out."""
    return qrels.groupBy("query_id").agg(F.sum((F.col("rel") >= 1).cast("int")).alias("num_rel")).where("num_rel > 0")


def judged(run: DataFrame, qrels: DataFrame, graded: bool = False, descending: bool = False) -> DataFrame:
    """(query_id, doc_id, score, ix, rel, num_rel, hits, prec): the whole run in evaluation order; unjudged is not relevant.

    Order: score descending, doc_id ascending, or descending in the other evaluator's mode, which also keeps grades.
    """
    grade = F.max(F.col("rel") if graded else (F.col("rel") >= 1).cast("int"))
    rel = qrels.groupBy("query_id", "doc_id").agg(grade.alias("rel"))
    num = relevant_counts(qrels) if not graded else qrels.groupBy("query_id").agg(F.sum("rel").alias("num_rel")).where("num_rel > 0")
    rows = run.select("query_id", "doc_id", "score").join(small(num), "query_id").join(rel, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id") if descending else F.asc("doc_id"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ix", F.row_number().over(order)).withColumn("hits", F.sum("rel").over(upto))
    return rows.withColumn("prec", F.col("hits") / F.col("ix"))


def average_precision(rows: DataFrame, depth: int = 1000) -> DataFrame:
    """(query_id, num_ret, num_rel, num_rel_ret, ap); every relevant document counts in the denominator."""
    top = F.col("ix") <= depth
    return rows.groupBy("query_id").agg(
        F.count("*").alias("num_ret"), F.max("num_rel").alias("num_rel"), F.sum(F.when(top, F.col("rel"))).alias("num_rel_ret"),
        F.round(F.sum(F.when(top & (F.col("rel") > 0), F.col("rel") * F.col("prec")).otherwise(0.0)) / F.max("num_rel"), 6).alias("ap"),
    )


def _at(k: Column, compat: bool) -> tuple[Column, Column]:
    """(precision, recall) at a rank; beyond what was retrieved, hits over the rank, or over one less as the reference pads."""
    pad = F.when(k > F.col("n"), F.col("total") / (k - (1 if compat else 0)))
    return F.coalesce(F.col("prec"), pad, F.lit(0.0)), F.coalesce(F.col("hits"), F.col("total"), F.lit(0)) / F.col("num_rel")


def cutoffs(rows: DataFrame, ks: tuple[int, ...] = CUTOFFS, compat: bool = True, depth: int = 1000) -> DataFrame:
    """(query_id, k, precision, recall, f1)."""
    rows = rows.where(F.col("ix") <= depth)
    totals = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("num_rel").alias("num_rel"), F.sum("rel").alias("total"))
    wanted = totals.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    at = wanted.join(rows.select("query_id", F.col("ix").alias("k"), "prec", "hits"), ["query_id", "k"], "left")
    p, r = _at(F.col("k"), compat)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return at.select("query_id", "k", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def r_precision(rows: DataFrame, depth: int = 1000) -> DataFrame:
    """(query_id, r_prec): precision at rank num_rel; where fewer were retrieved, hits over num_rel."""
    rows = rows.where(F.col("ix") <= depth)
    got = F.sum(F.when(F.col("ix") <= F.col("num_rel"), F.col("rel")).otherwise(0))
    return rows.groupBy("query_id").agg(F.round(got / F.max("num_rel"), 6).alias("r_prec"))


def interpolated(rows: DataFrame, levels: tuple[float, ...] = LEVELS, depth: int = 1000) -> DataFrame:
    """(query_id, level, precision): the best precision from the first rank on whose recall reaches the level, else 0."""
    rows = rows.where(F.col("ix") <= depth)
    after = Window.partitionBy("query_id").orderBy("ix").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    curve = rows.select("query_id", "ix", (F.col("hits") / F.col("num_rel")).alias("recall"), F.max("prec").over(after).alias("best"))
    each = curve.select("query_id", F.explode(F.array(*map(F.lit, levels))).alias("level"), "ix", "recall", "best")
    return each.groupBy("query_id", "level").agg(F.round(F.coalesce(F.min_by(F.when(F.col("recall") >= F.col("level"), F.col("best")), F.when(F.col("recall") >= F.col("level"), F.col("ix"))), F.lit(0.0)), 6).alias("precision"))


def ndcg(rows: DataFrame, compat: bool = True) -> DataFrame:
    """(query_id, ndcg) over all retrieved documents.

    compat: the ideal takes every retrieved document as relevant and goes on counting ranks from the last one,
    as the reference does; otherwise the ideal ranks the num_rel relevant documents first.
    """
    gain = F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("ix") + 1.0))
    n = F.count("*")
    if compat:
        sums = rows.groupBy("query_id").agg(gain.alias("dcg"), n.alias("n"))
        ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(F.col("n") + i + 1.0))
    else:
        sums = rows.groupBy("query_id").agg(gain.alias("dcg"), F.max("num_rel").alias("n"))
        ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return sums.select("query_id", F.round(F.try_divide(F.col("dcg"), ideal), 6).alias("ndcg"))


def per_topic(rows: DataFrame, depth: int = 1000) -> DataFrame:
    """(query_id, num_ret, num_rel, num_rel_ret, ap, r_prec, ndcg) in one aggregation; definitions as in the single measures (nDCG in compat mode)."""
    top = F.col("ix") <= depth
    n = F.col("num_ret")
    gain = F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("ix") + 1.0))
    each = rows.groupBy("query_id").agg(
        F.count("*").alias("num_ret"), F.max("num_rel").alias("num_rel"), F.sum(F.when(top, F.col("rel"))).alias("num_rel_ret"),
        F.round(F.sum(F.when(top & (F.col("rel") > 0), F.col("rel") * F.col("prec")).otherwise(0.0)) / F.max("num_rel"), 6).alias("ap"),
        F.round(F.sum(F.when(top & (F.col("ix") <= F.col("num_rel")), F.col("rel")).otherwise(0)) / F.max("num_rel"), 6).alias("r_prec"), gain.alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1 / F.log2(n + i + 1.0))
    return each.withColumn("ndcg", F.round(F.try_divide(F.col("dcg"), ideal), 6)).drop("dcg")


def summary(rows: DataFrame) -> DataFrame:
    """One row: topics, totals, and the macro averages map, r_prec and ndcg."""
    return per_topic(rows).agg(F.count("*").alias("topics"), F.sum("num_ret").alias("num_ret"), F.sum("num_rel").alias("num_rel"), F.sum("num_rel_ret").alias("num_rel_ret"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("r_prec"), 6).alias("r_prec"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def report_lines(rows: DataFrame) -> DataFrame:
    """(query_id, n, line): the report of every topic, and with a null query_id that of the averages over topics, in the order of n.

    Totals, interpolated precision at the recall levels, average precision, precision, recall and F1 at the cut-offs, R-precision, nDCG.
    """
    per = per_topic(rows).select("query_id", "num_ret", "num_rel", "num_rel_ret", "ap", "r_prec", "ndcg")
    curve = interpolated(rows).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("%.2f", "level"), "precision"))).alias("curve"))
    at = cutoffs(rows).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("precision", "recall", "f1")))).alias("at"))
    topics = per.join(curve, "query_id").join(at, "query_id")
    numbers = ["num_ret", "num_rel", "num_rel_ret", "ap", "r_prec", "ndcg"]
    mean = lambda c: F.avg(c)
    averages = topics.agg(
        *[(F.sum(c) if c.startswith("num") else mean(c)).alias(c) for c in numbers],
        F.create_map(*[x for v in LEVELS for k in [f"{v:.2f}"] for x in (F.lit(k), mean(F.col("curve")[k]))]).alias("curve"),
        F.create_map(*[x for k in CUTOFFS for x in (F.lit(k), F.struct(*[mean(F.col("at")[k][c]).alias(c) for c in ("precision", "recall", "f1")]))]).alias("at"), F.count("*").alias("topics"),
    ).where("topics > 0")
    every = topics.select(F.col("query_id").cast("string").alias("query_id"), *numbers, "curve", "at").unionByName(averages.select(F.lit(None).cast("string").alias("query_id"), *numbers, "curve", "at"))
    text = lambda form, *c: F.format_string(form, *c)
    lines = [F.concat(F.lit("Queryid: "), F.coalesce("query_id", F.lit("all"))), text("Retrieved: %d", F.col("num_ret").cast("long")), text("Relevant: %d", F.col("num_rel").cast("long")), text("Rel_ret: %d", F.col("num_rel_ret").cast("long")), F.lit("Interpolated recall - precision averages:")]
    lines += [text(f"at {v:.2f} %.4f", F.col("curve")[f"{v:.2f}"]) for v in LEVELS]
    lines += [text("Average precision: %.4f", F.col("ap")), F.lit("Precision, recall, F1 at the cut-offs:")]
    lines += [text(f"at {k} docs: %.4f %.4f %.4f", F.col("at")[k]["precision"], F.col("at")[k]["recall"], F.col("at")[k]["f1"]) for k in CUTOFFS]
    lines += [text("R-Precision: %.4f", F.col("r_prec")), text("nDCG: %.4f", F.col("ndcg"))]
    return every.select("query_id", F.posexplode(F.array(*lines)).alias("n", "line"))


def precision_recall_points(rows: DataFrame, depth: int = 1000) -> DataFrame:
    """(query_id, ix, recall, precision, interpolated): the points of the curve; drawing is left to whoever wants it."""
    after = Window.partitionBy("query_id").orderBy("ix").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.where(F.col("ix") <= depth)
    return rows.select("query_id", "ix", F.round(F.col("hits") / F.col("num_rel"), 6).alias("recall"), F.round("prec", 6).alias("precision"), F.round(F.max("prec").over(after), 6).alias("interpolated"))


def auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 64) -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties sharing their mean rank.

    Counts per distinct score are aggregated first. Ranks are running sums within buckets of the score (cut at approximate
    quantiles) plus the total of the buckets below, so no task orders all scores.
    """
    counts = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    bounds = sorted(set(scored.approxQuantile(score, [k / buckets for k in range(1, buckets)], 0.005)))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b <= F.col(score)))
    counts = counts.withColumn("bucket", bucket)
    # One number per bucket comes to the driver.
    totals = {r[0]: r[1] for r in counts.groupBy("bucket").agg(F.sum("n")).collect()}
    lower = [sum(n for k, n in totals.items() if k < at) for at in range(len(bounds) + 1)]
    own = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.get(F.array(*map(F.lit, lower)), F.col("bucket")).cast("long")
    ranks = counts.select("pos", "n", (below + own + (F.col("n") + 1) / 2).alias("mean_rank"))
    t = ranks.agg(F.sum(F.col("pos") * F.col("mean_rank")).alias("s"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return t.select(F.round(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), 6).alias("auc"))
