"""Labels, classifiers and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import ranges

#: Rows of label counts up to which they are broadcast.
BROADCAST_COUNTS = 200_000


def label_counts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n)."""
    return rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))


def merge_label_counts(neighbours: DataFrame, counts: DataFrame, group: str, key: str, label: str) -> DataFrame:
    """(group, label, n): counts of all of a group's keys, positive sums only. The counts are broadcast where they are counted to be few."""
    few = counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS
    return neighbours.join(F.broadcast(counts) if few else counts, key).groupBy(group, label).agg(F.sum("n").alias("n")).where("n > 0")


def top_labels(merged: DataFrame, group: str, label: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), label))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k)


def top_accuracy(top: DataFrame, truth: DataFrame, group: str, label: str) -> DataFrame:
    """One row: the share of groups whose true label is among their top labels."""
    hits = top.select(F.col(group).alias("_g"), F.col(label).alias("_l")).distinct()
    joined = truth.join(hits, (F.col(group) == F.col("_g")) & (F.col(label) == F.col("_l")), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("_g").alias("n_hit"), F.avg(F.col("_g").isNotNull().cast("double")).alias("accuracy"))


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, F1, AUROC (ties count half) and average precision.

    Rows are first counted by distinct score; running counts over scores go in ranges.
    """
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    run = ranges.with_running(by, [F.desc("s")], tp=F.col("p"), fp=F.col("q"))
    hit = F.col("s") >= threshold
    total = run.agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("q"))).alias("tn"),
        F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("area"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return total.select("tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / (positives + negatives)).alias("accuracy"), (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), (F.col("area") / (positives * negatives)).alias("auroc"), (F.col("ap") / positives).alias("average_precision"))


def tidy(metrics: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide to long: (ids, metric, value)."""
    return metrics.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "metric", "value")


def nearest_class(train: DataFrame, test: DataFrame, k: int, label: str) -> DataFrame:
    """(query, predicted): majority label of the k nearest rows; ties go to the least label."""
    from .vectors import nearest

    best = nearest(train, test, k).join(train.select(F.col("id").alias("neighbour"), F.col(label).alias("l")), "neighbour")
    votes = best.groupBy("query", "l").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("predicted"))


def class_report(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """(label, support, precision, recall, f1) of every label that is true or predicted somewhere; a share of nothing is 0."""
    counted = predicted.groupBy(label, guess).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(F.explode(F.array(
        F.struct(F.col(label).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col(label) == F.col(guess), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(guess).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")),
    )).alias("r")).select("r.*")
    summed = rows.groupBy("label").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))
    share = lambda of: F.when(of > 0, F.col("hit") / of).otherwise(0.0)
    return summed.select("label", "support", share(F.col("given")).alias("precision"), share(F.col("support")).alias("recall"), F.when(F.col("support") + F.col("given") > 0, 2 * F.col("hit") / (F.col("support") + F.col("given"))).otherwise(0.0).alias("f1"))


def neighbour_labels(sentences: DataFrame, neighbours: DataFrame, counts: DataFrame, weighted: bool = False) -> DataFrame:
    """(sent, label, n): for each token occurrence of a sentence (sent, token), the label counts (token, label, n) of all its neighbours, added up.

    neighbours is (query, neighbour, score) for the distinct tokens. A sentence's tokens are counted, so a neighbour's labels are met once for each distinct token of a
    sentence; counts that aren't positive are left out. weighted multiplies counts by score.
    """
    bags = sentences.groupBy("sent", "token").agg(F.count(F.lit(1)).alias("times"))
    labels = neighbours.join(counts, neighbours["neighbour"] == counts["token"]).groupBy("query", "label").agg(F.sum(F.col("score") * F.col("n") if weighted else F.col("n")).alias("n"))  # of a token's neighbours, added up before sentences meet them
    return bags.join(labels, bags["token"] == labels["query"]).groupBy("sent", "label").agg(F.sum(F.col("times") * F.col("n")).alias("n")).where("n > 0")


def classifier(name: str, seed: int = 42):
    """An estimator on (features, label) with label 0 or 1: one of this package's linear models, or of pyspark.ml."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, NaiveBayes, RandomForestClassifier
    from pyspark.ml.feature import Binarizer

    from .linear import ProximalLinear, Ridge, SelectThenFit

    makers = {
        "ridge": lambda: Ridge(1.0),
        "forest": lambda: RandomForestClassifier(numTrees=100, seed=seed),
        "svm": lambda: LinearSVC(regParam=0.01, maxIter=30),
        "svm_l1": lambda: ProximalLinear("squared_hinge", 0.01, 1.0),
        "sgd_l2": lambda: ProximalLinear("hinge", 0.01, 0.0),
        "sgd_l1": lambda: ProximalLinear("hinge", 0.01, 1.0),
        "sgd_elastic": lambda: ProximalLinear("hinge", 0.01, 0.15),
        "bernoulli_nb": lambda: Pipeline(stages=[Binarizer(threshold=0.0, inputCol="features", outputCol="bits"), NaiveBayes(modelType="bernoulli", smoothing=0.01, featuresCol="bits")]),
        "l1_pipeline": lambda: SelectThenFit(ProximalLinear("squared_hinge", 0.01, 1.0), ProximalLinear("squared_hinge", 0.01, 0.0)),
    }
    if name not in makers:
        raise ValueError(f"no such classifier: {name}")
    return makers[name]()
