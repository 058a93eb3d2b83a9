"""Correction, accuracy, NDCG and the batch-hard triplet loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.neighbours import distance


def corrected(label: Column, multiple: Column, prediction: Column) -> Column:
    """The true label where the prediction is one of the row's several labels."""
    return F.when(F.coalesce(F.array_contains(multiple, prediction), F.lit(False)), label).otherwise(prediction)


def accuracy(rows: DataFrame, label: Column, prediction: Column) -> DataFrame:
    return rows.agg(F.avg((label == prediction).cast("double")).alias("accuracy"))


def ndcg(scores: DataFrame, k: int = 5) -> DataFrame:
    """q_id and its NDCG at k. scores: q_id, label_id, p, rel.

    Labels of equal score share the mean gain over the discounts of their ranks; a row without relevant labels has 0.
    """
    def gain(order: list[Column], score: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(*order))
        discounted = scores.withColumn("rank", rank).withColumn("discount", F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
        ties = discounted.groupBy("q_id", *score).agg((F.avg("rel") * F.sum("discount")).alias("g"))
        return ties.groupBy("q_id").agg(F.sum("g").alias("gain"))

    rounded = scores.withColumn("p", F.round("p", 12))
    scores = rounded
    found = gain([F.desc("p"), F.col("label_id")], ["p"]).withColumnRenamed("gain", "dcg")
    ideal = gain([F.desc("rel"), F.col("label_id")], ["rel"]).withColumnRenamed("gain", "best")
    return found.join(ideal, "q_id").select("q_id", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def triplet_loss(batches: DataFrame, margin: float) -> DataFrame:
    """iteration and its loss. batches: iteration, id, label, vector (some dozen rows an iteration).

    For each anchor: the farthest row of its label, less the nearest of another, plus the margin, or 0 if that is more.
    """
    a = batches.select("iteration", F.col("id").alias("a"), F.col("label").alias("la"), F.col("vector").alias("va"))
    b = batches.select("iteration", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("vb"))
    pairs = a.join(b, "iteration").withColumn("d", distance(F.col("va"), F.col("vb")))
    same, other = F.col("la") == F.col("lb"), F.col("la") != F.col("lb")
    hard = pairs.groupBy("iteration", "a").agg(F.max(F.when(same & (F.col("a") != F.col("b")), F.col("d"))).alias("far"), F.min(F.when(other, F.col("d"))).alias("near"))
    # without another row of the label the farthest is the anchor itself
    loss = F.greatest(F.lit(0.0), F.coalesce("far", F.lit(0.0)) - F.coalesce("near", F.lit(0.0)) + margin)
    return hard.groupBy("iteration").agg(F.avg(loss).alias("loss"))
