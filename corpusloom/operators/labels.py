"""Label dictionaries and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.numbering import numbered
from corpusloom.operators.skew import broadcast_small


def label_dictionary(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label and label_id by first appearance; '' has none."""
    firsts = rows.filter(F.col(label) != "").groupBy(F.col(label).alias("label")).agg(F.min(order).alias("first"))
    return numbered(firsts, [], ["first", "label"], "label_id").select("label", "label_id")


def encode(rows: DataFrame, dictionary: DataFrame, label: str) -> DataFrame:
    """rows with label_id; rows with a blank label go, a label that isn't in the dictionary is an error."""
    known = dictionary.select(F.col("label").alias("__label"), "label_id")
    joined = rows.filter(F.col(label) != "").join(broadcast_small(known), F.col(label) == F.col("__label"), "left")
    checked = F.when(F.col("label_id").isNull(), F.raise_error(F.concat(F.lit("Unknown label: "), F.col(label))).cast("int")).otherwise(F.col("label_id"))
    return joined.withColumn("label_id", checked).drop("__label")


def relevance(rows: DataFrame, dictionary: DataFrame, labels: str, row_id: str) -> DataFrame:
    """(row_id, label_id, rel): 1 for the labels in each row's list, 0 for all others; null lists have no rows."""
    listed = rows.filter(F.col(labels).isNotNull()).select(row_id, labels)
    unknown = F.raise_error(F.lit("Unknown label in a list")).cast("string")
    names = dictionary.agg(F.collect_set("label").alias("known"))
    checked = listed.join(broadcast_small(names)).withColumn(labels, F.transform(labels, lambda x: F.when(F.array_contains("known", x), x).otherwise(unknown)))
    return checked.join(broadcast_small(dictionary)).select(row_id, "label_id", F.array_contains(labels, F.col("label")).cast("int").alias("rel"))
