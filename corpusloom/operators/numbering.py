"""Running numbers within a label, by a segmented prefix scan.

Rows are dealt to tasks by ranges of label and order, so a label of any size lies in as many tasks as it needs, in order. Each task numbers its
own rows; the rows that each (task, label) holds are counted, and the sum of the counts of a label's earlier tasks is added to its numbers. What is summed is
one row for each task and label that meet, which is at most the number of tasks and labels together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.skew import broadcast_small
from corpusloom.operators.storage import materialized


def numbered(rows: DataFrame, labels: Sequence[str], order: Sequence[str | Column], name: str, ranges: int | None = None, kind: str = "int") -> DataFrame:
    """rows with `name`: from 0, the number of the row within its label by `order`. Without labels all rows are numbered.

    Null labels are one label. Rows that `order` doesn't tell apart are numbered in any order. kind: the numbers' type.
    """
    spark = rows.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*(F.col(c) for c in labels), *(F.col(c) if isinstance(c, str) else c for c in order)]
    sorted_rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # the place within the task; stored, as another run could cut the ranges elsewhere
    placed = materialized(sorted_rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.spark_partition_id()), "placed")
    held = placed.groupBy("__task", *labels).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    earlier = Window.partitionBy(*(labels or [F.lit(0)])).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = held.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from"))
    offsets = broadcast_small(offsets.select(F.col("__task").alias("__t"), *(F.col(c).alias(f"__l{i}") for i, c in enumerate(labels)), "__before"))
    same = F.col("__task") == F.col("__t")
    for i, c in enumerate(labels):
        same = same & F.col(c).eqNullSafe(F.col(f"__l{i}"))
    return placed.join(offsets, same).select(*rows.columns, (F.col("__at") + F.col("__before")).cast(kind).alias(name))
