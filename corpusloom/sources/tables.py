"""CSV sources with fixed headers, and the result sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDICATOR_COLUMNS = ["id", "repeats", "text"]
GOAL_COLUMNS = ["id", "links", "text"]
EXTERNAL_COLUMNS = ["id", "name", "definition", "goal", "target"]
GOAL_ROWS = 16

RESULT = T.StructType([
    T.StructField("k", T.IntegerType()), T.StructField("encoder", T.StringType()), T.StructField("random_seed", T.LongType()),
    T.StructField("checkpoint", T.IntegerType()), T.StructField("goal_count", T.IntegerType()), T.StructField("target_count", T.IntegerType()),
    T.StructField("validation", T.DoubleType()), T.StructField("test", T.DoubleType()),
])


def _read(spark: SparkSession, path: str, columns: list[str], subset: bool = False) -> DataFrame:
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "utf-8", "inferSchema": False}
    raw = spark.read.options(**options).csv(path)
    found = [c for c in raw.columns if c in columns] if subset else raw.columns
    if found != columns:
        raise ValueError(f"{path}: columns {raw.columns}, not {columns}")
    frame = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).na.fill("")
    return frame.select(F.monotonically_increasing_id().alias("ord"), *columns)


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, INDICATOR_COLUMNS)


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    goals = _read(spark, path, GOAL_COLUMNS)
    if (n := goals.count()) != GOAL_ROWS:
        raise ValueError(f"{path}: {n} goals, not {GOAL_ROWS}")
    return goals


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """The file may have more columns; the five needed stand in the order of EXTERNAL_COLUMNS."""
    return _read(spark, path, EXTERNAL_COLUMNS, subset=True)


def write_results(rows: DataFrame, directory: str, test_task: str, append: bool = True, header: bool = False, run: str | None = None) -> None:
    """CSV below directory/<test_task>.csv, in a folder for each run.

    A run that is written again (a retry, or the same settings once more) replaces its own rows and no others; without a name each call is a run
    of its own. append=False leaves only what is written now.
    """
    named = rows.select([f.name for f in RESULT]).withColumn("run", F.lit(run or uuid.uuid4().hex)).coalesce(1)
    writer = named.write.mode("overwrite").partitionBy("run").option("header", header)
    writer.option("partitionOverwriteMode", "dynamic" if append else "static").csv(_results_path(directory, test_task))


def read_results(spark: SparkSession, directory: str, test_task: str, header: bool = False) -> DataFrame:
    """The rows of all runs, as RESULT has them, and run."""
    schema = T.StructType([*RESULT, T.StructField("run", T.StringType())])
    return spark.read.schema(schema).option("header", header).csv(_results_path(directory, test_task))


def _results_path(directory: str, test_task: str) -> str:
    return f"{directory.rstrip('/')}/{test_task}.csv"
