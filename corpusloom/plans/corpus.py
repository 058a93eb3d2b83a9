"""From wiki files to excerpts and training samples (entry A: E9, C5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.masking import clean
from corpusloom.operators import articles, excerpts, sampling
from corpusloom.sources.articles import read_pages


class DataExtractor:
    min_length, max_length, max_std = 20, 40, 15
    filter_min = filter_max = True

    def __init__(self, input_files: Sequence[str], flags: Sequence[bool], **cluster):
        """cluster: min_df, eps, min_samples and stop_words of the boilerplate filter."""
        self.input_files, self.flags, self.cluster = input_files, flags, cluster

    def run(self, spark: SparkSession) -> DataFrame:
        paragraphs = articles.paragraphs(read_pages(spark, self.input_files, self.flags))
        cleaned = paragraphs.withColumn("text", clean(F.col("text"), F.col("section")))
        return excerpts.excerpts(cleaned, self.min_length, self.max_length, self.max_std, self.filter_min, self.filter_max, **self.cluster)


class FineTuningDataExtractor:
    def __init__(self, input_files: Sequence[str], flags: Sequence[bool], **cluster):
        self.extractor = DataExtractor(input_files, flags, **cluster)

    def extract(self, data: DataFrame, goal_count: int, target_count: int) -> DataFrame:
        drawn = sampling.training_sample(data, goal_count, target_count, ["ord", "id"])
        return drawn.withColumn("license", F.lit(None).cast("string"))

    def run(self, spark: SparkSession, goal_count: int, target_count: int) -> DataFrame:
        return self.extract(self.extractor.run(spark), goal_count, target_count)
