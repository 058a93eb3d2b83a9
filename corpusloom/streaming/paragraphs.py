"""Pages of goals' articles as they arrive.

A page is one row, so what its lines mean depends on no other page: each micro-batch is read whole by the plan for tables, windows over lines included, and no
state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.functions import markup
from corpusloom.functions.masking import clean
from corpusloom.operators.articles import slices, specific_paragraphs


def cleaned_paragraphs(pages: DataFrame) -> DataFrame:
    """Masked paragraphs of pages (a table or one micro-batch)."""
    stripped = pages.withColumn("text", markup.strip_markup(F.col("text")))
    found = specific_paragraphs(stripped, slices(pages)).withColumn("text", markup.strip_links(F.col("text")))
    return found.withColumn("text", clean(F.col("text"), F.col("section")))


def write_paragraphs(pages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the paragraphs of a stream of pages, as Parquet with a folder for each micro-batch.

    A batch that is repeated after a failure replaces its own folder, so every page's paragraphs stand there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        cleaned_paragraphs(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
