"""Test sets from CSV sources (Q1-Q16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions.sentences import join_all, split_sentences, word_count
from corpusloom.operators.sampling import stratified_split

OUTPUT = ["ord", "id", "repeats", "goal", "target", "text"]
SEED = 42


def indicators(raw: DataFrame) -> DataFrame:
    """Indicators with a text, their goal, target and word categories."""
    rows = raw.filter(F.col("text") != "").withColumn("goal", L.goal_of(F.col("id"))).withColumn("target", L.target_of(F.col("id")))
    rows = rows.withColumn("word_count", word_count(F.col("text")))
    return rows.withColumn("word_cat_3", L.word_category(F.col("word_count"), [10, 20])).withColumn("word_cat_2", L.word_category(F.col("word_count"), [15]))


def indicator_split(prepared: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(validation, test): a quarter and the rest of each goal, which have no row in common."""
    split = stratified_split(prepared, ["word_cat_3", "word_cat_2"], seed)
    validation, test = split.filter("validation").select(OUTPUT), split.filter("not validation").select(OUTPUT)
    if not validation.select("ord").intersect(test.select("ord")).isEmpty():
        raise AssertionError("validation and test have rows in common")
    return validation, test


def goals(raw: DataFrame) -> tuple[None, DataFrame]:
    return None, raw.select("ord", "id", "links", F.col("id").alias("goal"), "text")


def external(raw: DataFrame, test_task: str, concatenation_option: int) -> tuple[None, DataFrame]:
    """concatenation_option: 0 for the name, 1 for the definition, else both."""
    name, definition = L.squeeze(F.col("name")), L.squeeze(F.col("definition"))
    packed = lambda text: join_all(split_sentences(text))
    if concatenation_option == 0:
        text = name
    elif concatenation_option == 1:
        text = packed(L.definition_or_name(name, definition))
    else:
        text = L.name_and_definition(name, packed(definition))
    several = F.col("goal" if "SDG" in test_task else "target")
    return None, raw.select("ord", "id", L.repeats(several).alias("repeats"), L.first_label(F.col("goal")).alias("goal"), L.first_label(F.col("target")).alias("target"), text.alias("text"))
