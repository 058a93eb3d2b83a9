"""Paragraphs to excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.labels import standard_target
from corpusloom.functions.sentences import pack_sentences, split_sentences, word_count
from corpusloom.operators import boilerplate
from corpusloom.operators.numbering import numbered
from corpusloom.operators.skew import salted_join
from corpusloom.operators.storage import materialized

GROUP = ["goal", "target", "section", "source_url", "title", "revision_id", "revision_timestamp"]
ORDER = ["file_ord", "page_ord", "emit_ord"]


def sentence_lists(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their sentences as an array; section names lose their commas."""
    return paragraphs.withColumn("section", F.replace("section", F.lit(","), F.lit(""))).withColumn("sentences", split_sentences(F.col("text")))


def drop_boilerplate(lists: DataFrame, **parameters) -> DataFrame:
    """The arrays without the sentences of dense clusters, in order; paragraphs left without any stay."""
    lists = materialized(lists, "sentences")
    at = F.struct(*ORDER, F.col("i")).alias("id")
    flat = lists.select(*ORDER, F.posexplode("sentences").alias("i", "text")).select(at, "text")
    kept = flat.join(boilerplate.noise(flat, **parameters), "id", "left_semi")
    back = kept.groupBy(*(F.col(f"id.{c}").alias(c) for c in ORDER)).agg(F.array_sort(F.collect_list(F.struct(F.col("id.i").alias("i"), "text"))).alias("s"))
    joined = lists.drop("sentences").join(back, ORDER, "left")
    return joined.withColumn("sentences", F.coalesce(F.transform("s", lambda x: x["text"]), F.array().cast("array<string>"))).drop("s")


def pack(lists: DataFrame, min_length: int = 20, max_length: int = 40) -> DataFrame:
    """One row per excerpt, in order; of equal ones (case aside) of a group the first stays.

    Equal ones are found by a 128-bit digest, whose rows move without their texts. A second digest is held to it: should two
    texts share the first only, all are compared as they are.
    """
    packed = lists.select(*ORDER, *GROUP, F.posexplode(pack_sentences(F.col("sentences"), min_length, max_length)).alias("part", "excerpt"))
    packed = materialized(packed, "packed")
    place, text = F.struct(*ORDER, "part"), [*(F.col(c) for c in GROUP), F.lower("excerpt")]
    marks = packed.select(place.alias("place"), F.xxhash64(*text).alias("d1"), F.xxhash64(F.lit(1), *text).alias("d2"), F.md5(F.to_json(F.struct(*text))).alias("check"))
    firsts = materialized(marks.groupBy("d1", "d2").agg(F.min("place").alias("place"), (F.min("check") == F.max("check")).alias("one")), "firsts")
    if not firsts.filter("not one").isEmpty():
        whole = Window.partitionBy(*GROUP, F.lower("excerpt")).orderBy(*ORDER, "part")
        return packed.withColumn("rn", F.row_number().over(whole)).filter("rn = 1").drop("rn")
    return packed.join(firsts.select(*(F.col(f"place.{c}").alias(c) for c in (*ORDER, "part"))), [*ORDER, "part"], "left_semi")


def _groups(packed: DataFrame) -> DataFrame:
    """Of each group: its key, its number of rows, the paragraph in which it begins, and its first row if this is the first of its target."""
    row = F.struct(*ORDER, "part")
    groups = packed.groupBy(F.struct(*GROUP).alias("key")).agg(F.min(F.struct(*ORDER)).alias("begun"), F.min(row).alias("opens"), F.count(F.lit(1)).alias("rows"))
    label = F.struct("key.goal", "key.target").alias("label")  # a struct, as null labels are labels too
    firsts = groups.groupBy(label).agg(F.min("opens").alias("opens"))
    return groups.withColumn("label", label).join(firsts.withColumn("first", F.lit(True)), ["label", "opens"], "left").select("key", "rows", "begun", F.when(F.col("first"), F.col("opens")).alias("first"))


def number(packed: DataFrame, min_length: int = 20, max_length: int = 40, max_std: int = 15, filter_min: bool = True, filter_max: bool = True) -> DataFrame:
    """Excerpts of fitting length with their ids, goal_target_counter.

    The first excerpt of a target is kept whatever its length. Groups follow each other in the order in which they begin. A label's rows
    are numbered where they lie, however many they are.
    """
    groups = materialized(_groups(packed), "groups")
    total = groups.agg(F.sum("rows")).first()[0] or 1
    rows = salted_join(packed.withColumn("key", F.struct(*GROUP)), groups, ["key"], "rows", F.xxhash64(*ORDER, "part"), total).withColumn("words", word_count(F.col("excerpt")))
    fits = F.lit(True)
    if filter_min:
        fits = fits & (F.col("words") >= min_length - max_std)
    if filter_max:
        fits = fits & (F.col("words") <= max_length + max_std)
    first = F.coalesce(F.struct(*ORDER, "part") == F.col("first"), F.lit(False))
    kept = rows.filter(fits | ((F.col("target") != "") & first)).filter(standard_target(F.col("target")))
    kept = kept.select("excerpt", *GROUP, F.struct("begun", *ORDER, "part").alias("ord"))
    counted = numbered(kept, ["goal", "target"], ["ord"], "counter", kind="long")
    named = counted.withColumn("id", F.concat_ws("_", "goal", "target", F.col("counter").cast("string")))
    return named.select("id", F.col("excerpt").alias("modified_text_excerpt"), *GROUP, "ord")


def excerpts(paragraphs: DataFrame, min_length: int = 20, max_length: int = 40, max_std: int = 15, filter_min: bool = True, filter_max: bool = True, **cluster) -> DataFrame:
    """From cleaned paragraphs to sorted excerpts; `ord` holds their order within a label."""
    lists = drop_boilerplate(sentence_lists(paragraphs), **cluster)
    return number(pack(lists, min_length, max_length), min_length, max_length, max_std, filter_min, filter_max).orderBy("goal", "target", "ord")
