"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: a chunk runs on to the first full stop, line end
or other mark after MIN_CHUNK characters; where there is none up to MAX_CHUNK, to the first character that repeats the third
before it, which any script has; or else it ends after MAX_CHUNK. Each chunk gets a
128-bit identifier, and the document becomes the ordered list of its identifiers, its recipe.
Chunks are deduplicated once, by content, to verify that no identifier stands for two chunks;
from then on only recipes move, never the texts. Cutting is a function of the text, so recipes
are equal exactly if texts are. Were an identifier to stand for two chunks, the recipes are
made anew with SHA-256 identifiers, which are verified alike. Recipes are grouped as they are, copies first within each
task; groups and rows then meet by a 128-bit digest of the recipe, which is held to the recipes in the same way, and rows of
large groups are dealt over several tasks.

Cases: a null text counts as empty; an empty text has the empty recipe, and all of these are one
group. Rows with a null doc_id take part, and lose to any other id; rows that repeat an id and a
text are one document and get the same verdict in `classify`, and `deduplicate` keeps one of them. Extra columns are ignored
by `classify` and kept by `deduplicate`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_small, salted_join, stored

MIN_CHUNK = 512
MAX_CHUNK = 8192
#: Where a chunk may end, as regular expressions: at a mark, or else behind a character that stands three places before as well.
CUT_AFTER = r"[.!?;:\n]"
CUT_ELSE = r"(.)..\1"


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The text's content-defined chunks in order; joined they are the text."""
    rule = rf"(?s).{{{low},{high - 1}}}?{CUT_AFTER}|.{{{low},{high - 4}}}?{CUT_ELSE}|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def _fast_id(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk, F.octet_length(chunk)).alias("b"))


def _sha_id(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def _ambiguous(texts: DataFrame, identify) -> bool:
    """Whether one identifier stands for two different chunks. Chunks move once, deduplicated before the shuffle."""
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("uses")).select(identify(F.col("chunk")).alias("id"))
    clashes = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return not clashes.isEmpty()


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe, whose identifiers are verified."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for identify in (_fast_id, _sha_id):
        if not _ambiguous(texts, identify):
            return texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), identify).alias("recipe"))
    raise ValueError("two different chunks have the same SHA-256")


def _digests(recipe: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), recipe, F.size(recipe)).alias(name) for k, name in ((2, "digest"), (3, "digest2"))]


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_sha256, n_chunks and the recipe's digest) and groups (digest, keep_id, group_size), both stored."""
    listed = stored(recipes(docs).select("*", *_digests(F.col("recipe")), F.monotonically_increasing_id().alias("row")), "recipes")
    keys = ["digest", "digest2"]
    groups = stored(listed.groupBy("recipe", *keys).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("recipe"), "groups")
    if not groups.groupBy(keys).count().filter("count > 1").isEmpty():
        raise ValueError("two different recipes have the same digests")
    return listed.select("doc_id", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), *keys, "row"), groups


def _verdicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    found = salted_join(rows, groups, ["digest", "digest2"], "group_size", F.xxhash64("row"), max(1, rows.count()))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks")


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    return _verdicts(*_classified(docs))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, all its columns as they are: that with the largest doc_id, or any where all ids are null or that id repeats."""
    rows, groups = _classified(docs)
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("")).alias("__id")
    away = _verdicts(rows, groups).filter("not kept").select(name(F.col("doc_id")), F.col("text_sha256").alias("__sha")).distinct()
    away = broadcast_small(stored(away, "away"))  # if there are few, texts needn't move
    marked = docs.select("*", name(docs["doc_id"]), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256).alias("__sha"))
    kept = marked.join(away, ["__id", "__sha"], "left_anti")
    if not rows.groupBy("doc_id", "digest", "digest2").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__id", "__sha"])
    return kept.select(*docs.columns)
