"""Queries over the test tables, one or more for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import markup, masking
from corpusloom.functions.sentences import finish, join_sentences, pack_sentences, split_sentences, word_count
from corpusloom.operators import articles, boilerplate, encoders, excerpts, labels, metrics, neighbours, sampling
from corpusloom.operators.storage import materialized

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectors


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fourth vector is a query, the others are for training."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"), "label")
    train = e.filter("vec_id % 4 <> 0").select(F.col("vec_id").alias("t_id"), F.col("label").alias("label_id"), F.col("embedding").alias("vector"))
    return queries, train


def _dictionary(train: DataFrame) -> DataFrame:
    return train.select("label_id").distinct()


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, train = sides(spark, sf_dir)
    return neighbours.nearest(queries, train, 3).select("q_id", "t_id", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


def _predicted(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries, train = sides(spark, sf_dir)
    found = neighbours.predict(neighbours.votes(neighbours.nearest(queries, train, k), k))
    return found.join(queries.select("q_id", "label"), "q_id")


def knn1_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, 1).select("q_id", "label", "prediction")


def knn3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, 3).select("q_id", "label", "prediction")


def knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, train = sides(spark, sf_dir)
    near = materialized(neighbours.nearest(queries, train, 3), "near")  # one search for every k
    known = queries.select("q_id", "label")
    parts = [metrics.accuracy(neighbours.predict(neighbours.votes(near, k)).join(known, "q_id"), F.col("label"), F.col("prediction")).select(F.lit(k).alias("k"), F.round("accuracy", 6).alias("accuracy")) for k in (1, 3)]
    return parts[0].unionAll(parts[1])


def label_correction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir, 3)
    multiple = F.array(F.col("label"), (F.col("label") + 3) % 10)
    return metrics.accuracy(rows, F.col("label"), metrics.corrected(F.col("label"), multiple, F.col("prediction"))).select(F.round("accuracy", 6).alias("accuracy"))


def _scored(spark: SparkSession, sf_dir: str, k: int, centred: bool = False) -> DataFrame:
    queries, train = sides(spark, sf_dir)
    side = neighbours.centroids(train) if centred else train
    p = neighbours.probabilities(neighbours.votes(neighbours.nearest(queries, side, k), k), _dictionary(train))
    relevant = F.array(F.col("label"), (F.col("label") + 1) % 10)
    return p.join(queries.select("q_id", "label"), "q_id").select("q_id", "label_id", "p", F.array_contains(relevant, F.col("label_id")).cast("int").alias("rel"))


def knn20_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 20).select("q_id", "label_id", F.round("p", 6).alias("p"))


def ndcg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_scored(spark, sf_dir, 20)).select("q_id", F.round("ndcg", 6).alias("ndcg"))


def centroid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train = sides(spark, sf_dir)
    return neighbours.centroids(train).select("label_id", F.posexplode("vector").alias("pos", "x")).select("label_id", "pos", F.round("x", 6).alias("x"))


def centroid_ndcg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_scored(spark, sf_dir, 10, centred=True)).select("q_id", F.round("ndcg", 6).alias("ndcg"))


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each k, as an evaluation writes them."""
    acc = knn_accuracy(spark, sf_dir)
    return acc.select("k", F.lit("HASHING").alias("encoder"), F.lit(SEED).cast("long").alias("random_seed"), F.lit(0).alias("checkpoint"), F.lit(14).alias("goal_count"), F.lit(6).alias("target_count"), F.lit(None).cast("double").alias("validation"), F.col("accuracy").alias("test"))


def batch_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("vec_id").alias("pos"))
    return sampling.balanced_batches(e, 4, start=1, seed=SEED, n_many=7).select("iteration", "id", "label")


def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    drawn = batch_sampler(spark, sf_dir).join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return metrics.triplet_loss(drawn, 0.4).select("iteration", F.round("loss", 6).alias("loss"))


def encoded_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hashing encoder gives: the numbers of each vector that aren't 0."""
    rows = encoders.embed(table(spark, sf_dir, "benchmark"), "text", "HASHING")
    listed = rows.select("item_id", F.size("vector").alias("dim"), F.posexplode("vector").alias("pos", "x"))
    return listed.filter("x <> 0").select("item_id", "dim", "pos", F.round(F.col("x").cast("double"), 4).alias("x"))


# ---------------------------------------------------------------- labels and samples


def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_dictionary(table(spark, sf_dir, "documents"), "source", "doc_id")


def _repeats(c: str) -> Column:
    """A list of identifiers made up from a number: none, one, or two of the form x.y.z."""
    one = F.concat((F.col(c) % 17 + 1).cast("string"), F.lit("."), (F.col(c) % 9).cast("string"), F.lit(".1"))
    two = F.concat((F.col(c) % 5 + 1).cast("string"), F.lit(".b.2"))
    return F.when(F.col(c) % 4 == 0, "").when(F.col(c) % 4 == 1, one).otherwise(F.concat_ws(",", one, two))


def multi_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _repeats("doc_id").alias("r"))
    both = [F.array_join(L.multiple_labels(F.col("r"), t), "|").alias(n) for t, n in (("ML-IND-SDG", "goals"), ("MC-IND-TRG", "targets"), ("ML-SDG-SDG", "links"))]
    return rows.select("doc_id", "r", *both)


def indicator_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.concat((F.col("p_partkey") % 17 + 1).cast("string"), F.lit("."), F.when(F.col("p_partkey") % 3 == 0, F.lit("b")).otherwise((F.col("p_partkey") % 9 + 1).cast("string")), F.lit("."), (F.col("p_size") % 4 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", i.alias("id")).select("p_partkey", "id", L.goal_of(F.col("id")).alias("goal"), L.target_of(F.col("id")).alias("target"))


def word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    rows = b.unionAll(c).withColumn("words", word_count(F.col("text")))
    return rows.select("id", "words", L.word_category(F.col("words"), [10, 20]).alias("cat3"), L.word_category(F.col("words"), [15]).alias("cat2"))


def external_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" Of  "), F.col("p_type"))).alias("definition"), F.concat_ws(" , ", "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))).alias("goal"))
    name, definition = L.squeeze(F.col("name")), L.squeeze(F.col("definition"))
    return rows.select("p_partkey", L.first_label(F.col("goal")).alias("goal"), L.repeats(F.col("goal")).alias("repeats"), L.definition_or_name(name, definition).alias("definition"), L.name_and_definition(name, definition).alias("both"))


def _goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words = word_count(F.col("text"))
    return d.select("doc_id", F.col("source").alias("goal"), F.coalesce("lang", F.lit("")).alias("section"), words.alias("words"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _goals(spark, sf_dir).withColumn("cat3", L.word_category(F.col("words"), [100, 400])).withColumn("cat2", L.word_category(F.col("words"), [200]))
    return sampling.stratified_split(rows, ["cat3", "cat2"], SEED, row_id="doc_id").select("doc_id", "goal", "validation")


_LANGS = ["es", "de", "fr", "en"]


def goal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.goal_sample(_goals(spark, sf_dir), 14, ["doc_id"], _LANGS).select("doc_id", "goal", "section")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _goals(spark, sf_dir)
    return rows.withColumn("target", F.concat(F.lit("1."), (F.col("doc_id") % 7).cast("string"))).withColumn("section", F.when(F.col("doc_id") % 2 == 0, "Targets").otherwise(F.col("section")))


def target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.target_sample(_targets(spark, sf_dir), 6, ["doc_id"]).select("doc_id", "target")


def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir).select("doc_id", "goal", "target", "section")
    parts = [sampling.goal_sample(rows, 14, ["doc_id"], _LANGS), sampling.target_sample(rows, 6, ["doc_id"])]
    return parts[0].unionByName(parts[1]).dropDuplicates()


# ---------------------------------------------------------------- text


def html_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (markup.drop_breaks, markup.drop_subscripts, markup.drop_references, markup.unwrap_tags, markup.drop_comments, markup.plain_spaces)
    text = F.col("html")
    for rule in rules:
        text = rule(text)
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def template_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("{{a {{b|"), F.col("doc_id").cast("string"), F.lit("}} c {{d {{e}} }} }}x{{}}y"), F.col("text"), F.lit(" {{z}}"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.drop_templates(made).alias("text"))


def link_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("[[a|b "), F.col("doc_id").cast("string"), F.lit("]] [[c [[d|e]] f]]  and [[g|h|i]] "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.strip_links(made).alias("text"))


def url_and_file_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("[[File:x"), F.col("doc_id").cast("string"), F.lit(".png|thumb|see [[y]] there]]'''bold''' [https://e.org/a some label] [http://e.org] "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.drop_quotes(markup.unwrap_urls(markup.drop_files(made))).alias("text"))


#: What the masking queries put before each text, by doc_id.
PHRASES = {
    "indicator": ["* Indicator 1.2.3: share of all;; ", "Indicator 4.a.1 is the \"rate of it\". ", "see indicator 3.1.2 of this. and Indicator 5.1.1 too. and indicator 6.1.1 last. ", "The target has one indicator: Share of all. ", "7.1.1 is the \"last one\".", ""],
    "list": ["so (a) first b) second ", "(ii) roman (2) and 12) then [7] cited ", "c) begins [x] y ", ""],
    "number": ["Target 1.2. By then. Target 3.b and SDG target 4.1 (target 5.2) ", "It links SDG 3 (SDG 5 or Goal 6) and Goal 7. Targets 1.1 through 1.4 ", "indicator 1.1.1 and indicator 2.2 or 1.2.3(a) then 4.4.4 end ", "#Goal 5 'quoted' \"text\" (1.1.) 1.1 – 2.a: ", ""],
    "phrase": ["The goal has five targets and six indicators to measure progress toward targets. ", "Long title: The full text of the target is: It has two indicators: ", "A proposal has been tabled in 2020 to delete the indicator. The the the end ", "The official wording is: The first three targets are outcome targets: # ", ""],
}


def _phrased(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    some = PHRASES[kind]
    lead = F.element_at(F.array(*map(F.lit, some)), (F.col("doc_id") % len(some) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.col("text")).alias("text"), "source")


def mask_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrased(spark, sf_dir, "indicator").select("doc_id", masking.mask_indicators(F.col("text")).alias("text"))


def mask_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrased(spark, sf_dir, "list").select("doc_id", masking.mask_lists(F.col("text")).alias("text"))


def mask_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("doc_id") % 2 == 0, "Links with other SDGs").otherwise("General")
    return _phrased(spark, sf_dir, "number").select("doc_id", masking.mask_numbers(F.col("text"), section).alias("text"))


def mask_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrased(spark, sf_dir, "phrase").select("doc_id", masking.mask_phrases(F.col("text")).alias("text"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("e.g. this, i.e. that (etc.) of U.S. kind.Then? more;; "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_sentences(made)).alias("pos", "sentence"))


def join_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", join_sentences(F.col("text"), F.col("role")).alias("low"), join_sentences(F.col("text"), F.initcap("role")).alias("high"), finish(F.col("text")).alias("done"))


def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(pack_sentences(split_sentences(F.col("text")))).alias("pos", "excerpt"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a paragraph of a label."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(0).alias("file_ord"), F.col("doc_id").alias("page_ord"), F.lit(0).alias("emit_ord"), F.col("source").alias("goal"), F.concat((F.col("doc_id") % 17).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string")).alias("target"),
        F.coalesce("lang", F.lit("")).alias("section"), F.lit("").alias("source_url"), F.lit("").alias("title"), F.lit("").alias("revision_id"), F.lit("").alias("revision_timestamp"), "text",
    )


def excerpt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as excerpts: length filter and running ids."""
    rows = lines(spark, sf_dir).withColumnRenamed("text", "excerpt").withColumn("part", F.lit(0))
    return excerpts.number(rows, 20, 400, 15).select("id", "goal", "target", F.col("ord.page_ord").alias("doc_id"))


def excerpt_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, boilerplate filter, packing and numbering over all documents."""
    return excerpts.excerpts(lines(spark, sf_dir)).select("id", "goal", "target", F.md5("modified_text_excerpt").alias("md5"))


def general_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an article whose every text is a goal's block."""
    d = table(spark, sf_dir, "documents")
    made = F.concat(F.lit("before\n==== Goal "), (F.col("doc_id") % 17 + 1).cast("string"), F.lit(": name ====\n"), F.col("text"), F.lit("\n \n=== Closing ===\nafter\n==== Goal 1: x\nlast"))
    pages = d.select(F.lit(0).alias("file_ord"), F.col("doc_id").alias("page_ord"), F.lit("The title").alias("title"), F.lit("1").alias("revision_id"), F.lit("t").alias("revision_timestamp"), made.alias("text"))
    return articles.general_paragraphs(pages).select(F.col("page_ord").alias("doc_id"), F.col("emit_ord").cast("long").alias("line_no"), "goal", "source_url", "text")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.tfidf(_pieces(spark, sf_dir), stop_words=["the", "and", "of"]).select("id", "term", "df", F.round("w", 6).alias("w"))


def boilerplate_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.noise(_pieces(spark, sf_dir), stop_words=["the", "and", "of"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn3_predictions, nearest_neighbours, knn1_predictions, knn_accuracy, label_correction_accuracy, knn20_probabilities, ndcg5, centroid_vectors, centroid_ndcg5, result_rows,
        batch_sampler, triplet_loss, encoded_benchmark, label_dictionary, multi_label_parse, indicator_ids, word_buckets, external_texts, stratified_split, goal_sample, target_sample, training_sample,
        html_unwrap, template_fixpoint, link_fixpoint, url_and_file_markup, mask_indicators, mask_lists, mask_numbers, mask_phrases, sentence_split, join_fragments, packed_sentences,
        excerpt_ids, excerpt_pipeline, general_article, tfidf_weights, boilerplate_noise,
    )
}
