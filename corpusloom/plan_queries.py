"""Queries over files, whole plans and chains of rules, each over its whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup, masking
from corpusloom.operators import articles, excerpts, labels, testsets
from corpusloom.operators.numbering import numbered
from corpusloom.operators.storage import scratch
from corpusloom.plans import evaluation, learning
from corpusloom.plans.corpus import FineTuningDataExtractor
from corpusloom.queries import PHRASES, SEED, lines, result_rows, sides, table
from corpusloom.sources import tables
from corpusloom.sources.articles import read_pages

# ---------------------------------------------------------------- evaluation and learning


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training side, dictionary and test rows whose labels are goals 1 to 10; every third row has two."""
    queries, train = sides(spark, sf_dir)
    dictionary = train.select("label_id").distinct().withColumn("label", (F.col("label_id") + 1).cast("string"))
    other = F.concat(F.lit(","), ((F.col("label") + 3) % 10 + 1).cast("string"), F.lit(".2.1"))
    several = F.concat((F.col("label") + 1).cast("string"), F.lit(".1.1"), other)
    rows = queries.select(F.col("q_id").alias("ord"), "vector", F.when(F.col("q_id") % 3 == 0, several).otherwise("").alias("repeats"), (F.col("label") + 1).cast("string").alias("goal"))
    return train.select("t_id", "label_id", "vector"), dictionary, rows


def _by_k(spark: SparkSession, found: dict[int, float], value: str) -> DataFrame:
    return spark.createDataFrame(list(found.items()), f"k int, {value} double").select("k", F.round(value, 6).alias(value))


def evaluated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of a multi-class task, from one search for every k."""
    return _by_k(spark, evaluation.multi_class(*_named(spark, sf_dir), "goal", "MC-IND-SDG", [1, 3]), "accuracy")


def evaluated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of a multi-label task over neighbours."""
    return _by_k(spark, evaluation.multi_label(*_named(spark, sf_dir), "repeats", "ML-IND-SDG", [20, 40]), "ndcg")


def evaluated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean NDCG of a multi-label task over centroids."""
    train, dictionary, rows = _named(spark, sf_dir)
    goals = rows.withColumn("links", F.regexp_replace("repeats", r"\.[0-9]\.[0-9]", ""))
    return _by_k(spark, evaluation.multi_label(train, dictionary, goals, "links", "ML-SDG-SDG", [10]), "ndcg")


def _learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a training sample."""
    i = F.col("item_id")
    goal = (i % 17 + 1).cast("string")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("e"), i.cast("string")).alias("id"), F.col("text").alias("modified_text_excerpt"), goal.alias("goal"),
        F.when(i % 3 != 0, F.concat(goal, F.lit("."), (i % 4).cast("string"))).alias("target"), F.struct((-i).alias("page_ord")).alias("ord"),
    )


def learner_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.GoalRepresentationLearner([""], [True]).prepare(_learning(spark, sf_dir)).select("id", "goal", "y", "pos")


def learner_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.TargetRepresentationLearner([""], [True]).prepare(_learning(spark, sf_dir)).select("id", "goal", "y", "pos")


def learner_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.class_ranges(learner_goals(spark, sf_dir))


def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("source")))
    return labels.encode(docs, labels.label_dictionary(docs, "source", "doc_id"), "source").select("doc_id", "label_id")


def label_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    several = F.when(F.col("doc_id") % 5 != 0, F.array("source", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"))))
    return labels.relevance(docs.withColumn("several", several), labels.label_dictionary(docs, "source", "doc_id"), "several", "doc_id")


# ---------------------------------------------------------------- chains of rules

#: What the queries on markup put before each text.
TAGGED = 'a<br/>b<br />c<sub class="x">2</sub>d<sub name/>e<ref name="q">cite</ref>f<ref name=r/>g<ref>h&nbsp;i<!-- note -->. j<b>k</b> <!--x-->l '
LINKED = "{{a {{b}} }}[[File:x.png|see [[y]] there]] '''bold''' [https://e.org/a some label] [http://e.org] [[a|b]]  [[c [[d|e]] ]] "


def tag_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(TAGGED), F.col("text"))
    for rule in (markup.drop_breaks, markup.drop_subscripts, markup.drop_references, markup.unwrap_tags, markup.drop_comments, markup.plain_spaces):
        text = rule(text)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def stripped_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markup rules one after another."""
    return table(spark, sf_dir, "documents").select("doc_id", markup.strip_links(markup.strip_markup(F.concat(F.lit(TAGGED), F.lit(LINKED), F.col("text")))).alias("text"))


def masked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masking rules one after another."""
    leads = [F.element_at(F.array(*map(F.lit, some)), (F.col("doc_id") % len(some) + 1).cast("int")) for some in PHRASES.values()]
    section = F.when(F.col("doc_id") % 2 == 0, "Links with other SDGs").otherwise("General")
    return table(spark, sf_dir, "documents").select("doc_id", masking.clean(F.concat(*leads, F.col("text")), section).alias("text"))


#: What follows every third text, and what follows the text's second copy, in the articles on single goals.
ARTICLE_LIST = "\nlike:\n* x\n* y\nz *\nlast:"
ARTICLE_END = "\n== Tools ==\nof these:\none *\ntwo *\nend\n=== Target 1.2: By 2030 ===\nsuch as:\n* a\n* b\nthen\n== See also ==\nno"


def specific_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles on single goals, with a lead, two sections, lists and a target."""
    listed = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, ARTICLE_LIST).otherwise(""))
    made = F.concat(listed, F.lit("\n== Background ==\n"), listed, F.lit(ARTICLE_END))
    pages = table(spark, sf_dir, "documents").select(F.lit(0).alias("file_ord"), F.col("doc_id").alias("page_ord"), F.lit("Sustainable Development Goal 3").alias("title"), F.lit("1").alias("revision_id"), F.lit("t").alias("revision_timestamp"), made.alias("text"))
    return articles.specific_paragraphs(pages).select(F.col("page_ord").alias("doc_id"), F.col("emit_ord").cast("long").alias("emit_ord"), "goal", "target", "section", "text")


def conversation_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From paragraphs to numbered excerpts: sentences, boilerplate filter, packing, copies, lengths and targets that are none."""
    target = F.when(F.col("turn") % 5 == 4, "x.y").otherwise(F.concat((F.col("conv_id") % 4).cast("string"), F.lit("."), (F.col("turn") % 3).cast("string")))
    rows = table(spark, sf_dir, "conversations").select(
        F.lit(0).alias("file_ord"), F.col("conv_id").alias("page_ord"), F.col("turn").alias("emit_ord"), (F.col("conv_id") % 2).cast("string").alias("goal"), target.alias("target"), F.concat("role", F.lit(", said")).alias("section"),
        *(F.lit("").alias(n) for n in ("source_url", "title", "revision_id", "revision_timestamp")), "text",
    )
    found = excerpts.excerpts(rows, 5, 12, 4, stop_words=["the", "and", "of"])
    return found.select("id", "goal", "target", "section", F.col("modified_text_excerpt").alias("excerpt"))


# ---------------------------------------------------------------- files


def _part_ids() -> Column:
    k = F.col("p_partkey")
    return F.concat((k % 17 + 1).cast("string"), F.lit("."), (k % 9 + 1).cast("string"), F.lit("."), k.cast("string"))


def _csv(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return path


def _indicator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.concat("p_name", F.lit(', "'), F.col("p_type"), F.lit('"\n'), F.expr("repeat('more ', p_size div 4)"), "p_brand"))
    return table(spark, sf_dir, "part").select(_part_ids().alias("id"), F.when(F.col("p_size") > 25, "1.1.1,2.2.2").otherwise("").alias("repeats"), text.alias("text"))


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testsets.indicators(tables.read_indicators(spark, _csv(_indicator_rows(spark, sf_dir), "indicators")))


def indicator_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a file of indicators and read from it."""
    return _indicators(spark, sf_dir).select("id", "repeats", "goal", "target", "text", "word_count", "word_cat_3", "word_cat_2")


def indicator_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation and test sets of those indicators."""
    validation, test = testsets.indicator_split(_indicators(spark, sf_dir), SEED)
    return validation.select("id", "goal", "target", F.lit("validation").alias("side")).unionAll(test.select("id", "goal", "target", F.lit("test")))


def goal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen groups of nations written as a file of goals and read from it."""
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), sep)
    n = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 16 + 1).cast("string").alias("id")).agg(joined("n_regionkey", ",").alias("links"), joined("n_name", ", ").alias("text"))
    _, goals = testsets.goals(tables.read_goals(spark, _csv(n, "goals")))
    return goals.select("id", "links", "goal", "text")


def _external_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as external indicators, with a column too many."""
    k = F.col("p_partkey")
    definition = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" Of  "), F.col("p_type"), F.when(k % 2 == 0, F.concat(F.lit(". Or "), F.col("p_brand"))).otherwise("")))
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("id"), F.concat("p_name", F.when(k % 7 == 0, ".").otherwise("")).alias("name"), definition.alias("definition"), F.lit("x").alias("further"),
        F.concat_ws(" , ", F.lit("1"), F.when(k % 2 == 0, "2")).alias("goal"), F.concat_ws(", ", F.lit("1.2"), F.when(k % 5 == 0, "2.b")).alias("target"),
    )


def external_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a file of external indicators and read with each way of making a text."""
    raw = tables.read_external(spark, _csv(_external_rows(spark, sf_dir), "external"))
    parts = [testsets.external(raw, task, option)[1].withColumn("option", F.lit(option)) for option, task in enumerate(("MC-IND-SDG", "MC-IND-TRG", "ML-IND-SDG"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("id", "option", "repeats", "goal", "target", "text")


def wiki_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as two wiki exports, each page with two revisions, and read from them."""
    revision = lambda i, text: F.struct(F.lit(i).alias("id"), F.lit(f"2020-01-0{i}").alias("timestamp"), text.alias("text"))
    revisions = F.array(revision("1", F.concat(F.lit("| "), F.col("text"), F.lit(" <&> |"))), revision("2", F.lit("later")))
    pages = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("half"), F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), revisions.alias("revision"))
    files = []
    for half in (0, 1):
        files.append(scratch(spark, "pages"))
        pages.filter(F.col("half") == half).drop("half").write.format("xml").options(rowTag="page", rootTag="mediawiki").save(files[-1])
    return read_pages(spark, files, [True, False]).select("file_ord", "is_general", "title", "revision_id", "revision_timestamp", "text")


def result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two tasks as they are read from their files: one task has two runs, of which the second is written twice."""
    rows = result_rows(spark, sf_dir)
    path = scratch(spark, "results")
    for task, run in (("MC-IND-SDG", "a"), ("ML-IND-SDG", "a"), ("ML-IND-SDG", "b"), ("ML-IND-SDG", "b")):
        tables.write_results(rows, path, task, run=run)
    read = lambda task: tables.read_results(spark, path, task).drop("run").withColumn("task", F.lit(task))
    return read("MC-IND-SDG").unionAll(read("ML-IND-SDG"))


def evaluation_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data set with every task that it serves: the rows of its sets with the label that the task compares, and the labels' columns."""
    n = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 16 + 1).cast("string").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("n_regionkey").cast("string"))), ",").alias("links"), F.min("n_name").alias("text"))
    paths = {"indicators": _csv(_indicator_rows(spark, sf_dir), "indicators"), "goals": _csv(n, "goals"), "external": _csv(_external_rows(spark, sf_dir), "external")}
    parts = []
    for name, (kind, tasks) in evaluation.DATASETS.items():
        for task in tasks:
            train_label, test_label = evaluation.label_columns(task)
            for side, rows in zip(("validation", "test"), evaluation.test_set(spark, name, task, 0, paths[kind]), strict=True):
                if rows is not None:
                    told = [F.lit(v).alias(c) for c, v in (("dataset", name), ("task", task), ("side", side), ("train_label", train_label), ("test_label", test_label))]
                    parts.append(rows.select(*told, "id", F.col(test_label).alias("label"), "text"))
    return reduce(DataFrame.unionAll, parts)


def allowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with numbers of training examples, and whether they go together."""
    pick = lambda c, some: F.element_at(F.array(*map(F.lit, some)), (F.col(c) % len(some) + 1).cast("int"))
    pairs = table(spark, sf_dir, "part").select(pick("p_size", [0, 14, 22, 15]).alias("goal_count"), pick("p_partkey", [6, 17, 5]).alias("target_count")).distinct()
    tasks = F.explode(F.array(*map(F.lit, [*evaluation.COUNTS, "MC-SDG-SDG"]))).alias("task")
    return pairs.select("*", tasks).select("task", "goal_count", "target_count", evaluation.allowed(F.col("task"), F.col("goal_count"), F.col("target_count")).alias("accepted"))


def saved_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of vectors as steps of a training that goes on from its tenth: what is saved after each."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), learning.saved_state(F.col("vec_id"), 10).alias("saved"))


# ---------------------------------------------------------------- from export files to a training sample


def _exports(spark: SparkSession, sf_dir: str) -> list[str]:
    """Conversations as two wiki exports: those with an even number as general articles, the others as articles on single goals with a target for each further turn."""
    goal = (F.col("conv_id") % 17 + 1).cast("string")
    block = lambda x: F.concat(F.lit("==== Goal "), goal, F.lit(": name ====\n"), x["text"])
    below = lambda x: F.when(x["turn"] == 0, x["text"]).otherwise(F.concat(F.lit("=== Target "), goal, F.lit("."), x["turn"].cast("string"), F.lit(": About it ===\n"), x["text"]))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    files = []
    for half, title, told in ((0, F.lit("Goals"), block), (1, F.concat(F.lit("Sustainable Development Goal "), goal), below)):
        revision = F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("2020-01-01").alias("timestamp"), F.array_join(F.transform("turns", told), "\n").alias("text"))
        pages = turns.filter(F.col("conv_id") % 2 == half).select("conv_id", title.alias("title"), F.array(revision).alias("revision"))
        files.append(scratch(spark, "export"))
        # an export is one file, whose pages stand in order
        pages.repartition(1).sortWithinPartitions("conv_id").drop("conv_id").write.format("xml").options(rowTag="page", rootTag="mediawiki").save(files[-1])
    return files


def fine_tuning_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from export files to a training sample."""
    drawn = FineTuningDataExtractor(_exports(spark, sf_dir), [True, False], stop_words=["the", "and", "of"]).run(spark, 14, 6)
    return drawn.select("id", "goal", "target", "section", F.col("modified_text_excerpt").alias("excerpt"))


def excerpt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as excerpts, and where each stands in the sorted output: by goal and target as strings."""
    found = excerpts.number(lines(spark, sf_dir).withColumnRenamed("text", "excerpt").withColumn("part", F.lit(0)), 20, 400, 15)
    return numbered(found, [], ["goal", "target", "ord"], "place").select("id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        evaluated_classes, evaluated_lists, evaluated_centroids, learner_goals, learner_targets, learner_ranges, label_encoding, label_relevance,
        tag_markup, stripped_article, masked_paragraphs, specific_article, conversation_excerpts, indicator_csv, indicator_split, goal_csv, external_csv, wiki_xml, result_csv,
        evaluation_branches, allowed_counts, saved_steps, fine_tuning_sample, excerpt_order,
    )
}
