"""Evaluation of an encoder on a task (entry B: B5, B7, B8, V11, S2, S4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import multiple_labels
from corpusloom.operators import encoders, labels, metrics, neighbours, testsets
from corpusloom.operators.numbering import numbered
from corpusloom.operators.skew import broadcast_small
from corpusloom.plans.corpus import FineTuningDataExtractor
from corpusloom.sources import tables

#: Neighbours of each task.
KS = {"MC-IND-SDG": [1, 3], "MC-IND-TRG": [1, 3], "ML-IND-SDG": [20, 40], "ML-SDG-SDG": [16]}
#: Training examples per goal and target that a task allows.
COUNTS = {
    "MC-IND-SDG": [(14, 6), (14, 17), (22, 6), (22, 17)],
    "ML-IND-SDG": [(14, 6), (14, 17), (22, 6), (22, 17)],
    "ML-SDG-SDG": [(14, 6), (14, 17), (22, 6), (22, 17)],
    "MC-IND-TRG": [(0, 6), (0, 17)],
}
#: Data sets: how they are read, and the tasks they serve.
DATASETS = {
    "IND-TITLE-AGENDA": ("indicators", ["MC-IND-SDG", "MC-IND-TRG", "ML-IND-SDG"]),
    "SDG-TITLE-WIKI": ("goals", ["ML-SDG-SDG"]),
    "IND-DESCR-EUSDG": ("external", ["MC-IND-SDG", "ML-IND-SDG"]),
    "IND-DESCR-WDISDG": ("external", ["MC-IND-SDG", "MC-IND-TRG"]),
    "IND-DESCR-URBAN": ("external", ["MC-IND-SDG", "MC-IND-TRG", "ML-IND-SDG"]),
    "IND-DESCR-REGIONS": ("external", ["MC-IND-SDG", "MC-IND-TRG"]),
}
NDCG_AT = 5


def validate(test_task: str, k: tuple[int, int]) -> None:
    if test_task not in COUNTS:
        raise ValueError(f"{test_task} is none of the tasks {', '.join(COUNTS)}")
    if tuple(k) not in COUNTS[test_task]:
        raise ValueError(f"{test_task} takes (goal, target) examples {COUNTS[test_task]}, not {tuple(k)}")


def allowed(test_task: Column, goal_count: Column, target_count: Column) -> Column:
    """Whether validate() takes a task with these counts."""
    cell = lambda t, g, n: F.struct(t.alias("task"), g.cast("int").alias("goals"), n.cast("int").alias("targets"))
    every = F.array(*(cell(F.lit(t), F.lit(g), F.lit(n)) for t, some in COUNTS.items() for g, n in some))
    return F.array_contains(every, cell(test_task, goal_count, target_count))


def test_set(spark: SparkSession, test_dataset: str, test_task: str, concatenation_option: int, path: str) -> tuple[DataFrame | None, DataFrame]:
    """(validation, test) of a data set; validation is None where it has none."""
    kind, tasks = DATASETS.get(test_dataset, ("", []))
    if test_task not in tasks:
        raise ValueError(f"No data set {test_dataset} for the task {test_task}")
    if kind == "indicators":
        return testsets.indicator_split(testsets.indicators(tables.read_indicators(spark, path)))
    if kind == "goals":
        return testsets.goals(tables.read_goals(spark, path))
    return testsets.external(tables.read_external(spark, path), test_task, concatenation_option)


def label_columns(test_task: str) -> tuple[str, str]:
    """Of the training set and of the test set."""
    single = "goal" if test_task.endswith("SDG") else "target"
    if test_task.startswith("ML"):
        return single, "repeats" if "IND" in test_task else "links"
    return single, single


def _queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ord").alias("q_id"), "vector")


def multi_class(train: DataFrame, dictionary: DataFrame, rows: DataFrame, label: str, test_task: str, ks: Sequence[int]) -> dict[int, float]:
    """Accuracy for each k, with predictions that are one of a row's several labels counted as right."""
    known = labels.encode(rows, dictionary, label).withColumn("multiple", multiple_labels(F.col("repeats"), test_task))
    near = neighbours.nearest(_queries(known), train, max(ks)).persist()
    names = dictionary.select(F.col("label_id").alias("prediction"), F.col("label").alias("predicted"))
    out = {}
    for k in ks:
        predicted = neighbours.predict(neighbours.votes(near, k)).join(broadcast_small(names), "prediction")
        joined = known.join(predicted, known["ord"] == predicted["q_id"])
        final = metrics.corrected(F.col(label), F.col("multiple"), F.col("predicted"))
        out[k] = metrics.accuracy(joined, F.col(label), final).first()[0]
    near.unpersist()
    return out


def multi_label(train: DataFrame, dictionary: DataFrame, rows: DataFrame, listed: str, test_task: str, ks: Sequence[int]) -> dict[int, float]:
    """Mean NDCG for each k; rows with less than two labels have no part."""
    known = rows.withColumn("multiple", multiple_labels(F.col(listed), test_task)).filter("multiple is not null")
    relevant = labels.relevance(known, dictionary, "multiple", "ord").withColumnRenamed("ord", "q_id")
    side = neighbours.centroids(train) if test_task == "ML-SDG-SDG" else train
    near = neighbours.nearest(_queries(known), side, max(ks)).persist()
    out = {}
    for k in ks:
        scored = neighbours.probabilities(neighbours.votes(near, k), dictionary).join(relevant, ["q_id", "label_id"])
        out[k] = metrics.ndcg(scored, NDCG_AT).agg(F.avg("ndcg")).first()[0]
    near.unpersist()
    return out


class Evaluator:
    def evaluate(self, training: DataFrame, validation: DataFrame | None, test: DataFrame, test_task: str, encoder: str, checkpoint_number: int, k: tuple[int, int], random_seed: int, **directories) -> DataFrame:
        """Result rows from excerpts (goal, target, modified_text_excerpt) and test rows (ord, text, labels)."""
        spark = training.sparkSession
        train_label, test_label = label_columns(test_task)
        ordered = training.filter(F.col(train_label) != "")
        dictionary = labels.label_dictionary(ordered, train_label, "ord")
        vectors = encoders.embed(ordered, "modified_text_excerpt", encoder, checkpoint=checkpoint_number, **directories)
        train = numbered(labels.encode(vectors, dictionary, train_label), [], ["ord", "modified_text_excerpt"], "t_id").select("t_id", "label_id", "vector")
        embedded = {n: None if rows is None else encoders.embed(rows, "text", encoder, checkpoint=checkpoint_number, **directories) for n, rows in (("validation", validation), ("test", test))}
        ks, found = KS[test_task], {}
        for name, rows in embedded.items():
            if rows is None or (name == "validation" and test_task.startswith("ML")):
                found[name] = dict.fromkeys(ks)
            elif test_task.startswith("MC"):
                found[name] = multi_class(train, dictionary, rows.filter(F.col(test_label) != ""), test_label, test_task, ks)
            else:
                found[name] = multi_label(train, dictionary, rows, test_label, test_task, ks)
        rows = [(n, encoder, random_seed, checkpoint_number, k[0], k[1], found["validation"][n], found["test"][n]) for n in ks]
        return spark.createDataFrame(rows, tables.RESULT)

    def run(self, spark: SparkSession, input_files: Sequence[str], flags: Sequence[bool], test_input_file: str, test_dataset: str, concatenation_option: int, encoder: str, base_model_directory: str, checkpoint_directory: str, checkpoint_number: int, test_task: str, k: tuple[int, int], random_seed: int, result_directory: str, **cluster) -> DataFrame:
        validate(test_task, k)
        validation, test = test_set(spark, test_dataset, test_task, concatenation_option, test_input_file)
        training = FineTuningDataExtractor(input_files, flags, **cluster).run(spark, *k)
        results = self.evaluate(training, validation, test, test_task, encoder, checkpoint_number, k, random_seed, base_directory=base_model_directory, checkpoint_directory=checkpoint_directory)
        run = "-".join(map(str, (test_dataset, concatenation_option, encoder, random_seed, checkpoint_number, *k)))
        tables.write_results(results, result_directory, test_task, run=run)  # the same settings replace their own rows
        return results
