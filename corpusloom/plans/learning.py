"""Fine-tuning data, batches and the training loop (entry C: L1-L5, S3)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import sampling
from corpusloom.operators.encoders import MAX_TOKENS
from corpusloom.operators.numbering import numbered
from corpusloom.operators.skew import broadcast_small
from corpusloom.plans.corpus import FineTuningDataExtractor

SEED = 2355764148
BATCH_SIZE = 64
LEARNING_RATE = 2e-5
CHECKPOINT_EVERY = 5


def class_ranges(data: DataFrame) -> DataFrame:
    """goal, start, end: the positions of each goal's rows."""
    return data.groupBy("goal").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def is_checkpoint(step: int) -> bool:
    """step: from 0."""
    return step > 0 and (step + 1) % CHECKPOINT_EVERY == 0


def saved_state(step: Column, start_iteration: int) -> Column:
    """The name of the state that is saved after a step (from 0) of a training from start_iteration on; null where none is."""
    number = (step + start_iteration + 1).cast("string")
    return F.when((step > 0) & ((step + 1) % CHECKPOINT_EVERY == 0), F.concat(number, F.lit("_model.pt")))


def state_path(directory: str, step: int) -> str:
    return os.path.join(directory, f"{step}_model.pt")


class Trainer:
    """A transformer with its optimizer. loss: a function of torch, normalised vectors and labels."""

    def __init__(self, base_model_dir: str, loss: Callable):
        import torch
        from transformers import AutoModel, AutoTokenizer

        self.torch, self.loss = torch, loss
        self.tokenizer, self.model = AutoTokenizer.from_pretrained(base_model_dir), AutoModel.from_pretrained(base_model_dir)
        self.optimizer = torch.optim.Adam(self.model.parameters(), lr=LEARNING_RATE)

    def restore(self, directory: str, step: int) -> bool:
        """Go on from a saved step, if there is one."""
        found = os.path.exists(state_path(directory, step))
        if found:
            saved = self.torch.load(state_path(directory, step))
            self.model.load_state_dict(saved["model_state_dict"])
            self.optimizer.load_state_dict(saved["optimizer_state_dict"])
        return found

    def save(self, directory: str, step: int) -> None:
        self.model.eval()
        self.torch.save({"model_state_dict": self.model.state_dict(), "optimizer_state_dict": self.optimizer.state_dict()}, state_path(directory, step))

    def vectors(self, texts: list[str]):
        given = self.tokenizer(texts, return_tensors="pt", max_length=MAX_TOKENS, truncation=True, padding="max_length")
        weights = given["attention_mask"].unsqueeze(-1).float()
        pooled = (self.model(**given)[0] * weights).sum(1) / weights.sum(1).clamp(min=1e-9)
        return self.torch.nn.functional.normalize(pooled, dim=1)

    def step(self, texts: list[str], y: list[int]) -> None:
        self.model.train()
        self.optimizer.zero_grad()
        self.loss(self.torch, self.vectors(texts), self.torch.tensor(y)).backward()
        self.optimizer.step()


class RepresentationLearner:
    """label: the column whose classes are told apart."""

    label = "goal"

    def __init__(self, input_files: Sequence[str], flags: Sequence[bool], margin: float, **cluster):
        self.margin, self.extractor = margin, FineTuningDataExtractor(input_files, flags, **cluster)

    def counts(self, k: int) -> tuple[int, int]:
        raise NotImplementedError

    def prepare(self, data: DataFrame) -> DataFrame:
        """id, text, goal, y and pos, by goal as a number, then target."""
        rows = numbered(data.na.fill(""), [], [F.col("goal").cast("int"), "target", "ord", "id"], "pos")
        if self.label == "goal":
            return rows.select("id", F.col("modified_text_excerpt").alias("text"), "goal", (F.col("goal").cast("int") - 1).alias("y"), "pos")
        firsts = numbered(rows.groupBy("target").agg(F.min("pos").alias("first")), [], ["first"], "y").select("target", "y")
        return rows.join(broadcast_small(firsts), "target").select("id", F.col("modified_text_excerpt").alias("text"), "goal", "y", "pos")

    def load_data(self, spark: SparkSession, k: int) -> DataFrame:
        return self.prepare(self.extractor.run(spark, *self.counts(k)))

    def batches(self, data: DataFrame, iterations: int, start: int = 0, end: int | None = None) -> Iterator[tuple[list[str], list[str], list[int]]]:
        """Texts, ids and labels of each iteration: some dozen rows at a time reach the driver."""
        drawn = sampling.balanced_batches(data, iterations, start, end, SEED, label="goal", row_id="pos").persist()
        for i in range(start, iterations if end is None else min(end, iterations)):
            rows = drawn.filter(F.col("iteration") == i).orderBy("pos").collect()
            yield [r["text"] for r in rows], [r["id"] for r in rows], [r["y"] for r in rows]
        drawn.unpersist()

    def train_network(self, spark: SparkSession, k: int, base_model_dir: str, output_dir: str, iterations: int, start_iteration: int, end_iteration: int) -> None:
        """Steps over the batches from start_iteration on; needs torch and transformers on the driver."""
        trainer = Trainer(base_model_dir, self._loss)
        trainer.restore(output_dir, start_iteration)
        for done, (texts, _, y) in enumerate(self.batches(self.load_data(spark, k), iterations, start_iteration, end_iteration)):
            trainer.step(texts, y)
            if is_checkpoint(done):
                trainer.save(output_dir, start_iteration + done + 1)

    def _loss(self, torch, vectors, y):
        d = 1 - vectors @ vectors.T
        same = y[:, None] == y[None, :]
        far = d.masked_fill(~same, -1).amax(1)
        near = d.masked_fill(same, 3).amin(1)
        return torch.relu(far - near + self.margin).mean()


class GoalRepresentationLearner(RepresentationLearner):
    def __init__(self, input_files: Sequence[str], flags: Sequence[bool], margin: float = 0.4, **cluster):
        super().__init__(input_files, flags, margin, **cluster)

    def counts(self, k: int) -> tuple[int, int]:
        return k, 0


class TargetRepresentationLearner(RepresentationLearner):
    label = "target"

    def __init__(self, input_files: Sequence[str], flags: Sequence[bool], margin: float = 0.2, **cluster):
        super().__init__(input_files, flags, margin, **cluster)

    def counts(self, k: int) -> tuple[int, int]:
        return 0, k
