"""Model families and the training loop on stand-ins with the interface of the model libraries."""

import contextlib
import pickle
import sys
import types

import numpy as np
import pytest

from corpusloom.operators import encoders
from corpusloom.plans import learning

DIM = 384


class Tensor:
    """An array with the methods that are used of a tensor."""

    def __init__(self, values):
        self.values = np.asarray(values)

    def numpy(self):
        return self.values

    def unsqueeze(self, axis):
        return Tensor(np.expand_dims(self.values, axis))

    def float(self):
        return Tensor(self.values.astype(float))

    def sum(self, axis):
        return Tensor(self.values.sum(axis))

    def clamp(self, min):  # noqa: A002
        return Tensor(np.maximum(self.values, min))

    def __mul__(self, other):
        return Tensor(self.values * other.values)

    def __truediv__(self, other):
        return Tensor(self.values / other.values)


class Model:
    """Gives a token its number times a row of weights; padding gives large numbers, which a mask must hide."""

    def __init__(self, size):
        self.weights, self.modes = np.arange(1.0, size + 1), []

    def load_state_dict(self, state):
        self.weights = state["weights"]

    def state_dict(self):
        return {"weights": self.weights}

    def parameters(self):
        return [self.weights]

    def eval(self):
        self.modes.append("eval")

    def train(self):
        self.modes.append("train")

    def __call__(self, input_ids, attention_mask, return_dict=False):
        hidden = np.where(attention_mask.values > 0, input_ids.values, 1e6)[:, :, None] * self.weights
        out = types.SimpleNamespace(last_hidden_state=Tensor(hidden), pooler_output=Tensor(hidden[:, 0] + 1.0))
        return out if return_dict else (out.last_hidden_state, out.pooler_output)


class Tokenizer:
    def __call__(self, texts, padding, truncation, return_tensors, max_length):
        assert (padding, truncation, return_tensors, max_length) == ("max_length", True, "pt", 128)
        ids, mask = np.zeros((len(texts), max_length)), np.zeros((len(texts), max_length))
        for row, text in enumerate(texts):
            for k, word in enumerate(text.split()[:max_length]):
                ids[row, k], mask[row, k] = len(word), 1
        return {"input_ids": Tensor(ids), "attention_mask": Tensor(mask)}


class Adam:
    def __init__(self, parameters, lr):
        self.lr, self.steps = lr, 0

    def zero_grad(self):
        pass

    def step(self):
        self.steps += 1

    def state_dict(self):
        return {"steps": self.steps}

    def load_state_dict(self, state):
        self.steps = state["steps"]


@pytest.fixture
def libraries(monkeypatch):
    """A directory's name ends in the model's dimension."""
    torch = types.ModuleType("torch")
    torch.no_grad, torch.tensor = contextlib.nullcontext, Tensor
    torch.load = lambda path: pickle.loads(open(path, "rb").read())
    torch.save = lambda state, path: open(path, "wb").write(pickle.dumps(state))
    torch.optim = types.SimpleNamespace(Adam=Adam)
    torch.nn = types.SimpleNamespace(functional=types.SimpleNamespace(normalize=lambda t, dim: Tensor(encoders.normalize(t.values))))
    transformers = types.ModuleType("transformers")
    transformers.AutoTokenizer = types.SimpleNamespace(from_pretrained=lambda path: Tokenizer())
    transformers.AutoModel = types.SimpleNamespace(from_pretrained=lambda path: Model(int(path.rsplit("-", 1)[1])))
    hub, tensorflow = types.ModuleType("tensorflow_hub"), types.ModuleType("tensorflow")
    tensorflow.constant = list
    hub.KerasLayer = lambda path, trainable: lambda texts: Tensor(np.array([[len(t), 2.0] for t in texts]))
    for name, module in (("torch", torch), ("transformers", transformers), ("tensorflow", tensorflow), ("tensorflow_hub", hub), ("tensorflow_text", types.ModuleType("tensorflow_text"))):
        monkeypatch.setitem(sys.modules, name, module)
    return torch


TEXTS = np.array(["a bbb", "cc", "", " ".join(["w"] * 200)], object)


def test_pooled_by_mask(libraries, tmp_path, capsys):
    """Family two: the mean over real tokens, of unit length; without a checkpoint the base weights."""
    vectors = encoders.load("SBERT-MINILM-L6", f"base-{DIM}", str(tmp_path), 5)(TEXTS)
    row = np.arange(1.0, DIM + 1)
    assert vectors[:2] == pytest.approx(np.stack([row, row]) / np.linalg.norm(row)) and not vectors[2].any() and np.linalg.norm(vectors[3]) == pytest.approx(1)
    assert "no " in capsys.readouterr().out


def test_pooled_output_and_checkpoint(libraries, tmp_path, capsys):
    """Family three: the pooled output, of unit length, with the weights of the checkpoint."""
    weights = np.linspace(1, 2, 768)
    libraries.save({"model_state_dict": {"weights": weights}}, str(tmp_path / "7_model.pt"))
    vectors = encoders.load("SIMCSE-SUP-BERT-BASE", "base-768", str(tmp_path), 7)(TEXTS[:2])
    expected = np.stack([1 * weights + 1, 2 * weights + 1])
    assert vectors == pytest.approx(expected / np.linalg.norm(expected, axis=1, keepdims=True))
    assert "step 7" in capsys.readouterr().out


def test_raw_output(libraries):
    """Family one: the layer's output as it is; null texts are empty."""
    assert encoders.load("USE-TRANSFORMER", "anywhere")(np.array(["abc", None], object)).tolist() == [[3.0, 2.0], [0.0, 2.0]]


class Loss:
    def __init__(self, seen, vectors, y):
        self.seen, self.given = seen, (vectors, y)

    def backward(self):
        self.seen.append(self.given)


def test_trainer(libraries, tmp_path):
    seen = []
    trainer = learning.Trainer("base-4", lambda torch, vectors, y: Loss(seen, vectors, y))
    assert not trainer.restore(str(tmp_path), 0)
    for _ in range(3):
        trainer.step(["a bb", "c"], [0, 1])
    assert trainer.optimizer.steps == 3 and trainer.optimizer.lr == learning.LEARNING_RATE and trainer.model.modes == ["train"] * 3
    vectors, y = seen[-1]
    row = np.arange(1.0, 5)
    assert vectors.values == pytest.approx(np.stack([row, row]) / np.linalg.norm(row)) and y.values.tolist() == [0, 1]
    trainer.model.weights = row * 3
    trainer.save(str(tmp_path), 5)
    again = learning.Trainer("base-4", None)
    assert again.restore(str(tmp_path), 5) and again.optimizer.steps == 3 and again.model.weights.tolist() == [3, 6, 9, 12]


def test_train_network(libraries, spark, tmp_path, monkeypatch):
    """Every fifth step is saved under its number, and training goes on from there."""
    rows = [(f"e{i}", f"text {i}", str(i % 3 + 1), None, i) for i in range(30)]
    data = spark.createDataFrame(rows, "id string, modified_text_excerpt string, goal string, target string, ord long")
    learner = learning.GoalRepresentationLearner([""], [True])
    monkeypatch.setattr(learner, "load_data", lambda spark, k: learner.prepare(data))
    seen = []
    monkeypatch.setattr(learner, "_loss", lambda torch, vectors, y: Loss(seen, vectors, y))
    learner.train_network(spark, 14, "base-4", str(tmp_path), 12, 0, 7)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["5_model.pt"] and len(seen) == 7
    learner.train_network(spark, 14, "base-4", str(tmp_path), 12, 5, 12)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["10_model.pt", "5_model.pt"] and len(seen) == 14
    assert libraries.load(str(tmp_path / "10_model.pt"))["optimizer_state_dict"] == {"steps": 10}
