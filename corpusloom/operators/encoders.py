"""Sentence encoders as batch functions on executors.

A model is loaded once in a worker, when its first batch comes. Model libraries are imported there and only by the families
that need them; `hashing` needs none and gives the same vectors everywhere.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.workers import importable

BATCH = 64
MAX_TOKENS = 128
#: Name: (family, dimension).
REGISTRY = {
    "USE-TRANSFORMER": ("one", 512),
    "USE-MULTILINGUAL-CONVOLUTION": ("one", 512),
    "USE-MULTILINGUAL-TRANSFORMER": ("one", 512),
    "ST5-BASE": ("one", 768),
    "ST5-LARGE": ("one", 768),
    "SBERT-BERT-BASE": ("two", 768),
    "SBERT-MINILM-L6": ("two", 384),
    "SBERT-MINILM-L12": ("two", 384),
    "SBERT-DISTILROBERTA": ("two", 768),
    "SBERT-MPNET-BASE": ("two", 768),
    "SIMCSE-UNSUP-BERT-BASE": ("three", 768),
    "SIMCSE-SUP-BERT-BASE": ("three", 768),
    "HASHING": ("hashing", 256),
}

Predict = Callable[[np.ndarray], np.ndarray]


def dimension(name: str) -> int:
    if name not in REGISTRY:
        raise ValueError(f"No encoder is called {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name][1]


def normalize(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask holds. tokens: n x t x d, mask: n x t."""
    mask = mask[:, :, None].astype(float)
    return (tokens * mask).sum(1) / np.maximum(mask.sum(1), 1e-9)


def _hashing(size: int) -> Predict:
    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for word in str(text or "").lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:4])
                out[i, h % size] += 1 if (h >> 16) & 1 else -1
        return normalize(out)

    return predict


def _hub(base_directory: str) -> Predict:
    import tensorflow as tf
    import tensorflow_text  # noqa: F401
    from tensorflow_hub import KerasLayer

    layer = KerasLayer(base_directory, trainable=False)
    return lambda texts: layer(tf.constant([str(t or "") for t in texts])).numpy()


def _transformer(name: str, base_directory: str, checkpoint_directory: str, checkpoint: int, pooled: bool) -> Predict:
    import torch
    from transformers import AutoModel, AutoTokenizer

    tokenizer, model = AutoTokenizer.from_pretrained(base_directory), AutoModel.from_pretrained(base_directory)
    path = os.path.join(checkpoint_directory, f"{checkpoint}_model.pt")
    if os.path.exists(path):
        model.load_state_dict(torch.load(path)["model_state_dict"])
        print(f"{name}: weights of step {checkpoint}")
    else:
        print(f"{name}: no {path}, so the weights of {base_directory}")
    model.eval()

    def predict(texts: np.ndarray) -> np.ndarray:
        given = tokenizer([str(t or "") for t in texts], padding="max_length", truncation=True, return_tensors="pt", max_length=MAX_TOKENS)
        with torch.no_grad():
            out = model(**given, return_dict=True)
        found = out.pooler_output.numpy() if pooled else mean_pool(out.last_hidden_state.numpy(), given["attention_mask"].numpy())
        return normalize(found)

    return predict


def load(name: str, base_directory: str = "", checkpoint_directory: str = "", checkpoint: int = 0) -> Predict:
    size = dimension(name)
    family = REGISTRY[name][0]
    if family == "hashing":
        return _hashing(size)
    if family == "one":
        return _hub(base_directory)
    return _transformer(name, base_directory, checkpoint_directory, checkpoint, pooled=family == "three")


def encoder(name: str, base_directory: str = "", checkpoint_directory: str = "", checkpoint: int = 0) -> Callable[[Column], Column]:
    """A column function from texts to vectors."""
    size = dimension(name)

    def make() -> Predict:
        model = load(name, base_directory, checkpoint_directory, checkpoint)

        def predict(texts: np.ndarray) -> np.ndarray:
            made = np.asarray(model(texts), np.float32)
            if made.shape[1] != size:
                raise ValueError(f"{name} gave {made.shape[1]} numbers, not {size}")
            return made

        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=BATCH)


def embed(rows: DataFrame, text: str, name: str, **directories) -> DataFrame:
    """rows with their vectors."""
    importable(rows.sparkSession)
    return rows.withColumn("vector", encoder(name, **directories)(F.col(text)))
