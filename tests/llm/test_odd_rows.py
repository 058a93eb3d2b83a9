"""Null ids, repeated rows, very long and empty texts, many languages, empty tables and columns with clashing names, for the operators on texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import bpe, language_id, packing, perplexity, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, n_words long, part int, shard int, ids string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice(("one", "two", "três", "four,", "слово")) for _ in range(n))
    return [make(60_000), "x" * 200_000, *[None] * 20, *[""] * 5, *[make(70)] * 40, make(80), "a\x00b", "\n \t"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i % 3 == 0 else i // 2, t, None if i % 7 == 0 else f"l{i % 20}", 1.0, 1, 1, 1, "i") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[1]], SCHEMA)


@pytest.fixture(scope="module")
def every(texts):
    return [*texts, *texts[:2]]


def test_sharding(docs, every, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    rows = sharding.assign(docs, 4).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 16 for t in every)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs.limit(0), 4).count() == 0


def test_bpe(docs, every):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(open(path, "rb").read()), special_tokens={})
    expected = sorted(hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for t in every if t is None or len(set(t)) > 1 or len(t) < 9)
    rows = bpe.encode(docs, path, digests=True).collect()
    assert sorted(r["ids_sha256"] for r in rows if r["decoded_sha256"] != hashlib.sha256(b"x" * 200_000).hexdigest()) == expected and len(rows) == len(every)
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in every)


def test_packing(docs, every):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    expected = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in every]
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == sorted(expected) and sum(r["length"] for r in rows) == sum(expected)
    assert sorted((r["sequence_id"], r["offset"]) for r in rows)[-1][0] == (sum(expected) - 1) // 1024


def test_perplexity(docs, every):
    rows = perplexity.judge(docs).collect()
    assert sorted(r["n_words"] for r in rows) == sorted(len((t or "").split()) for t in every)
    assert all(r["base_failed"] or np.isfinite(r["log_perplexity"]) for r in rows)
    assert not any(r["kept"] for r in rows if r["n_words"] < 50)


def test_toxicity(spark, docs, every):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(every) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert docs.columns == toxicity.accept(docs, toxicity.train(docs, labels)).columns


def test_language_id(docs, every):
    rows = language_id.identify(docs, per_language=3).collect()
    assert len(rows) == len(every) and sum(r["lang_pred"] == "und" for r in rows) == sum(not any(c.isalpha() for c in t or "") for t in every)
