"""Duplicate operators against brute force, with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, ngram_join, suffix_dedup
from corpusloom.llm.components import connected
from corpusloom.llm.incidence import from_bytes, shorten, to_bytes

SCHEMA = "doc_id long, text string, lang string, owner string, recipe string, n int"


def frame(spark, rows):
    """Documents with further columns, some of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "o", "r", 1) for i, t in rows], SCHEMA)


def corpus(seed=5, docs=70):
    """Texts of common words with copies, edited copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 10**6)}é" for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(25), make(80).split()
    out = []
    for _ in range(docs):
        kind = rng.random()
        if kind < 0.3:
            out.append(make(rng.randint(0, 60)))
        elif kind < 0.6:
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            out.append("  ".join(edited).upper() if rng.random() < 0.3 else " ".join(edited))
        elif kind < 0.8:
            out.append(f"{make(20)} {passage} {make(10)}")
        else:
            out.append(rng.choice(out) if out else "")
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [*corpus(), None, "", "   ", "One two", "one  TWO", "x" * 49, "y" * 300, "y" * 300, "ab " * 3000, "漢字" * 40, "漢字" * 41]
    out = list(enumerate(texts))
    return [*out, out[3], (None, texts[0]), (None, None)]


def test_exact(spark, rows):
    got = exact_dedup.classify(frame(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    expected = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        expected.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected, key=key)
    kept = exact_dedup.deduplicate(frame(spark, [*rows, (None, "only without an id"), (None, "only without an id")])).collect()
    assert sorted((r["text"] or "", r["doc_id"]) for r in kept if r["text"] != "only without an id") == sorted((t, max(x for x in ids if x is not None)) for t, ids in groups.items())
    assert [(r["doc_id"], r["owner"], r["recipe"]) for r in kept if r["text"] == "only without an id"] == [(None, "o", "r")]
    assert exact_dedup.classify(frame(spark, rows).limit(0)).count() == 0


def test_chunks_join_to_the_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abc. é\n") for _ in range(5000)) + "z" * 20_000
    df = spark.createDataFrame([(text,), ("",)], "text string").select(exact_dedup.chunks(F.col("text")).alias("c"))
    found = [r["c"] for r in df.collect()]
    assert ["".join(c) for c in found] == [text, ""]
    assert max(map(len, found[0])) <= exact_dedup.MAX_CHUNK and len(found[0]) > 5


@pytest.mark.parametrize("letters", ["abcdefgh. ", "".join(map(chr, range(0x4E00, 0x4E80)))])
def test_chunks_follow_the_content(spark, letters):
    """What is put in front of a text changes its first chunks alone, with marks or without any."""
    rng = random.Random(2)
    text = "".join(rng.choice(letters) for _ in range(60_000))
    df = spark.createDataFrame([(text,), ("x" * 777 + text,)], "text string").select(exact_dedup.chunks(F.col("text")).alias("c"))
    one, two = (r["c"] for r in df.collect())
    assert len(one) > 20 and len(set(one) & set(two)) > len(one) - 10


def test_ambiguous_chunks(spark):
    assert exact_dedup._ambiguous(spark.createDataFrame([("a",), ("b",)], "text string"), lambda c: F.lit(1))


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("block", "star"), [(ngram_join.BLOCK_GRAMS, 100), (400, 100), (400, 3)])
def test_ngram_join(spark, rows, monkeypatch, block, star):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", max(1, block // 60))
    monkeypatch.setattr(ngram_join, "STAR_SETS", star)
    monkeypatch.setattr(ngram_join, "STAR_BLOCKS", 2)
    got = ngram_join.components(frame(spark, rows)).collect()
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for a, x in named for b, y in named if a < b and 100 * len(x & y) >= 80 * len(x | y) and x]
    expected = roots({i for i, _ in named}, links)
    assert len(links) > 50 and len(set(expected.values())) > 10
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, len(s), expected[i]) for i, s in named)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_ngram_join_of_nothing(spark):
    assert ngram_join.components(frame(spark, []).limit(0)).count() == 0
    assert ngram_join.distinct(frame(spark, []).limit(0)).count() == 0


def test_ngram_join_of_repeated_ids(spark):
    """A doc_id with several texts has the links of all; `distinct` judges each row by itself."""
    make = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    edit = lambda t: t + " more"
    rows = [(5, make(1)), (5, make(2)), (3, edit(make(2))), (9, edit(make(1))), (8, make(3)), (8, make(4)), (None, make(1)), (None, make(4)), (11, make(6)), (11, make(6))]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.components(frame(spark, rows)).collect())
    assert got == [(0, None), (0, None), (3, 3), (5, 3), (5, 3), (8, 8), (8, 8), (9, 3), (11, 11), (11, 11)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.distinct(frame(spark, rows)).collect())
    assert kept == sorted([(0, make(1)), (0, make(4)), (3, edit(make(2))), (5, make(1)), (8, make(3)), (8, make(4)), (11, make(6)), (11, make(6))])


def test_ngram_join_of_alternating_words(spark):
    """Words that a hash with a linear structure takes for one."""
    word = lambda i, k: "".join("ab"[(j.bit_count() + k) & 1] for j in range(1024)) + f"{i}"
    rows = [(k, " ".join(word(i, k) for i in range(20))) for k in (0, 1)]
    assert sorted(tuple(r)[:3] for r in ngram_join.components(frame(spark, rows)).collect()) == [(0, 16, 0), (1, 16, 1)]


def test_a_head_of_many_sets(spark, monkeypatch):
    """A third of all rows are near copies of each other, with some that link only among themselves or by way of others."""
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 1000)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    monkeypatch.setattr(ngram_join, "STAR_SETS", 7)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"e{rng.randint(0, 40)}"
        texts.append(" ".join(words) if i % 3 else " ".join(f"u{i}x{j}" for j in range(40)))
    rows = list(enumerate(texts))
    named = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for a, x in named for b, y in named if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    expected = roots(range(150), links)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(frame(spark, rows)).collect()} == expected
    assert 50 < len(set(expected.values())) < 110


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(25)]
    assert ngram_join.overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) if a is not b else ngram_join.overlaps(sets)[i, i] for b in sets] for i, a in enumerate(sets)]


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (2, 1), *((i, i + 1) for i in range(20, 50))]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 20 for i in range(20, 51)}}


def removed(rows):
    """By the definition: bytes under a string that starts in a smaller document too."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_TEXTS, 2, 8])
def test_suffix_dedup(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    got = suffix_dedup.remove_repeats(frame(spark, rows), digests=True).collect()
    expected = removed(rows)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert sum(e[2] > 0 for e in expected) > 20
    texts = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert all("�" not in r["kept"] for r in texts)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0
    assert [tuple(r)[:4] for r in suffix_dedup.remove_repeats(frame(spark, [(1, None), (2, "a")])).collect()] == [(1, 0, 0, 0), (2, 1, 0, 0)]


def test_merge_of_runs():
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))) for _ in range(k)]
        made, base, flat = [], 0, []
        for run in runs:
            rest, common = b"", []
            for i, s in enumerate(run):
                before = run[i - 1] if i else b""
                c = next((j for j in range(min(len(s), len(before))) if s[j] != before[j]), min(len(s), len(before))) if i else 0
                common.append(c)
                rest += s[c:]
            made.append(suffix_dedup.Run(base, bytes(common), bytes(map(len, run)), rest))
            base += len(run)
            flat += run
        order, shared = suffix_dedup.merge(made)
        result = [flat[i] for i in order]
        assert result == sorted(flat) and sorted(order) == list(range(base))
        for a, b, c in zip(result, result[1:], shared[1:], strict=False):
            assert a[:c] == b[:c] and (len(a) == c or len(b) == c or a[c] != b[c])


def test_short_features():
    x = np.array([1, 2**40 + 7, 2**63 + 5], np.uint64)
    assert from_bytes(to_bytes(x).tobytes()).tolist() == shorten(x).tolist()
