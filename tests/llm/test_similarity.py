"""Hard negatives, spelling variants and MinHash against brute force, with odd rows, small blocks and hot keys."""

import collections
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import corpus, frame, roots

from corpusloom.llm import hard_negatives, minhash, ngram_join, spelling

# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, label int, embedding array<float>, score long, a int, grp string"


def vectors(seed=3, rows=400, width=70):
    """A hot label, a rare one, equal scores, short and empty vectors, repeated ids and rows that take no part."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        v = np.round(rng.normal(0.3, 0.2, width), 1)[: None if i % 5 else width // (1 + i % 3)].tolist()
        out.append((i, 0 if i % 3 == 0 else int(rng.integers(-2, 6)), v))
    out += [(rows, 99, [1.0] * width), (rows + 50 - rows % 50, 98, [1.0]), (401, 1, []), (402, None, [1.0]), (403, 1, None), (404, 1, [1.0, None]), (405, 1, [float("nan")]), (406, 1, [float("inf")]), (None, 1, [1.0]), (407, 1, [1e30, -1e30])]
    return [*out, out[0], (50, 0, [0.5] * width), (10, 7, [9.0])]


def brute_negatives(rows, anchor, positives=5, negatives=3):
    seen = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v]
        seen[i] = min(seen.get(i, (label, q)), (label, q))
    out = []
    for a in filter(anchor, seen):
        score = {i: sum(x * y for x, y in zip(seen[a][1], q)) for i, (_, q) in seen.items() if i != a}  # noqa: B905
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if seen[i][0] == seen[a][0]][:positives]:
            inside = [i for i in order if seen[i][0] != seen[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("groups", "block", "wide"), [(256, 512, 32), (3, 40, 32), (1, 7, 16)])
def test_hard_negatives(spark, monkeypatch, groups, block, wide):
    for name, value in (("GROUPS", groups), ("ROW_BLOCK", block), ("ANCHOR_BLOCK", max(2, block // 5)), ("LEAST_WIDE", wide), ("MOST_WIDE", wide)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    expected = brute_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got)) == expected and len(expected) > 100


def test_no_copies_of_blocks_are_broadcast(spark, monkeypatch):
    """A join of exploded blocks, whose stored files are small, broadcasts neither side, and vectors of one chunk exchange no tile."""
    plans, made = [], hard_negatives._meeting
    monkeypatch.setattr(hard_negatives, "_meeting", lambda rows, anchors: plans.append(made(rows, anchors)) or plans[-1])
    rows = vectors(width=20)
    got = hard_negatives.mine(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], VECTORS), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)
    shown = [str(p._jdf.queryExecution().executedPlan()) for p in (*plans, got)]
    assert len(plans) == 2 and all("SortMergeJoin [a" in s for s in shown[:2]) and "BroadcastHashJoin" not in shown[0]
    assert not re.search(r"FlatMapGroupsInArrow \[a#\d+, b#\d+\]", shown[2])


def test_hard_negatives_without_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for df in (none, spark.createDataFrame([(1, 1, [1.0], 1, 1, "x")], VECTORS), spark.createDataFrame([(0, 1, [1.0], 1, 1, "x")], VECTORS)):
        found = hard_negatives.mine(df, F.col("vec_id") % 50 == 0)
        assert found.columns == names and found.count() == 0


def test_large_scores_stay_exact(spark):
    """Components at the bound: sums beyond 2^32, in tiles of eight bytes."""
    big = [(i, i % 2, [20_000.0 - i / 300] * 40) for i in range(30)]
    got = hard_negatives.mine(spark.createDataFrame(big, "vec_id long, label int, embedding array<float>"), F.col("vec_id") < 3, least=1, most=10_000).collect()
    assert all(r["positive_score"] > 1 << 40 for r in got) and len(got) == 3 * 5 * 3
    wide = brute_negatives([(i, label, [v[0] / 300] * 40) for i, label, v in big], lambda i: i < 3)
    again = hard_negatives.mine(spark.createDataFrame([(i, label, [v[0] / 300] * 40) for i, label, v in big], "vec_id long, label int, embedding array<float>"), F.col("vec_id") < 3).collect()
    assert sorted(map(tuple, again)) == wide


# ---------------------------------------------------------------- spelling

DOCS = "doc_id long, text string, word string, n long, form string, size int"


def brute_words(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart(a, b):
    """One edit, by the whole table of edit distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] == 1


def brute_variants(rows):
    n = brute_words(rows)
    near = collections.defaultdict(list)
    for a, b in combinations(n, 2):
        if apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


@pytest.fixture(scope="module")
def spelt():
    """Words over two letters (so that many share their grams), variants of words, marks of all kinds, a very long run."""
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(150)]
    base = ["straße", "königlich", "Éclair", "anan" * 3, "aaaaaa", "aaaaaaa", "x" * 150, "x" * 149 + "y", "a×÷bc", "ÀÁÂÃÄ", "word"]
    words += base
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            words += [w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("ab") + w[k + 1 :]]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 120))) for _ in range(250)]
    texts += ["straße" * 2 + "漢字straße\x00Straße-STRASSE ſtrasse", None, "", "  ", *[" ".join(words)] * 3]
    rows = [(None if i % 17 == 0 else i % 200, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize(("block", "gather"), [(1000, 200_000), (6, 10)])
def test_spelling(spark, spelt, monkeypatch, block, gather):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "GATHER", gather)
    df = spark.createDataFrame([(i, t, "x", 1, "x", 1) for i, t in spelt], DOCS)
    got = sorted(map(tuple, spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    expected = brute_variants(spelt)
    assert got == expected
    assert len(expected) > 150 and sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] for r in expected if r[1])
    assert spelling.variants(df.limit(0)).count() == 0


def test_heap_merge():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 6)
        count = collections.Counter(x for postings in lists for x in postings)
        assert list(spelling.merged(lists, least)) == sorted(x for x, m in count.items() if m >= least)


def test_shared_grams_reach_the_bound():
    """Any two words one edit apart share so many grams at their places, and one of the first PREFIX in any order of grams."""
    rng = random.Random(9)
    for _ in range(2000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9)))
        k = rng.randrange(len(w))
        v = rng.choice([w[:k] + rng.choice("abcd") + w[k:], w[:k] + rng.choice("abcd") + w[k + 1 :]])
        if v == w:
            continue
        shift = len(v) - len(w)
        ours, theirs = spelling._places(w), spelling._places(v)
        assert sum(any((g, k - d) in ours for d in range(shift + 1)) for g, k in theirs) >= spelling.least_shared(len(v))
        rank = {g: rng.random() for g in {g for g, _ in ours + theirs}}
        first = lambda places: sorted(places, key=lambda p: (rank[p[0]], p))[: spelling.PREFIX]  # noqa: B023, E731
        assert any((g, k - d) in first(ours) for g, k in first(theirs) for d in range(shift + 1))


# ---------------------------------------------------------------- MinHash


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("block", "star"), [(ngram_join.BLOCK_GRAMS, 100), (300, 3)])
def test_minhash(spark, monkeypatch, block, star):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", max(1, block // 60))
    monkeypatch.setattr(ngram_join, "STAR_SETS", star)
    texts = [*corpus(seed=6, docs=110), None, "", "   ", "One two", "one  TWO", "ab " * 30_000, "ab " * 29_000, " ".join(f"v{k}" for k in range(3000)), " ".join(f"v{k}" for k in range(100, 3000))]
    rows = [*enumerate(texts), (3, texts[5]), (3, texts[3]), (None, texts[0]), (None, None)]
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for (i, a), (j, b) in combinations(sets, 2) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    root = roots({i for i, _ in sets}, links)
    expected = sorted([(i, len(s), root[i], i == root[i]) for i, s in sets] + [(-1, len(shingles(t)), None, None) for i, t in rows if i is None], key=lambda r: r[:2])
    got = minhash.components(frame(spark, rows)).collect()
    assert sorted([(-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got], key=lambda r: r[:2]) == expected
    assert len({i for i in root.values()}) < len(root) - 10
    assert minhash.components(frame(spark, rows).limit(0)).count() == 0


def test_posterior_bounds():
    """The least number of equal values is where the numerically integrated posterior reaches the miss probability."""
    t = np.linspace(0, 1, 200_001)[1:-1]
    for k, least in minhash.least_equal(85, 1e-4, 160, 16):
        tail = []
        for m in (least - 1, least):
            density = np.exp(m * np.log(t) + (k - m) * np.log1p(-t) + math.lgamma(k + 2) - math.lgamma(m + 1) - math.lgamma(k - m + 1))
            tail.append(density[t >= 0.85].sum() * (t[1] - t[0]))
        assert tail[0] < 1e-4 <= tail[1] * 1.01


def test_signatures_estimate_and_prune():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(x) for x in (pool[:2000], pool[200:2000], pool[1000:3000], pool[2000:4000], np.zeros(0, np.uint64))]
    sigs = minhash.signatures(sets)
    assert abs((sigs[0] == sigs[1]).mean() - 0.9) < 0.1 and abs((sigs[0] == sigs[2]).mean() - 1 / 3) < 0.13
    live, _ = minhash.likely(sigs, np.array([0, 0, 0]), np.array([1, 2, 3]))
    assert live.tolist() == [0]
    assert minhash.linked(sets[:4], sigs[:4]) == [(0, 1)]
