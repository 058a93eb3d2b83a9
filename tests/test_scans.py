"""Running numbers without a label's window, density without pairs, and excerpts over many tasks."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import boilerplate, excerpts, sampling
from corpusloom.operators.numbering import numbered


@pytest.mark.parametrize("ranges", [1, 8])
def test_numbers_within_labels(spark, ranges):
    """One label holds most rows and lies in all ranges; others are null, or have one row."""
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice([None, "a", f"one{i}"]), i % 3 and "t", rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "goal string, target string, x double").repartition(6)
    got = numbered(df, ["goal", "target"], ["x"], "k", ranges=ranges).collect()
    expected, seen = [], {}
    for g, t, x in sorted(rows, key=lambda r: r[2]):
        seen[g, t] = seen.get((g, t), -1) + 1
        expected.append((str(g), str(t), x, seen[g, t]))
    assert sorted((str(r["goal"]), str(r["target"]), r["x"], r["k"]) for r in got) == sorted(expected)
    every = numbered(df, [], [F.desc("x")], "k", ranges=ranges).collect()
    assert [r["x"] for r in sorted(every, key=lambda r: r["k"])] == sorted((r[2] for r in rows), reverse=True)
    assert numbered(df.limit(0), ["goal"], ["x"], "k").count() == 0


def test_one_label_over_eight_partitions(spark):
    """The ranges of one label are even, so no task holds it whole, and no plan sorts it in a window."""
    df = spark.range(0, 8000, 1, 5).select(F.lit("1").alias("goal"), F.lit("").alias("target"), F.xxhash64("id").alias("x"))
    out = numbered(df, ["goal", "target"], ["x"], "k", ranges=8)
    sizes = [r["count"] for r in df.repartitionByRange(8, "goal", "target", "x").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window ")
    assert "HashAggregate" in plan[window:]  # the window runs over counts, a row for each task and label
    assert sorted(r["k"] for r in out.collect()) == list(range(8000))


def brute_noise(sentences, min_df, eps, min_samples):
    """Density clusters over all pairs of TF-IDF vectors."""
    words = [s.split() for s in sentences]
    df = {w: sum(w in x for x in words) for w in {w for x in words for w in x}}
    terms = sorted(w for w in df if df[w] >= min_df)
    matrix = np.array([[(1 + np.log(x.count(w))) * (np.log((1 + len(words)) / (1 + df[w])) + 1) if w in x else 0 for w in terms] for x in words])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    near = matrix @ matrix.T >= 1 - eps - 1e-9
    np.fill_diagonal(near, True)
    core = near.sum(1) >= min_samples
    return {i for i in range(len(words)) if not core[i] and not (near[i] & core).any()}


@pytest.mark.parametrize("block", [400, 12])
def test_noise_is_that_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(boilerplate, "BLOCK_POINTS", block)
    rng = random.Random(block)
    pool = [f"word{i}" for i in range(60)]
    base = rng.sample(pool, 8)
    sentences = []
    for _ in range(240):
        kind = rng.random()
        if kind < 0.35:
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(8)] = rng.choice(pool)
            sentences.append(" ".join(changed))
        elif kind < 0.9:
            sentences.append(" ".join(rng.choices(pool, k=rng.randint(2, 12))))
        else:
            sentences.append(rng.choice(sentences) if sentences else "word1")
    df = spark.createDataFrame(list(enumerate(sentences)), "id long, text string")
    got = {r["id"] for r in boilerplate.noise(df, 3, 0.3, 6, []).collect()}
    expected = brute_noise(sentences, 3, 0.3, 6)
    assert got == expected and 20 < len(expected) < 220


def test_blocks_give_no_more_rows_than_points():
    """300 variants of one sentence are 44,850 near pairs and at most 300 rows, whose counts stop at what makes a core point."""
    rng = np.random.default_rng(2)
    n = 300
    ids = [np.array([1, *sorted(rng.choice(np.arange(2, 40), 20, replace=False))], np.int64) for _ in range(n)]
    ws = [np.r_[0.95, np.full(20, np.sqrt((1 - 0.95**2) / 20))] for _ in ids]
    table = pa.table({
        "run": np.zeros(n, np.int64), "own": np.zeros(n, np.int32), "low": np.zeros(n, np.int32), "high": np.zeros(n, np.int32), "tail": np.ones(n), "node": np.arange(n), "m": np.ones(n, np.int64),
        "before": pa.array([[]] * n, pa.list_(pa.int64())), "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int64())), "ws": pa.array([x.tolist() for x in ws], pa.list_(pa.float64())),
    })
    i, j = boilerplate.near_pairs(table, 0.7)
    assert len(i) == n * (n - 1) // 2
    found = boilerplate.degrees(table, 0.7, 10)
    assert found.num_rows == n and set(found["others"].to_pylist()) == {10}
    marked = table.append_column("core", pa.array([True] + [False] * (n - 1)))
    assert sorted(boilerplate.reached(marked, 0.7)["node"].to_pylist()) == list(range(1, n))


def test_pairs_count_once():
    """Two points with two common terms are near under the first one alone."""
    rows = {"own": [0] * 2, "low": [0] * 2, "high": [0] * 2, "node": [7, 8], "m": [1, 1]}
    make = lambda run, before, ids, w: pa.table(rows | {"run": [run] * 2, "tail": [float(np.sqrt((np.array(w) ** 2).sum()))] * 2, "before": pa.array([before] * 2, pa.list_(pa.int64())), "ids": pa.array([ids] * 2, pa.list_(pa.int64())), "ws": pa.array([w] * 2, pa.list_(pa.float64()))})
    first, second = make(0, [], [1, 2], [0.6, 0.8]), make(1, [1], [2], [0.8])
    assert len(boilerplate.near_pairs(first, 0.6)[0]) == 1 and len(boilerplate.near_pairs(second, 0.6)[0]) == 0
    both = pa.concat_tables([first, second])
    assert [x.tolist() for x in boilerplate.near_pairs(both, 0.6)] == [[0], [1]]


def test_five_thousand_variants(spark):
    rng = random.Random(3)
    pool = [f"variant{i}" for i in range(40)]
    sentences = [" ".join(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", *sorted(rng.sample(pool, 2))]) for _ in range(5000)]
    df = spark.createDataFrame([*enumerate(sentences), (9999, "something else stands here")], "id long, text string")
    assert [r["id"] for r in boilerplate.noise(df, 10, 0.8, 10, []).collect()] == [9999]


def test_capped_samples_are_limited_in_each_task(spark):
    """Before the exchange a task keeps no more rows of a label than the sample takes."""
    rows = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).cast("string").alias("goal"), F.concat(F.lit("1."), (F.col("id") % 4).cast("string")).alias("target"), F.lit("General").alias("section"), "id")
    for found in (sampling.goal_sample(rows, 14, ["id"]), sampling.target_sample(rows.withColumn("section", F.lit("Targets")), 6, ["id"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


PLACE = ["file_ord", "page_ord", "emit_ord"]


def test_numbers_of_excerpts(spark):
    """Copies, lengths, the first excerpt of a target, and groups with null keys, against a plain loop."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = rng.choice([1, 2, 4, 6])
        rows.append((0, i // 9, i % 9, rng.choice(["1", "2"]), rng.choice(["1.1", "", "x.y"]), rng.choice(["a", "b"]), "u", None if i % 5 else "t", "r", "s", 0, " ".join(rng.choices(["One", "one", "two"], k=words))))
    names = [*PLACE, *excerpts.GROUP, "part", "excerpt"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n in (*PLACE, 'part') else 'string'}" for n in names)).repartition(5)
    got = excerpts.number(df, 4, 4, 1)
    seen, begun, label, expected = set(), {}, {}, []
    for r in rows:
        begun.setdefault(r[3:10], r[:3])
    for r in sorted(rows, key=lambda r: (r[3], r[4], begun[r[3:10]], r[:3])):
        first = r[3:5] not in seen
        seen.add(r[3:5])
        if 3 <= len(r[11].split()) <= 5 or (first and r[4]):
            label[r[3:5]] = label.get(r[3:5], -1) + 1
            if r[4] != "x.y":
                expected.append((f"{r[3]}_{r[4]}_{label[r[3:5]]}", *r[:3], r[11]))
    place = [F.col(f"ord.{c}") for c in PLACE]
    assert sorted(map(tuple, got.select("id", *place, "modified_text_excerpt").collect())) == sorted(expected)


def test_a_pair_of_blocks_meets_across_alone(monkeypatch):
    """Points of a hot term in two blocks: only products of one block with the other are made, and all near pairs across are found."""
    rng, n, shapes = np.random.default_rng(6), 300, []
    shared = boilerplate._shared
    monkeypatch.setattr(boilerplate, "_shared", lambda *a: shapes.append((found := shared(*a)).shape) or found)
    own, angle = rng.integers(0, 2, n), rng.uniform(0, 1.5, n)
    lists = lambda v, kind: pa.array(v, pa.list_(kind))
    table = pa.table({
        "run": pa.array(np.zeros(n, np.int64)), "own": pa.array(own.astype(np.int32)), "low": pa.array(np.zeros(n, np.int32)), "high": pa.array(np.ones(n, np.int32)), "tail": pa.array(np.ones(n)),
        "ids": lists([[1, 2]] * n, pa.int64()), "ws": lists(np.stack([np.cos(angle), np.sin(angle)], 1).tolist(), pa.float64()), "before": lists([[]] * n, pa.int64()),
    })
    i, j = boilerplate.near_pairs(table, 0.7)
    expected = {(a, b) for a in range(n) for b in range(a + 1, n) if own[a] != own[b] and np.cos(angle[a] - angle[b]) >= 0.7}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and len(i) == len(expected)
    assert shapes[0] == ((own == 0).sum(), (own == 1).sum())


def test_long_sentences_move_in_few_copies(spark, monkeypatch):
    """The vector of a long sentence goes to places with a near one alone, not to each of its hundreds of rare terms."""
    rng, stored = random.Random(11), {}
    pool = [f"word{i}" for i in range(1500)]
    base = rng.sample(pool, 300)
    sentences = [" ".join(rng.sample(pool, 300)) for _ in range(40)] + [" ".join(rng.sample(base, 290)) for _ in range(12)]
    kept = boilerplate.materialized

    def noted(df, name):
        out = kept(df, name)
        if name == "prefixes":
            stored[name] = out.agg(F.coalesce(F.sum(F.size("ids") + F.size("before")), F.lit(0))).first()[0]
        return out

    monkeypatch.setattr(boilerplate, "materialized", noted)
    df = spark.createDataFrame(list(enumerate(sentences)), "id long, text string")
    assert {r["id"] for r in boilerplate.noise(df, 3, 0.3, 6, []).collect()} == brute_noise(sentences, 3, 0.3, 6) == set(range(40))
    assert stored["prefixes"] <= 8 * 300 * 12
