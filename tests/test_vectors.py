"""Neighbours, votes and metrics against direct computation."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encoders, labels, metrics, neighbours


def frames(spark, q, t, y):
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q_id long, vector array<double>")
    train = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(t, y, strict=True))], "t_id long, label_id int, vector array<double>")
    return queries, train


@pytest.mark.parametrize("block", [neighbours.BLOCK_VALUES, 24])
def test_nearest_and_votes(spark, monkeypatch, block):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", block)
    t = rng.integers(0, 3, (20, 4)) / 2
    q, y = np.concatenate([rng.integers(0, 3, (10, 4)) / 2, t[:2]]), rng.integers(0, 3, 20)
    queries, train = frames(spark, q, t, y)
    near = neighbours.nearest(queries, train, 5)
    d = np.maximum(1 - q @ t.T, 0)
    best = np.lexsort((np.broadcast_to(np.arange(20), d.shape), d), axis=1)[:, :5]
    assert [[r["t_id"] for r in near.filter(F.col("q_id") == i).orderBy("rank").collect()] for i in range(len(q))] == best.tolist()
    got = {r["q_id"]: r["prediction"] for r in neighbours.predict(neighbours.votes(near, 5)).collect()}
    p = {(r["q_id"], r["label_id"]): r["p"] for r in neighbours.probabilities(neighbours.votes(near, 5), spark.createDataFrame([(i,) for i in range(3)], "label_id int")).collect()}
    for i in range(len(q)):
        dist = d[i, best[i]]
        w = (dist == 0).astype(float) if (dist == 0).any() else 1 / dist
        total = np.bincount(y[best[i]], weights=w, minlength=3)
        assert got[i] == int(np.round(total, 9).argmax())
        assert [p[i, k] for k in range(3)] == pytest.approx((total / total.sum()).tolist())
    with pytest.raises(ValueError):
        neighbours.nearest(queries, train, 21)


def test_centroids(spark):
    _, train = frames(spark, [], np.array([[1.0, 0], [0, 1.0], [2, 2]]), [0, 0, 1])
    assert {r["label_id"]: r["vector"] for r in neighbours.centroids(train).collect()} == {0: [0.5, 0.5], 1: [2.0, 2.0]}


def test_ndcg_shares_ties(spark):
    rows = [(1, 0, 0.5, 1), (1, 1, 0.5, 0), (1, 2, 0.0, 0), (2, 0, 0.1, 0), (2, 1, 0.2, 0), (3, 0, 0.1, 0), (3, 1, 0.9, 1)]
    df = spark.createDataFrame(rows, "q_id long, label_id int, p double, rel int")
    found = {r["q_id"]: r["ndcg"] for r in metrics.ndcg(df).collect()}
    assert found == {1: pytest.approx((1 + 1 / np.log2(3)) / 2), 2: 0.0, 3: 1.0}


def test_correction_and_accuracy(spark):
    df = spark.createDataFrame([("a", ["b", "c"], "c"), ("a", None, "b"), ("a", None, "a")], "y string, m array<string>, p string")
    assert metrics.accuracy(df, F.col("y"), metrics.corrected(F.col("y"), F.col("m"), F.col("p"))).first()[0] == pytest.approx(2 / 3)


def test_triplet_loss(spark):
    v = np.array([[1.0, 0], [0.8, 0.6], [0, 1.0]])
    df = spark.createDataFrame([(0, i, y, x.tolist()) for i, (x, y) in enumerate(zip(v, [0, 0, 1], strict=True))], "iteration int, id int, label int, vector array<double>")
    d = 1 - v @ v.T
    expected = np.mean([max(0, d[0, 1] - d[0, 2] + 0.4), max(0, d[1, 0] - d[1, 2] + 0.4), max(0, 0 - min(d[2, 0], d[2, 1]) + 0.4)])
    assert metrics.triplet_loss(df, 0.4).first()["loss"] == pytest.approx(expected)


def test_labels(spark):
    df = spark.createDataFrame([(0, "b"), (1, ""), (2, "a"), (3, "b")], "ord int, y string")
    names = labels.label_dictionary(df, "y", "ord")
    assert {r["label"]: r["label_id"] for r in names.collect()} == {"b": 0, "a": 1}
    assert [r["label_id"] for r in labels.encode(df, names, "y").orderBy("ord").collect()] == [0, 1, 0]
    with pytest.raises(Exception, match="Unknown label"):
        labels.encode(spark.createDataFrame([(0, "z")], df.schema), names, "y").collect()
    lists = spark.createDataFrame([(0, ["a"]), (1, None)], "ord int, m array<string>")
    assert {(r["label_id"], r["rel"]) for r in labels.relevance(lists, names, "m", "ord").collect()} == {(0, 0), (1, 1)}


def test_encoders(spark):
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    rows = [r["vector"] for r in encoders.embed(df, "text", "HASHING").collect()]
    assert rows[0] == rows[2] and len(rows[0]) == encoders.dimension("HASHING") and not any(rows[1])
    assert np.linalg.norm(rows[0]) == pytest.approx(1, abs=1e-6)
    tokens = np.array([[[1.0, 2], [3, 4], [9, 9]]])
    assert encoders.mean_pool(tokens, np.array([[1, 1, 0]])).tolist() == [[2.0, 3.0]]
    assert encoders.mean_pool(tokens, np.array([[0, 0, 0]])).tolist() == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        encoders.dimension("x")
    assert len(encoders.REGISTRY) == 13


@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_pruned_cells_are_exact(spark, monkeypatch, scale):
    """A training side of many blocks in 30 clusters, with copies, zero vectors and (at the larger scale) products above 1: all neighbours, and most cells left out."""
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 8 * 40)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 8))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    draw = lambda n: centers[rng.integers(0, 30, n)] + rng.normal(scale=0.02, size=(n, 8))
    train, queries, k = draw(900), draw(120), 5
    train[10:20] = train[0]
    train[20:23] = 0
    queries[0] = 0
    train, queries = train * np.sqrt(scale), queries * np.sqrt(scale)
    t = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(train)], "t_id long, label_id int, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q_id long, vector array<double>")
    got = {(r["q_id"], r["rank"]): (r["t_id"], r["label_id"], round(r["d"], 9)) for r in neighbours.nearest(q, t, k).collect()}
    d = np.maximum(1 - queries @ train.T, 0)
    expected = {}
    for i, row in enumerate(d):
        for rank, j in enumerate(np.lexsort((np.arange(len(row)), row))[:k], 1):
            expected[i, rank] = (j, j % 7, round(row[j], 9))
    wrong = {key for key in expected if expected[key][0] != got[key][0]}  # only products that round the same may change places
    assert got.keys() == expected.keys() and all(abs(expected[key][2] - got[key][2]) < 1e-8 for key in expected) and len(wrong) < 10
    if scale == 1:
        cells, placed = neighbours._cells(t, 64)
        near = neighbours._meet(neighbours.routes(q, cells, k), placed, cells, 8, k)
        kth = near.groupBy("q_id").agg(F.max("d").alias("kth"))
        visits = neighbours.routes(q, cells, k).count() + neighbours.routes(q.join(kth, "q_id"), cells, k).count()
        assert visits < 0.35 * len(queries) * (cells.rows > 0).sum()


def test_a_cell_bound_holds():
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(300, 6)), rng.normal(size=(50, 6))
    cells = neighbours.Cells(vectors[:12], np.zeros(0), np.zeros(0))
    cell, away = cells.of(vectors)
    cells.rows = np.bincount(cell, minlength=12)
    cells.radius = np.array([away[cell == c].max(initial=0) for c in range(12)])
    d = np.maximum(1 - queries @ vectors.T, 0)
    for k in (1, 7):
        first = cells.first(queries, k)
        assert all(cells.rows[f].sum() >= k for f in first)
        kth = np.sort(d, axis=1)[:, k - 1]
        visited = first | cells.further(queries, k, kth)
        assert all(visited[i, cell[j]] for i in range(50) for j in np.flatnonzero(d[i] <= kth[i]))


def test_products_are_bounded_and_copies_keep_their_order():
    """2,000 queries and 20,000 rows, of which many are equal: no product of all of them, and of equal rows the smallest ids."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(900, 8))
    t, q, k = some[rng.integers(0, 900, 20_000)], rng.normal(size=(2000, 8)), 30
    tracemalloc.start()
    found = list(neighbours._nearest(pa.array(np.arange(len(q))), q, np.arange(len(t)), np.zeros(len(t), np.int32), t, k))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # one product of all would have 320 MB
    got = {}
    for rows in found:
        for i, j in zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True):
            got.setdefault(i, []).append(j)
    for i in range(0, len(q), 97):
        dots = np.zeros(len(t))
        for x, y in zip(q[i], t.T, strict=True):
            dots += x * y
        assert got[i] == np.lexsort((np.arange(len(t)), np.maximum(1 - dots, 0)))[:k].tolist()
    assert len(got) == len(q)
