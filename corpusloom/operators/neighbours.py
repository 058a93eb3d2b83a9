"""Exact nearest neighbours, weighted votes and centroids (V1-V5, V8, V9).

The training side of a classifier is small (tens of rows per label). If its values fit one block, the block goes to
the executors, and the queries, dealt evenly over tasks, meet it in matrix products of PRODUCT_VALUES numbers at most, of which the k nearest stay.
Nothing but those leaves the task. A larger training side is dealt in cells around pivots, with their radius. A query meets
the cells nearest to it, and then only those that a bound from pivot and radius doesn't rule out at its k-th distance; each product has the same bound,
and the candidates are ranked. Products only tell which rows may be near: their distances are added up dimension by dimension, so that
equal vectors are equally far wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.skew import broadcast_small
from corpusloom.operators.storage import materialized
from corpusloom.workers import importable

#: Numbers in one block of vectors (64 MB); a training side of no more is broadcast.
BLOCK_VALUES = 8_000_000
#: Numbers in one product of queries and training rows (16 MB), and training rows of it.
PRODUCT_VALUES = 2_000_000
PRODUCT_ROWS = 4096
#: Pivots of a large training side.
LEAST_PIVOTS, MOST_PIVOTS = 64, 1024
#: Slack of comparisons with a bound.
SLACK = 1e-9


def distance(a: Column, b: Column) -> Column:
    """1 - a.b, at least 0; vectors are taken as they are."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), 1 - dot)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _firsts(t: np.ndarray, k: int) -> np.ndarray:
    """Rows of t, which is sorted by id, but those with k equal ones before them; no other can be among the k nearest."""
    if len(t) <= k or not t.shape[1]:
        return np.arange(len(t))
    kinds = np.unique(np.ascontiguousarray(t).view(np.dtype((np.void, t.itemsize * t.shape[1]))).reshape(-1), return_inverse=True)[1].reshape(-1)
    order = np.argsort(kinds, kind="stable")
    kinds = kinds[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(kinds, kinds) < k])


def _distances(q: np.ndarray, t: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of pairs, added up in the order of the dimensions."""
    dots = np.zeros(len(rows))
    for x, y in zip(q.T, t.T, strict=True):
        dots += x[rows] * y[cols]
    return np.maximum(1 - dots, 0)


def _best(q: np.ndarray, t: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k nearest of each query that are no farther than its limit, ties by column. No more than PRODUCT_ROWS columns meet at once."""
    slack = SLACK * np.maximum(1, np.linalg.norm(q, axis=1) * np.sqrt((t**2).sum(1).max(initial=0)))
    rows, cols, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for y in range(0, len(t), PRODUCT_ROWS):
        dots = q @ t[y : y + PRODUCT_ROWS].T
        at = dots.shape[1] - k
        known = limit if y or at < 0 else np.minimum(limit, np.maximum(1 - np.partition(dots, at, axis=1)[:, at], 0))
        r, c = np.nonzero(dots >= (1 - known - slack)[:, None])
        rows, cols, d = np.concatenate([rows, r]), np.concatenate([cols, c + y]), np.concatenate([d, _distances(q, t, r, c + y)])
        order = np.lexsort((cols, d, rows))
        order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
        rows, cols, d = rows[order], cols[order], d[order]
        full = np.flatnonzero(np.bincount(rows, minlength=len(q)) == k)
        limit = limit.copy()
        limit[full] = np.minimum(limit[full], d[np.searchsorted(rows, full, side="right") - 1])
    return rows, cols, d


def _nearest(q_ids: pa.Array, q: np.ndarray, t_ids: np.ndarray, t_labels: np.ndarray, t: np.ndarray, k: int, kth: np.ndarray | None = None) -> Iterator[list[pa.Array]]:
    """q_id, t_id, label_id and d of the k nearest; t is sorted by id. kth: how far they may be."""
    kth = np.full(len(q), np.inf) if kth is None else kth
    tall = max(1, PRODUCT_VALUES // max(1, min(len(t), PRODUCT_ROWS)))
    for x in range(0, len(q), tall):
        rows, cols, d = _best(q[x : x + tall], t, k, kth[x : x + tall])
        yield [q_ids.take(pa.array(rows + x)), pa.array(t_ids[cols]), pa.array(t_labels[cols], pa.int32()), pa.array(d)]


_FOUND = ["q_id", "t_id", "label_id", "d"]
_FOUND_SQL = "q_id long, t_id long, label_id int, d double"


def _kind(vectors: DataFrame) -> str:
    """The type of the vectors; numbers of single precision move as such."""
    return vectors.schema["vector"].dataType.simpleString()


def _by_broadcast(queries: DataFrame, side: DataFrame, k: int) -> DataFrame:
    """side: a single block, whose size has been looked at."""
    importable(queries.sparkSession)
    table = side.orderBy("t_id").toArrow()
    vectors = _vectors(table["vector"])
    some = _firsts(vectors, k)
    shared = queries.sparkSession.sparkContext.broadcast((table["t_id"].to_numpy()[some], table["label_id"].to_numpy()[some], vectors[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for found in _nearest(b.column("q_id"), _vectors(b.column("vector")), *shared.value, k):
                    yield pa.record_batch(found, names=_FOUND)

    return queries.repartition(_tasks(queries), "q_id").mapInArrow(run, _FOUND_SQL)


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Cells:
    """Cells of a training side: pivots, and of each cell its rows and its radius, the most that a row lies away from the pivot."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray):
        self.pivots, self.rows, self.radius = pivots, rows, radius

    def of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and how far it is."""
        squares = (vectors**2).sum(1)[:, None] - 2 * vectors @ self.pivots.T + (self.pivots**2).sum(1)[None, :]
        cell = squares.argmin(1)
        return cell, np.sqrt(((vectors - self.pivots[cell]) ** 2).sum(1))

    def first(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Query x cell: the cells of greatest product with the pivot, as many as hold k rows."""
        order = np.argsort(-(queries @ self.pivots.T), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (before < k) & (self.rows[order] > 0), 1)
        return out

    def further(self, queries: np.ndarray, k: int, kth: np.ndarray) -> np.ndarray:
        """Query x cell: the other cells that can hold a row as near as kth. As q.t = q.p + q.(t - p), no product in a cell passes q.p + |q| radius."""
        most = queries @ self.pivots.T + np.linalg.norm(queries, axis=1)[:, None] * self.radius[None, :]
        near = np.maximum(1 - most, 0) <= kth[:, None] + SLACK
        return near & (self.rows > 0) & ~self.first(queries, k)


def _parts(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of which a row makes `wide` numbers."""
    tall = max(1, PRODUCT_VALUES // max(1, wide))
    for x in range(0, batch.num_rows, tall):
        yield batch.slice(x, tall)


def _cells(side: DataFrame, many: int) -> tuple[Cells, DataFrame]:
    """Cells around rows of the side that are drawn by hash, and the side with the cell of each row. many: MOST_PIVOTS at most, which bounds what the driver holds."""
    drawn = side.orderBy(F.xxhash64("t_id"), "t_id").limit(many).toArrow()
    shared = side.sparkSession.sparkContext.broadcast(Cells(_vectors(drawn["vector"]), np.zeros(0), np.zeros(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, many):
                cell, away = shared.value.of(_vectors(part.column("vector")))
                yield pa.record_batch([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*part.schema.names, "cell", "away"])

    placed = materialized(side.mapInArrow(place, f"t_id long, label_id int, vector {_kind(side)}, cell int, away double"), "cells")
    found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("away").alias("r")).toArrow()  # a row for each cell
    pivots = shared.value.pivots
    rows, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    rows[found["cell"].to_numpy()], radius[found["cell"].to_numpy()] = found["m"].to_numpy(), found["r"].to_numpy()
    return Cells(pivots, rows, radius), placed.drop("away")


def routes(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """queries (q_id, vector, and kth where it is known) with each cell that they have to visit."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    known = "kth" in queries.columns
    names = ["q_id", "vector", *["kth"] * known]
    many, dim = cells.pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, many * dim):
                vectors = _vectors(part.column("vector"))
                visits = shared.value.further(vectors, k, part.column("kth").to_numpy()) if known else shared.value.first(vectors, k)
                row, cell = np.nonzero(visits)
                at = pa.array(row)
                yield pa.record_batch([*(part.column(n).take(at) for n in names), pa.array(cell, pa.int32())], names=[*names, "cell"])

    return queries.select(names).mapInArrow(run, f"q_id long, vector {_kind(queries)}, {'kth double, ' * known}cell int")


def _meet(visits: DataFrame, placed: DataFrame, cells: Cells, dim: int, k: int) -> DataFrame:
    """The k nearest of each query in each block of the cells that it visits, but none beyond its kth where visits have that."""
    spark, most = placed.sparkSession, max(1, BLOCK_VALUES // 4 // dim)
    came = {r["cell"]: r["m"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()}  # a row for each cell
    blocks = [(c, -(-m // most), -(-int(cells.rows[c]) // most)) for c, m in came.items()]
    sizes = F.broadcast(spark.createDataFrame(blocks, "cell int, q_blocks int, t_blocks int"))  # MOST_PIVOTS rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    kth = "kth" if "kth" in visits.columns else F.lit(float("inf")).alias("kth")
    q = visits.join(sizes, "cell").withColumn("i", own("q_id", "q_blocks")).withColumn("j", every("t_blocks")).select("cell", "i", "j", "q_id", "vector", kth)
    t = placed.join(sizes, "cell").withColumn("j", own("t_id", "t_blocks")).withColumn("i", every("q_blocks")).select("cell", "i", "j", "t_id", "label_id", "vector")

    def run(queries: pa.Table, train: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], kind) for n, kind in zip(_FOUND, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)})
        if not queries.num_rows or not train.num_rows:
            return empty
        order = np.argsort(train["t_id"].to_numpy(), kind="stable")
        vectors = _vectors(train["vector"])[order]
        some = _firsts(vectors, k)
        ids, labels = (train[n].to_numpy()[order][some] for n in ("t_id", "label_id"))
        found = _nearest(queries["q_id"].combine_chunks(), _vectors(queries["vector"]), ids, labels, vectors[some], k, queries["kth"].to_numpy())
        return pa.concat_tables([empty, *(pa.Table.from_arrays(f, names=_FOUND) for f in found)])

    keys = ["cell", "i", "j"]
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(run, _FOUND_SQL)


def _by_cells(queries: DataFrame, side: DataFrame, k: int, blocks: int, dim: int) -> DataFrame:
    """First the cells nearest to a query, which gives a k-th distance; then those cells alone that can hold a nearer row. Other pairs of blocks are never multiplied.

    Visits are made anew wherever they are read, as they are many times the queries.
    """
    importable(queries.sparkSession)
    cells, placed = _cells(side, min(MOST_PIVOTS, max(LEAST_PIVOTS, blocks)))
    queries = queries.repartition(_tasks(queries), "q_id")
    near = materialized(_meet(routes(queries, cells, k), placed, cells, dim, k), "near")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("d", "t_id"))
    kth = near.withColumn("rank", rank).filter(F.col("rank") == k).select("q_id", F.col("d").alias("kth"))
    bounded = materialized(queries.join(kth, "q_id").repartition(_tasks(queries), "q_id"), "bounded")
    return near.unionByName(_meet(routes(bounded, cells, k), placed, cells, dim, k))


def _numbers(vectors: DataFrame) -> Column:
    return F.col("vector") if _kind(vectors) == "array<float>" else F.col("vector").cast("array<double>").alias("vector")


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """q_id, t_id, label_id, d, rank of the k nearest training rows of each query; ties by t_id.

    queries: q_id, vector. train: t_id, label_id, vector. k must not exceed the training rows.
    """
    side = train.select(F.col("t_id").cast("long").alias("t_id"), F.col("label_id").cast("int").alias("label_id"), _numbers(train))
    size = side.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if k > size["n"]:
        raise ValueError(f"k = {k} with {size['n']} training rows")
    q = queries.select(F.col("q_id").cast("long").alias("q_id"), _numbers(queries))
    blocks = -(-size["n"] * size["dim"] // BLOCK_VALUES)
    if blocks == 1:
        found = _by_broadcast(q, side, k)
    else:
        found = _by_cells(q, side, k, blocks, size["dim"])
    best = Window.partitionBy("q_id").orderBy("d", "t_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def votes(neighbours: DataFrame, k: int) -> DataFrame:
    """q_id, label_id, weight: the sum of 1/d over the k nearest, or of 1 over those at distance 0 if there are any."""
    near = neighbours.filter(F.col("rank") <= k)
    least = F.min("d").over(Window.partitionBy("q_id"))
    weight = F.when(least == 0, (F.col("d") == 0).cast("double")).otherwise(1 / F.col("d"))
    return near.withColumn("w", weight).groupBy("q_id", "label_id").agg(F.sum("w").alias("weight"))


def predict(vote: DataFrame) -> DataFrame:
    """q_id, prediction: the label of most weight, the smallest of equal ones."""
    best = F.max_by("label_id", F.struct(F.round("weight", 9), -F.col("label_id")))
    return vote.groupBy("q_id").agg(best.alias("prediction"))


def probabilities(vote: DataFrame, dictionary: DataFrame) -> DataFrame:
    """q_id, label_id, p for every label of the dictionary, 0 where no neighbour has it."""
    total = vote.groupBy("q_id").agg(F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct("label_id", "weight"))).alias("w"))
    every = total.join(broadcast_small(dictionary.select("label_id")))
    return every.select("q_id", "label_id", (F.coalesce(F.try_element_at("w", F.col("label_id")), F.lit(0.0)) / F.col("total")).alias("p"))


_SUMS = "label_id int, n long, total array<double>"


def _sums(labels: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> pa.Table:
    """A row for each label: its rows and the sum of its vectors."""
    order = np.argsort(labels, kind="stable")
    at = np.flatnonzero(np.append(True, labels[order][1:] != labels[order][:-1])) if len(order) else np.zeros(0, np.int64)
    total = np.add.reduceat(vectors[order], at, axis=0) if len(at) else vectors[:0]
    dim = total.shape[1] if len(at) else 0
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(dim)), pa.array(total.reshape(-1)))
    return pa.table({"label_id": pa.array(labels[order][at], pa.int32()), "n": pa.array(np.add.reduceat(n[order], at) if len(at) else n[:0], pa.int64()), "total": lists})


def _added(parts: list[pa.Table]) -> pa.Table:
    joined = pa.concat_tables(parts).combine_chunks()
    return _sums(joined["label_id"].to_numpy(), joined["n"].to_numpy(), _vectors(joined["total"]))


def centroids(train: DataFrame) -> DataFrame:
    """label_id and the mean vector of its rows, not normalised; also as t_id, for use as a training side.

    Each task adds up whole vectors by label before the exchange, which carries one row for each task and label (more where the sums of a task's
    labels pass BLOCK_VALUES numbers).
    """
    importable(train.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                parts.append(_sums(b.column("label_id").to_numpy(), np.ones(b.num_rows, np.int64), _vectors(b.column("vector"))))
                if sum(len(p["total"].combine_chunks().flatten()) for p in parts) > BLOCK_VALUES // 8:
                    parts = [_added(parts)]
                    if len(parts[0]["total"].combine_chunks().flatten()) > BLOCK_VALUES // 16:
                        yield from parts[0].to_batches()
                        parts = []
        if parts:
            yield from _added(parts).to_batches()

    side = train.select(F.col("label_id").cast("int").alias("label_id"), F.col("vector").cast("array<double>").alias("vector")).filter("label_id is not null and vector is not null")
    sums = side.mapInArrow(partial, _SUMS).groupBy("label_id").applyInArrow(lambda t: _added([t]), _SUMS)
    return sums.select(F.col("label_id").alias("t_id"), "label_id", F.transform("total", lambda x: x / F.col("n")).alias("vector"))
