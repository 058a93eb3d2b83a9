"""Hard-negative mining: a two-dimensional block matrix multiply of anchors and rows.

Anchors times rows is a matrix of scores that no task holds whole. Both sides are dealt in blocks of rows, each block is
cut in chunks of dimensions (SUMMA), and a task multiplies one chunk of an anchor block with the same chunk of a row block. Vectors of up to
MOST_WIDE dimensions are one chunk, whose tile of integer scores is whole and stays in its task; longer ones send their partial tiles to the
tile's place, where the tiles of all chunks are added. Of a whole tile only the few rows that an anchor can use leave the task:

1. Blocks hold rows of one label group (labels dealt by hash over at most GROUPS groups), so tiles within a group give the
   positives of each anchor: the best POSITIVES rows of its label, by tile and then over all tiles.
2. The other tiles, and those of groups with several labels, give the negatives: for each anchor and positive the best
   NEGATIVES rows of another label in the window LEAST to MOST hundredths of the positive's score, by tile and then over all.

A label that holds a third of all rows has a third of the blocks; no block, tile or task grows with a label. Blocks, and not scores, are what the shuffle carries where
vectors are one chunk: each block once for each block of the other side. The work is what the definition asks for: every anchor meets every row.

Cases: a row takes no part with a null vec_id or label, a null vector, or a null or non-finite component; vectors of different lengths count as
filled up with zeros, and an empty one scores 0; floor(256 x) is held to +-2^22 (|x| up to 16384), so that sums and the comparisons stay exact; rows that repeat a
vec_id are one row, the least by label, then vector; equal scores are ordered by vec_id; an anchor without another row of its label, or a positive without a row in its
window, gives no rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import discard, small_batches, stored

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Scale of a component before it is cut to an integer, and the most that the integer may be.
SCALE, LIMIT = 256, 1 << 22
#: Label groups at most; rows and anchors of a block, about.
GROUPS, ROW_BLOCK, ANCHOR_BLOCK = 256, 2048, 1024
#: Rows for each label group, about, of a small table.
GROUP_ROWS = 512
#: Dimensions of a chunk: at most MOST_WIDE, so that LIMIT^2 times that is exact in a double, and else a vector or LEAST_WIDE.
LEAST_WIDE, MOST_WIDE = 32, 512

_TILE = "a int, b int, first boolean, anchors binary, rows binary, anchor_labels binary, row_labels binary, windows binary, wide boolean, scores binary"


def prepared(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and q (integer components) of the rows that take part, one for each vec_id."""
    x = F.col(vector).cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    whole = whole.filter("vec_id is not null and label is not null and x is not null")
    whole = whole.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    bounded = F.transform("x", lambda v: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), v * SCALE))).cast("double"))).cast("int"))
    return whole.select("vec_id", "label", bounded.alias("q"))


def _single(rows: DataFrame) -> DataFrame:
    """rows with one row for each vec_id; where none repeats, which only ids are moved to find out, rows are as they are."""
    several = stored(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("vec_id"), "repeated")
    if several.isEmpty():
        discard(several)
        return rows
    least = rows.join(several, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("one"))
    return rows.join(several, "vec_id", "left_anti").unionByName(least.select("vec_id", "one.label", "one.q"))


def _packed(rows: DataFrame, block: str, wide: int) -> DataFrame:
    """A row for each block and chunk: ids, labels and the components of its rows that reach the chunk, rows by id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        parts = table["part"].combine_chunks()
        many = np.diff(parts.offsets.to_numpy())
        values = np.zeros((table.num_rows, wide), np.int32)
        values[np.arange(wide) < many[:, None]] = parts.flatten().to_numpy()
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        return pa.table({"grp": table["grp"][:1], block: table[block][:1], "chunk": table["chunk"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()), "data": pa.array([values.tobytes()], pa.binary())})

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("q"), F.lit(1)) - 1) / wide).cast("int")), lambda c: F.struct(c.alias("chunk"), F.slice("q", c * wide + 1, wide).alias("part")))
    cut = rows.select("vec_id", "label", "grp", block, F.explode(chunks).alias("c")).select("vec_id", "label", "grp", block, "c.chunk", "c.part")
    return cut.groupBy(block, "chunk").applyInArrow(run, f"grp int, {block} int, chunk int, ids binary, labels binary, data binary")


def _meeting(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each copy of a block with its partner. Neither side is broadcast: copies are many times the stored blocks, by whose files Spark would tell their size."""
    return rows.hint("merge").join(anchors.hint("merge"), ["a", "b", "chunk"])


def _products(rows: DataFrame, anchors: DataFrame, wide: int, found: Callable[[pa.Table], pa.Table] | None = None, schema: str = _TILE) -> DataFrame:
    """Partial tiles of scores, one for each pair of blocks and chunk. Labels and windows go with the first chunk alone. found: what leaves the task in a tile's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in partial(batches):
            yield from [tile] if found is None else found(pa.Table.from_batches([tile])).to_batches()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {n: batch.column(n)[r] for n in batch.schema.names}
                x, y = (np.frombuffer(cell[n].as_buffer(), np.int32).reshape(-1, wide).astype(np.float64) for n in ("anchor_data", "data"))
                scores = (x @ y.T).astype(np.int64)  # exact, as no sum passes 2^53
                long = bool(scores.size) and int(np.abs(scores).max()) >= 1 << 31
                first = cell["chunk"].as_py() == 0
                some = lambda n: cell[n].as_py() if first else None  # noqa: B023, E731
                yield pa.record_batch([
                    pa.array([cell["a"].as_py()], pa.int32()), pa.array([cell["b"].as_py()], pa.int32()), pa.array([first]),
                    *(pa.array([v], pa.binary()) for v in (cell["anchor_ids"].as_py(), cell["ids"].as_py(), some("anchor_labels"), some("labels"), some("windows"))),
                    pa.array([long]), pa.array([(scores if long else scores.astype(np.int32)).tobytes()], pa.binary()),
                ], names=["a", "b", "first", "anchors", "rows", "anchor_labels", "row_labels", "windows", "wide", "scores"])

    return _meeting(rows, anchors).mapInArrow(run, schema)


def _added(tiles: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The sum of a tile's partial tiles, whether a cell's labels agree, and the ids and windows of the first."""
    parts = sorted(tiles.to_pylist(), key=lambda p: not p["first"])
    head = {n: np.frombuffer(parts[0][n] or b"", np.int64) for n in ("anchors", "rows", "anchor_labels", "row_labels", "windows")}
    total = np.zeros((len(head["anchors"]), len(head["rows"])), np.int64)
    for p in parts:
        a, b = np.frombuffer(p["anchors"], np.int64), np.frombuffer(p["rows"], np.int64)
        scores = np.frombuffer(p["scores"], np.int64 if p["wide"] else np.int32).reshape(len(a), len(b))
        if len(a) == total.shape[0] and len(b) == total.shape[1]:
            total += scores
        else:  # vectors that end before this chunk have no part in it
            total[np.ix_(np.searchsorted(head["anchors"], a), np.searchsorted(head["rows"], b))] += scores
    return total, head["anchor_labels"][:, None] == head["row_labels"][None, :], head


def best_positives(tiles: pa.Table, many: int) -> pa.Table:
    """anchor_id, vec_id, score: of each anchor the first rows of its label in one tile, but itself."""
    total, same, head = _added(tiles)
    same &= head["anchors"][:, None] != head["rows"][None, :]
    a, b = np.nonzero(same)
    score = total[a, b]
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < many
    return pa.table({"anchor_id": pa.array(head["anchors"][a[kept]], pa.int64()), "vec_id": pa.array(head["rows"][b[kept]], pa.int64()), "score": pa.array(score[kept], pa.int64())})


def best_negatives(tiles: pa.Table, many: int, least: int, most: int) -> pa.Table:
    """For each anchor and positive of one tile the first rows of other labels whose score lies in the window."""
    total, same, head = _added(tiles)
    windows = head["windows"].reshape(-1, 3)  # anchor, positive, score
    out: list[list[np.ndarray]] = [[], [], [], []]
    at = np.searchsorted(head["anchors"], windows[:, 0])
    for a in np.unique(at):
        other = np.flatnonzero(~same[a])
        if not len(other):
            continue
        score = total[a, other]
        order = np.argsort(-score, kind="stable")  # rows are by id
        other, falling = other[order], -score[order]
        mine = windows[at == a]
        upper, lower = mine[:, 2] * most // 100, -(-mine[:, 2] * least // 100)
        begin = np.searchsorted(falling, -upper, side="left")
        end = np.minimum(np.searchsorted(falling, -lower, side="right"), begin + many)
        for w, x, y in zip(mine, begin.tolist(), end.tolist(), strict=True):
            if x < y:
                for column, values in zip(out, (np.full(y - x, w[1]), np.full(y - x, w[2]), head["rows"][other[x:y]], -falling[x:y]), strict=True):
                    column.append(values)
                out[0][-1] = np.stack([np.full(y - x, w[0]), out[0][-1]])
    pairs = np.concatenate(out[0], axis=1) if out[0] else np.zeros((2, 0), np.int64)
    rest = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out[1:]]
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), (*pairs, *rest), strict=True)})


def _groups(rows: DataFrame, is_anchor: Column) -> list[dict]:
    """Of each label group (GROUPS at most): its blocks of rows (b0, kb), its blocks of anchors (a0, ka) and whether it has several labels."""
    found = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum(is_anchor.cast("long")).alias("anchors"), F.min("label").alias("x"), F.max("label").alias("y")).orderBy("grp").collect()
    out, b0, a0 = [], 0, 0
    for r in found:
        kb, ka = -(-r["m"] // ROW_BLOCK), -(-r["anchors"] // ANCHOR_BLOCK)
        out.append({"grp": r["grp"], "b0": b0, "kb": kb, "a0": a0, "ka": ka, "mixed": r["x"] != r["y"]})
        b0, a0 = b0 + kb, a0 + ka
    return out


def _of_group(groups: list[dict], start: str, count: str) -> tuple[Column, Column]:
    """First block and number of blocks of a row's group."""
    pick = lambda n: F.element_at(F.create_map(*(F.lit(v) for g in groups for v in (g["grp"], g[n]))), F.col("grp"))
    return pick(start), pick(count)


def _copies(blocks: DataFrame, groups: list[dict], start: str, count: str, name: str, meets: Callable[[Column, Column], Column]) -> DataFrame:
    """A copy of each packed block for each block of the other side, in the groups that it meets."""
    others = [F.struct(*(F.lit(g[n]).alias(n) for n in ("grp", "mixed", start, count))) for g in groups if g[count]]
    met = F.explode(F.filter(F.array(*others), lambda o: meets(o["grp"], o["mixed"]))).alias("o")
    return blocks.select("*", met).select(*blocks.columns, F.explode(F.sequence(F.col(f"o.{start}"), F.col(f"o.{start}") + F.col(f"o.{count}") - 1)).alias(name))


def mine(vectors: DataFrame, is_anchor: Column, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label and the vector. is_anchor: a condition on vec_id and label.
    """
    small_batches(vectors.sparkSession)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = _single(prepared(vectors, vector))
    size, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not size:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    wide = min(MOST_WIDE, max(LEAST_WIDE, longest))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(min(GROUPS, -(-size // min(GROUP_ROWS, ROW_BLOCK))))).cast("int"))
    groups = _groups(rows, is_anchor)
    if not any(g["ka"] for g in groups):
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dealt = lambda start, count: (start + F.pmod(F.xxhash64("vec_id"), count)).cast("int")
    row_blocks = stored(_packed(rows.withColumn("b", dealt(*_of_group(groups, "b0", "kb"))), "b", wide), "rows")
    anchor_blocks = _packed(rows.filter(is_anchor).withColumn("a", dealt(*_of_group(groups, "a0", "ka"))), "a", wide)
    anchor_blocks = stored(anchor_blocks.select("grp", "a", "chunk", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("data").alias("anchor_data")), "anchors")

    def tiles(anchors: DataFrame, meets: Callable[[Column, Column], Column], best: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        ours, theirs = _copies(row_blocks, groups, "a0", "ka", "a", meets).drop("grp"), _copies(anchors, groups, "b0", "kb", "b", meets).drop("grp")
        if longest <= wide:
            return _products(ours, theirs, wide, best, schema)
        return _products(ours, theirs, wide).groupBy("a", "b").applyInArrow(best, schema)

    found = tiles(anchor_blocks.withColumn("windows", F.lit(None).cast("binary")), lambda g, mixed: g == F.col("grp"), lambda t: best_positives(t, positives), "anchor_id long, vec_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives)
    best = stored(best.join(rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), dealt(*_of_group(groups, "a0", "ka")).alias("a")), "anchor_id").select("a", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def packed(table: pa.Table) -> pa.Table:
        flat = np.stack([table[n].to_numpy() for n in ("anchor_id", "positive_id", "positive_score")], 1).astype(np.int64)
        return pa.table({"a": table["a"][:1], "windows": pa.array([flat.tobytes()], pa.binary())})

    windows = best.groupBy("a").applyInArrow(packed, "a int, windows binary")
    found = tiles(anchor_blocks.join(windows, "a"), lambda g, mixed: (g != F.col("grp")) | mixed, lambda t: best_negatives(t, negatives, least, most), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives).select(*names)
