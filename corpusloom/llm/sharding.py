"""Sharding by minimax contiguous partition (DataFrame functions only).

Documents stand in the order of a 64-bit fingerprint of their text. Equal texts share a
fingerprint, and its top UNIT_BITS bits name the atomic unit that is never cut, so copies stay
together. Units are at most 2**UNIT_BITS however large the table is; only their sizes reach the
driver. There the smallest feasible shard capacity is found by binary search: a capacity is
feasible if greedy filling needs no more than n_shards shards. Among the cuts within that
capacity the one with the least sum of squared shard sizes is taken, so a unit that outweighs a
shard's share makes its own shard large and the others stay near equal. The units on either side of a cut are
then taken apart by further bits of the fingerprint, down to groups of equal texts where a table is not very large, and the search is made
again with these finer units (PARTS more at most), so that cuts fall between texts and not between ranges of them.

Slots number the rows of a shard without a gap. A unit with many rows (a group of copies may hold
a third of the table, and may have no ids) is numbered in several cells, each by a window of its own, with the counts of
the cells before it added; the number of cells is bounded as well.

Cases: a null text has no bytes and weighs ROW_BYTES, as an empty one; null ids and repeated rows
are rows like others; an empty table gives no rows; extra columns are ignored. Shards are empty, at
the end, only where there are fewer units than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import stored

UNIT_BITS = 14
ROW_BYTES = 16
N_SHARDS = 40
#: Finer units, at most, into which the units beside the cuts are taken apart.
PARTS = 1 << 16
#: Rows of a unit from which it is numbered in more than one cell.
CELL_ROWS = 2000


def shards_needed(prefix: list[int], capacity: int, most: int) -> int:
    """Shards that greedy filling takes, at most `most` + 1. prefix: running totals from 0."""
    at, used, last = 0, 0, len(prefix) - 1
    while at < last and used <= most:
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        used += 1
    return used


def smallest_capacity(sizes: list[int], n_shards: int) -> int:
    """The least capacity at which the ordered sizes fit into n_shards contiguous shards."""
    prefix = [0, *accumulate(sizes)]
    low = max([-(-prefix[-1] // n_shards), *sizes, 0])
    high = low + max([0, *sizes])
    while low < high:
        middle = (low + high) // 2
        if shards_needed(prefix, middle, n_shards) <= n_shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each unit, in order: of all cuts within the least capacity, the one with the least sum of squared shard sizes.

    Where the last of k shards over the first j units begins at best never falls as j grows, so each round of halving
    looks only between the beginnings found for the neighbours, for all of its j at once.
    """
    n = len(sizes)
    shards = min(n_shards, n)  # as many as can have a unit each
    if not n:
        return []
    capacity = smallest_capacity(sizes, n_shards)
    prefix = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    first = np.searchsorted(prefix, prefix - capacity)  # the least beginning of a shard that ends at j
    reach = [0]
    for _ in range(shards):
        reach.append(int(np.searchsorted(prefix, prefix[reach[-1]] + capacity, side="right")) - 1)
    scaled = prefix / max(1.0, float(prefix[-1]) / shards)
    best, ends = np.zeros(1), []
    low_j = 0
    for k in range(1, shards + 1):
        at = np.arange(k, max(k, reach[k]) + 1)  # j that k shards can cover, each with a unit
        floor, ceiling = np.maximum(first[at], k - 1), np.minimum(at - 1, low_j + len(best) - 1)
        found, value = np.full(len(at), -1, np.int64), np.zeros(len(at))
        step = 1 << len(at).bit_length()
        while step > 1:
            step >>= 1
            j = np.arange(step - 1, len(at), 2 * step)
            if not len(j):
                continue
            left, right = j - step, j + step
            a = np.maximum(floor[j], np.where(left >= 0, found[np.maximum(left, 0)], 0))
            b = np.minimum(ceiling[j], np.where(right < len(at), found[np.minimum(right, len(at) - 1)], n))
            width = b - a + 1
            heads = np.cumsum(width) - width
            i = np.arange(int(width.sum())) - np.repeat(heads - a, width)
            cost = best[i - low_j] + (np.repeat(scaled[at[j]], width) - scaled[i]) ** 2
            least = np.minimum.reduceat(cost, heads)
            hits = np.flatnonzero(cost == np.repeat(least, width))
            of = np.searchsorted(heads, hits, side="right") - 1
            _, one = np.unique(of, return_index=True)
            found[j], value[j] = i[hits[one]], least
        ends.append((k, found))
        best, low_j = value, k
    out, end = np.zeros(n, np.int64), n
    for k, found in reversed(ends):
        begin = int(found[end - k])
        out[begin:end] = k - 1
        end = begin
    return out.tolist()


def assign(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("mark"),
        F.monotonically_increasing_id().alias("row"),  # spreads rows whatever their ids and texts
    ).withColumn("unit", F.shiftrightunsigned("mark", 64 - UNIT_BITS).cast("int"))
    rows = stored(rows, "sizes")  # some numbers for each row; texts are read once, and row numbers are settled
    count = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")]
    units = sorted(rows.groupBy("unit").agg(*count).collect())  # at most 2**UNIT_BITS rows
    coarse = cut([u["bytes"] for u in units], n_shards)
    beside = sorted({units[k]["unit"] for i in range(1, len(units)) if coarse[i] != coarse[i - 1] for k in (i - 1, i)})
    bits = max(0, (PARTS // max(1, len(beside))).bit_length() - 1)
    fine = F.shiftrightunsigned(F.shiftleft("mark", UNIT_BITS), 64 - bits) if bits else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("unit").isin(beside), fine).otherwise(0).cast("int"))
    parts = rows.filter(F.col("unit").isin(beside)).groupBy("unit", "part").agg(*count).collect()  # at most PARTS rows
    whole = [(u["unit"], 0, u["bytes"], u["n"]) for u in units if u["unit"] not in set(beside)]
    atoms = sorted([*whole, *map(tuple, parts)])
    shard_of = dict(zip(((unit, part) for unit, part, _, _ in atoms), cut([size for _, _, size, _ in atoms], n_shards), strict=True))
    total = sum(n for *_, n in atoms)
    per_cell = max(CELL_ROWS, -(-total // (1 << UNIT_BITS)))  # so that cells are at most twice as many as units
    cells_of = {(unit, part): -(-n // per_cell) for unit, part, _, n in atoms}
    plan = "unit int, part int, shard int, cells int"
    placed = rows.join(F.broadcast(spark.createDataFrame([(*atom, shard_of[atom], n) for atom, n in cells_of.items()], plan)), ["unit", "part"])
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")).cast("int"))
    counts = {(unit, part, 0): n for unit, part, _, n in atoms if cells_of[unit, part] == 1}
    if len(counts) < len(atoms):  # cells of units with many rows: at most 2**UNIT_BITS of them
        counted = placed.filter("cells > 1").groupBy("unit", "part", "cell").count().collect()
        counts |= {(r["unit"], r["part"], r["cell"]): r["count"] for r in counted}
    base, before = [], [0] * (n_shards + 1)
    for unit, part, cell in sorted(counts):
        shard = shard_of[unit, part]
        base.append((unit, part, cell, before[shard]))
        before[shard] += counts[unit, part, cell]
    placed = placed.join(F.broadcast(spark.createDataFrame(base, "unit int, part int, cell int, base long")), ["unit", "part", "cell"])
    order = Window.partitionBy("unit", "part", "cell").orderBy("mark", "doc_id", "text_crc32", "size")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.row_number().over(order) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
