"""Capped, stratified and balanced samples."""

from __future__ import annotations

import hashlib
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import patterns as P
from corpusloom.operators.skew import broadcast_small
from corpusloom.workers import importable

#: Hexadecimal digits of a key by which groups are cut in buckets (16 to that power).
DIGITS = 3


def draw_key(*parts: Column, seed: int) -> Column:
    """A reproducible pseudo-random order, equal on every engine that has MD5."""
    return F.md5(F.concat_ws("-", *(p.cast("string") for p in parts), F.lit(str(seed))))


def goal_sample(data: DataFrame, count: int, order: list[str], priority: list[str] | None = None) -> DataFrame:
    """Up to `count` rows of each goal, from sections in order of priority.

    A section has each priority whose words it holds, so a row may be drawn twice; target sections have none.
    """
    words = P.SECTION_PRIORITY if priority is None else priority
    section = F.lower("section")
    found = F.filter(F.array(*(F.when(section.contains(w), i) for i, w in enumerate(words))), lambda x: x.isNotNull())
    rows = data.withColumn("prio", F.explode(found)).filter(~section.contains("target"))
    best = Window.partitionBy("goal").orderBy("prio", *order)
    return rows.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= count).drop("rn", "prio")


def target_sample(data: DataFrame, count: int, order: list[str]) -> DataFrame:
    """The first `count` rows of each target, from target sections."""
    rows = data.filter(F.lower("section").contains("target"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy(*order))).filter(F.col("rn") <= count).drop("rn")


def training_sample(data: DataFrame, goal_count: int, target_count: int, order: list[str]) -> DataFrame:
    """Both samples, without repeated rows."""
    parts = []
    if goal_count > 0:
        parts.append(goal_sample(data, goal_count, order))
    if target_count > 0:
        parts.append(target_sample(data, target_count, order))
    if not parts:
        return data.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def stratified_split(data: DataFrame, strata: list[str], seed: int = 42, share: float = 0.25, row_id: str = "id") -> DataFrame:
    """data with a boolean `validation`: in each goal the ceiling of `share` of its rows, spread over strata.

    strata: columns from fine to coarse; a goal uses the first whose every value has two rows and that has no
    more values than either side has rows, or else the goal as a whole. Shares are rounded down and what is left goes
    to the largest remainders. A goal with a single row can't be split, which is an error.
    """
    goal, size = Window.partitionBy("goal"), F.col("size")
    cells = data.groupBy("goal", *strata).agg(F.count(F.lit(1)).alias("size"))  # all that is decided for a goal follows from these counts
    cells = cells.withColumn("n", F.sum(size).over(goal)).withColumn("n_val", F.ceil(F.col("n") * share).cast("int"))
    cells = cells.withColumn("n", F.when(F.col("n") < 2, F.raise_error(F.concat(F.lit("One row only: goal "), F.col("goal"))).cast("long")).otherwise(F.col("n")))
    level = F.lit("all")
    for c in reversed(strata):
        cells = cells.withColumn(f"size_{c}", F.sum(size).over(Window.partitionBy("goal", c)))
        least = F.min(f"size_{c}").over(goal)
        values = F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(""))).over(goal))
        fits = (least >= 2) & (values <= F.col("n_val")) & (values <= F.col("n") - F.col("n_val"))
        level = F.when(fits, F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("")))).otherwise(level)
    cells = cells.withColumn("stratum", level)
    sizes = cells.groupBy("goal", "stratum").agg(F.sum(size).alias("size"), F.first("n").alias("n"), F.first("n_val").alias("n_val"))
    exact = F.col("size") * F.col("n_val") / F.col("n")
    sizes = sizes.withColumn("floor", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    by_rest = Window.partitionBy("goal").orderBy(F.desc("rest"), "stratum")
    missing = F.col("n_val") - F.sum("floor").over(Window.partitionBy("goal"))
    quota = sizes.withColumn("quota", F.col("floor") + (F.row_number().over(by_rest) <= missing).cast("long")).select("goal", "stratum", "quota")
    named = cells.join(quota, ["goal", "stratum"]).select("stratum", "quota", *(F.col(c).alias(f"__{c}") for c in ["goal", *strata]))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ["goal", *strata]]
    keyed = data.join(broadcast_small(named), same).withColumn("__key", draw_key(F.col(row_id), seed=seed))
    return first_of(keyed, ["goal", "stratum"], "__key", [row_id], "quota", "validation").select(*data.columns, "validation")


def first_of(rows: DataFrame, group: list[str], key: str, ties: list[str], count: str, name: str) -> DataFrame:
    """rows with a boolean `name`: whether a row is one of the first `count` of its group by key (of hexadecimal digits), then ties.

    A selection, not a sort: a histogram of the keys' first digits tells for each group which of its BUCKETS buckets are in, which are out, and
    the one that the cut goes through. Only that bucket's rows are ordered, so no group comes together in one task.
    """
    bucket = F.substring(key, 1, DIGITS)
    rows = rows.withColumn("__bucket", bucket)
    cells = rows.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.first(count).alias("__count"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket")) - F.col("__n")  # over BUCKETS rows of a group at most
    cells = cells.withColumn("__before", before).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate([*group, "__bucket"])), F.greatest(F.lit(0), F.col("__count") - F.col("__before")).alias("__left"), "__n")
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate([*group, "__bucket"])]
    held = rows.join(cells, same)
    whole = held.filter("__left = 0 or __left >= __n").withColumn(name, F.col("__left") > 0)
    within = Window.partitionBy(*group, "__bucket").orderBy(key, *ties)
    cut = held.filter("__left > 0 and __left < __n").withColumn(name, F.row_number().over(within) <= F.col("__left"))
    return whole.unionByName(cut).select(*(c for c in rows.columns if c != "__bucket"), name)


def _least_draws(rows: DataFrame, turns: range, seed: int, most: int) -> DataFrame:
    """iteration, label and id of the `most` least draws of each iteration and label in each task. rows: label and id, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, str | None], list[tuple[str, str]]] = {}
        for b in batches:
            for label, row in zip(b.column("label").to_pylist(), b.column("id").to_pylist(), strict=True):
                for i in turns:
                    key = hashlib.md5(f"{row}-{i}-{seed}".encode()).hexdigest()
                    least = kept.setdefault((i, label), [])
                    if len(least) < most or (key, row) < least[-1]:
                        insort(least, (key, row))
                        del least[most:]
        found = [(i, label, row) for (i, label), least in kept.items() for _, row in least]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.int32(), pa.string(), pa.string()), strict=True)], names=["iteration", "label", "id"])

    importable(rows.sparkSession)
    return rows.mapInArrow(run, "iteration int, label string, id string")


def balanced_batches(data: DataFrame, iterations: int, start: int = 0, end: int | None = None, seed: int = 2355764148, many: int = 4, few: int = 3, n_many: int = 13, label: str = "label", row_id: str = "id", order: str = "pos") -> DataFrame:
    """Rows of each iteration's batch: n_many classes give `many` rows, the others `few`, or what they have.

    A draw depends only on row, iteration and seed, so skipping or resuming iterations changes nothing. Each task keeps the least draws of
    every iteration and class, so what is exchanged is bounded by iterations x classes x `many` for each task, and holds no row but its id.
    """
    last = iterations if end is None else min(iterations, end)
    turns = range(start, max(start, last))
    keys = data.select(F.col(label).cast("string").alias("label"), F.col(row_id).cast("string").alias("id"))
    classes = keys.select("label").distinct().select("label", F.explode(F.array(*map(F.lit, turns)).cast("array<int>")).alias("iteration"))  # as many rows as iterations
    rank = F.row_number().over(Window.partitionBy("iteration").orderBy(draw_key(F.col("label"), F.col("iteration"), seed=seed), "label"))
    quotas = classes.withColumn("quota", F.when(rank <= n_many, many).otherwise(few)).select(F.col("label").alias("__label"), F.col("iteration").alias("__iteration"), "quota")
    least = _least_draws(keys, turns, seed, max(many, few))
    drawn = F.row_number().over(Window.partitionBy("iteration", "label").orderBy(draw_key(F.col("id"), F.col("iteration"), seed=seed), "id"))
    ranked = least.join(quotas, F.col("label").eqNullSafe(F.col("__label")) & (F.col("iteration") == F.col("__iteration"))).withColumn("rn", drawn).filter(F.col("rn") <= F.col("quota"))
    chosen = ranked.select("iteration", F.col("id").alias("__id"))
    rows = data.join(broadcast_small(chosen), data[row_id].cast("string") == F.col("__id"))
    return rows.select(*data.columns, "iteration").orderBy("iteration", order)
