"""Joins whose rows may share one key, and broadcasts whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows; so there are no more hot keys than this.
HOT_KEYS = 4000
#: Rows up to which broadcast_small broadcasts.
BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if a count says that it is small; for dictionaries, whose rows are a few numbers and a name."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, spread: Column, total: int) -> DataFrame:
    """rows joined with their group. groups: a row for each key, with its rows in `count`, which add up to total; read twice.

    The rows of a hot key are dealt over several salts by `spread`, and its group goes to each of them, so that
    no task gets more than about 1 / HOT_KEYS of all rows for one key. Hot keys are HOT_KEYS at most, which bounds what is broadcast.
    """
    pieces = F.ceil(F.col(count) * HOT_KEYS / F.lit(max(1, total)))
    hot = groups.filter(F.col(count) * HOT_KEYS >= total).select(*keys, pieces.cast("int").alias("__pieces"))
    salt = F.when(F.col("__pieces").isNull(), 0).otherwise(F.pmod(spread, F.col("__pieces"))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__pieces")
    spread_out = groups.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))).drop("__pieces")
    return dealt.join(spread_out, [*keys, "__salt"]).drop("__salt")
