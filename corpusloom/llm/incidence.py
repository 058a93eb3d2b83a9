"""Which features do several owners share? An exchange of hashed features in blocks.

A feature is a 64-bit hash. Each task gathers entries (feature, owner), settles those that several
owners share within the task, and sends the rest to the feature's partition: COLUMN_BYTES of the hash and, once
for a run of entries, the owner. A feature that is shared within a task goes on once, for no owner, so
one that stands in a third of all documents makes one entry a task. The answer may call a few
features shared that aren't, as their bytes are cut short; it never misses a shared one, so it serves as a filter
before an exact test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMN_BYTES = 5
#: Entries that a task gathers before it sends them.
FLUSH_ENTRIES = 1_500_000
#: Stands for "several owners" beside a feature; no owner has it.
SEVERAL = 0

SCHEMA = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("owner", pa.int64()), ("owner2", pa.int64()), ("mark", pa.int64()), ("features", pa.binary()), ("owners", pa.binary()), ("runs", pa.binary()), ("credit", pa.int64()), ("sample", pa.binary())])
SCHEMA_SQL = "bucket int, doc_id long, n long, owner long, owner2 long, mark long, features binary, owners binary, runs binary, credit long, sample binary"


def record(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in SCHEMA], schema=SCHEMA)


def shorten(features: np.ndarray) -> np.ndarray:
    return features & np.uint64((1 << 8 * COLUMN_BYTES) - 1)


def to_bytes(features: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(features.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :COLUMN_BYTES])


def from_bytes(data) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, COLUMN_BYTES)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :COLUMN_BYTES] = short
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _distinct(features: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries by feature, then owner, and whether the feature has several owners."""
    order = np.lexsort((owners, features))
    features, owners = features[order], owners[order]
    new = np.ones(len(features), bool)
    new[1:] = (features[1:] != features[:-1]) | (owners[1:] != owners[:-1])
    features, owners = features[new], owners[new]
    size = np.diff(runs_of(features))
    return features, owners, np.repeat(size > 1, size) if len(features) else np.zeros(0, bool)


def _answers(features: np.ndarray, owners: np.ndarray, named: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each owner with its shared features, or with their number."""
    order = np.argsort(owners, kind="stable")
    features, owners = features[order], owners[order]
    cuts = runs_of(owners)
    if len(cuts) < 2:
        return
    who = owners[cuts[:-1]]
    where = (who % buckets).astype(np.int32)
    if named:
        data, at = to_bytes(features), cuts.tolist()
        yield record(bucket=where, owner=who, credit=np.diff(cuts), features=[data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)])
    else:
        yield record(bucket=where, owner=who, credit=np.diff(cuts))


class Gatherer:
    """Entries of one task."""

    def __init__(self, buckets: int, named: bool):
        self.buckets, self.named = buckets, named
        self.features: list[np.ndarray] = []
        self.owners: list[int] = []
        self.total = 0

    def add(self, features: np.ndarray, owner: int) -> None:
        if len(features):
            self.features.append(features)
            self.owners.append(owner)
            self.total += len(features)

    def full(self) -> bool:
        return self.total >= FLUSH_ENTRIES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.total:
            return
        features = np.concatenate(self.features)
        owners = np.repeat(np.array(self.owners, np.int64), [len(f) for f in self.features])
        self.features, self.owners, self.total = [], [], 0
        features, owners, shared = _distinct(features, owners)
        yield from _answers(shorten(features[shared]), owners[shared], self.named, self.buckets)
        first = np.ones(len(features), bool)
        first[1:] = features[1:] != features[:-1]
        owners, features = np.where(shared, SEVERAL, owners)[first], features[first]
        where = ((features >> np.uint64(8 * COLUMN_BYTES)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.lexsort((owners, where))
        where, owners, data = where[order], owners[order], to_bytes(features[order])
        cuts = runs_of(where).tolist()
        rows: dict[str, list] = {"bucket": [], "features": [], "owners": [], "runs": []}
        for a, b in zip(cuts, cuts[1:], strict=False):
            runs = runs_of(owners[a:b])
            rows["bucket"].append(int(where[a]))
            rows["features"].append(data[a:b].tobytes())
            rows["owners"].append(owners[a:b][runs[:-1]].tobytes())
            rows["runs"].append(np.diff(runs).astype("<u4").tobytes())
        yield record(**rows)


def exchanged(entries: DataFrame, buckets: int, named: bool) -> DataFrame:
    """Rows without features as they are, and the answers of the features' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, owners = [], []
        for b in batches:
            sent = b.column("runs").is_valid()
            yield b.filter(pa.compute.invert(sent))
            for f, o, r in zip(*(b.column(c).filter(sent) for c in ("features", "owners", "runs")), strict=True):
                features.append(from_bytes(f.as_buffer()))
                owners.append(np.repeat(np.frombuffer(o.as_buffer(), np.int64), np.frombuffer(r.as_buffer(), "<u4")))
        if features:
            features, owners, shared = _distinct(np.concatenate(features), np.concatenate(owners))
            keep = shared & (owners != SEVERAL)
            yield from _answers(features[keep], owners[keep], named, buckets)

    return entries.repartition(buckets, "bucket").mapInArrow(run, SCHEMA_SQL).drop("bucket", "owners", "runs")
