"""Removal of repeated passages by a distributed merge sort of suffixes.

Every place where LENGTH bytes equal LENGTH bytes of a document with a smaller doc_id is found, exactly, from
sorted suffixes and the common prefixes of neighbours:

1. Anchors. Of the GRAM-byte strings inside any LENGTH bytes, those with the least hash are anchors, so equal
   strings have equal anchors at equal places. Only anchors that two different texts share can matter;
   an exchange of hashes (see incidence) finds these. This cuts the suffixes to sort, as prefix
   doubling does by its test for unique prefixes.
2. Runs. Each task sorts the suffixes at its shared anchors, LENGTH bytes long and with the bytes before the
   anchor beside them. Of equal suffixes with equal bytes before, those of larger documents are settled at
   once and the least document's goes on. Runs are cut at splitters and sent front-coded: the
   length of the prefix shared with the suffix before, and the rest.
3. Merge. Each range merges its runs by a loser tree whose nodes know how long a prefix each suffix
   shares with the last winner, and compare only from there on. Order and common prefixes say
   which suffixes agree in any number of bytes; with the bytes before the anchor ordered alike, each
   string over the anchor has its class, and a class its least document.
4. Hot anchors. An anchor lies whole in one range, so one that stands in a great part of a sample of texts would make that range
   too large. What its runs leave unsettled is dealt by the LENGTH-byte strings over the anchor instead (by 128 bits of
   their hashes): a task keeps the least document of each string and settles the others, so that a string comes to its range but once from each.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; a copy of a whole text loses all; a row
with a null doc_id loses nothing and is no source; rows that repeat id and text are one document
and get the same result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.bpe import _within
from corpusloom.llm.incidence import SCHEMA_SQL, Gatherer, exchanged, from_bytes, record, shorten
from corpusloom.llm.shared import discard, mix, partitions_for, release, salted_join, slices, small_batches, span_hash_pairs, stored, text_buffers

LENGTH = 50
GRAM = 20
#: Anchors in any LENGTH bytes lie in this many places.
PLACES = LENGTH - GRAM + 1
BEFORE = LENGTH - GRAM
#: Suffixes that a task sorts into one run.
RUN_SUFFIXES = 150_000
#: Anchor strings from which splitters are taken, about: so many, or so many for each range.
SAMPLE = 4_000
SAMPLE_PER_RANGE = 5
#: Texts (about) whose shared anchors are counted, and the number of these texts that makes an anchor hot.
HOT_SAMPLE = 20_000
HOT_TEXTS = 400

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each `width` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the rows of a slice."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    words = np.ndarray((n - 7,), "<u8", raw.data, 0, (1,))
    m = n - GRAM + 1
    h = mix((words[:m] * _C[0]) ^ (words[8 : 8 + m] * _C[1] + words[GRAM - 8 : GRAM - 8 + m] * _C[2]))
    least = _sliding(h, PLACES, np.minimum)
    outside = np.zeros(n + 1, np.int32)  # strings that begin here leave their row
    ends = offsets[1:]
    np.add.at(outside, np.maximum(ends - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(outside, ends, -1)
    least[np.cumsum(outside)[: len(least)] > 0] = 0
    padded = np.zeros(len(least) + 2 * BEFORE, np.uint64)
    padded[BEFORE : BEFORE + len(least)] = least
    most = _sliding(padded, PLACES, np.maximum)  # of the strings that hold a place
    at = np.flatnonzero((h == most[:m]) & (h > 0))
    return at, h[at]


def _first_pass(texts: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gatherer(buckets, True)
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            owners = b.column("owner").to_numpy()
            samples: list[bytes | None] = []
            for x, y in slices(offsets):
                piece, offs = raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                at, h = anchors(piece, offs)
                cuts = np.searchsorted(at, offs).tolist()
                for k, (u, v) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if v > u:
                        found = np.unique(h[u:v])
                        got.add(found, int(owners[x + k]))
                        one = at[u + int(found[0] % np.uint64(v - u))]
                        samples.append(piece[one : one + GRAM].tobytes())
                    else:
                        samples.append(None)
                if got.full():
                    yield from got.flush()
            yield record(bucket=np.arange(len(owners), dtype=np.int32) % buckets, doc_id=b.column("doc_id"), n=np.diff(offsets), owner=owners, owner2=b.column("owner2"), sample=samples)
        yield from got.flush()

    return texts.mapInArrow(run, SCHEMA_SQL)


# ---------------------------------------------------------------- runs


def _windows(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, back: bool) -> np.ndarray:
    """A row of `width` bytes for each start: forward from it, or backward from the byte before; 0 beyond its size."""
    step = np.arange(width)
    index = starts[:, None] - 1 - step if back else starts[:, None] + step
    out = raw[np.clip(index, 0, len(raw) - 1)]
    out[step >= sizes[:, None]] = 0
    return out


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian words, the first most significant."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(1), rows.shape[1], np.argmin(same, axis=1))
        out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def _all_places(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the places l at which LENGTH bytes from l before the anchor lie inside the text."""
    low = np.maximum(LENGTH - right, 0)
    high = np.minimum(left, BEFORE)
    bits = (np.int64(1) << (high + 1)) - (np.int64(1) << low)
    return np.where(high >= low, bits, 0)


_RUN = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("owner", pa.int64()), ("places", pa.binary()), ("bits", pa.binary()), ("common", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("before", pa.binary()), ("before_sizes", pa.binary()), ("docs", pa.binary()), ("owners", pa.binary()), ("at", pa.binary()), ("hot", pa.binary())])
_RUN_SQL = "range int, doc_id long, owner long, places binary, bits binary, common binary, sizes binary, rest binary, before binary, before_sizes binary, docs binary, owners binary, at binary, hot binary"


def _run_rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _RUN], schema=_RUN)


def _settled(doc: np.ndarray, owner: np.ndarray, at: np.ndarray, bits: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Found places by document."""
    has = bits != 0
    doc, owner, at, bits = doc[has], owner[has], at[has], bits[has]
    if not len(doc):
        return
    order = np.lexsort((owner, doc))
    doc, owner, at, bits = doc[order], owner[order], at[order], bits[order]
    cuts = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])) + 1, [len(doc)]]).tolist()
    spans = list(zip(cuts, cuts[1:], strict=False))
    first = np.array(cuts[:-1])
    yield _run_rows(range=(owner[first] % ranges).astype(np.int32), doc_id=doc[first], owner=owner[first], places=[at[a:b].astype("<i4").tobytes() for a, b in spans], bits=[bits[a:b].astype("<i4").tobytes() for a, b in spans])


def _packed(data: np.ndarray) -> bytes:
    return pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


_HOT = np.dtype([("doc", "<i8"), ("owner", "<i8"), ("one", "<u8"), ("two", "<u8"), ("at", "<i4"), ("before", "<i4")])


def _repeated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows (of _HOT) in the order of their strings, and which of them repeat a string of a smaller document."""
    rows = rows[np.lexsort((rows["doc"], rows["two"], rows["one"]))]
    new = np.append(True, (rows["one"][1:] != rows["one"][:-1]) | (rows["two"][1:] != rows["two"][:-1]))
    return rows, rows["doc"] > rows["doc"][np.flatnonzero(new)[np.cumsum(new) - 1]]


def _settled_strings(rows: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    yield from _settled(rows["doc"], rows["owner"], rows["at"].astype(np.int64), np.int64(1) << rows["before"].astype(np.int64), ranges)


def _dealt(parts: tuple[np.ndarray, ...], ranges: int) -> Iterator[pa.RecordBatch]:
    """The strings over hot anchors (the anchor's place, the bytes before it and the string's hashes), in blocks dealt by hash.

    Of equal strings of several documents those of larger ones are settled at once and the least document's goes on.
    """
    right, sizes, left, left_sizes, doc, owner, at = parts
    wide = np.concatenate([left[:, ::-1], right], axis=1)
    row, before = np.nonzero((_all_places(left_sizes, sizes)[:, None] >> np.arange(BEFORE + 1)) & 1)
    if not len(row):
        return
    starts = row * wide.shape[1] + BEFORE - before
    rows = np.empty(len(row), _HOT)
    rows["one"], rows["two"] = span_hash_pairs(np.ascontiguousarray(wide).reshape(-1), starts, starts + LENGTH)
    rows["doc"], rows["owner"], rows["at"], rows["before"] = doc[row], owner[row], at[row], before
    rows, larger = _repeated(rows)
    yield from _settled_strings(rows[larger], ranges)
    rows = rows[~larger]
    where = (rows["one"] % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(rows)]
    yield _run_rows(range=where[cuts[:-1]], hot=[rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])


def _sorted_run(parts: list[tuple], splitters: np.ndarray, ranges: int, hot: bool = False) -> Iterator[pa.RecordBatch]:
    right, sizes, left, left_sizes, doc, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc, left_sizes, *_keys(left)[::-1], sizes, *_keys(right)[::-1]))
    right, sizes, left, left_sizes, doc, owner, at = (x[order] for x in (right, sizes, left, left_sizes, doc, owner, at))
    new = np.ones(len(doc), bool)
    new[1:] = (right[1:] != right[:-1]).any(1) | (sizes[1:] != sizes[:-1]) | (left[1:] != left[:-1]).any(1) | (left_sizes[1:] != left_sizes[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    larger = doc > doc[head]  # a smaller document of this task has the same bytes on both sides
    yield from _settled(doc[larger], owner[larger], at[larger], _all_places(left_sizes, sizes)[larger], ranges)
    keep = ~larger
    right, sizes, left, left_sizes, doc, owner, at = (x[keep] for x in (right, sizes, left, left_sizes, doc, owner, at))
    if hot:
        yield from _dealt((right, sizes, left, left_sizes, doc, owner, at), ranges)
        return
    prefix = np.ascontiguousarray(right[:, :GRAM]).view(f"S{GRAM}").reshape(-1)
    where = np.searchsorted(splitters, prefix, side="right")
    rows: dict[str, list] = {k: [] for k in ("range", "common", "sizes", "rest", "before", "before_sizes", "docs", "owners", "at")}
    cuts = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b == a:
            continue
        common = _common(right[a:b], sizes[a:b])
        step = np.arange(LENGTH)
        rows["range"].append(int(where[a]))
        rows["common"].append(common.astype(np.uint8).tobytes())
        rows["sizes"].append(sizes[a:b].astype(np.uint8).tobytes())
        rows["rest"].append(_packed(right[a:b][(step >= common[:, None]) & (step < sizes[a:b, None])]))
        rows["before"].append(_packed(left[a:b][np.arange(BEFORE) < left_sizes[a:b, None]]))
        rows["before_sizes"].append(left_sizes[a:b].astype(np.uint8).tobytes())
        rows["docs"].append(doc[a:b].astype("<i8").tobytes())
        rows["owners"].append(owner[a:b].astype("<i8").tobytes())
        rows["at"].append(at[a:b].astype("<i4").tobytes())
    if rows["range"]:
        yield _run_rows(**rows)


def _runs(texts: DataFrame, splitters: np.ndarray, ranges: int, hot: np.ndarray) -> DataFrame:
    """texts: doc_id, owner, text, shared (list of the shared anchors' hashes); hot: sorted hashes of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        total = {False: 0, True: 0}
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            docs, owners, shared = b.column("doc_id").to_numpy(), b.column("owner").to_numpy(), b.column("shared")
            for x, y in slices(offsets):
                piece, offs = raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                at, h = anchors(piece, offs)
                h = shorten(h)
                cuts = np.searchsorted(at, offs).tolist()
                keep = np.zeros(len(at), bool)
                for k, (u, v) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lists = shared[x + k]
                    keep[u:v] = np.isin(h[u:v], np.concatenate([from_bytes(s.as_buffer()) for s in lists.values]))
                at = at[keep]
                row = np.searchsorted(offs, at, side="right") - 1
                is_hot = np.isin(h[keep], hot)
                for kind in (False, True):
                    mine = np.flatnonzero(is_hot == kind)
                    for u in range(0, len(mine), 20_000):
                        p, r = at[mine[u : u + 20_000]], row[mine[u : u + 20_000]]
                        sizes, before = np.minimum(offs[r + 1] - p, LENGTH), np.minimum(p - offs[r], BEFORE)
                        held[kind].append((_windows(piece, p, sizes, LENGTH, False), sizes, _windows(piece, p, before, BEFORE, True), before, docs[x + r], owners[x + r], p - offs[r]))
                        total[kind] += len(p)
                        if total[kind] >= RUN_SUFFIXES:
                            yield from _sorted_run(held[kind], splitters, ranges, kind)
                            held[kind], total[kind] = [], 0
        for kind, parts in held.items():
            if parts:
                yield from _sorted_run(parts, splitters, ranges, kind)

    return texts.mapInArrow(run, _RUN_SQL)


# ---------------------------------------------------------------- merge


class Run:
    """A front-coded sorted run, decoded one suffix at a time."""

    __slots__ = ("base", "common", "i", "n", "rest", "sizes", "at")

    def __init__(self, base: int, common: bytes, sizes: bytes, rest: bytes):
        self.base, self.common, self.sizes, self.rest = base, common, sizes, rest
        self.i, self.n, self.at = -1, len(common), 0

    def after(self, last: bytes) -> bytes | None:
        """The next suffix; last is the one before it."""
        self.i += 1
        if self.i >= self.n:
            return None
        c = self.common[self.i]
        start, self.at = self.at, self.at + self.sizes[self.i] - c
        return last[:c] + self.rest[start : self.at]


def merge(runs: list[Run]) -> tuple[list[int], list[int]]:
    """Numbers of all suffixes in sorted order, and the common prefix of each with the one before.

    A loser tree. Each run's current suffix carries the length of its common prefix with the last winner.
    Of two suffixes the one that shares more with the last winner is the smaller; only where both share as
    much, bytes are compared, from there on, and the loser keeps what it shares with the winner.
    """
    k = len(runs)
    current: list[bytes | None] = [r.after(b"") for r in runs]
    known = [0] * k
    tree = [-1] * k
    order: list[int] = []
    shared: list[int] = []

    def play(a: int, node: int) -> int:
        """a moves up from the node; the winner."""
        while node:
            b = tree[node]
            if b < 0:  # while the tree fills, the first to come waits
                tree[node] = a
                return -1
            x, y = current[a], current[b]
            if x is None or y is None:
                wins = y is None
            else:
                i, j = known[a], known[b]
                if i != j:
                    wins = i > j
                else:
                    end = min(len(x), len(y))
                    if x[i:end] == y[i:end]:
                        i = end
                        wins = len(x) < len(y) or (len(x) == len(y) and a < b)
                    else:
                        while x[i] == y[i]:
                            i += 1
                        wins = x[i] < y[i]
                    known[b if wins else a] = i
            if not wins:
                tree[node], a = a, b
            node >>= 1
        return a

    winner = 0
    for leaf in range(k):
        if (top := play(leaf, (leaf + k) >> 1)) >= 0:
            winner = top
    while k and (text := current[winner]) is not None:
        r = runs[winner]
        order.append(r.base + r.i)
        shared.append(known[winner])
        current[winner] = r.after(text)
        if r.i < r.n:
            known[winner] = r.common[r.i]
        winner = play(winner, (winner + k) >> 1)
    return order, shared


def _verdicts(right_common: np.ndarray, sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of the places at which each suffix, in sorted order, repeats a smaller document."""
    n = len(doc)
    group = np.cumsum(right_common < GRAM)  # equal anchors
    by_left = np.lexsort((left_sizes, *_keys(left)[::-1], group))
    left_common = _common(left[by_left], left_sizes[by_left])
    left_common[np.append(True, group[by_left][1:] != group[by_left][:-1])] = -1
    bits = np.zeros(n, np.int64)
    for l in range(BEFORE + 1):  # noqa: E741
        valid = np.flatnonzero((left_sizes >= l) & (sizes >= LENGTH - l))
        if not len(valid):
            continue
        right_class = np.cumsum(right_common < LENGTH - l)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_common < l)
        key = (right_class[valid] << 32) | left_class[valid]
        order = np.lexsort((doc[valid], key))
        key, who = key[order], doc[valid][order]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        least = who[np.flatnonzero(head)[np.cumsum(head) - 1]]
        bits[valid[order[who > least]]] |= np.int64(1) << l
    return bits


def _merged(blocks: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[dict]] = {}
        hot: list[np.ndarray] = []
        for b in batches:
            sent, strings = b.column("common").is_valid(), b.column("hot").is_valid()
            yield b.filter(pa.compute.invert(pa.compute.or_(sent, strings)))
            hot += [np.frombuffer(x.as_buffer(), _HOT) for x in b.column("hot").filter(strings)]
            for row in b.filter(sent).to_pylist():
                by_range.setdefault(row["range"], []).append(row)
        if hot:
            rows, larger = _repeated(np.concatenate(hot))
            yield from _settled_strings(rows[larger], ranges)
        for rows in by_range.values():
            runs, base = [], 0
            for row in rows:
                size = sum(row["sizes"]) - sum(row["common"])
                runs.append(Run(base, row["common"], row["sizes"], _unpacked(row["rest"], size)))
                base += len(row["common"])
            order, shared = merge(runs)
            order, shared = np.array(order, np.int64), np.array(shared, np.int64)
            joined = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)[order]  # noqa: B023, E731
            sizes, doc, owner, at = joined("sizes", np.uint8).astype(np.int64), joined("docs", "<i8"), joined("owners", "<i8"), joined("at", "<i4").astype(np.int64)
            widths = np.frombuffer(b"".join(r["before_sizes"] for r in rows), np.uint8).astype(np.int64)
            left = np.zeros((base, BEFORE), np.uint8)
            left[np.repeat(np.arange(base), widths), _within(widths)] = np.frombuffer(b"".join(_unpacked(r["before"], sum(r["before_sizes"])) for r in rows), np.uint8)
            shared[:1] = -1
            bits = _verdicts(shared, sizes, left[order], widths[order], doc)
            yield from _settled(doc, owner, at, bits, ranges)

    return blocks.repartition(ranges, "range").mapInArrow(run, _RUN_SQL).select("doc_id", "owner", "places", "bits")


# ---------------------------------------------------------------- hot anchors


def _hot_anchors(shared: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors in many texts of a sample. shared: owner and features, blocks of an owner's shared anchors."""
    texts = shared.select("owner").distinct().count()
    bound = -(2.0**63) + 2.0**64 * min(1.0, HOT_SAMPLE / max(1, texts))
    some = shared.filter(F.xxhash64("owner").cast("double") <= bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [from_bytes(f.as_buffer()).astype(np.int64) for f in b.column("features")]
            owners = np.repeat(b.column("owner").to_numpy(), [len(h) for h in hashes])
            yield pa.record_batch([pa.array(owners), pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))], names=["owner", "anchor"])

    counted = some.select("features", "owner").mapInArrow(run, "owner long, anchor long").distinct().groupBy("anchor").count()
    rows = counted.filter(F.col("count") >= HOT_TEXTS).select("anchor").collect()  # bounded by the sample
    return np.array(sorted(r["anchor"] for r in rows), np.uint64)


# ---------------------------------------------------------------- removal


def removed_bytes(size: int, places: list[bytes], bits: list[bytes]) -> np.ndarray:
    """Which bytes go."""
    edge = np.zeros(size + 1, np.int32)
    at = np.concatenate([np.frombuffer(p, "<i4") for p in places]).astype(np.int64)
    mask = np.concatenate([np.frombuffer(p, "<i4") for p in bits]).astype(np.int64)
    for l in range(BEFORE + 1):  # noqa: E741
        start = at[(mask >> l) & 1 == 1] - l
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge)[:size] > 0


def _removed(found: DataFrame, digests: bool) -> DataFrame:
    """found: doc_id, text, copy (of a smaller document's whole text), places, bits, perhaps carried."""
    carried = [f for f in found.schema.fields if f.name == "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            copies, places, bits = b.column("copy").to_pylist(), b.column("places"), b.column("bits")
            out: list[tuple] = []
            for k, (x, y) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                piece, gone = raw[x:y], None
                if y - x >= LENGTH:
                    if copies[k]:
                        gone = np.ones(y - x, bool)
                    elif places[k].is_valid:
                        gone = removed_bytes(y - x, places[k].as_py(), bits[k].as_py())
                n, spans = 0, 0
                if gone is not None:
                    n = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    piece = piece[~gone]
                kept = piece.tobytes()
                out.append((y - x, n, spans, hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(b.column(name) for name in extra)]
            yield pa.record_batch(made, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *extra])

    extra = [f.name for f in carried]
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept string")
    return found.mapInArrow(run, StructType([*schema.fields, *carried]))


def remove_repeats(docs: DataFrame, digests: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the remaining text (characters cut in two dropped), or the
    SHA-256 of the remaining bytes. The columns in carry stay with their row, whatever its doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions_for(docs)
    extra = ["carried"] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *(F.struct(*carry).alias(c) for c in extra))
    key = F.xxhash64("text")
    rows = rows.withColumn("owner", F.when(key == 0, F.lit(1)).otherwise(key)).withColumn("owner2", F.xxhash64(F.lit(1), "text"))
    texts = rows.filter("doc_id is not null")
    found = stored(exchanged(_first_pass(texts.drop(*extra), buckets), buckets, True), "anchors")
    release(spark)
    stats = found.filter("n is not null")
    counted = stats.groupBy("owner", "owner2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    least = counted.drop("n")
    blocks = found.filter("credit is not null").select("owner", "features")
    hot = _hot_anchors(blocks)
    shared = blocks.groupBy("owner").agg(F.collect_list("features").alias("shared"))
    sampled = stats.filter("sample is not null").select("sample", F.xxhash64("sample", "doc_id").alias("o"))
    wanted = max(SAMPLE, SAMPLE_PER_RANGE * buckets)
    bound = -(2.0**63) + 2.0**64 * min(1.0, wanted / max(1, sampled.count()))
    sample = [bytes(r[0]) for r in sampled.filter(F.col("o").cast("double") <= bound).select("sample").toLocalIterator()]
    sample = np.unique(np.array(sample, f"S{GRAM}"))
    splitters = sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else sample
    splitters = np.unique(splitters)

    chosen = least.join(shared, "owner").select(F.col("least").alias("doc_id"), "owner", "owner2", "shared")
    runs = _runs(texts.join(chosen, ["doc_id", "owner", "owner2"]).select("doc_id", "owner", "text", "shared"), splitters, buckets, hot)
    merged = stored(_merged(runs, buckets), "merged")
    release(spark)  # texts and runs of the merge go before the verdicts move
    verdicts = merged.groupBy("doc_id", "owner").agg(F.collect_list("places").alias("places"), F.collect_list("bits").alias("bits"))
    verdicts = least.withColumnRenamed("least", "doc_id").join(verdicts, ["doc_id", "owner"])
    copies = salted_join(stats.select("doc_id", "owner", "owner2"), counted, ["owner", "owner2"], "n", F.xxhash64("doc_id"), max(1, stats.count())).filter("doc_id > least").select("doc_id", "owner", "owner2").distinct()
    copies = copies.select("*", F.lit(True).alias("copy"), F.lit(None).cast("array<binary>").alias("places"), F.lit(None).cast("array<binary>").alias("bits"))
    verdicts = stored(verdicts.select("doc_id", "owner", "owner2", F.lit(False).alias("copy"), "places", "bits").unionByName(copies), "verdicts")
    discard(found, merged)
    release(spark)
    settled = texts.join(verdicts, ["doc_id", "owner", "owner2"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "places", "bits", *extra)
    nameless = rows.filter("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<binary>").alias("places"), F.lit(None).cast("array<binary>").alias("bits"), *extra)
    kept = _removed(settled.unionByName(nameless), digests)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried.*") if carry else kept
