"""MinHash near-dedup: banded candidates, pruned by a sequential Bayesian test of their signatures, then verified on full sets.

1. Texts become sets of hashed word n-grams; equal sets are one class. A class has a signature: for each of BANDS x ROWS hash functions the
   least hash of its n-grams.
2. Classes that agree in a band meet in its bucket. A bucket names its least class, its head; buckets with one head are one group, so
   copies that agree in many bands still stand in few groups. A group is compared in bounded blocks (the head first, then what doesn't link with it), and a
   block returns no more links than connect its classes, never all pairs.
3. Within a block signatures are compared BATCH values at a time. With m of the first k values equal and a uniform prior, the similarity has the posterior
   Beta(m + 1, k - m + 1); a pair leaves as soon as the chance that it is similar enough is below MISS. What survives all batches is
   verified by the exact overlap of the full sets, the likeliest pairs first, but for pairs that other links connect already.

Two sets of similarity exactly 0.85 share no band with a chance of 7e-9, and a pair that should link leaves the test with one of about MISS for each of ten
batches; nothing else is lost, and no pair links unverified.

Cases: as in ngram_join: a null or wordless text has the empty set and links with nothing; fewer words than n make one n-gram of the whole sequence; a null doc_id
is reported with a null component and links with nothing; rows that repeat a doc_id are one document, with the links of all their
texts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.incidence import COLUMN_BYTES, SCHEMA_SQL, Gatherer, exchanged
from corpusloom.llm.ngram_join import joined_components, linked_sets, placed, set_key, shingle_sets
from corpusloom.llm.shared import BROADCAST_ROWS, discard, mix, partitions_for, plain, release, salted_join, slices, small_batches, stored, text_buffers

WORDS = 3
#: Similarity in hundredths from which two texts link.
PERCENT = 85
#: Bands of a signature and values of a band.
BANDS, ROWS = 32, 5
#: Values that are compared before the next look at the posterior.
BATCH = 16
#: Posterior chance of a link below which a pair is given up.
MISS = 1e-9

_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS x ROWS values for each set; zeros for an empty one.

    A value is 16 bits made of the least hash, so unequal ones agree by chance once in 65,536 times, which adds a candidate now and then and loses none.
    """
    out = np.zeros((len(sets), len(_FACTORS)), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        grams = mix(np.concatenate([sets[i] for i in full]))
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, factor in enumerate(_FACTORS):
            out[full, k] = mix(np.minimum.reduceat(grams * factor, first)) >> np.uint64(48)
    return out


def bands(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    values = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), values.shape[:2])
    for k in range(ROWS):
        out = mix(out ^ (values[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return out


@lru_cache
def least_equal(percent: int = PERCENT, miss: float = MISS, values: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """After how many values how many must be equal for the pair to stay.

    The chance that Beta(m + 1, k - m + 1) passes t is that of at most m successes in k + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for k in [*range(batch, values, batch), values]:
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def likely(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a, b) of rows survive every batch, and how many of their values are equal."""
    live, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for k, least in least_equal(percent):
        equal[live] += (sigs[a[live], done:k] == sigs[b[live], done:k]).sum(1)
        live, done = live[equal[live] >= least], k
    return live, equal[live]


def _overlap(one: np.ndarray, two: np.ndarray) -> int:
    """Numbers in both of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    return int((two[np.minimum(at, len(two) - 1)] == one).sum())


def linked(grams: list[np.ndarray], sigs: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what links among the sets; at most one less than there are sets."""
    n = np.array([len(s) for s in grams], np.int64)
    a, b = np.nonzero(np.triu(np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent, 1))
    root, out = list(range(len(grams))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    live, equal = likely(sigs, a, b, percent)
    for k in live[np.argsort(-equal, kind="stable")].tolist():
        i, j = int(a[k]), int(b[k])
        x, y = find(i), find(j)
        if x != y:
            both = _overlap(grams[i], grams[j])
            if both * 100 >= (int(n[i]) + int(n[j]) - both) * percent:
                root[y] = x
                out.append((i, j))
    return out


def links_to(own: int, grams: list[np.ndarray], sigs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets link with that of row `own`."""
    every, found = np.arange(len(grams)), np.zeros(len(grams), bool)
    live, _ = likely(sigs, np.full(len(grams), own), every, percent)
    for i in live.tolist():
        both = _overlap(grams[i], grams[own])
        found[i] = both * 100 >= (len(grams[i]) + len(grams[own]) - both) * percent
    return found


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, mark, n, the set's key (owner, owner2) and the signature of each row; no key and signature where there is no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            counts, keys, sigs = [], [], []
            for x, y in slices(offsets):
                sets = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], n)
                counts += [len(s) for s in sets]
                keys += [set_key(s) if len(s) else (None, None) for s in sets]
                sigs += [v.tobytes() if len(s) else None for v, s in zip(signatures(sets), sets, strict=True)]
            one, two = zip(*keys, strict=True) if keys else ((), ())
            yield pa.record_batch([b.column("doc_id"), b.column("mark"), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "mark", "n", "owner", "owner2", "sig"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, owner long, owner2 long, sig binary")


def _whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """node, grams and sig of the texts whose set is that of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            owners = list(zip(b.column("owner").to_pylist(), b.column("owner2").to_pylist(), strict=True))
            for x, y in slices(offsets):
                sets = shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], n)
                rows = [i for i, s in enumerate(sets, x) if len(s) and set_key(s) == owners[i]]
                sets = [sets[i - x] for i in rows]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
                yield pa.record_batch([b.column("node").take(pa.array(rows, pa.int32())), grams, pa.array([v.tobytes() for v in signatures(sets)], pa.binary())], names=["node", "grams", "sig"])

    return docs.mapInArrow(run, "node long, grams array<long>, sig binary")


def _met_head(table: pa.Table, percent: int) -> pa.Table:
    """head, node and whether they link, of one block that has the head's own set."""
    nodes, head = table["node"].to_numpy(), table["head"][0].as_py()
    own, rows = int(np.flatnonzero(nodes == head)[0]), np.flatnonzero(nodes != head)
    return pa.table({"head": pa.array(np.full(len(rows), head)), "node": pa.array(nodes[rows]), "linked": pa.array(links_to(own, *_sets(table), percent)[rows])})


def _sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    grams = [np.asarray(g.values) for g in table["grams"].combine_chunks()]
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(grams), -1)
    return [g.view(np.uint64) for g in grams], sigs


def _members(classes: DataFrame, buckets: int) -> DataFrame:
    """head, node: the classes of every bucket with several, under the bucket's least. classes: node, sig.

    Most buckets hold one class; an exchange of short hashes tells which don't, and only these are grouped.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gatherer(buckets, True)
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            for node, own in zip(b.column("node").to_pylist(), bands(sigs), strict=True):
                got.add(own, node + 1)  # as 0 stands for several owners
            if got.full():
                yield from got.flush()
        yield from got.flush()

    shared = exchanged(classes.mapInArrow(entries, SCHEMA_SQL), buckets, True).select("owner", "features")
    short = F.transform(F.sequence(F.lit(1), F.length("features"), F.lit(COLUMN_BYTES)), lambda at: F.xxhash64(F.substring(F.col("features"), at, F.lit(COLUMN_BYTES))))
    rows = stored(shared.select(F.explode(short).alias("bucket"), (F.col("owner") - 1).alias("node")), "buckets")
    release(classes.sparkSession)
    heads = rows.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = stored(salted_join(rows, heads, ["bucket"], "m", F.xxhash64("node"), max(1, rows.count())).select("head", "node").distinct(), "members")
    discard(rows)
    return members


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_size (documents with an equal set), kept."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = plain(docs).withColumn("mark", F.xxhash64("text"))
    signed = stored(_signed(texts, n), "signed")
    stats = stored(signed.drop("sig"), "stats")
    keys = ["owner", "owner2"]
    usable = signed.filter("owner is not null and doc_id is not null")
    classes = usable.groupBy(keys).agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("class_size"), F.min("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # which fixes the nodes' numbers
    discard(signed)
    release(spark)
    members = _members(classes.select("node", "sig"), partitions_for(docs))
    wanted = classes.join(members.select("node").distinct(), "node").select("node", *keys, F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
    wanted = stored(wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS  # then texts needn't move
    chosen = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("text", "node", *keys)
    sets = stored(_whole_sets(chosen, n).dropDuplicates(["node"]), "sets")
    release(spark)

    def block_links(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        found = np.array(linked(*_sets(table), percent), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(nodes[found[:, 0]], pa.int64()), "v": pa.array(nodes[found[:, 1]], pa.int64())})

    links = linked_sets(members.join(classes.select("node", "n"), "node"), sets, block_links, lambda table: _met_head(table, percent), ("grams", "sig"))
    discard(sets, members, wanted)
    rows = joined_components(placed(stats, classes.select(*keys, "first", "class_size"), classes.select("node", *keys, "first"), links))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
