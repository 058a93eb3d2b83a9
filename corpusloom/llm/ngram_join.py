"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

Texts become sets of hashed word n-grams; equal sets are one class from the start. The incidence
of classes and n-grams is multiplied by its own transpose in blocks of columns (n-grams dealt by
hash), and only as far as sizes allow a link:

1. Incidence of a prefix. In hash order, two sets of Jaccard similarity t share at least l n-grams among
   their first n - ceil(t n) + l. Blocks of hashes go to their column's partition, which credits every
   class with its columns that another class has. A class with fewer than l credits cannot
   link and leaves. A column with several classes in one task is summed there before the exchange.
2. Product over the classes that remain. Each column that several of them have names its most credited class, its
   head. A class with fewer shared columns than a link needs leaves. Two classes that link share t of the larger set's
   columns, so each may leave the heads of its least columns, up to half of that, and they still meet under one of
   their heads: there the sets meet in one product, or in bounded blocks of it. A block adds up overlaps over all
   columns, drops the cells below the bound that sizes give, and returns no more links than connect what is left,
   never all pairs.
3. A head with more sets than a block holds meets each of them first, in as many blocks as it takes: sets that link
   with it are one component, whatever links there are between them. Only the others need the product, with each other and
   with those that link, in bounded pairs of blocks.

Links are then contracted into components.

Cases: a null or wordless text has the empty set and links with nothing; fewer words than n make one
n-gram of the whole sequence; a null doc_id is reported with a null component and links with nothing;
rows that repeat a doc_id are one document to `components`, with the links of all their texts, and rows each by itself to
`distinct`; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.components import connected
from corpusloom.llm.incidence import COLUMN_BYTES, SCHEMA_SQL, Gatherer, exchanged, from_bytes, record, runs_of, to_bytes
from corpusloom.llm.shared import BROADCAST_ROWS, LOWER, broadcast_small, discard, mix, partitions_for, plain, release, salted_join, slices, small_batches, span_hashes, stored, text_buffers, words_of

WORDS = 5
#: Entries and sets of one block of the product, about, and how many sets make a column dense.
BLOCK_GRAMS = 120_000
BLOCK_SETS = 400
#: Sets that meet their head in one block, and blocks for which the head's set travels once.
STAR_SETS = 100
STAR_BLOCKS = 1000
DENSE_FROM = 6
DENSE_COLUMNS = 2048
#: Similarity in hundredths from which two texts link.
PERCENT = 80

_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    raw = LOWER[raw]
    starts, ends, rows = words_of(raw, offsets)
    words = span_hashes(raw, starts, ends)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : len(words) - n + 1 + k] * _WEIGHTS[k] if len(grams) else grams
    grams = mix(grams)
    out = []
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = words[a:b] * _WEIGHTS[8 : 8 + b - a]
            out.append(mix(np.array([whole.sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def prefix_length(n: int, extra: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + extra)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True) or 1, int.from_bytes(digest[8:], "little", signed=True)


def _incidence(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """A row for each document, and blocks of the incidence of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gatherer(buckets, False)
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            counts, owner, owner2 = [], [], []
            for x, y in slices(offsets):
                for grams in shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], n):
                    size = len(grams)
                    one, two = set_key(grams) if size else (None, None)
                    counts.append(size)
                    owner.append(one)
                    owner2.append(two)
                    if size:
                        got.add(grams[: prefix_length(size, size // 5 + 1, percent)], one)
                if got.full():
                    yield from got.flush()
            yield record(bucket=np.arange(len(counts), dtype=np.int32) % buckets, doc_id=b.column("doc_id"), mark=b.column("mark"), n=counts, owner=owner, owner2=owner2)
        yield from got.flush()

    return docs.mapInArrow(run, SCHEMA_SQL)


def _whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """node, n, weight and grams of the texts whose set is that of their class (owner, owner2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            owners = list(zip(b.column("owner").to_pylist(), b.column("owner2").to_pylist(), strict=True))
            sets, rows = [], []
            for x, y in slices(offsets):
                for i, grams in enumerate(shingle_sets(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], n), x):
                    if set_key(grams) == owners[i]:
                        sets.append(grams.view(np.int64))
                        rows.append(i)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            kept = pa.array(rows, pa.int32())
            yield pa.record_batch([b.column("node").take(kept), pa.array(np.diff(ends), pa.int64()), b.column("weight").take(kept), grams], names=["node", "n", "weight", "grams"])

    return docs.mapInArrow(run, "node long, n long, weight double, grams array<long>")


def _columns(sets: DataFrame, buckets: int) -> DataFrame:
    """The incidence of whole sets in blocks of columns, dealt by hash; only nodes, not texts or sets, go with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("grams")
            many = np.diff(lists.offsets.to_numpy())
            grams = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(lists)), many)
            where = ((grams >> np.uint64(8 * COLUMN_BYTES)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((row, where))
            where, row, data = where[order], row[order], to_bytes(grams[order])
            node, weight = b.column("node").to_numpy(), b.column("weight").to_numpy()
            out: list[tuple] = []
            cuts = runs_of(where).tolist()
            for x, y in zip(cuts, cuts[1:], strict=False):
                runs = runs_of(row[x:y])
                who = row[x:y][runs[:-1]]
                out.append((int(where[x]), data[x:y].tobytes(), node[who].tobytes(), weight[who].tobytes(), np.diff(runs).astype("<u4").tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "features", "nodes", "weights", "runs"])

    return sets.mapInArrow(run, "bucket int, features binary, nodes binary, weights binary, runs binary")


def _headed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks of head, node and the number of columns that the node shares under the head, dealt by node.

    A column's head is its node of most weight. Columns with one node have none. Two columns may be taken for one, as
    their bytes are cut short; then their nodes meet under one head, which costs a comparison and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, nodes, weights = [], [], []
        for b in batches:
            for f, o, w, r in zip(*(b.column(c) for c in ("features", "nodes", "weights", "runs")), strict=True):
                runs = np.frombuffer(r.as_buffer(), "<u4")
                features.append(from_bytes(f.as_buffer()))
                nodes.append(np.repeat(np.frombuffer(o.as_buffer(), np.int64), runs))
                weights.append(np.repeat(np.frombuffer(w.as_buffer(), np.float64), runs))
        if not features:
            return
        features, nodes, weights = (np.concatenate(x) for x in (features, nodes, weights))
        order = np.lexsort((nodes, -weights, features))
        features, nodes = features[order], nodes[order]
        cuts = runs_of(features)
        size = np.diff(cuts)
        heads = np.repeat(nodes[cuts[:-1]], size)
        many = np.repeat(size > 1, size)
        heads, nodes = heads[many], nodes[many]
        order = np.lexsort((nodes, heads))
        heads, nodes = heads[order], nodes[order]
        if len(heads):
            new = np.append(True, (heads[1:] != heads[:-1]) | (nodes[1:] != nodes[:-1]))
            at = np.flatnonzero(new)
            count, heads, nodes = np.diff(np.append(at, len(heads))), heads[at], nodes[at]
            where = (nodes % buckets).astype(np.int32)
            order = np.argsort(where, kind="stable")
            where, triples = where[order], np.stack([heads, nodes, count], 1)[order]
            cuts = runs_of(where).tolist()
            yield pa.record_batch([pa.array(where[cuts[:-1]]), pa.array([triples[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["bucket", "triples"])

    return blocks.mapInArrow(run, "bucket int, triples binary")


def _summed(blocks: DataFrame) -> DataFrame:
    """head, node, columns: what the blocks count, a row for each head and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(t.as_buffer(), np.int64).reshape(-1, 3) for b in batches for t in b.column("triples")]
        if not parts:
            return
        triples = np.concatenate(parts)
        triples = triples[np.lexsort((triples[:, 0], triples[:, 1]))]
        at = np.flatnonzero(np.append(True, (triples[1:, :2] != triples[:-1, :2]).any(1)))
        yield pa.record_batch([pa.array(triples[at, 0]), pa.array(triples[at, 1]), pa.array(np.add.reduceat(triples[:, 2], at))], names=["head", "node", "columns"])

    return blocks.mapInArrow(run, "head long, node long, columns long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets: the incidence of sets and n-grams times its transpose, column by column.

    Columns with a few sets add their cells one by one, the others in dense blocks; a column with one set adds nothing.
    """
    size = len(sets)
    rows = np.repeat(np.arange(size), [len(s) for s in sets])
    grams = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    rows, grams = rows[order], grams[order]
    cuts = np.concatenate([[0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(grams)]]) if len(grams) else np.zeros(1, np.int64)
    begin, many = cuts[:-1], np.diff(cuts)
    cells = np.zeros(size * size, np.float64)
    for m in range(2, DENSE_FROM):
        first = begin[many == m]
        for i in range(m if len(first) else 0):
            for j in range(i + 1, m):
                cells += np.bincount(rows[first + i] * size + rows[first + j], minlength=size * size)
    dense = np.flatnonzero(many >= DENSE_FROM)
    cells = cells.reshape(size, size)
    cells += cells.T
    for at in range(0, len(dense), DENSE_COLUMNS):
        some = dense[at : at + DENSE_COLUMNS]
        block = np.zeros((size, len(some)), np.float32)
        for k, c in enumerate(some.tolist()):
            block[rows[cuts[c] : cuts[c + 1]], k] = 1
        cells += block @ block.T
    return cells


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what links among the sets; at most one less than there are sets."""
    n = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    a, b = np.nonzero(np.triu(both * 100 >= (n[:, None] + n[None, :] - both) * percent, 1))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            out.append((i, j))
    return out


def _sized(members: DataFrame, rows: int) -> DataFrame:
    """members (head, node, n) with their head's `total` weight; heads with one member go."""
    weight = F.greatest(F.col("n"), F.lit(max(1, BLOCK_GRAMS // BLOCK_SETS)))  # so that small sets are no more than BLOCK_SETS
    totals = members.groupBy("head").agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("m"))
    return salted_join(members.withColumn("weight", weight), totals, ["head"], "m", F.xxhash64("node"), rows).filter("m > 1").drop("m")


def _met(table: pa.Table, percent: int) -> pa.Table:
    """head, node and whether they link, of one block; the head's set is the row whose node is the head."""
    nodes, head = table["node"].to_numpy(), table["head"][0].as_py()
    grams = table["grams"].combine_chunks()
    sets = [np.asarray(g.values) for g in grams]
    own = sets[int(np.flatnonzero(nodes == head)[0])]
    rows = np.flatnonzero(nodes != head)
    both = np.array([np.isin(sets[i], own, assume_unique=True).sum() for i in rows], np.int64)
    size = np.array([len(sets[i]) for i in rows], np.int64)
    return pa.table({"head": pa.array(np.full(len(rows), head)), "node": pa.array(nodes[rows]), "linked": pa.array(both * 100 >= (size + len(own) - both) * percent)})


def _stars(large: DataFrame, sets: DataFrame, meet: Callable[[pa.Table], pa.Table], columns: tuple[str, ...]) -> DataFrame:
    """head, node and linked, for the members of large heads other than the head."""
    count = F.ceil(F.col("m") / STAR_SETS).cast("int").alias("k")
    heads = large.groupBy("head").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("m")).select("head", count)
    own = sets.select(F.col("node").alias("head"), *columns).join(broadcast_small(heads), "head")
    # a head of very many blocks is copied in two steps, so that no task makes all copies
    spread = own.select("head", *columns, "k", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / STAR_BLOCKS).cast("int"))).alias("part")).repartition("head", "part")
    first = F.col("part") * STAR_BLOCKS
    copies = spread.select("head", F.explode(F.sequence(first, F.least(first + STAR_BLOCKS, F.col("k")) - 1)).alias("block"), F.col("head").alias("node"), *columns)
    others = salted_join(large.filter("head <> node").select("head", "node"), large.groupBy("head").agg(F.count(F.lit(1)).alias("m")).withColumn("k", F.ceil(F.col("m") / STAR_SETS).cast("int")), ["head"], "m", F.xxhash64("node"), max(1, large.count()))
    members = stored(others.select("head", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("block"), "node"), "star-members")
    dealt = sets.select("node", *columns).join(broadcast_small(members), "node").select("head", "block", "node", *columns)
    return dealt.unionByName(copies).groupBy("head", "block").applyInArrow(meet, "head long, node long, linked boolean")


def _blocks(rest: DataFrame) -> DataFrame:
    """head, node, block: the pieces of the product that a set takes part in. rest: head, node, n, weight, linked (with the head).

    A head's sets are dealt by size class (sizes a quarter apart) and hash, those that link with it apart. Only blocks of the same
    or neighbouring classes meet, as others can't be similar enough, and never two blocks of sets that link with the head.
    """
    keys = ["head", "linked", "s"]
    rows = rest.withColumn("s", F.floor(F.log("n") / float(np.log(1.25))).cast("int"))
    classes = rows.groupBy(keys).agg(F.ceil(F.sum("weight") * 2 / BLOCK_GRAMS).cast("int").alias("k"), F.count(F.lit(1)).alias("m"))
    near = classes.select("head", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"), F.struct("linked", "s", "k").alias("other"))
    near = near.groupBy("head", "s").agg(F.collect_list("other").alias("others"))  # six at most
    dealt = salted_join(rows, classes.join(near, ["head", "s"]), keys, "m", F.xxhash64("node"), max(1, rest.count()))
    name = lambda linked, s, j: F.format_string("%s.%d.%d", linked, s, j)
    own = name(F.col("linked"), F.col("s"), F.pmod(F.xxhash64("node"), F.col("k")))
    met = F.filter("others", lambda o: ~(o["linked"] & F.col("linked")))
    others = F.flatten(F.transform(met, lambda o: F.transform(F.sequence(F.lit(0), o["k"] - 1), lambda r: name(o["linked"], o["s"], r))))
    pairs = dealt.select("head", "node", own.alias("own"), F.explode(others).alias("other"))
    return pairs.select("head", "node", F.concat_ws(" ", F.least("own", "other"), F.greatest("own", "other")).alias("block"))


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    nodes, grams = table["node"].to_pylist(), table["grams"].combine_chunks()
    found = linked([np.asarray(g.values) for g in grams], percent)
    return pa.table({"u": pa.array([nodes[i] for i, _ in found], pa.int64()), "v": pa.array([nodes[j] for _, j in found], pa.int64())})


def _links(blocks: DataFrame, sets: DataFrame, link: Callable[[pa.Table], pa.Table], columns: tuple[str, ...]) -> DataFrame:
    """u, v: links that connect the sets of each block. Few rows of blocks, which a count tells, go to the sets, which then move only to their blocks."""
    return sets.select("node", *columns).join(broadcast_small(blocks), "node").groupBy("head", "block").applyInArrow(link, "u long, v long")


def linked_sets(members: DataFrame, sets: DataFrame, link: Callable[[pa.Table], pa.Table], meet: Callable[[pa.Table], pa.Table], columns: tuple[str, ...] = ("grams",)) -> DataFrame:
    """u, v: links that connect the members (head, node, n) of all heads. sets: node and columns.

    link gives u and v of one block of sets, meet gives head, node and linked of a block that has the head's set.
    """
    sized = stored(_sized(members, max(1, members.count())), "sized")
    small = sized.filter(F.col("total") <= BLOCK_GRAMS).select("head", "node", F.lit("").alias("block"))
    large = sized.filter(F.col("total") > BLOCK_GRAMS)
    links = _links(small, sets, link, columns)
    if large.isEmpty():
        links = stored(links, "links")
        discard(sized)
        return links
    met = stored(_stars(large, sets, meet, columns), "met")
    links = links.unionAll(met.filter("linked").select(F.col("head").alias("u"), F.col("node").alias("v")))
    done = [sized, met]
    if not met.filter("not linked").isEmpty():
        rest = stored(large.join(met, ["head", "node"]).select("head", "node", "n", "weight", "linked"), "rest")
        blocks = stored(_blocks(rest), "blocks")
        links = links.unionAll(_links(blocks, sets, link, columns))
        done += [rest, blocks]
    links = stored(links, "links")
    discard(*done)
    return links


def placed(stats: DataFrame, classes: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """stats (doc_id, mark, n, owner, owner2) with class_size and `first`: doc_id and mark of the first document of the component, or null
    where there is no set or no doc_id. classes: owner, owner2, first, class_size. nodes: node, owner, owner2, first of the classes that links name."""
    keys = ["owner", "owner2"]
    rooted = stored(connected(links).join(nodes, "node"), "rooted")
    discard(links)
    least = rooted.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("m"))
    joined = salted_join(rooted, least, ["component"], "m", F.xxhash64("node"), max(1, rooted.count())).select(*keys, "least")
    found = stored(classes.join(joined, keys, "left").select(*keys, "class_size", F.coalesce("least", "first").alias("first")), "classes")
    usable = stats.filter("owner is not null and doc_id is not null")
    grouped = salted_join(usable, found, keys, "class_size", F.xxhash64("doc_id", "mark"), max(1, stats.count())).select("doc_id", "mark", "n", "class_size", "first")
    lone = stats.filter("owner is null or doc_id is null").select("doc_id", "mark", "n", F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("struct<doc_id:long,mark:long>").alias("first"))
    return grouped.unionByName(lone)


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per document: doc_id, mark (a hash of the text), n, class_size, and `first`: doc_id and mark of the first document of
    its component, or null where there is no set or no doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = plain(docs).withColumn("mark", F.xxhash64("text"))
    buckets = partitions_for(docs)
    counted = stored(exchanged(_incidence(texts, n, percent, buckets), buckets, False).select("doc_id", "mark", "n", "owner", "owner2", "credit"), "incidence")
    release(spark)
    stats = counted.filter("n is not null").select("doc_id", "mark", "n", "owner", "owner2")
    keys = ["owner", "owner2"]
    usable = stats.filter("owner is not null and doc_id is not null")
    classes = usable.groupBy(keys).agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("class_size"))
    credits = counted.filter("credit is not null").groupBy("owner").agg(F.sum("credit").alias("credit"))
    left = classes.join(credits, "owner").filter("credit >= greatest(1, n div 5)")
    left = left.select(F.monotonically_increasing_id().alias("node"), *keys, "first", (F.col("credit") / F.col("n")).alias("weight"))
    survivors = stored(left, "survivors")  # which fixes the nodes' numbers
    wanted = survivors.select("node", *keys, "weight", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"))
    few = survivors.count() <= BROADCAST_ROWS  # then texts needn't move
    chosen = texts.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), ["doc_id", "mark"]).select("text", "node", *keys, "weight")
    sets = stored(_whole_sets(chosen, n).dropDuplicates(["node"]), "sets")
    release(spark)

    headed = _headed(_columns(sets, buckets).repartition(buckets, "bucket"), buckets)
    shared = _summed(headed.repartition(buckets, "bucket"))
    shared = shared.join(sets.select("node", "n"), "node")
    upto = F.sum("columns").over(Window.partitionBy("node").orderBy("columns", "head"))  # a node has no more heads than n-grams
    live = F.sum("columns").over(Window.partitionBy("node"))
    members = shared.withColumn("upto", upto).withColumn("live", live).filter(F.col("live") * 100 >= F.col("n") * percent)
    members = stored(members.filter(F.col("upto") * 200 >= F.col("n") * percent).select("head", "node", "n"), "members")
    links = linked_sets(members, sets, lambda table: _block_links(table, percent), lambda table: _met(table, percent))
    discard(sets, members)
    return placed(stats, classes, survivors.select("node", *keys, "first"), links)


def joined_components(grouped: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size; documents whose rows are in several components join these."""
    rows = grouped.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "class_size")
    rows = stored(rows, "grouped")
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("one"), F.max("component_id").alias("two")).filter("one < two")
    several = stored(several, "several")
    if several.isEmpty():
        return rows
    edges = rows.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    joined = connected(edges.distinct()).select(F.col("node").alias("component_id"), "component")
    found = rows.join(joined, "component_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"), "class_size")


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_size (documents with an equal set)."""
    return joined_components(_grouped(docs, n, percent))


def distinct(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, all their columns as they are: of each group of near copies the first by doc_id.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id with other texts are judged each by itself, and rows that repeat both stay
    together. Rows without a doc_id or a word stay.
    """
    away = _grouped(docs, n, percent).filter("first is not null and not (first.doc_id = doc_id and first.mark = mark)")
    away = broadcast_small(stored(away.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "away"))
    same = (docs["doc_id"].cast("long") == away["__id"]) & (F.xxhash64(docs["text"].cast("string")) == away["__mark"])
    return docs.join(away, same, "left_anti")
