"""Boilerplate filter: TF-IDF weights and the noise of density clusters.

Only points that no dense cluster reaches are kept, so clusters need no names: a sentence stays if it isn't a core
point and no core point is near. Near pairs come from an inverted index on the rarest terms of each sentence, as
many as needed for the rest to be too light for a match. Two near points meet under their first common term: there the product of
what either weighs from that term on is a bound. A sieve moves sketches of what follows a term, not vectors, and finds the places (a point under a
term) that may have another near; only their vectors move, and one matrix product of bounded size finds the pairs. Neither candidates nor pairs leave
the task: a first pass counts what is near each point, up to what makes it a core point, a second one names the points near a core point, and
from a block comes a row for each of its points at most. Terms of very many points are dealt in pairs of blocks. Sentences
with the same terms are one point with a multiplicity, so copies make no pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.regex import let
from corpusloom.operators.skew import broadcast_small
from corpusloom.operators.storage import discard, materialized, release
from corpusloom.workers import importable

MIN_DF = 10
EPS = 0.3
MIN_SAMPLES = 10
#: Slack of comparisons with the threshold.
SLACK = 1e-9
#: Terms with their counts up to which they are broadcast, as three numbers each.
VOCABULARY = 1_000_000
#: Points of a term, about, that meet in one product, and columns of it that are taken at once.
BLOCK_POINTS = 2000
BLOCK_COLUMNS = 4096
#: Points of small terms that share one product.
CALL_POINTS = 100
#: A sketch has about so many buckets for the square of a vector's sum, which chance meetings of terms add up to, and these at least and at most.
SKETCH_BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 4, 16, 16384
#: Different sketches of one point at most, and what its places tell of the terms before theirs.
POINT_SKETCHES, LEAD_TERMS = 32, 4
#: Terms that are put into sketches at once.
SKETCHED_TERMS = 1 << 20
#: Slack of bounds in single precision.
BOUND_SLACK = 1e-4


def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without them, by decomposition."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x2000) if len(d := [x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and d[0] != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased words of two or more characters, without accents and stop words."""
    plain = F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), _FROM, _TO)
    words = F.regexp_extract_all(plain, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def tfidf(sentences: DataFrame, min_df: int = MIN_DF, stop_words: list[str] | None = None) -> DataFrame:
    """id, term, df and w: sublinear, smoothed and of unit length. sentences: id and text."""
    words = sentences.select("id", F.explode(tokens(F.col("text"), stop_words)).alias("term"))
    counts = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = sentences.agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    idf = df.join(F.broadcast(n)).select("term", "df", _idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row
    raw = counts.join(idf, "term").select("id", "term", "df", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("w", F.col("w") / norm)


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def _counted(words: Column) -> Column:
    """The different values of an array, each with its count, in one pass over the sorted array."""

    def runs(some: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(some) - 1), lambda i: (i == 0) | (F.get(some, i) != F.get(some, i - 1)))
        return let([starts], lambda at: F.transform(at, lambda i, j: F.struct(F.get(some, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(some)) - i).alias("tf"))))

    return F.when(F.size(words) > 0, let([F.array_sort(words)], runs))


def _vectors(sentences: DataFrame, min_df: int, stop_words: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """What tfidf() weighs, as arrays: sentences with numbers (row, id) and vectors (row, ids and ws in order of rarity). Words move as hashes and sentences as numbers."""
    words = sentences.select("id", _counted(F.transform(tokens(F.col("text"), stop_words), lambda w: F.xxhash64(w))).alias("words")).withColumn("row", F.monotonically_increasing_id())
    words = materialized(words, "words")
    flat = words.select("row", F.inline("words"))
    df = materialized(flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df), "terms")
    idf = broadcast_small(df.select("term", "df", _idf(F.lit(words.count()), F.col("df")).alias("idf")), VOCABULARY)
    raw = flat.join(idf, "term").select("row", F.struct("df", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")).alias("x"))
    vectors = raw.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y["w"] * y["w"])).alias("norm")
    vectors = vectors.select("row", "v", norm).select("row", F.col("v.term").alias("ids"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("ws"))
    return words.select("row", "id"), vectors


# ---------------------------------------------------------------- near points of one term


def _together(runs: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that are compared in one product: whole runs, of CALL_POINTS rows together or of one run. runs: where each begins, and the end."""
    out, at = [], 0
    for x, y in zip(runs, runs[1:], strict=False):
        if x > at and y - at > CALL_POINTS:
            out.append((at, int(x)))
            at = int(x)
    return [*out, (at, int(runs[-1]))] if runs[-1] > at else out


def _cuts(run: np.ndarray) -> np.ndarray:
    """Where each run begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)) if len(run) else np.zeros(1, np.int64)


def _heavy(run: np.ndarray, tail: np.ndarray, least: float) -> np.ndarray:
    """The rows whose tail and the greatest other one of their run are enough for a near point."""
    order = np.lexsort((-tail, run))
    begin = np.searchsorted(run[order], run)
    first = tail[order][begin]
    second = tail[order][np.minimum(begin + 1, len(run) - 1)]
    alone = run[order][np.minimum(begin + 1, len(run) - 1)] != run
    most = np.where(tail == first, second, first)  # the most that another point of the run may have
    return np.flatnonzero(~alone & (begin + 1 < len(run)) & (tail * most >= least - SLACK))


def _shared(lists: pa.ListArray, weights: np.ndarray | None, run: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the sparse vectors of rows a and b; terms of different runs are different."""
    row = np.repeat(np.arange(len(run)), np.diff(lists.offsets.to_numpy()))
    terms = lists.flatten().to_numpy().view(np.uint64) ^ (run[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    names, column = np.unique(terms, return_inverse=True)
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(names), BLOCK_COLUMNS):
        inside = (column >= at) & (column < at + BLOCK_COLUMNS)
        block = np.zeros((len(run), min(BLOCK_COLUMNS, len(names) - at)))
        block[row[inside], column[inside] - at] = 1 if weights is None else weights[inside]
        out += block[a] @ block[b].T
    return out


def _sides(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that meet each other: one block and the other where these are all rows of a pair of blocks, else all and all."""
    if len(own) and low[0] != high[0] and (low == low[0]).all() and (high == high[0]).all():
        return np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0])
    return np.arange(len(own)), np.arange(len(own))


def _before(lists: pa.ListArray, run: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair have no term in common before the one under which they meet."""
    (a, at_a), (b, at_b) = (np.unique(x, return_inverse=True) for x in (i, j))
    rows = np.concatenate([a, b])
    return _shared(lists.take(pa.array(rows)), None, run[rows], np.arange(len(a)), np.arange(len(a), len(rows)))[at_a, at_b] == 0


def near_pairs(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j that are near points of one term and pair of blocks, each two points under their first common term alone.

    table: sorted by run (a term and a pair of blocks). Two points meet under every term that both have; terms come in one order, so the first one
    is where they have none in common before, and from there on the product is that of the whole vectors.
    """
    run, own, low, high = (table[n].to_numpy() for n in ("run", "own", "low", "high"))
    kept = _heavy(run, table["tail"].to_numpy(), least)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in _together(_cuts(run[kept])):
        some = kept[x:y]
        part = table.take(pa.array(some))
        part_run = run[some]
        mine, other = _sides(own[some], low[some], high[some])
        dots = _shared(part["ids"].combine_chunks(), part["ws"].combine_chunks().flatten().to_numpy(), part_run, mine, other)
        i, j = np.nonzero(dots >= least - SLACK)
        ordered = mine[i] < other[j] if len(mine) == len(some) else np.ones(len(i), bool)
        i, j = i[ordered], j[ordered]
        if len(i):
            alone_before = _before(part["before"].combine_chunks(), part_run, mine[i], other[j])
            a, b = some[np.minimum(mine[i], other[j])], some[np.maximum(mine[i], other[j])]
            met = alone_before & (np.minimum(own[a], own[b]) == low[a]) & (np.maximum(own[a], own[b]) == high[a])
            pairs.append((a[met], b[met]))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def degrees(table: pa.Table, least: float, enough: int) -> pa.Table:
    """node, others: of the points of some runs, how many sentences are near in them, up to `enough`. A row for each run and point at most."""
    i, j = near_pairs(table, least)
    m = table["m"].to_numpy()
    near = np.bincount(i, m[j], len(m)) + np.bincount(j, m[i], len(m))
    some = np.flatnonzero(near)
    return pa.table({"node": table["node"].take(pa.array(some)), "others": pa.array(np.minimum(near[some], enough).astype(np.int64))})


def reached(table: pa.Table, least: float) -> pa.Table:
    """node: the points of some runs that aren't core and have a core point near."""
    i, j = near_pairs(table, least)
    core = table["core"].to_numpy(zero_copy_only=False)
    at = np.unique(np.concatenate([i[~core[i] & core[j]], j[~core[j] & core[i]]]))
    return pa.table({"node": table["node"].take(pa.array(at))})


# ---------------------------------------------------------------- the sieve

PLACES = "term long, node long, at int, tail double"
SKETCHES = PLACES + ", lead array<long>, scale float, sketch binary"


def sketches(points: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """SKETCHES: the places of points under which they can meet others. points: node, ids (terms in order) and ws.

    A sketch holds for each bucket of terms the length of the vector's part in it, from the place on or from one before it; rounded up to 1/255 of the longest.
    """
    lists = points["ids"].combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    length, ids, ws = np.diff(offsets), lists.flatten().to_numpy(), points["ws"].combine_chunks().flatten().to_numpy()
    node, point = points["node"].to_numpy(), np.repeat(np.arange(len(length)), length)
    sums = np.append(0, np.cumsum((ws * ws).astype(np.longdouble)))  # in more digits, as a tail is a difference
    tail = np.sqrt(np.maximum(sums[offsets[1:]][point] - sums[:-1], 0)).astype(np.float64)
    places = np.bincount(point[tail >= least - SLACK], minlength=len(length))  # tails fall, so these come first
    step = np.maximum(1, -(-places // POINT_SKETCHES))
    # terms of sketches, and 16 bytes of what leaves, at most: a sum's square is no more than the length
    work = np.cumsum(-(-places // step) * length + places * np.minimum(2 * SKETCH_BUCKETS * length, MOST_BUCKETS) // 16) // SKETCHED_TERMS
    cuts = _cuts(work)
    for x, y in zip(cuts, cuts[1:], strict=False):
        who = np.repeat(np.arange(x, y), places[x:y])
        if not len(who):
            continue
        at = np.arange(len(who)) - np.repeat(np.cumsum(places[x:y]) - places[x:y], places[x:y])
        new = at % step[who] == 0
        made, of = np.flatnonzero(new), np.cumsum(new) - 1
        size = length[who[made]] - at[made]
        sketch = np.repeat(np.arange(len(made)), size)
        term = np.arange(len(sketch)) + np.repeat(offsets[who[made]] + at[made] - (np.cumsum(size) - size), size)
        wanted = SKETCH_BUCKETS * np.bincount(sketch, ws[term], len(made)) ** 2
        buckets = (2 ** np.ceil(np.log2(np.clip(wanted, LEAST_BUCKETS, MOST_BUCKETS)))).astype(np.int64)
        begin = np.append(0, np.cumsum(buckets))
        norms = np.sqrt(np.bincount(begin[sketch] + (ids[term] & (buckets[sketch] - 1)), ws[term] ** 2, begin[-1]))
        scale = np.nextafter(np.maximum.reduceat(norms, begin[:-1]).astype(np.float32), np.float32(2))
        levels = np.ceil(norms / np.repeat(scale, buckets) * 255).astype(np.uint8)
        told = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(levels)])
        lead = np.minimum(at, LEAD_TERMS)
        lead_begin = np.append(0, np.cumsum(lead))
        leads = ids[np.arange(lead_begin[-1]) + np.repeat(offsets[who] - lead_begin[:-1], lead)]
        here = offsets[who] + at
        yield from pa.table({
            "term": ids[here], "node": node[who], "at": at.astype(np.int32), "tail": tail[here], "lead": pa.ListArray.from_arrays(pa.array(lead_begin, pa.int32()), pa.array(leads)),
            "scale": scale[of], "sketch": told.take(pa.array(of)),
        }).to_batches(1000)


def _bounded(sizes: np.ndarray, begin: np.ndarray, data: np.ndarray, scale: np.ndarray, run: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a run whose sketches allow a near pair; a longer sketch is folded to the shorter one's buckets."""
    folded, held = np.zeros((0, 0), np.float32), np.zeros(0, np.int64)
    for c in np.unique(sizes)[::-1]:
        while len(held) and folded.shape[1] > c:
            half = folded.shape[1] // 2
            folded = np.hypot(folded[:, :half], folded[:, half:])
        new = np.flatnonzero(sizes == c)
        rows = data[begin[new][:, None] + np.arange(c)] * (scale[new][:, None] / np.float32(255))
        folded = np.concatenate([rows, folded]) if len(held) else rows
        held = np.concatenate([new, held])
        i, j = np.nonzero((rows @ folded.T >= least - BOUND_SLACK) & (run[new][:, None] == run[held]))
        yield new[i], held[j]


def hopeful(table: pa.Table, least: float) -> pa.Table:
    """PLACES: those of some runs that may have a near point under their term, which is the first that both have."""
    run, own, low, high, tail, scale = (table[n].to_numpy() for n in ("run", "own", "low", "high", "tail", "scale"))
    kept = _heavy(run, tail, least)
    found = []
    for x, y in _together(_cuts(run[kept])):
        some = kept[x:y]
        part = table.select(["lead", "sketch"]).take(pa.array(some))
        told, leads = part["sketch"].combine_chunks(), part["lead"].combine_chunks()
        begin = np.frombuffer(told.buffers()[1], np.int32, len(told) + 1, told.offset * 4).astype(np.int64)
        size = np.diff(leads.offsets.to_numpy())
        lead = np.zeros((len(some), LEAD_TERMS), np.int64)
        filled = np.arange(LEAD_TERMS) < size[:, None]
        lead[filled] = leads.flatten().to_numpy()
        for i, j in _bounded(np.diff(begin), begin[:-1], np.frombuffer(told.buffers()[2], np.uint8), scale[some], run[some], least):
            a, b = some[i], some[j]
            met = (a != b) & (tail[a] * tail[b] >= least - SLACK) & (np.minimum(own[a], own[b]) == low[a]) & (np.maximum(own[a], own[b]) == high[a])
            i, j = i[met], j[met]
            before = np.zeros(len(i), bool)
            for p in range(LEAD_TERMS):
                for q in range(LEAD_TERMS):
                    before |= filled[i, p] & filled[j, q] & (lead[i, p] == lead[j, q])
            found += [some[i[~before]], some[j[~before]]]
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return table.select(["term", "node", "at", "tail"]).take(pa.array(at))


# ---------------------------------------------------------------- all terms


def _by_run(places: DataFrame, terms: DataFrame, found: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `found` tells of whole runs. terms: term and k (its blocks); a hot term is dealt in pairs of blocks, and these terms are few."""
    run = ["term", "low", "high"]
    hot = broadcast_small(terms.filter("k > 1").select("term", "k"))
    dealt = places.join(hot, "term", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not table.num_rows:
                continue
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([(c := table[n].to_numpy())[1:] != c[:-1] for n in run])
            last = int(np.flatnonzero(new)[-1])  # the next batch may go on with this run
            if last:
                done = table.slice(0, last).append_column("run", pa.array(np.cumsum(new[:last]))).combine_chunks()
                yield from found(done).to_batches()
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield from found(rest.append_column("run", pa.array(np.zeros(rest.num_rows, np.int64))).combine_chunks()).to_batches()

    n = max(1, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.drop("other", "k").repartition(n, *run).sortWithinPartitions(*run).mapInArrow(whole, schema)


def _blocks(places: DataFrame, *wanted: Column) -> DataFrame:
    """term, n and k of the terms under which points can meet."""
    counts = places.groupBy("term").agg(F.count(F.lit(1)).alias("n"), *wanted)
    return counts.filter("n > 1").withColumn("k", F.ceil(F.col("n") * 2 / BLOCK_POINTS).cast("int"))


def _sieved(points: DataFrame, least: float) -> DataFrame:
    """PLACES of points that may have a near point there. points: node, ids and ws."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from sketches(pa.Table.from_batches([b]), least)

    # how many places a term has: tails are those of the sketches, so the counts are too but for the last digits
    squares = F.aggregate("ws", F.lit(0.0), lambda s, w: s + w * w)
    tails = F.aggregate("ws", F.struct(squares.alias("rest"), F.lit(0).alias("n")), lambda s, w: F.struct((s["rest"] - w * w).alias("rest"), (s["n"] + F.when(s["rest"] >= (least - SLACK) ** 2, 1).otherwise(0)).alias("n")))
    terms = materialized(_blocks(points.select(F.explode(F.slice("ids", F.lit(1), tails["n"])).alias("term"))).filter("k > 1"), "terms")
    found = _by_run(points.select("node", "ids", "ws").mapInArrow(sketched, SKETCHES), terms, lambda t: hopeful(t, least), PLACES)
    out = materialized(found, "places")
    discard(terms)
    return out.distinct()


def noise(sentences: DataFrame, min_df: int = MIN_DF, eps: float = EPS, min_samples: int = MIN_SAMPLES, stop_words: list[str] | None = None) -> DataFrame:
    """id of the sentences that stay. sentences: id and text."""
    spark = sentences.sparkSession
    importable(spark)
    least = 1 - eps
    rows, vectors = _vectors(sentences, min_df, stop_words)
    # the weights of equal term counts are equal, so rounding only guards the grouping
    named = materialized(vectors.withColumn("point", F.sha2(F.to_json(F.struct("ids", F.transform("ws", lambda w: F.round(w, 10)).alias("ws"))), 256)), "vectors")
    release(spark)
    firsts = named.groupBy("point").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("m"))
    points = named.select("row", "ids", "ws").join(firsts, "row").select("point", "m", "ids", "ws")
    points = materialized(points.withColumn("node", F.monotonically_increasing_id()), "points")  # which fixes the nodes' numbers
    names = materialized(named.select("row", "point"), "names")
    discard(named)
    places = _sieved(points, least)
    i = F.col("at")
    after, rest = F.slice("ids", i + 1, F.size("ids")), F.slice("ws", i + 1, F.size("ws"))
    prefixes = places.join(points.drop("point"), "node").select("node", "m", "term", "tail", F.slice("ids", F.lit(1), i).alias("before"), after.alias("ids"), rest.alias("ws"))
    prefixes = materialized(prefixes, "prefixes")
    release(spark)
    terms = materialized(_blocks(prefixes), "terms")
    near = _by_run(prefixes, terms, lambda t: degrees(t, least, min_samples), "node long, others long")
    degree = points.select("node", "point", "m").join(near.groupBy("node").agg(F.sum("others").alias("others")), "node", "left")
    others = F.coalesce("others", F.lit(0))
    judged = materialized(degree.select("node", "point", (F.col("m") + others >= min_samples).alias("core"), (others > 0).alias("near")), "judged")
    release(spark)
    # terms under which a core point can meet another
    marked = prefixes.join(judged.filter("near").select("node", "core"), "node")
    both = materialized(_blocks(marked, F.max("core").alias("some"), F.min("core").alias("every")).filter("some and not every").drop("some", "every"), "terms")
    touched = _by_run(marked.join(both.select("term"), "term", "left_semi"), both, lambda t: reached(t, least), "node long").distinct().join(judged, "node").select("point")
    gone = materialized(judged.filter("core").select("point").unionAll(touched), "gone")
    discard(prefixes, terms, both, judged, points)
    release(spark)
    return rows.join(names.join(gone, "point", "left_semi").select("row"), "row", "left_anti").select("id")
