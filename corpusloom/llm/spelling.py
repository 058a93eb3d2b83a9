"""Spelling variant grouping: words one edit apart, by a positional q-gram inverted index with a count filter.

1. Words are counted over all texts; a dictionary of the words that are long and common enough remains.
2. Each word is padded and cut in q-grams with positions. Two words one edit apart share at least `least_shared` of them, at the same place
   or, after an inserted letter, one place on. So with q-grams in one fixed order, the rarest first, they share one of their first
   `PREFIX`: ties within a word go by position, and an edit keeps the order of what it leaves, so the first shared one is the same in both.
3. A word is indexed under each of those q-grams with its length and position, and looks itself up there, and among the words one
   letter shorter at its own place and the one before. What meets under one key is a small inverted index of its own: the postings of all
   q-grams of a word, within these limits of length and position, are merged by a heap that skips what can't reach the bound any more; words that reach it are
   verified letter by letter.
4. A key under which many words meet is dealt in blocks of BLOCK words; each word that looks there visits all of them.

The number of words near one is bounded by its length and the alphabet, so near pairs grow with the dictionary and no faster. The table of q-gram counts, which goes to all tasks, has
ALPHABET^3 entries at most (three megabytes).

Cases: a null text has no words; a null doc_id counts as an empty one before the colon; rows that repeat count each; a run of any length is a word; equal
counts go to the smallest word by code points; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.incidence import runs_of
from corpusloom.llm.shared import LOWER, broadcast_small, discard, partitions_for, plain, salted_join, slices, small_batches, spans_of, stored, text_buffers

#: A word's least code points and least occurrences; how much more common its form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
#: Of how many hashes one deletes a code point.
DELETE = 97
#: Letters of a gram; padded words of m letters have m + Q - 1 grams.
Q = 3
#: Rarest grams of a word that are indexed: one more than two words one edit apart may fail to share.
PREFIX = Q + 1
#: Letters: a-z, U+00C0 to U+00FF (upper case stays there), and 0 for padding.
ALPHABET = 1 + 26 + 64
#: Words that meet under one key in one block.
BLOCK = 1000
#: Distinct words that a task gathers before it sends them.
GATHER = 200_000
#: Runs longer than this are hashed one by one.
_BESIDE = 64

_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # crc32 is linear: T[i], as T[0] is 0
_LETTER = np.zeros(256, bool)  # bytes of letters: ASCII ones, and C3 with what follows it, which is U+00C0 to U+00FF
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
_BREAKS = np.array([True, False])


def least_shared(longer: int) -> int:
    """Grams that two words one edit apart share at least; longer: letters of the longer one."""
    return longer + Q - 1 - Q


# ---------------------------------------------------------------- words


def crc32_after(states: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes after what states (crc32 values) have taken in."""
    state = states ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    live, done = np.flatnonzero((size > 0) & (size <= _BESIDE)), 0
    while len(live):
        state[live] = _CRC[(state[live] ^ raw[starts[live] + done]) & np.uint32(255)] ^ (state[live] >> np.uint32(8))
        done += 1
        live = live[size[live] > done]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _BESIDE).tolist():
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(states[i]))
    return state


def altered_words(raw: np.ndarray, offsets: np.ndarray, ids: list[int | None], delete: int = DELETE, letters: int = LEAST_LETTERS) -> pa.Array:
    """The words of some texts, with a code point deleted where the hash says so; those with too few code points are left out."""
    low = LOWER[raw]
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    starts, ends, rows = spans_of(_BREAKS, inside.view(np.uint8), offsets)
    if not len(starts):
        return pa.array([], pa.string())
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32_after(np.repeat(before, np.diff(rows)), low, starts, ends)
    heads = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])  # code points before each byte
    points = heads[ends] - heads[starts]
    gone = np.flatnonzero(h % np.uint32(delete) == 0)
    place = np.searchsorted(heads, heads[starts[gone]] + h[gone] % points[gone].astype(np.uint32) + 1) - 1  # byte of the code point
    inside[place] = False
    wide = low[place] >= 0x80
    inside[place[wide] + 1] = False
    sizes = ends - starts
    sizes[gone] -= 1 + wide
    points[gone] -= 1
    kept = points >= letters
    edge = np.zeros(len(low) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    data = low[inside & (np.cumsum(edge[:-1]) > 0)]
    at = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def word_counts(docs: DataFrame) -> DataFrame:
    """word and its occurrences n, for the words of all texts."""

    def counted(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            for x, y in slices(offsets):
                found = pc.value_counts(altered_words(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], ids[x:y]).cast(pa.string()))
                parts.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if sum(p.num_rows for p in parts) > GATHER:
                parts = [counted(parts)]
                if parts[0].num_rows > GATHER // 2:
                    yield from parts[0].to_batches()
                    parts = []
        if parts:
            yield from counted(parts).to_batches()

    return plain(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- grams


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram codes of all words, one word after another, their positions, and the first gram of each word (n + 1 values)."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    letters = np.where(points >= 0xC0, points - 0xC0 + 27, points - 0x61 + 1)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size + 2 * (Q - 1))
    first = end - size - 2 * (Q - 1)
    padded = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    padded[np.repeat(first + Q - 1 - (np.cumsum(size) - size), size) + np.arange(len(letters))] = letters
    many = size + Q - 1
    rows = np.concatenate([[0], np.cumsum(many)])
    pos = np.arange(rows[-1]) - np.repeat(rows[:-1], many)
    at = np.repeat(first, many) + pos
    code = np.zeros(len(at), np.int64)
    for k in range(Q):
        code = code * ALPHABET + padded[at + k]
    return code, pos, rows


def _gram_counts(words: DataFrame) -> np.ndarray:
    """In how many places of the dictionary each gram stands; ALPHABET^Q values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**Q, np.int64)
        for b in batches:
            total += np.bincount(grams_of(b.column("word"))[0], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.record_batch([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["gram", "m"])

    table = words.select("word").mapInArrow(run, "gram int, m long").groupBy("gram").agg(F.sum("m").alias("m")).toArrow()
    counts = np.zeros(ALPHABET**Q, np.int64)
    counts[table["gram"].to_numpy()] = table["m"].to_numpy()
    return counts


def _postings(words: DataFrame) -> DataFrame:
    """gram, size, at, word, n, longer: index entries of each word, and (longer) its looks among words one letter shorter."""
    counts = words.sparkSession.sparkContext.broadcast(_gram_counts(words).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, pos, rows = grams_of(b.column("word"))
            many = np.diff(rows)
            row = np.repeat(np.arange(len(many)), many)
            order = np.lexsort((pos, code, counts.value[code], row))
            first = order[(np.arange(len(order)) - rows[row]) < PREFIX]
            row, code, pos = row[first], code[first], pos[first]
            size = (many - Q + 1)[row]
            out = [np.concatenate(x) for x in ((code, code, code), (size, size - 1, size - 1), (pos, pos, pos - 1), (row, row, row), (np.zeros(len(row), bool), *[np.ones(len(row), bool)] * 2))]
            kept = (out[1] >= LEAST_LETTERS) & (out[2] >= 0)
            gram, size, at, row, longer = (x[kept] for x in out)
            who = pa.array(row)
            yield pa.record_batch([pa.array(gram, pa.int32()), pa.array(size, pa.int32()), pa.array(at, pa.int32()), b.column("word").take(who), b.column("n").take(who), pa.array(longer)], names=["gram", "size", "at", "word", "n", "longer"])

    return words.mapInArrow(run, "gram int, size int, at int, word string, n long, longer boolean")


# ---------------------------------------------------------------- one key


def one_edit(a: str, b: str) -> bool:
    """Do a and b differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that stand in at least so many of the sorted lists.

    A heap has the front of every list. While the front's number is short of the bound, the lists that could not make it up
    jump past everything below the first that may.
    """
    at = [0] * len(lists)
    heap = [(postings[0], i) for i, postings in enumerate(lists) if postings]
    heapify(heap)
    while len(heap) >= least:
        number, popped = heap[0][0], []
        while heap and heap[0][0] == number:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            yield number
            upto = number + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            upto = max(number + 1, heap[0][0])
        for i in popped:
            at[i] = bisect_left(lists[i], upto, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))


def _places(word: str) -> list[tuple[str, int]]:
    padded = "\0" * (Q - 1) + word + "\0" * (Q - 1)
    return [(padded[k : k + Q], k) for k in range(len(word) + Q - 1)]


def near_words(index: list[str], same: list[str] | None, longer: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart: of words in `same` (or each two in `index`) and in `index`, all of one length, and of those in `longer`, one letter more, and in `index`."""
    postings: dict[tuple[str, int], list[int]] = {}

    def reached(lists: list[list[int]], word: str) -> Iterator[tuple[str, str]]:
        least = least_shared(len(word))
        if len(lists) >= least:
            for i in merged(lists, least):
                if one_edit(word, index[i]):
                    yield word, index[i]

    for i, word in enumerate(index):
        places = _places(word)
        if same is None and i:
            yield from reached([postings[p] for p in places if p in postings], word)  # those before it
        for place in places:
            postings.setdefault(place, []).append(i)
    for word in same or ():
        yield from reached([postings[p] for p in _places(word) if p in postings], word)
    for word in longer:
        lists = []
        for gram, k in _places(word):
            here, before = postings.get((gram, k)), postings.get((gram, k - 1))
            if here or before:
                lists.append(sorted({*here, *before}) if here and before else here or before)
        yield from reached(lists, word)


# ---------------------------------------------------------------- all keys

_KEY = ["gram", "size", "at"]


def _dealt(postings: DataFrame) -> DataFrame:
    """postings with the block of each: index entries (role 0) in one, looks (1: same length where there are several blocks, 2: longer) in every one."""
    keys = stored(postings.groupBy(_KEY).agg(F.count(F.when(~F.col("longer"), 1)).alias("k"), F.count(F.lit(1)).alias("m")).filter(F.col("k") > BLOCK).withColumn("k", F.ceil(F.col("k") / BLOCK).cast("int")), "hot-keys")
    role = F.when(F.col("longer"), 2).otherwise(0)
    if keys.isEmpty():
        discard(keys)
        return postings.select(*_KEY, "word", "n", role.cast("int").alias("role"), F.lit(0).alias("block"))
    small = broadcast_small(keys.select(*_KEY))
    cold = postings.join(small, _KEY, "left_anti").select(*_KEY, "word", "n", role.cast("int").alias("role"), F.lit(0).alias("block"))
    hot = salted_join(postings.join(small, _KEY, "left_semi"), keys, _KEY, "m", F.xxhash64("word"), max(1, keys.agg(F.sum("m")).first()[0] or 0))
    own = F.pmod(F.xxhash64("word"), F.col("k")).cast("int")
    looks = hot.select(*_KEY, "word", "n", F.when(F.col("longer"), 2).otherwise(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
    return cold.unionByName(hot.filter("not longer").select(*_KEY, "word", "n", F.lit(0).alias("role"), own.alias("block"))).unionByName(looks)


def _met(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """Row numbers of pairs one edit apart. rows: whole keys, sorted, with roles in order."""
    key = np.stack([rows[n].to_numpy() for n in (*_KEY, "block")], 1)
    role = rows["role"].to_numpy()
    cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key)) if len(key) else np.zeros(1, np.int64)
    size = np.diff(cuts)
    several = (size > 1) & (role[cuts[:-1]] == 0) if len(size) else np.zeros(0, bool)
    words = rows["word"].to_pylist()
    for x, y in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist(), strict=True):
        one, two = x + np.searchsorted(role[x:y], [1, 2])
        if one == x + 1 and one == y:
            continue
        at = {w: i for i, w in zip(range(y - 1, x - 1, -1), words[y - 1 : x - 1 if x else None : -1], strict=True)}
        for a, b in near_words(words[x:one], words[one:two] if two > one else None, words[two:y]):
            yield at[a], at[b]


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: each two words one edit apart, both ways, once. words: word, n."""
    buckets = partitions_for(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            found = np.array(list(_met(table)), np.int64).reshape(-1, 2)
            one, two = np.concatenate([found[:, 0], found[:, 1]]), np.concatenate([found[:, 1], found[:, 0]])
            return pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["word"].take(pa.array(one)), table["word"].take(pa.array(two)), table["n"].take(pa.array(two)))], names=["word", "near", "near_n"])

        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = 0  # where the last key begins, which the next batch may go on with
            if table.num_rows:
                key = np.stack([table[n].to_numpy() for n in (*_KEY, "block")], 1)
                last = int(np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)[-1])
            if last:
                yield pairs(table.slice(0, last).combine_chunks())
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield pairs(rest.combine_chunks())

    keys = [*_KEY, "block"]
    sorted_keys = _dealt(_postings(words)).repartition(buckets, *keys).sortWithinPartitions(*keys, "role")
    pairs = sorted_keys.mapInArrow(run, "word string, near string, near_n long")
    return pairs.repartition(buckets, "word").dropDuplicates(["word", "near"])


def _rooted(forms: DataFrame) -> DataFrame:
    """word and root, the last of its forms. forms: word and form, which no word leads back to, as counts rise."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not longer.filter("moved").isEmpty()
        now = longer.select("word", "root")  # twice as far as before
        if not moved:
            return now


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of the dictionary."""
    small_batches(docs.sparkSession)
    words = stored(word_counts(docs).filter(F.col("n") >= least), "dictionary")
    best = F.struct(-F.col("near_n"), F.col("near"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.col1")
    common = form_n >= times * F.col("n")
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, form_n).alias("form_n")), "forms")
    roots = _rooted(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
