"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A window of documents (up to WINDOW_BYTES of text) is cut into pre-tokens, and its distinct
pre-tokens are encoded together: an inverted index holds, for each rank, the places where a pair
of that rank stands in any of the words. Ranks are taken in order, every place of a rank is merged,
and only the two pairs beside a merged place are ranked anew and listed. In a word that holds a rank at several
places, all that don't overlap are merged at once, from the left; a word where a merge gives a pair of lower rank, which
would have to go before the next place, is replayed by itself with an index in order of rank and place. Words of earlier
windows are kept in a table of bounded size, so that a frequent word is replayed once in a worker. Words are looked up by
one 64-bit hash and compared by a second one; should these ever disagree, the table is made anew with other
hashes. No shuffle: encoding is one pass over the table.

Cases: a null text counts as empty and has no ids; a null doc_id is carried through; repeated rows are
encoded alike; extra columns are ignored; an empty table gives no rows; texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.shared import doc_ids, plain, slices, small_batches, span_hash_pairs, text_buffers

#: Text whose words are replayed together.
WINDOW_BYTES = 24 << 20
#: Entries at which a worker's table of known words starts anew.
TABLE_WORDS = 2_000_000

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: The characters with the White_Space property.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or other."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(low, high)))
            for kind, rule in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
                for m in regex.finditer(rule, text):
                    table[low + m.start() : low + m.end()] = kind
        table[_WHITE_SPACE] = _SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the matches of the byte-level pattern in code points, each row by itself.

    rows: n + 1 offsets of the rows in points. The pattern's parts are: contractions after an
    apostrophe, runs of letters, of numbers or of other marks, each with one space before it, and
    white space, whose last character is left to what follows.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    run = np.ones(n, bool)
    run[1:] = (kind[1:] != kind[:-1]) | row_start[1:n]
    start = run.copy()
    blank = points == 0x20
    # what follows a white-space run in its row
    after = np.flatnonzero(run[1:] & ~row_start[1:n] & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[blank[after - 1]]] = False
    # an apostrophe alone, with no space taken, before letters
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER) & ~row_start[1:n])
    if len(mark):
        one = points[mark + 1]
        room = mark + 2 < n
        two = np.where(room & ~row_start[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        single = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        taken = np.where(single, 1, np.where(pair, 2, 0))
        mark, taken = mark[taken > 0], taken[taken > 0]
        start[mark + 1] = False
        rest = mark + 1 + taken
        inside = rest < n
        start[rest[inside]] |= kind[rest[inside]] == _LETTER
    return np.flatnonzero(start)


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class MergeReplay:
    """Encodes many words at once by merges in rank order."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.base = max(ranks.values()) + 1
        made = [(ranks[x] * self.base + ranks[y], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (x := token[:k]) in ranks and (y := token[k:]) in ranks]
        table = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.pairs, self.pair_ranks = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32)
        self._merges = {divmod(key, self.base): rank for key, rank in made}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the two don't merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], self.NONE)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        todo = np.flatnonzero(whole < 0)
        lengths = np.ones(len(words), np.int64)
        ids, counts = self._replay([words[i] for i in todo])
        lengths[todo] = counts
        out = np.empty(int(lengths.sum()), np.int32)
        at = np.cumsum(lengths) - lengths
        known = whole >= 0
        out[at[known]] = whole[known]
        out[np.repeat(at[todo], counts) + _within(counts)] = ids
        return out, lengths

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if n == 0:
            return np.zeros(0, np.int32), sizes
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        after[ends] = -1
        before[ends + 1 - sizes] = -1
        paired = np.full(n, self.NONE, np.int32)  # the rank of the pair that begins at a place
        left = np.flatnonzero(after >= 0)
        paired[left] = self.rank(ids[left], ids[left + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def listed(places: np.ndarray) -> None:
            ranks = paired[places]
            open_ = ranks < self.NONE
            places, ranks = places[open_], ranks[open_]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for a, b in zip(bounds, bounds[1:]):  # noqa: B905
                r = int(ranks[a])
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(queue, r)

        alone: set[int] = set()  # words that are replayed by themselves
        listed(left)
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            places = places[paired[places] == r]
            if len(places) > 1:
                places = np.unique(places)
                if alone:
                    places = places[~np.isin(word[places], np.fromiter(alone, np.int32, len(alone)))]
            if not len(places):
                continue
            if len(places) > 1:
                follows = after[places[:-1]] == places[1:]  # overlaps the place before
                if follows.any():  # of overlapping places every other one is merged, the leftmost first
                    at = np.arange(len(places))
                    run = np.maximum.accumulate(np.where(np.append(True, ~follows), at, 0))
                    places = places[(at - run) % 2 == 0]
                several = word[places[1:]] == word[places[:-1]]
                if several.any() and len(early := self._early(r, places, ids, after, before)):
                    mine = word[places]
                    shared = np.unique(mine[1:][several])
                    if len(hard := np.intersect1d(mine[early], shared)):
                        alone.update(hard.tolist())
                        places = places[~np.isin(mine, hard)]
                        if not len(places):
                            continue
            gone = after[places]
            beyond = after[gone]
            ids[places] = r
            ids[gone] = -1
            paired[gone] = self.NONE
            after[places] = beyond
            has = beyond >= 0
            before[beyond[has]] = places[has]
            paired[places] = self.NONE
            right = places[has]
            paired[right] = self.rank(ids[right], ids[after[right]])
            prior = before[places]
            prior = prior[prior >= 0]
            paired[prior] = self.rank(ids[prior], ids[after[prior]])
            listed(np.concatenate([right, prior]))
        if alone:
            begin = np.cumsum(sizes) - sizes
            for w in sorted(alone):
                own = self._replay_one(self.byte_ids[np.frombuffer(words[w], np.uint8)])
                ids[begin[w] : begin[w] + sizes[w]] = -1
                ids[begin[w] : begin[w] + len(own)] = own
        kept = ids >= 0
        return ids[kept], np.bincount(word[kept], minlength=len(words))

    def _early(self, r: int, places: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which of the places, merged from the left, give a pair of a rank below r."""
        low = np.zeros(len(places), bool)
        beyond = after[after[places]]
        has = np.flatnonzero(beyond >= 0)
        low[has] = self.rank(np.full(len(has), r), ids[beyond[has]]) < r
        prior = before[places]
        has = np.flatnonzero(prior >= 0)
        left = ids[prior[has]]
        joined = has > 0
        joined[joined] = after[places[has[joined] - 1]] == prior[has[joined]]  # the place before is merged by then
        left[joined] = r
        low[has] |= self.rank(left, np.full(len(has), r)) < r
        return np.flatnonzero(low)

    def _replay_one(self, ids: np.ndarray) -> list[int]:
        """The ids of one word, from those of its bytes: merges in order of rank and place."""
        own = ids.tolist()
        n = len(own)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank = self._merges
        queue = [(r, i) for i in range(n - 1) if (r := rank.get((own[i], own[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if own[i] < 0 or j < 0 or rank.get((own[i], own[j])) != r:
                continue
            own[i], own[j] = r, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (new := rank.get((r, own[k]))) is not None:
                    heapq.heappush(queue, (new, i))
            h = before[i]
            if h >= 0 and (new := rank.get((own[h], r))) is not None:
                heapq.heappush(queue, (new, h))
        return [i for i in own if i >= 0]


def _within(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Clash(Exception):
    """Two words with one hash."""


class WordTable:
    """Ids of known words, looked up by one hash of the word and held to a second one."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.seed = encode, 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def reseed(self) -> None:
        self.seed += 1
        self.clear()

    def missing(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        if (self.checks[at[known]] != checks[known]).any():
            raise Clash
        return ~known

    def add(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        """keys: sorted, none known."""
        if not len(keys):
            return
        ids, lengths = self.encode(words)
        slots = np.arange(len(self.starts), len(self.starts) + len(keys), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots, self.checks = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots), np.insert(self.checks, at, checks)

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[np.searchsorted(self.keys, keys)]

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and the words' lengths."""
        lengths = self.lengths[slots].astype(np.int64)
        return self.ids[np.repeat(self.starts[slots], lengths) + _within(lengths)], lengths


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of a slice, and how many each row has."""
    text = raw.tobytes().decode("utf-8")
    lead = (raw & 0xC0) != 0x80
    if len(text) == len(raw):
        points, byte_at = raw, None
        rows = offsets
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero(lead), len(raw))
        rows = np.concatenate([[0], np.cumsum(lead)])[offsets]
    starts = pretokens(points, rows)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    counts = np.diff(np.searchsorted(starts, rows))
    if byte_at is not None:
        starts, ends = byte_at[starts], byte_at[ends]
    return starts, ends, counts


def _looked_up(columns: list[pa.Array], table: WordTable) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the columns: rows, keys of its different words, each place's word and the words of each row. The table knows them then."""
    parts, new = [], {}
    for column in columns:
        raw, offsets = text_buffers(column)
        for a, b in slices(offsets):
            piece, offs = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, counts = _cut(piece, offs)
            keys, checks = span_hash_pairs(piece, starts, ends, table.seed)
            distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            if (checks != checks[first][inverse]).any():
                raise Clash
            for i in np.flatnonzero(table.missing(distinct, checks[first])).tolist():
                at = first[i]
                word, check = new.setdefault(int(distinct[i]), (piece[starts[at] : ends[at]].tobytes(), checks[at]))
                if check != checks[at]:
                    raise Clash
            parts.append((b - a, distinct, inverse.astype(np.int32), counts))
    order = sorted(new)
    table.add(np.array(order, np.uint64), np.array([new[k][1] for k in order], np.uint64), [new[k][0] for k in order])
    return parts


def encode_window(columns: list[pa.Array], table: WordTable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the texts of the columns, in order: number of rows, their ids in a row and n + 1 offsets."""
    if len(table.keys) > TABLE_WORDS:
        table.clear()
    parts = None
    while parts is None:
        try:
            parts = _looked_up(columns, table)
        except Clash:
            table.reseed()
    for rows, distinct, inverse, counts in parts:
        slots = table.slots_of(distinct)[inverse] if len(distinct) else np.zeros(0, np.int32)
        ids, lengths = table.ids_of(slots)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        yield rows, ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def windows(batches: Iterator[pa.RecordBatch], limit: int = WINDOW_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        ordered = sorted(ranks, key=ranks.get)
        values = np.array([ranks[t] for t in ordered])
        sizes = np.zeros(values[-1] + 1, np.int64)
        sizes[values] = [len(t) for t in ordered]
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and n + 1 offsets of the ids in them."""
        sizes = self.sizes[ids]
        return self.bytes[np.repeat(self.starts[ids], sizes) + _within(sizes)], np.concatenate([[0], np.cumsum(sizes)])


_state: dict = {}


def _worker(key: str, make: Callable):
    """What a worker keeps from task to task."""
    if key not in _state:
        _state[key] = make()
    return _state[key]


def encode(docs: DataFrame, ranks_path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers), or in the ids' place ids_sha256 and decoded_sha256.

    ranks_path: a rank file, read on the driver; it has some thousand tokens, whatever the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    name = hashlib.sha256(lines.value).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _worker(f"ranks {name}", lambda: load_ranks(lines.value))
        table = _worker(f"table {name}", lambda: WordTable(MergeReplay(ranks)))
        decode = _worker(f"decoder {name}", lambda: Decoder(ranks))
        for held in windows(batches):
            encoded = encode_window([b.column("text") for b in held], table)
            ids_of_docs = pa.concat_arrays([b.column("doc_id") for b in held])
            done = 0
            for rows, ids, ends in encoded:
                wide = ids.astype("<u4")
                counts = np.diff(ends)
                spans = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
                doc = ids_of_docs.slice(done, rows)
                done += rows
                if digests:
                    view = memoryview(wide).cast("B")
                    text, at = decode(ids)
                    seen = memoryview(text)
                    yield pa.record_batch([
                        doc, pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                        pa.array([hashlib.sha256(seen[at[a] : at[b]]).hexdigest() for a, b in spans]),
                    ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.record_batch([doc, pa.array(counts, pa.int64()), pa.array([wide[a:b].tobytes() for a, b in spans], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    return plain(docs).mapInArrow(run, out)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and bytes (binary) of what encode() gave."""
    with open(ranks_path, "rb") as f:
        lines = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker("decoder " + hashlib.sha256(lines.value).hexdigest(), lambda: Decoder(load_ranks(lines.value)))
        for b in batches:
            texts = [decoder(np.frombuffer(x or b"", "<u4").astype(np.int64))[0].tobytes() for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


__all__ = ["Decoder", "MergeReplay", "WordTable", "decode", "doc_ids", "encode", "encode_window", "load_ranks", "pretokens", "windows"]
