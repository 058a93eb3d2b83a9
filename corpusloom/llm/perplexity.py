"""Quality rules: n-gram perplexity within language-specific bands.

The model is a modified Kneser-Ney model of 4-grams of UTF-16 units for each language. Nothing is folded: case, accents
and every script count, and four units are one 64-bit key without collisions. Keys are counted over all documents and
stay in Spark, spread by language and key, so the model grows with the corpus and is nowhere whole: no task, driver or
broadcast holds it. Each order's probabilities come from joins with the totals of its contexts and with the order below.

Partitions are read in blocks of BLOCK_BYTES of text. A first pass gives each block's different keys with their counts;
a join by language and key answers each block with the probabilities of its own keys alone. A second pass over the same
rows sends the texts to their block's answers. A block that is not the same in both passes is an error, not a guess.

There each document gets its base statistics and its log perplexity, which is told by letters, marks of letters and
numbers: spaces and signs cost what the model says but do not count. A sign behind every word is common once many
texts have it, and told by symbols it would be no more of a surprise than a letter. The bands of a language
are its median and the median deviation from it, over the different values of its documents (copies count once, so
that a large group of them doesn't narrow the band), from a histogram of log perplexities: a document is rejected
above or below BAND deviations. There is no least width but the histogram's step.

Cases: a null text has no words and fails the base rules; a null language is one of its own, and a language with
a single text has its own median and so is kept; a text without letters is told as one of a single letter; ids play no
part and may be null or repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import mix, release, slices, small_batches, span_hashes, stored, text_buffers, words_of

ORDER = 4
UNIT_BITS = 16
#: Of the small alphabet of Model, which tests hold the probabilities from Spark to.
SYMBOL_BITS = 5
#: Deviations (of the median, scaled as for a normal distribution) that a band reaches to either side.
BAND = 4.5
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Steps of the histogram for one unit of log perplexity.
STEPS = 1000
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 25

_PAD = (1 << UNIT_BITS) - 1
_KEYS = 1 << (SYMBOL_BITS * ORDER)
#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


#: UTF-16 units that perplexity is told by: letters, their marks and numbers of any script (and halves of characters beyond 16 bits).
LETTERS = np.array([0xD800 <= u < 0xE000 or unicodedata.category(chr(u))[0] in "LMN" for u in range(1 << UNIT_BITS)])


def unit_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends with each UTF-16 unit, and n + 1 bounds of the rows. Rows begin after padding."""
    units = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    size = ((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0)
    rows = np.concatenate([[0], np.cumsum(size)])[offsets]
    pad = ORDER - 1
    wide = np.full(len(units) + pad * len(rows), _PAD, np.uint64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = np.arange(len(units)) + pad * (row + 1)
    wide[at] = units
    key = wide[at]
    for k in range(1, ORDER):
        key |= wide[at - k] << np.uint64(UNIT_BITS * k)
    return key.view(np.int64), rows


def _name(lang: str | None) -> str:
    """A language as a key that is never null."""
    return "" if lang is None else "=" + lang


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each batch with the number of its block, which follows from the partition and the texts before."""
    part, number, held = TaskContext.get().partitionId() << 32, 0, 0
    for b in batches:
        size = int(text_buffers(b.column("text"))[1][-1])
        if held and held + size > BLOCK_BYTES:
            number, held = number + 1, 0
        held += size
        yield part | number, b


def _by_language(b: pa.RecordBatch) -> Iterator[tuple]:
    """Of each slice of a batch: bytes, offsets, keys, bounds of the rows and (language, its keys' places)."""
    raw_all, offsets = text_buffers(b.column("text"))
    langs = [_name(v) for v in b.column("lang").to_pylist()]
    codes = {v: k for k, v in enumerate(dict.fromkeys(langs))}
    of_row = np.array([codes[v] for v in langs], np.int64)
    for x, y in slices(offsets):
        raw, offs = raw_all[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
        keys, rows = unit_keys(raw, offs)
        of = np.repeat(of_row[x:y], np.diff(rows))
        yield raw, offs, keys, rows, [(v, np.flatnonzero(of == codes[v])) for v in dict.fromkeys(langs[x:y])]


def count(rows: DataFrame) -> DataFrame:
    """block, k (the language), gram and n: the different n-grams of each block."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def emit(block: int, held: dict) -> Iterator[pa.RecordBatch]:
        for k, parts in held.items():
            grams, counts = merged(parts)
            for at in range(0, len(grams), 1 << 16):
                some = grams[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(some), block)), pa.array([k] * len(some), pa.string()), pa.array(some), pa.array(counts[at : at + (1 << 16)])], names=["block", "k", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for block, b in _numbered(batches):
            if block != at:
                yield from emit(at, held)
                at, held = block, {}
            for _, _, keys, _, places in _by_language(b):
                for k, mine in places:
                    if len(mine):
                        parts = held.setdefault(k, [])
                        parts.append(np.unique(keys[mine], return_counts=True))
                        if len(parts) > 16:
                            parts[:] = [merged(parts)]
        yield from emit(at, held)

    return rows.mapInArrow(run, "block long, k string, gram long, n long")


# ---------------------------------------------------------------- the model


def _discounts(counts: np.ndarray) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float((counts == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return tuple(float(np.clip(v, 0.05, 0.95 * (k + 1))) for k, v in enumerate(d))


class Model:
    """The model in one place, over a small alphabet, as tests hold chances() to it. For orders 1 to ORDER: sorted n-grams with their interpolated probabilities, sorted contexts with their back-off weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int = 1 << SYMBOL_BITS):
        """grams: sorted 4-grams; counts: how often each stands in the corpus; alphabet: symbols that may follow at the lowest order."""
        self.alphabet = alphabet
        mask = lambda n: (1 << (SYMBOL_BITS * n)) - 1
        levels = [(grams.astype(np.int64), counts.astype(np.int64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: n-grams by the characters before them
            longer = levels[0][0]
            levels.insert(0, np.unique(longer & mask(n), return_counts=True))
        self.keys, self.chances, self.contexts, self.backoffs = [], [], [], []
        for n, (keys, n_seen) in enumerate(levels, 1):
            d1, d2, d3 = _discounts(n_seen)
            context, at = np.unique(keys >> SYMBOL_BITS, return_inverse=True)
            total = np.bincount(at, weights=n_seen)
            ones, twos, more = (np.bincount(at, weights=w) for w in (n_seen == 1, n_seen == 2, n_seen >= 3))
            discount = np.where(n_seen == 1, d1, np.where(n_seen == 2, d2, d3))
            backoff = (d1 * ones + d2 * twos + d3 * more) / total
            lower = self._chance(keys & mask(n - 1), n - 1) if n > 1 else np.full(len(keys), 1 / self.alphabet)
            self.keys.append(keys)
            self.chances.append((n_seen - discount) / total[at] + backoff[at] * lower)
            self.contexts.append(context)
            self.backoffs.append(backoff)

    def _chance(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1 / self.alphabet)
        own, chances = self.keys[n - 1], self.chances[n - 1]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        seen = own[at] == keys
        out = np.where(seen, chances[at], 0.0)
        rest = keys[~seen]
        if len(rest):
            context = rest >> SYMBOL_BITS
            c = np.minimum(np.searchsorted(self.contexts[n - 1], context), len(self.contexts[n - 1]) - 1)
            weight = np.where(self.contexts[n - 1][c] == context, self.backoffs[n - 1][c], 1.0)
            out[~seen] = weight * self._chance(rest & ((1 << (SYMBOL_BITS * (n - 1))) - 1), n - 1)
        return out

    def log_chances(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each 4-gram's last character after the others."""
        return np.log(self._chance(grams.astype(np.int64), ORDER))


def _level_chances(level: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """k, gram and chance of an order's n-grams, interpolated with the order below."""
    n = F.col("n")
    times = level.groupBy("k").agg(*(F.sum((n == c).cast("long")).alias(f"n{c}") for c in (1, 2, 3, 4)))
    c1, c2, c3, c4 = (F.col(f"n{c}").cast("double") for c in (1, 2, 3, 4))
    y = F.coalesce(F.try_divide(c1, c1 + 2 * c2), F.lit(0.5))
    cuts = [F.coalesce(1 - F.try_divide(2 * y * c2, c1), y), F.coalesce(2 - F.try_divide(3 * y * c3, c2), 2 * y), F.coalesce(3 - F.try_divide(4 * y * c4, c3), 3 * y)]
    times = stored(times.select("k", *(F.least(F.greatest(d, F.lit(0.05)), F.lit(0.95 * (i + 1))).alias(f"d{i + 1}") for i, d in enumerate(cuts))), f"discounts{order}")  # by language; Spark broadcasts it if its files are small
    context = F.shiftrightunsigned("gram", UNIT_BITS).alias("context")
    totals = level.groupBy("k", context).agg(F.sum("n").alias("total"), *(F.sum((c).cast("long")).alias(v) for v, c in (("ones", n == 1), ("twos", n == 2), ("more", n >= 3))))
    found = level.select("k", "gram", "n", context).join(totals, ["k", "context"]).join(times, "k")
    if lower is None:
        found = found.withColumn("lower", F.lit(1 / (1 << UNIT_BITS)))
    else:
        found = found.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(order - 1)))).join(lower.select("k", F.col("gram").alias("suffix"), F.col("chance").alias("lower")), ["k", "suffix"])
    discount = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    backoff = F.expr("d1 * ones + d2 * twos + d3 * more")
    return found.select("k", "gram", ((n - discount + backoff * F.col("lower")) / F.col("total")).alias("chance"))


def _mask(order: int) -> int:
    return (1 << (UNIT_BITS * order)) - 1


def chances(grams: DataFrame) -> DataFrame:
    """k, gram and chance: the probability of each n-gram's last unit after the others. grams: k, gram and n, in any number of parts."""
    levels = [stored(grams.groupBy("k", "gram").agg(F.sum("n").alias("n")), "grams4")]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: n-grams by the units before them
        shorter = levels[0].groupBy("k", F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, stored(shorter, f"grams{order}"))
    found = None
    for order, level in enumerate(levels, 1):
        found = stored(_level_chances(level, found, order), f"chances{order}")
    return found


# ---------------------------------------------------------------- statistics of a text


def _runs_by_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[rows[1:]] - total[rows[:-1]]


def base_statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, rows = words_of(raw, offsets)
    n = len(starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    words = span_hashes(raw, starts, ends)
    repeated = np.zeros(n, bool)
    if n >= 3:
        tri = mix(words[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(words[1:-1] + np.uint64(1)) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(row[:-2].astype(np.uint64)))
        whole = np.flatnonzero(row[2:] == row[:-2])
        _, at, times = np.unique(tri[whole], return_inverse=True, return_counts=True)
        again = whole[times[at] > 1]
        for k in range(3):
            repeated[again + k] = True
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 0x0A) + 1]))
    line_start = cuts[:-1]
    line_end = cuts[1:] - (raw[np.maximum(cuts[1:] - 1, 0)] == 0x0A) if len(raw) else cuts[1:]
    held = np.searchsorted(starts, cuts)
    worded = np.flatnonzero(held[1:] > held[:-1])
    of = np.searchsorted(offsets, line_start[worded], side="right") - 1
    line = mix(span_hashes(raw, line_start[worded], line_end[worded]) + mix(of.astype(np.uint64)))
    _, first = np.unique(line, return_index=True)
    later = np.ones(len(line), bool)
    later[first] = False
    size = len(offsets) - 1
    return {
        "n_words": np.diff(rows),
        "word_chars": _runs_by_row(chars, rows),
        "n_symbols": _runs_by_row(SYMBOLS[raw], offsets),
        "n_dup_lines": np.bincount(of[later], minlength=size),
        "n_repeat_words": _runs_by_row(repeated, rows),
    }


KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}


def _sent(rows: DataFrame) -> DataFrame:
    """block and payload: the rows of each batch, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _numbered(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(b)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    return rows.mapInArrow(run, "block long, payload binary")


def _scored(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows with base statistics and log_perplexity. answers: block, k, gram and log of every n-gram of each block."""
    names = ["doc_id", "lang", *KINDS, "log_perplexity"]

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        if len(found):
            coded = found.column("k").combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            codes, grams, logs = coded.indices.to_numpy(), found.column("gram").to_numpy(), found.column("log").to_numpy()
            for c, k in enumerate(coded.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == c)
                mine = mine[np.argsort(grams[mine])]
                tables[k] = grams[mine], logs[mine]
        made = []
        for payload in texts.column("payload").to_pylist():
            for b in pa.ipc.open_stream(payload):
                parts: dict[str, list[np.ndarray]] = {k: [] for k in [*KINDS, "log_perplexity"]}
                for raw, offs, keys, rows_at, places in _by_language(b):
                    for k, v in base_statistics(raw, offs).items():
                        parts[k].append(v)
                    logs_at = np.zeros(len(keys))
                    for k, mine in places:
                        if len(mine):
                            own, logs = tables.get(k, (np.zeros(1, np.int64), np.zeros(1)))
                            at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
                            if k not in tables or (own[at] != keys[mine]).any():
                                raise RuntimeError("the documents changed between two passes over them: store them first")
                            logs_at[mine] = logs[at]
                    letters = _runs_by_row(LETTERS[keys & _PAD], rows_at)
                    parts["log_perplexity"].append(0.0 - _runs_by_row(logs_at, rows_at) / np.maximum(letters, 1))
                done = {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}
                made.append(pa.record_batch([b.column("doc_id"), b.column("lang").cast(pa.string()), *(pa.array(done[k].astype(np.int64), t) for k, t in KINDS.items()), pa.array(done["log_perplexity"].astype(np.float64))], names=names))
        return pa.Table.from_batches(made)

    schema = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in KINDS) + ", log_perplexity double"
    return _sent(rows).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _median(rows: DataFrame, value: str) -> DataFrame:
    """Of each language, from counts by steps of the histogram: bounded by the steps, not the rows."""
    steps = rows.groupBy("lang", F.floor(F.col(value) * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy("step")
    steps = steps.select("lang", "step", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    return steps.filter("2 * upto >= all").groupBy("lang").agg((F.min("step") / STEPS).alias(value))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base statistics, base_failed, kept, log_perplexity and the language's bounds."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    grams = stored(count(rows), "block-grams")
    found = chances(grams).select("k", "gram", F.log("chance").cast("float").alias("log"))
    answers = stored(grams.select("block", "k", "gram").join(found, ["k", "gram"]), "answers")
    release(docs.sparkSession)  # shuffles of the model go before the texts move
    scored = _scored(rows, answers)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = stored(scored.withColumn("base_failed", failed), "scored")
    usable = scored.filter("not base_failed").select("lang", "log_perplexity").distinct()
    middle = stored(_median(usable, "log_perplexity").withColumnRenamed("log_perplexity", "middle"), "middle")
    away = usable.join(middle, usable["lang"].eqNullSafe(middle["lang"])).select(usable["lang"].alias("lang"), F.abs(F.col("log_perplexity") - F.col("middle")).alias("deviation"))
    bands = middle.alias("m").join(_median(away, "deviation").alias("d"), F.col("m.lang").eqNullSafe(F.col("d.lang")))
    width = BAND * 1.4826 * F.col("deviation") + 1 / STEPS
    bands = stored(bands.select(F.col("m.lang").alias("band_lang"), (F.col("middle") - width).alias("low"), (F.col("middle") + width).alias("high")), "bands")
    judged = scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left").drop("band_lang")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)
