"""Language identification of words by a linear-chain conditional random field.

The words of a line are a chain. A word's features are its prefixes and suffixes of 1 to 3 characters, its n-grams
of 2 and 3 characters, all hashed to 2**FEATURE_BITS columns, and its entry in a lexicon of the training texts' most
frequent words; learned transitions join neighbours, so a word that says little takes its neighbours'
language, while a switch inside a line can still pay. Forward-backward gives each word's probabilities, whose mean over
a text is the text's answer. Training maximises the likelihood of lines, of which a part is spliced
from two languages to show switches.

The field is fitted on a bounded sample of labelled documents: of every language the DOCS_PER_LANGUAGE with the least hash of
doc_id, of each at most SAMPLE_CHARS characters, from a place that the hash gives, and LINES_PER_LANGUAGE lines. Lines
beyond CHAIN_WORDS words are several chains in training. The field then labels every word of every document, in whole lines, in one
pass. It takes about 0.14 MB for each language. A task keeps the scores of up to KNOWN_WORDS different words.

Cases: a null text, or one without any letter, gets `und` and score 0; without labelled documents every text does;
null ids are never learned from; ties go to the language that sorts first; repeated rows
are labelled alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.shared import LOWER, mix, plain, slices, small_batches, span_hashes, spans_of, text_buffers
from corpusloom.llm.toxicity import held_out

FEATURE_BITS = 15
DOCS_PER_LANGUAGE = 150
#: Characters of a text that the sample takes; they bound the sample's size, not what is labelled.
SAMPLE_CHARS = 20_000
LINES_PER_LANGUAGE = 1500
CHAIN_WORDS = 80
LEXICON_WORDS = 2000
#: Different words whose scores a task keeps at once.
KNOWN_WORDS = 400_000
#: Bytes of weights that a broadcast may have; more languages than fit are an error.
FIELD_BYTES = 1 << 31
EPOCHS = 3
BATCH_LINES = 64
UNDETERMINED = "und"

#: Letters in ASCII and all bytes of other characters make words.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _has_letter(raw: np.ndarray) -> bool:
    if not _BREAKS[raw[raw < 0x80]].all():
        return True
    return any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def word_columns(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the words' features in a row, word by word, and n + 1 bounds. raw: in lower case."""
    n = len(starts)
    char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character begins
    first, last = np.searchsorted(char, starts), np.searchsorted(char, ends)
    size = last - first
    owners, columns = [], []

    def take(kind: int, which: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        owners.append(which)
        columns.append((mix(span_hashes(raw, char[a], char[b]) + np.uint64(kind)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))

    for k in (1, 2, 3):
        which = np.flatnonzero(size >= k)
        take(k, which, first[which], first[which] + k)
        take(16 + k, which, last[which] - k, last[which])
    for k in (2, 3):
        many = np.maximum(size - k + 1, 0)
        which = np.repeat(np.arange(n), many)
        at = np.repeat(first, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        take(32 + k, which, at, at + k)
    owners, columns = np.concatenate(owners), np.concatenate(columns)
    order = np.argsort(owners, kind="stable")
    return columns[order], np.searchsorted(owners[order], np.arange(n + 1))


class Field:
    """The model: languages, a row of weights for each column and lexicon entry, and transitions."""

    def __init__(self, languages: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions

    def lexicon_rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each word's lexicon entry, or the last row, which is 0."""
        if not len(self.lexicon):
            return np.full(len(keys), len(self.weights) - 1)
        at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == keys, (1 << FEATURE_BITS) + at, len(self.weights) - 1)

    def word_scores(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Scores of each language for each of some words; raw in lower case."""
        columns, bounds = word_columns(raw, starts, ends)
        scores = self.weights[self.lexicon_rows(keys)]
        return scores + np.add.reduceat(self.weights[columns], bounds[:-1], axis=0) if len(columns) else scores


class KnownWords:
    """The scores of a task's words, each made once while it is kept."""

    def __init__(self, field: Field):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.field.languages)))

    def emissions(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of each language for each word; raw in lower case."""
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        distinct, first, inverse = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, np.uint64(0))[at] == distinct
        known[at == len(self.keys)] = False
        new = first[~known]
        if len(new):
            made = self.field.word_scores(raw, starts[new], ends[new], distinct[~known])
            self.keys, self.scores = np.insert(self.keys, at[~known], distinct[~known]), np.insert(self.scores, at[~known], made, axis=0)
        return self.scores[np.searchsorted(self.keys, distinct)][inverse]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Forward-backward over chains that lie one after another in scores.

    Returns each position's probabilities, the chains' log partition sums and, if asked, the
    expected transitions. Chains are handled together, longest first, a position at a time.
    """
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than t
    top = scores.max(1, keepdims=True)
    local = np.exp(scores - top)
    move = np.exp(transitions)
    forward, backward, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
    for t in range(steps):
        at = starts[: live[t]] + t
        a = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
        s = a.sum(1)
        scale[at] = s
        forward[at] = a / s[:, None]
    for t in range(steps - 1, -1, -1):
        at = starts[: live[t]] + t
        b = np.ones((len(at), k))
        m = live[t + 1] if t + 1 < steps else 0
        if m:
            nxt = at[:m] + 1
            b[:m] = (backward[nxt] * local[nxt] / scale[nxt, None]) @ move.T
        backward[at] = b
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    if not pairs:
        return both
    expected = np.zeros((k, k))
    inside = np.ones(n, bool)
    inside[starts] = False
    nxt = np.flatnonzero(inside)
    if len(nxt):
        right = backward[nxt] * local[nxt] / scale[nxt, None]
        expected = move * (forward[nxt - 1].T @ right)
    logs = np.log(scale) + top[:, 0]
    return both, float(logs.sum()), expected


def fit(examples: list[tuple[str, bytes]], seed: int = 7) -> Field:
    """From (language, text) pairs."""
    languages = sorted({lang for lang, _ in examples})
    k = len(languages)
    rng = np.random.default_rng(seed)
    lines: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    buffers, seen = [], []
    for lang, text in examples:
        raw = LOWER[np.frombuffer(text, np.uint8)]
        cuts = np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1, [len(raw)]])
        starts, ends, rows = spans_of(_BREAKS, raw, cuts)
        keys = span_hashes(raw, starts, ends)
        seen.append(keys)
        buffers.append(raw)
        for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
            for u in range(a, b, CHAIN_WORDS):
                v = min(b, u + CHAIN_WORDS)
                lines.append((languages.index(lang), len(buffers) - 1, starts[u:v], ends[u:v]))
    words, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
    lexicon = np.sort(words[np.argsort(-counts, kind="stable")[:LEXICON_WORDS]])
    size = (1 << FEATURE_BITS) + len(lexicon) + 1
    weights, transitions = np.zeros((size, k)), np.zeros((k, k))
    field = Field(languages, lexicon, weights, transitions)
    if k > 1 and lines:
        rng.shuffle(lines)
        taken, chosen = [0] * k, []
        for line in lines:
            taken[line[0]] += 1
            if taken[line[0]] <= LINES_PER_LANGUAGE:
                chosen.append(line)
        lines = chosen
        made = [(word_columns(buffers[i], a, b), field.lexicon_rows(span_hashes(buffers[i], a, b)), np.full(len(a), lang)) for lang, i, a, b in lines]
        g2, t2 = np.full((size, k), 1e-6), np.full((k, k), 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(made))
            for u in range(0, len(order), BATCH_LINES):
                _step(field, _spliced([made[i] for i in order[u : u + BATCH_LINES]], rng), g2, t2)
    field.weights, field.transitions = weights.astype(np.float32), transitions
    return field


def _spliced(batch: list, rng: np.random.Generator) -> list:
    """Every third line goes on as the line after it."""
    out, i = [], 0
    while i < len(batch):
        if i + 1 < len(batch) and rng.random() < 0.33:
            out.append([batch[i], batch[i + 1]])
            i += 2
        else:
            out.append([batch[i]])
            i += 1
    return out


def _step(field: Field, chains: list, g2: np.ndarray, t2: np.ndarray, rate: float = 0.2, penalty: float = 1e-5) -> None:
    """One AdaGrad step on the likelihood of the chains' labels."""
    lines = [line for chain in chains for line in chain]
    lengths = np.array([sum(len(line[2]) for line in chain) for chain in chains])
    gold = np.concatenate([line[2] for line in lines])
    lexicon = np.concatenate([line[1] for line in lines])
    columns = np.concatenate([line[0][0] for line in lines])
    counts = np.concatenate([np.diff(line[0][1]) for line in lines])
    word = np.repeat(np.arange(len(gold)), counts)
    k = len(field.languages)
    scores = field.weights[lexicon].copy()
    for j in range(k):
        scores[:, j] += np.bincount(word, weights=field.weights[columns, j], minlength=len(gold))
    both, _, expected = marginals(scores, lengths, field.transitions, pairs=True)
    error = both
    error[np.arange(len(gold)), gold] -= 1
    touched, at = np.unique(np.concatenate([columns, lexicon]), return_inverse=True)
    spread = np.concatenate([word, np.arange(len(gold))])
    gradient = np.stack([np.bincount(at, weights=error[spread, j], minlength=len(touched)) for j in range(k)], 1) / len(chains) + penalty * field.weights[touched]
    g2[touched] += gradient**2
    field.weights[touched] -= rate * gradient / np.sqrt(g2[touched])
    field.weights[-1] = 0
    first = np.zeros(len(gold), bool)
    first[np.cumsum(lengths) - lengths] = True
    nxt = np.flatnonzero(~first)
    observed = np.bincount(gold[nxt - 1] * k + gold[nxt], minlength=k * k).reshape(k, k) if len(nxt) else 0
    change = (expected - observed) / len(chains) + 1e-3 * field.transitions
    t2 += change**2
    field.transitions -= rate * change / np.sqrt(t2)


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(language, text) of per_language documents of each language that may be learned from, those with the least hash of doc_id and text.

    A first pass counts each language's documents; those whose hash lies below a bound that twice as many as wanted should lie under
    are then ordered within each language, so no window holds more than about that many.
    """
    from_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = from_.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    counts = [(r["lang"], -(2.0**63) + 2.0**64 * min(1.0, 2.0 * per_language / r["n"])) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    _fits(len(counts))
    bounds = docs.sparkSession.createDataFrame(counts, "lang string, bound double")  # as many languages as a field holds, at most
    near = usable.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(bounds), "lang").filter(F.col("h").cast("double") <= F.col("bound"))
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = near.select("lang", "h", "doc_id", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    return sorted((r["lang"], r["text"].encode()) for r in rows.select("lang", "text").toLocalIterator())


def _fits(languages: int) -> None:
    size = 4 * languages * ((1 << FEATURE_BITS) + LEXICON_WORDS + 1)
    if size > FIELD_BYTES:
        raise ValueError(f"{languages} languages make a field of {size} bytes, more than {FIELD_BYTES}")


def label(docs: DataFrame, field: Field, words: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches; with words also word_langs, each word's language."""
    spark = docs.sparkSession
    small_batches(spark)
    _fits(len(field.languages))
    shared = spark.sparkContext.broadcast(field)
    names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"] + ["word_langs"] * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, k = KnownWords(model), len(model.languages)
        for b in batches:
            raw_all, offsets = text_buffers(b.column("text"))
            out: list[tuple] = []
            for x, y in slices(offsets):
                raw, offs = LOWER[raw_all[offsets[x] : offsets[y]]], offsets[x : y + 1] - offsets[x]
                cuts = np.unique(np.concatenate([offs, np.flatnonzero(raw == 0x0A) + 1]))
                starts, ends, lines = spans_of(_BREAKS, raw, cuts)
                lengths = np.diff(lines)
                n = len(starts)
                if n and k:
                    both = marginals(known.emissions(raw, starts, ends), lengths[lengths > 0], model.transitions)
                    best = both.argmax(1)
                    total = np.concatenate([np.zeros((1, k)), np.cumsum(both, axis=0)])
                rows = np.searchsorted(starts, offs).tolist()
                for r, (u, v) in enumerate(zip(rows, rows[1:], strict=False)):
                    if not k or u == v or not _has_letter(raw[offs[r] : offs[r + 1]]):
                        out.append((UNDETERMINED, 0.0, v - u, 0, [UNDETERMINED] * (v - u)))
                        continue
                    mean = (total[v] - total[u]) / (v - u)
                    lang = int(np.round(mean, 12).argmax())
                    out.append((model.languages[lang], float(min(1.0, mean[lang])), v - u, int((best[u + 1 : v] != best[u : v - 1]).sum()), [model.languages[i] for i in best[u:v]] if words else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in list(zip(columns, kinds, strict=True))[: len(names) - 1])], names=names)

    labelled = plain(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_switches long" + ", word_langs array<string>" * words)
    return labelled.select("doc_id", held_out().alias("held_out"), *names[1:])


def identify(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    return label(docs, fit(sample(docs, per_language)))
