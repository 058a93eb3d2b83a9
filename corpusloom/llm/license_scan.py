"""License scans by template-markup matching.

Templates (see licenses) are wording with marked regions: [[ ... ]] may be left out, (( a | b )) is one of its parts and <<k>>
stands for up to k words of any kind. Each template is compiled into an automaton over words; it accepts a
passage whose mandatory wording stands there word for word. Words are told apart by two 64-bit hashes, and an automaton is
started only where its first word stands before one that may follow, so texts without license wording cost one pass.

Cases: a null text is empty: no words, no labels, score 0; ids and extra columns play no part; repeated rows are
scanned alike; an empty table gives no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import licenses
from corpusloom.llm.shared import LOWER, plain, slices, small_batches, span_hash_pairs, spans_of, text_buffers

#: The phrases that are always looked for, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Bytes that end a word, \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F.
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _tokens(template: str) -> list[str]:
    return re.findall(r"\[\[|\]\]|\(\(|\)\)|\||<<\d+>>|[^\s\[\]()<>|]+", template)


class Automaton:
    """A template compiled to numbered states; words[s] leads from s to s + 1, free[s] leads on without a word, and a
    state in loops takes any word to s + 1."""

    def __init__(self, template: str):
        self.words: dict[int, str] = {}
        self.free: dict[int, list[int]] = {}
        self.loops: set[int] = set()
        self.at = 0
        tokens = _tokens(template)
        if self._sequence(tokens, 0) != len(tokens):
            raise ValueError(f"A region of a template is not closed, or not open: {template}")
        self.final = self.at
        self.start = self._closed({0})
        self.first = {self.words[s] for s in self.start if s in self.words}
        after = self._closed({s + 1 for s in self.start if s in self.words})
        self.second = {self.words[s] for s in after if s in self.words}
        self.any_first = bool(self.start & self.loops) or self.final in self.start
        self.any_second = bool(after & self.loops) or self.final in after

    def _edge(self, a: int, b: int) -> None:
        self.free.setdefault(a, []).append(b)

    def _sequence(self, tokens: list[str], i: int) -> int:
        """States for the tokens from i up to the end of their region; the place of what ends it."""
        while i < len(tokens) and tokens[i] not in ("]]", "))", "|"):
            token, begin = tokens[i], self.at
            if token == "[[":
                i = self._sequence(tokens, i + 1)
                self._edge(begin, self.at)
            elif token == "((":
                ends, mark = [], "|"
                while mark == "|":
                    self.at += 1  # no part begins where another ends
                    self._edge(begin, self.at)
                    i = self._sequence(tokens, i + 1)
                    mark = tokens[i] if i < len(tokens) else ""
                    ends.append(self.at)
                self.at += 1
                for end in ends:
                    self._edge(end, self.at)
            elif token.startswith("<<"):
                for _ in range(int(token[2:-2])):
                    self.loops.add(self.at)
                    self._edge(self.at, self.at + 1)
                    self.at += 1
            else:
                self.words[self.at] = token
                self.at += 1
            i += 1
        return i

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts(self, words: list[str]) -> bool:
        """Whether a beginning of the words is accepted."""
        states = self.start
        for w in words:
            if self.final in states:
                return True
            states = self._closed({s + 1 for s in states if s in self.loops or self.words.get(s) == w})
            if not states:
                return False
        return self.final in states


class Vocabulary:
    """Numbers for the words of templates and phrases; 0 for all others."""

    def __init__(self, words: set[str]):
        self.words = ["", *sorted(words)]
        raw = np.frombuffer("".join(self.words).encode(), np.uint8)
        sizes = np.array([len(w.encode()) for w in self.words[1:]], np.int64)
        ends = np.cumsum(sizes)
        one, two = span_hash_pairs(raw, ends - sizes, ends)
        self.order = np.argsort(one)
        self.one, self.two = one[self.order], two[self.order]

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.one):
            return np.zeros(len(starts), np.int64)
        one, two = span_hash_pairs(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), self.order[at] + 1, 0)

    def marked(self, words: set[str]) -> np.ndarray:
        """For each number, whether its word is one of the words."""
        out = np.zeros(len(self.words), bool)
        out[[self.words.index(w) for w in words]] = True
        return out


class Template:
    """label: what it stands for; whole: whether it is licensing words, not only a name."""

    def __init__(self, label: str, text: str, whole: bool, vocabulary: Vocabulary):
        self.label, self.whole, self.automaton = label, whole, Automaton(text)
        if self.automaton.any_first:
            raise ValueError(f"A template must begin with a word: {text}")
        self.first, self.second = vocabulary.marked(self.automaton.first), vocabulary.marked(self.automaton.second)

    def starts(self, words: np.ndarray, following: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places (of those in known) where its words may begin."""
        at = known[self.first[words[known]]]
        return at if self.automaton.any_second else at[self.second[following[at]]]


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates.

    score: 1 where licensing words stand, 0.75 where a license is named in a known way, 0.5 where only a phrase stands, else 0.
    """
    small_batches(docs.sparkSession)
    texts, notices = licenses.TEXTS if texts is None else texts, licenses.NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [(label, t, whole) for kind, whole in ((texts, True), (notices, False)) for label, all_of in kind.items() for t in all_of]
        phrases = [(p.split(), label) for p, label in BASE_PHRASES.items()]
        vocabulary = Vocabulary({w for _, t, _ in given for w in Automaton(t).words.values()} | {w for p, _ in phrases for w in p})
        templates = [Template(label, t, whole, vocabulary) for label, t, whole in given]
        numbered = [([vocabulary.words.index(w) for w in p], label) for p, label in phrases]
        for b in batches:
            raw, offsets = text_buffers(b.column("text"))
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates")}
            for x, y in slices(offsets):
                piece, offs = LOWER[raw[offsets[x] : offsets[y]]], offsets[x : y + 1] - offsets[x]
                starts, ends, rows = spans_of(BREAKS, piece, offs)
                words = vocabulary.numbers(piece, starts, ends)
                row = np.repeat(np.arange(y - x), np.diff(rows))
                n = len(words)
                following = np.zeros(n, np.int64)
                if n > 1:
                    following[:-1] = np.where(row[1:] == row[:-1], words[1:], 0)
                known = np.flatnonzero(words)
                places: dict[int, list[int]] = {}
                base: dict[int, set[str]] = {}
                found: dict[int, set[str]] = {}
                scores: dict[int, float] = {}
                accepted: dict[int, int] = {}
                for numbers, label in numbered:
                    m = n - len(numbers) + 1
                    if m < 1:
                        continue
                    hit = row[len(numbers) - 1 :] == row[:m]
                    for k, w in enumerate(numbers):
                        hit &= words[k : m + k] == w
                    for at in np.flatnonzero(hit).tolist():
                        r = int(row[at])
                        places.setdefault(r, []).append(at - int(rows[r]))
                        base.setdefault(r, set()).add(label)
                for template in templates:
                    for at in template.starts(words, following, known).tolist():
                        r = int(row[at])
                        end = min(int(rows[r + 1]), at + template.automaton.final + 1)
                        if template.automaton.accepts([vocabulary.words[i] for i in words[at:end].tolist()]):
                            found.setdefault(r, set()).add(template.label)
                            accepted[r] = accepted.get(r, 0) + 1
                            scores[r] = max(scores.get(r, 0.0), 1.0 if template.whole else 0.75)
                for r in range(y - x):
                    p = places.get(r, [])
                    out["n_words"].append(int(rows[r + 1] - rows[r]))
                    out["n_base"].append(len(p))
                    out["first_word"].append(min(p, default=None))
                    out["last_word"].append(max(p, default=None))
                    out["base_labels"].append(",".join(sorted(base.get(r, ()))))
                    out["labels"].append(",".join(sorted(base.get(r, set()) | found.get(r, set()))))
                    out["score"].append(scores.get(r, 0.5 if p else 0.0))
                    out["n_templates"].append(accepted.get(r, 0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return plain(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long")
