"""Sentence splitting and greedy packing into excerpts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.literals import where_needed
from corpusloom.functions.regex import java, let, matches, replace, strip


def protect_stops(text: Column) -> Column:
    return where_needed(text, *((pattern, partial(replace, pattern=pattern, replacement=to)) for pattern, to in P.ABBREVIATIONS))


def restore_stops(text: Column) -> Column:
    """Every rule needs the mark that stands for a stop."""

    def back(t: Column) -> Column:
        for pattern, to in P.ABBREVIATIONS_BACK:
            t = replace(t, pattern, to)
        return t

    return F.when(F.contains(text, F.lit("~")), back(text)).otherwise(text)


def split_sentences(text: Column, separators: str = P.SEPARATORS) -> Column:
    """The text's pieces between separators; empty ones go."""
    pieces = F.filter(F.split(protect_stops(text), java(separators)), lambda p: p != "")
    return F.transform(pieces, restore_stops)


def word_count(text: Column) -> Column:
    """Words as str.split() counts them."""
    return F.size(F.filter(F.split(text, java(r"\s+")), lambda w: w != ""))


def join_sentences(one: Column, two: Column) -> Column:
    """Two fragments with the stop and space that belong between; with an empty second one, the first with its stop."""

    def joined(one: Column, two: Column) -> Column:
        spaced = F.concat(one, F.lit(" "), two)
        return (
            F.when(matches(two, r"^[^A-Z]."), spaced)
            .when(matches(one, r"^.+[:;?!]\s*$"), spaced)
            .when(one == "", two)
            .otherwise(F.concat(one, F.lit(". "), two))
        )

    text = let([strip(one), strip(two)], joined)
    for pattern, to in ((r"(\.\s?){2,}", ". "), (r"\s{2,}", " "), (r"^\.\s+", "")):
        text = replace(text, pattern, to)
    return strip(text)


def finish(text: Column) -> Column:
    return join_sentences(text, F.lit(""))


def join_all(parts: Column) -> Column:
    """All fragments in one, without a budget."""
    return F.aggregate(parts, F.lit(""), join_sentences)


def _cuts(words: Column, min_words: int, max_words: int) -> Column:
    """Which pieces make each excerpt, from the pieces' word counts: `at` (from 0), `size`, and how it begins and ends.

    An excerpt that ends before a piece which would take it beyond the budget is `closed` with a stop, and so is the last one. The one after such an
    excerpt begins with its piece as it is (`bare`).
    """
    kind = "array<struct<at:int,size:int,bare:boolean,closed:boolean>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("bare"))

    def state(done: Column, at: Column, i: Column, n: Column, bare: Column) -> Column:
        return F.struct(done.alias("done"), at.alias("at"), i.alias("i"), n.alias("n"), bare.alias("bare"))

    def cut(at: Column, size: Column, bare: Column, closed: bool) -> Column:
        return F.array(F.struct(at.alias("at"), size.alias("size"), bare.alias("bare"), F.lit(closed).alias("closed")))

    def step(s: Column, w: Column) -> Column:
        total, after = s["n"] + w, s["i"] + 1
        over = total > max_words
        before = over & ((s["n"] >= min_words) | ((s["n"] > 0) & (F.abs(total - max_words) >= F.abs(F.lit(min_words) - s["n"]))))
        return (
            F.when(before, state(F.concat(s["done"], cut(s["at"], s["i"] - s["at"], s["bare"], True)), s["i"], after, w, F.lit(True)))
            .when(over, state(F.concat(s["done"], cut(s["at"], after - s["at"], s["bare"], False)), after, after, F.lit(0), F.lit(False)))
            .otherwise(state(s["done"], s["at"], after, total, s["bare"]))
        )

    def end(s: Column) -> Column:
        return F.when(s["i"] > s["at"], F.concat(s["done"], cut(s["at"], s["i"] - s["at"], s["bare"], True))).otherwise(s["done"])

    return F.aggregate(words, start, step, end)


def pack_sentences(parts: Column, min_words: int = 20, max_words: int = 40) -> Column:
    """Excerpts of the pieces, in order, each as near the word budget as whole pieces allow.

    A fold over word counts finds where excerpts end; each excerpt's pieces are then joined once.
    """

    def skipped(p: Column) -> Column:
        return let([strip(p)], lambda bare: (p == "") | matches(bare, r"^\.+$") | matches(bare, r"^Category:.+$"))

    def excerpt(pieces: Column, c: Column) -> Column:
        first = F.element_at(pieces, c["at"] + 1)
        begun = F.when(c["bare"], first).otherwise(join_sentences(F.lit(""), first))
        text = F.aggregate(F.slice(pieces, c["at"] + 2, c["size"] - 1), begun, join_sentences)
        last = c["at"] + c["size"] == F.size(pieces)
        return let([text], lambda t: F.struct(F.when(c["closed"], finish(t)).otherwise(t).alias("text"), (last & (t == "")).alias("nothing")))

    def packed(pieces: Column) -> Column:
        made = F.transform(_cuts(F.transform(pieces, word_count), min_words, max_words), lambda c: excerpt(pieces, c))
        return F.transform(F.filter(made, lambda e: ~e["nothing"]), lambda e: e["text"])

    return let([F.filter(parts, lambda p: ~skipped(p))], packed)
