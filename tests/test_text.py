"""Column functions against Python's own regular expressions and hand-made cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import markup, masking
from corpusloom.functions import patterns as P
from corpusloom.functions.regex import java
from corpusloom.functions.sentences import finish, join_sentences, pack_sentences, split_sentences, word_count


def apply(spark, function, *rows):
    """function of the columns a, b, ... on rows of values."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    names = list("abcd")[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"{n} string" for n in names)]))
    return [r[0] for r in df.orderBy("i").select(function(*(F.col(n) for n in names)).alias("x")).collect()]


def test_java_patterns():
    assert java(r"[\[\]a]]") == r"(?dU)[\[\]a]\]"
    assert java("{{[^{}]+}}") == r"(?dU)\{\{[^{}]+\}\}"
    assert java(r"\s{2,}") == r"(?dU)[\s\x1c-\x1f]{2,}"


def test_markup_rules(spark):
    cases = {
        markup.drop_breaks: [("a<br/>b<br />c<br>", "abc<br>")],
        markup.drop_subscripts: [("x<sub>1</sub>y<sub a/>z", "xyz")],
        markup.drop_references: [('a<ref name="x">t</ref>b<ref n/>c<ref n>d', "abcd")],
        markup.unwrap_tags: [("<b>x</i> <u><v>y</v></u>", "x <u>y</u>")],
        markup.drop_comments: [("a<!-- x -->.b<!--<-->", "ab<!--<-->")],
        markup.plain_spaces: [("a&nbsp;b", "a b")],
        markup.drop_templates: [("a{{b {{c}} {{d {{e}}}} }}f{{}}", "af{{}}")],
        markup.drop_files: [("[[File:a.png|x [[y]] z]]k[[Image:b|[http://u v]]]", "k")],
        markup.unwrap_urls: [("[http://a.b c d]", "c d"), ("x[https://d]y", "xy")],
        markup.drop_quotes: [("''a'' '''b''' 'c'", "a b 'c'")],
        markup.strip_links: [("[[a|b]] [[c]]  [[x [[y|z]] w]] [[:Image:q]] [[File:f]]", "b c x z w :Image:q [[File:f]]")],
    }
    for rule, pairs in cases.items():
        assert apply(spark, rule, *(a for a, _ in pairs)) == [b for _, b in pairs], rule.__name__


def python_mask(text, rules):
    for pattern, to, limited in rules:
        text = re.sub(pattern, to, text, count=2 if limited else 0)
    return text


def python_numbers(text, section):
    text = python_mask(text, P.NUMBER_RULES_ONCE)
    while True:
        new = python_mask(text, P.NUMBER_RULES)
        if section.lower() == "links with other sdgs":
            new = python_mask(new, P.NUMBER_RULES_LINKS)
        if new == text:
            return text
        text = new


PIECES = ["Indicator 1.2.3", "indicator 4.a.1(b) ", " Target 1.2. ", ". Target 3.b", "see SDG 5 ", "(SDG 3 or Goal 4)", "the goal ;", " 1.1 ", "“x”", "*", "' ", "\u00a0", "\u2003", "\n", ";; ", ". ", "the the ", "The goal has five targets and six indicators to measure progress.", "(a) ", "[7]", "(ii)", "x", "is the \"y\". ", "#Goal 12 ", "In 2020 it was proposed to delete the former."]
texts = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(texts, min_size=60, max_size=60))
def test_masking_is_as_python(spark, some):
    assert apply(spark, masking.mask_indicators, *some) == [python_mask(t, P.INDICATOR_RULES) for t in some]
    assert apply(spark, masking.mask_lists, *some) == [python_mask(t, P.LIST_RULES) for t in some]
    assert apply(spark, masking.mask_phrases, *some) == [python_mask(t, P.PHRASE_RULES) for t in some]
    for section in ("General", "Links with other SDGs"):
        assert apply(spark, lambda c, s=section: masking.mask_numbers(c, F.lit(s)), *some) == [python_numbers(t, section) for t in some]


def test_limited_rules_stop_after_two(spark):
    assert apply(spark, masking.mask_indicators, "Indicator 1.1.1 a. Indicator 1.1.2 b. indicator 1.1.3 c.") == [python_mask("Indicator 1.1.1 a. Indicator 1.1.2 b. indicator 1.1.3 c.", P.INDICATOR_RULES)]


def python_split(text):
    for pattern, to in P.ABBREVIATIONS:
        text = re.sub(pattern, to, text)
    pieces = [x for x in re.split(P.SEPARATORS, text) if x]
    for pattern, to in P.ABBREVIATIONS_BACK:
        pieces = [re.sub(pattern, to, x) for x in pieces]
    return pieces


def test_sentences(spark):
    some = ["See e.g. this. Then (etc.) that? No! U.S.A is;; end.Next", "", "U.S. x", "the (U.S.) plan, etc. And so. 2015.It i.e. ends etc."]
    assert apply(spark, split_sentences, *some) == [python_split(t) for t in some]
    assert apply(spark, word_count, " a\u00a0b\n c ", "", "x") == [3, 0, 1]
    assert apply(spark, join_sentences, ("A b", "c d"), ("A:", "Bc"), ("", "Bc"), ("A", "Bc"), ("A.", "B"), ("A", "c")) == ["A b c d", "A: Bc", "Bc", "A. Bc", "A. B", "A. c"]
    assert apply(spark, finish, "Done", "Done.", "Is it?", ". x") == ["Done.", "Done.", "Is it?", "x."]


def test_packing(spark):
    part = lambda n, c="W": c + " w" * (n - 1)
    packed = lambda *p: spark.createDataFrame([(list(p),)], "p array<string>").select(pack_sentences(F.col("p"))).first()[0]
    assert packed() == []
    assert packed("", "...", "Category:x", part(3)) == [part(3) + "."]
    assert [len(x.split()) for x in packed(part(25), part(20))] == [25, 20]  # full enough, so begun anew
    assert [len(x.split()) for x in packed(part(15), part(27), part(4))] == [42, 4]  # over the budget by less than it lacks
    assert [len(x.split()) for x in packed(part(5), part(60))] == [5, 60]
    assert packed(part(60))[0].endswith("w")  # emitted without a stop
    assert [len(x.split()) for x in packed(part(10), part(10), part(10))] == [30]


def test_labels(spark):
    assert apply(spark, L.goal_of, "7.b.1", "x 12.3.4") == ["7", "12"]
    assert apply(spark, L.target_of, "7.B.1") == ["7.B"]
    with pytest.raises(Exception, match="Not an identifier"):
        apply(spark, L.goal_of, "7")
    assert apply(spark, L.repeats, "a , b", "a", "") == ["a,b", "", ""]
    assert apply(spark, L.first_label, " a , b") == ["a"]
    lists = apply(spark, lambda c: L.multiple_labels(c, "ML-IND-SDG"), "", "1.2.3", "1.1.1,2.1.1,1.2.1", "1.1.1,2.b.1", "3,4")
    assert lists == [None, None, None, ["1", "2"], ["3", "4"]]
    with pytest.raises(ValueError, match="no task"):
        L.multiple_labels(F.lit(""), "x")
    assert apply(spark, lambda n, d: L.definition_or_name(n, d), ("N.", "D"), ("N", "")) == ["D", "N."]
    assert apply(spark, lambda n, d: L.name_and_definition(n, d), ("N.", "D"), ("N", ""), ("N", "D.")) == ["N. D.", "N. ", "N. D."]
    df = spark.createDataFrame([(n,) for n in (0, 10, 11, 15, 16, 20, 21)], "n int")
    assert [tuple(r) for r in df.select(L.word_category(F.col("n"), [10, 20]), L.word_category(F.col("n"), [15])).collect()] == [(None, None), (1, 1), (2, 1), (2, 1), (2, 2), (2, 2), (3, 2)]
    assert apply(spark, L.standard_target, "1.a", "", "1.abc", "12.10", "x", "1.A\n") == [True, True, False, True, False, False]
