"""What patterns need, and nested markup."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_rules import CASES
from test_text import apply

from corpusloom.functions import literals, markup
from corpusloom.functions import patterns as P

RULES = [r[0] for name in CASES for r in getattr(P, name)]
PATTERNS = [*RULES, P.BREAK, *P.SUBSCRIPTS, *P.REFERENCES, P.PAIRED_TAG, P.COMMENT, P.TEMPLATE, *P.FILE_LINKS, P.LABELLED_URL, P.BARE_URL, P.QUOTES, P.PIPED_LINK, P.PLAIN_LINK, *(p for p, _ in P.ABBREVIATIONS)]


@pytest.mark.parametrize(("pattern", "expected"), [
    ("abc+d", ("ab",)), ("(ab|cd)e?", ("ab", "cd")), ("[iI]ndex", ("index", "Index")), ("(ab)?x", ()), ("a.+bcd$", ("bcd",)), (r"\s+", ()), (r"^\(?[a-z]\)", (")",)), ("(?!no)yes", ("yes",)), ("(ab|c?)", ()),
])
def test_required(pattern, expected):
    assert literals.required(pattern) == expected


def test_every_match_has_what_its_pattern_needs():
    """Matches in the rules' own cases and in random texts of their pieces."""
    rng = random.Random(5)
    pieces = [*"<>[]{}()|'\"*#~;: .,-–\n", "br", "</b>", "ref", "[[", "]]", "{{", "}}", "http://a ", "File:", "Target", "target ", "1.2", "Indicator", "indicator ", "1.2.3", "Goal 5", "SDG", "the goal", "The targets are:", "etc.", "e.g.", "<!--", "-->"]
    texts = [t for cases in CASES.values() for t, _ in cases] + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(4000)]
    seen = set()
    for p in PATTERNS:
        for t in texts:
            if re.search(p, t):
                seen.add(p)
                assert not literals.required(p) or any(x in t for x in literals.required(p)), (p, t)
    assert len(seen) > len(PATTERNS) * 0.85


def _innermost(text):
    while (new := re.sub(P.TEMPLATE, "", text)) != text:
        text = new
    return text


def test_templates_as_rounds_take_them(spark):
    """Single, odd and empty braces, unbalanced ones, templates at the front of others, and more levels than a round takes."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["{{", "}}", "{", "}", "a", "|b", " "], [6, 6, 1, 1, 4, 2, 2], k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x" + "{{a" * n + "}}" * n + "y" for n in (1, 39, 40, 41, 130)] + ["{{" * 60 + "a" + "}}" * 60, "{{a " * 300 + "}}" * 10]
    assert apply(spark, markup.drop_templates, *texts) == [_innermost(t) for t in texts]


def test_deep_and_wide_markup(spark):
    """500 levels, and one template with 50,000 inside it: no stack overflows."""
    deep, wide = "x" + "{{a b" * 500 + "c}} d" * 500 + "y", "x{{ " + "{{a}} b " * 50_000 + "}}y"
    opened = "x {{ a " + "{{b}} " * 2000
    assert apply(spark, markup.drop_templates, deep, wide, opened) == [_innermost(deep), "xy", "x {{ a " + " " * 2000]
    links = "x " + "[[a b" * 60 + "]] c" * 60
    text = links
    while (new := re.sub(P.PLAIN_LINK, r"\1", re.sub(P.PIPED_LINK, r"\2", text))) != text:
        text = new
    assert apply(spark, markup.unwrap_links, links) == [text]


def test_rules_follow_each_other(spark):
    """A rule sees what the one before it has made; a hundred rules make no deep expression; a null stays one."""
    rules = [(chr(97 + i), lambda t, i=i: F.replace(t, F.lit(chr(97 + i)), F.lit(chr(98 + i)))) for i in range(25)]
    assert literals.required("a") == ()  # so they are tried on every text
    assert apply(spark, lambda a: literals.where_needed(a, *rules * 4), "abc", None) == ["zzz", None]
