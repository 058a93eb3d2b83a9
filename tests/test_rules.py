"""Each masking rule by itself, with its input and output written out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import masking
from corpusloom.functions import patterns as P
from corpusloom.functions.regex import WHITE

CASES = {
    "INDICATOR_RULES": [
        ("The target has one indicator: Share (all). Rest", " Rest"), ("x * Indicator 1.2.3: share;; y", "x  y"), ('A Indicator 1.2.3 is the "rate". B', "A  B"), ('A Indicator is 1.a.3. is the "rate". B', "A  B"),
        ("see Indicator 1.2.3 more", ""), ("A * indicator 1.2.3: share of all. B", "A  B"), ("indicator 1.2.3 share of all", ""), ('The 1.2.3 is the "rate".', "The "),
    ],
    "LIST_RULES": [("so (a) x", "so  x"), ("b) x", "  x"), ("so [x] y", "so  y"), ("(ii) x", "  x"), ("so 12) x", "so  x"), ("cited [7] x", "cited  x")],
    "NUMBER_RULES_ONCE": [('"a" “b” *c', "a b c"), ("a 'b", "a b"), ("b' c", "b c"), ("a  b", "a b")],
    "NUMBER_RULES": [
        ("indicator 1.2.3(a), 1.a.1, 2.2.2", "indicator, indicator, 2.2.2"), ("indicator 2.2 or", "indicator or"), ("Target 1.2. By", "The target By"), ("So. Target 3.b is", "So. The target is"),
        ("and SDG target 4.1 is", "and the target is"), ("x (target 5.2) y", "x  y"), ("x (targets 1.1, 1.2 and 1.3) y", "x  y"), ("1.1 – x", " x"), ("2.a: x", "x"),
        ("So. Targets 1.1 through 1.4 are", "So. The targets are"), ("Targets 1.1 and 1.2 are", "The targets are"), ("Indicator 1.1 is", "the target is"), ("x (SDG 5 or Goal 6) y", "x  y"),
        ("x (Goal 5 or Global Goal 6 ) y", "x  y"), ("x (SDG 5 or the goal) y", "x  y"), ("x (SDG 5, y)", "x (the goal y)"), ("Sustainable Goal 5 is", "The goal is"), ("So. SDG 5 is", "So. The goal is"),
        ("links SDG 3 to", "links the goal to"), ("a #Goal 12 b", "a #Goal  b"), ("a (1.1.) b", "a b"), ("a \n b", "a b"),
    ],
    "NUMBER_RULES_LINKS": [("a 1.1 b", "a b"), ("x the goal ; y", "x  y"), ("x (the goal the target) y", "x  y")],
    "PHRASE_RULES": [
        ("a \n b", "a b"), ("x A proposal has been tabled in 2020 to delete the target. y", "x  y"), ("In 2020 it was proposed to delete the former. y", " y"),
        ("The goal has five targets and six indicators to measure progress toward targets. y", " y"), ("The Goal has 12 indicators to measure progress toward targets. y", " y"),
        ("This target has two indicators: x", "x"), ("This target has two Xs", "Xs"), ("Its two indicators are: ;;", ""), ("It has only 2 indicators: x", "x"), ("The 5 targets are: x", "x"), ("Long title: x", "x"),
        ("The full text of the target is to: x", "x"), ("The full-title is: x", "x"), ("The target is formulated as: x", "x"), ("The text of the target is: x", "x"), ("The goal is to: x", "x"),
        ("The official wording of the goal is: x", " x"), ("The five outcome-oriented targets are: x", "x"), ("The first three targets are outcome targets: x", "x"), ("The 2 targets of the goal are the targets: x", "x"),
        ("The goal has 3 outcome targets: x", "x"), ("There are two indicators: ", ""), ("The two indicators are: The ", ""), ("Indicators include: ", ""), ('"a“*', "a"), ("a 'b", "a b"), ("b' c", "b c"),
        ("# x", "x"), ("a\t\tb", "a b"), ("The the the end", "The end"),
    ],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    rules, cases = getattr(P, name), CASES[name]
    assert len(rules) == len(cases)
    texts = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    rows = texts.select(F.array(*(masking.mask(F.col("text"), [r]) for r in rules)).alias("made"), "text").collect()
    made = {r["text"]: r["made"] for r in rows}
    assert [made[t][i] for i, (t, _) in enumerate(cases)] == [x for _, x in cases]


def test_parts_are_in_every_match():
    """What is looked for before a rule is tried: each match of the rule, in its own cases and in random texts, holds it."""
    rng = random.Random(8)
    pieces = [*"()[]*.,:;–'\"“”# \n\t ", "  ", "1.2", "3.b", "4.4.4", "12", "a)", "[x]", "(ii)", "Indicator ", "indicator ", "Target ", "target  ", "is the ", "the ", "The ", "Goal 5", "SDG 6", "sdg_7", "x "]
    texts = [t for cases in CASES.values() for t, _ in cases] + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(40_000)]
    known = {rule[0] for name in CASES for rule in getattr(P, name)}
    for pattern, part in masking.PARTS.items():
        found = [t for t in texts if re.search(pattern, t)]
        assert pattern in known and found, pattern
        assert all(re.search(part, t) for t in found), pattern
    for pattern, *_ in P.NUMBER_RULES[:-1]:
        assert all(masking.numbered(t) for t in texts if re.search(pattern, t)), pattern
    assert all(masking.wide(t) == bool(re.search(r"\s{2,}", t)) for t in [*texts, *(f"a{x}{y}b" for x in WHITE for y in WHITE), *(f"a{x}b" for x in WHITE)])
    assert all(masking.squeezed(t) == re.sub(r"\s+", " ", t) for t in [*texts, "", " ", "\n\n", " a"])


def test_long_texts_are_masked_in_a_pass(monkeypatch):
    """A text without a goal's or target's number meets no rule on numbers but the one on spaces, in any round."""
    tried = []
    monkeypatch.setattr(masking, "_masked", lambda t, rules, f=masking._masked: (tried.append(len(rules)), f(t, rules))[1])
    text = "Plain words of 1990, and  some more\n\nof 12 (or 7 ). " * 2000
    assert masking._clean(text, False) == python_clean(text)
    assert sum(tried) == sum(map(len, (P.INDICATOR_RULES, P.NUMBER_RULES_ONCE, masking.SPACE_RULES, P.LIST_RULES, P.PHRASE_RULES)))


def python_clean(text):
    for name in ("INDICATOR_RULES", "NUMBER_RULES_ONCE", "NUMBER_RULES", "LIST_RULES", "PHRASE_RULES"):
        for pattern, to, limited in getattr(P, name):
            text = re.sub(pattern, to, text, count=2 if limited else 0)
    return text
