"""Rule chains that mask labels and common phrases.

Some 75 rules, a third of them in rounds, meet each text. What tells most of them off is whether the text has a few literals, and a search for these is far
faster in a Python string than in a column function, so a task's texts come as Arrow arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.literals import required
from corpusloom.functions.regex import WHITE
from corpusloom.workers import importable

Rules = list[tuple[str, str, bool]]

#: Matches that a limited rule replaces.
LIMIT = 2
#: Parts of patterns that every match holds and that are found sooner: they begin with a rare literal, if need be looking back from it.
PARTS = {
    r"(\*\s?)?[iI]ndicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?:?[^.]+\.": r"ndicator\s[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]",
    r'[0-9]{1,2}\.[0-9a-z]{1,2}\.[0-9]{1,2}(\.[a-z])?\.?\sis\s(the\s)?[“”"].+[“”"]\.$': r"\.(?<=[0-9]\.)[0-9a-z]{1,2}\.[0-9]",
    r"(indicator\s+)?[0-9]{1,2}\.[a-z0-9]{1,2}\.[0-9]{1,2}(\([a-z]\))?": r"\.(?<=[0-9]\.)[a-z0-9]{1,2}\.[0-9]",
    r"([a-z:]\s)(SDG\s)?[tT]arget\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?": r"arget\s+[0-9]{1,2}\.[a-zA-Z0-9]",
    r"[0-9]{1,2}\.[a-z0-9]{1,2}\.?: ": r": (?<=[a-z0-9.]: )",
    r"[iI]ndicator\s+[0-9]{1,2}\.[a-zA-Z0-9]{1,2}\.?": r"ndicator\s+[0-9]{1,2}\.[a-zA-Z0-9]",
    r"\s+\([0-9]{1,2}\.[a-z0-9]{1,2}\.?\)\s+": r"\([0-9]{1,2}\.[a-z0-9]",
    r"\s+[0-9]{1,2}\.[a-z0-9]{1,2}\.?\s+": r"\.(?<=[0-9]\.)[a-z0-9]",
    r"\s\(?[a-z]\)": r"\)(?<=[a-z]\))",
    r"\s\[?[a-z]]": r"](?<=[a-z]])",
    r"\s\(?[0-9]{1,2}\)": r"\)(?<=[0-9]\))",
    r"\s?\[[0-9]{1,2}]": r"\[[0-9]",
    r"([tT]he\s)([tT]he\s)+": r"he\s[tT]he\s",
}
#: Of the rules on numbers the one that needs none, and what each of the others needs unless a goal is named.
SPACE_RULES = P.NUMBER_RULES[-1:]
_NUMBER = re.compile(r"\.(?<=[0-9]\.)[a-zA-Z0-9]")
#: White space but the space itself, beside other white space. Listed characters are found sooner than a class.
_WIDE = re.compile("[" + WHITE.replace(" ", "") + r"](?:\s|(?<=\s\s))")


def wide(text: str) -> bool:
    """Whether white space stands beside white space."""
    return "  " in text or bool(_WIDE.search(text))


def squeezed(text: str) -> str:
    """A space for each run of white space."""
    inside = " ".join(text.split())
    if not inside:
        return " " if text else ""
    return " " * text[0].isspace() + inside + " " * text[-1].isspace()


@lru_cache(maxsize=None)
def _rule(pattern: str, replacement: str, limited: bool) -> Callable[[str], str]:
    if (pattern, replacement, limited) == (r"\s+", " ", False):
        return squeezed
    if (pattern, replacement, limited) == (r"\s{2,}", " ", False):
        return lambda t: re.sub(r"\s{2,}", " ", t) if wide(t) else t
    found, literals, part = re.compile(pattern), required(pattern), PARTS.get(pattern)
    first, count = part and re.compile(part).search, LIMIT if limited else 0

    def change(t: str) -> str:
        if literals and not any(x in t for x in literals):
            return t
        return t if first and not first(t) else found.sub(replacement, t, count=count)

    return change


def _masked(text: str, rules: Rules) -> str:
    """The rules one after another, each only where the text has what it needs."""
    for rule in rules:
        text = _rule(*rule)(text)
    return text


def numbered(text: str) -> bool:
    """Whether a rule on numbers can match, but for the one on spaces."""
    return "Goal" in text or "SDG" in text or "sdg" in text or bool(_NUMBER.search(text))


def _without_numbers(text: str, links: bool) -> str:
    """Until nothing changes: a round that changes more than white space takes away a digit or a mention of the goal or target."""
    text, before = _masked(text, P.NUMBER_RULES_ONCE), None
    while text != before:
        before = text
        text = _masked(text, P.NUMBER_RULES if numbered(text) else SPACE_RULES)
        if links:
            text = _masked(text, P.NUMBER_RULES_LINKS)
    return text


def _clean(text: str, links: bool) -> str:
    numberless = _without_numbers(_masked(text, P.INDICATOR_RULES), links)
    return _masked(_masked(numberless, P.LIST_RULES), P.PHRASE_RULES)


def _of_texts(change: Callable[[str, bool], str], text: Column, links: Column) -> Column:
    """change of each text; a null stays one."""
    if spark := SparkSession.getActiveSession():
        importable(spark)

    def run(texts: pa.Array, flags: pa.Array) -> pa.Array:
        return pa.array((None if t is None else change(t, x) for t, x in zip(texts.to_pylist(), flags.to_pylist(), strict=True)), pa.string())

    return F.arrow_udf(run, "string")(text, links)


def mask(text: Column, rules: Rules) -> Column:
    return _of_texts(lambda t, _: _masked(t, rules), text, F.lit(False))


def _links(section: Column) -> Column:
    """The section on links with other goals has rules of its own."""
    return F.coalesce(F.lower(section) == "links with other sdgs", F.lit(False))


def mask_indicators(text: Column) -> Column:
    return mask(text, P.INDICATOR_RULES)


def mask_numbers(text: Column, section: Column) -> Column:
    return _of_texts(_without_numbers, text, _links(section))


def mask_lists(text: Column) -> Column:
    return mask(text, P.LIST_RULES)


def mask_phrases(text: Column) -> Column:
    return mask(text, P.PHRASE_RULES)


def clean(text: Column, section: Column) -> Column:
    return _of_texts(_clean, text, _links(section))
