"""Wiki markup, each rule a column function."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.literals import where_needed
from corpusloom.functions.regex import fixpoint, replace


#: Levels of nested templates that one round takes away.
LEVELS = 40


def _rules(text: Column, *patterns: str, to: str = "") -> Column:
    return where_needed(text, *((p, partial(replace, pattern=p, replacement=to)) for p in patterns))


def drop_breaks(text: Column) -> Column:
    return _rules(text, P.BREAK)


def drop_subscripts(text: Column) -> Column:
    return _rules(text, *P.SUBSCRIPTS)


def drop_references(text: Column) -> Column:
    return _rules(text, *P.REFERENCES)


def unwrap_tags(text: Column) -> Column:
    return _rules(text, P.PAIRED_TAG, to=r"\1")


def drop_comments(text: Column) -> Column:
    return _rules(text, P.COMMENT)


def plain_spaces(text: Column) -> Column:
    return F.replace(text, F.lit("&nbsp;"), F.lit(" "))


def _opened(text: Column, mark: str) -> Column:
    """Rounds that suffice: each but the last takes away one opening mark at least."""
    return F.size(F.split(text, java_literal(mark))) + F.lit(1)


def java_literal(mark: str) -> str:
    return "".join("\\" + c for c in mark)


def nested_templates(levels: int = LEVELS) -> str:
    """A template with templates inside, to so many levels, as one (Java) pattern.

    What is taken away is what rounds of P.TEMPLATE take away, from the inside out: whatever order innermost templates go in, the same text is left, as two of them
    never overlap. A template that begins with another one, or is deeper, waits for the next round. Groups are possessive, which runs them
    in a loop, so long templates need no deep stack.
    """
    pattern = r"\{\{[^{}]++\}\}"
    for _ in range(levels - 1):
        pattern = rf"\{{\{{[^{{}}]++(?:{pattern}[^{{}}]*+)*+\}}\}}"
    return pattern


def drop_templates(text: Column) -> Column:
    """Templates with all that they hold, until none is left; an empty one stays."""
    step = lambda t: F.regexp_replace(t, F.lit(nested_templates()), F.lit(""))
    return where_needed(text, (P.TEMPLATE, lambda t: fixpoint(t, step, _opened(t, "{{"))))


def drop_files(text: Column) -> Column:
    return _rules(text, *P.FILE_LINKS)


def unwrap_urls(text: Column) -> Column:
    return _rules(_rules(text, P.LABELLED_URL, to=r"\1"), P.BARE_URL)


def drop_quotes(text: Column) -> Column:
    return _rules(text, P.QUOTES)


def strip_markup(text: Column) -> Column:
    """What is done to a whole article before it is split into lines."""
    for rule in (drop_breaks, drop_subscripts, drop_references, unwrap_tags, drop_comments, plain_spaces, drop_templates, drop_files, unwrap_urls, drop_quotes):
        text = rule(text)
    return text


def unwrap_links(text: Column) -> Column:
    """Internal links to their labels, from the inside out."""
    step = lambda t: replace(replace(t, P.PIPED_LINK, r"\2"), P.PLAIN_LINK, r"\1")
    return where_needed(text, (P.PLAIN_LINK, lambda t: fixpoint(t, step, _opened(t, "[["))))


def collapse_spaces(text: Column) -> Column:
    return replace(text, P.SPACES, " ")


def strip_links(text: Column) -> Column:
    """What is done to each paragraph."""
    return collapse_spaces(unwrap_links(text))
