"""Labels and identifiers in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.regex import java, matches, replace, strip


def _part(identifier: Column, pattern: str) -> Column:
    return F.regexp_extract(identifier, java(pattern, ignore_case=True), 1)


def _required(found: Column, identifier: Column) -> Column:
    return F.when(found == "", F.raise_error(F.concat(F.lit("Not an identifier of the form x.y.z: "), identifier)).cast("string")).otherwise(found)


def goal_of(identifier: Column) -> Column:
    """x of x.y.z; any other identifier is an error."""
    return _required(_part(identifier, P.GOAL_ID), identifier)


def target_of(identifier: Column) -> Column:
    """x.y of x.y.z; any other identifier is an error."""
    return _required(_part(identifier, P.TARGET_ID), identifier)


def first_label(labels: Column) -> Column:
    return strip(F.split(labels, ",")[0])


def repeats(labels: Column) -> Column:
    """A comma list without spaces, '' where it has one label."""
    parts = F.transform(F.split(labels, ","), strip)
    return F.when(F.size(parts) > 1, F.array_join(parts, ",")).otherwise("")


def squeeze(text: Column) -> Column:
    return replace(strip(text), r"\s+", " ")


def definition_or_name(name: Column, definition: Column) -> Column:
    """The stop at the end goes by the name's end, as in the reference."""
    return F.concat(F.when(definition == "", name).otherwise(definition), F.when(name.endswith("."), "").otherwise("."))


def name_and_definition(name: Column, definition: Column) -> Column:
    tail = F.concat(definition, F.when(definition.endswith("."), "").otherwise("."))
    return F.concat(name, F.when(name.endswith("."), " ").otherwise(". "), F.when(definition == "", "").otherwise(tail))


def multiple_labels(labels: Column, task: str) -> Column:
    """The labels of a comma list as the task sees them; null without labels, or where first and last agree."""
    parts = F.split(labels, ",")
    if task in ("MC-IND-SDG", "ML-IND-SDG"):
        pattern = P.GOAL_ID
    elif task == "MC-IND-TRG":
        pattern = P.TARGET_ID
    elif task == "ML-SDG-SDG":
        pattern = None
    else:
        raise ValueError(f"{task!r} is no task with several labels")
    if pattern:  # a label that isn't an identifier is taken as it is
        parts = F.transform(parts, lambda p: F.when(_part(p, pattern) == "", p).otherwise(_part(p, pattern)))
    return F.when((labels == "") | (parts[0] == F.element_at(parts, -1)), None).otherwise(parts)


def word_category(words: Column, edges: list[int]) -> Column:
    """1, 2, ... for counts up to each edge and beyond the last; null for 0."""
    out = F.when(words <= 0, F.lit(None).cast("int"))
    for k, edge in enumerate(edges, 1):
        out = out.when(words <= edge, k)
    return out.otherwise(len(edges) + 1)


def standard_target(target: Column) -> Column:
    return (target == "") | matches(target, P.TARGET_LABEL, ignore_case=True)
