"""Python-flavoured regular expressions on Spark columns.

Java needs flags for Unicode classes and for line ends that are newlines only, its \\s lacks the
separators \\x1c-\\x1f, and braces must be escaped. `java` makes a Python pattern mean the same there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"\x1c-\x1f"
#: What str.isspace() calls white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def java(pattern: str, ignore_case: bool = False) -> str:
    out, i, in_class, first = [], 0, False, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\s":
                out.append(rf"\s{SEPARATORS}" if in_class else rf"[\s{SEPARATORS}]")
            elif pair == r"\S" and not in_class:
                out.append(rf"[^\s{SEPARATORS}]")
            else:
                out.append(pair)
            first = False
            i += 2
            continue
        if in_class:
            if c == "]" and not first:
                in_class = False
            elif c == "[" or (c == "&" and pattern[i : i + 2] == "&&"):
                c = "\\" + c
            first = first and c == "^"
        elif c == "[":
            in_class, first = True, True
        elif c == "]":
            c = r"\]"
        elif c in "{}" and not _quantifier(pattern, i):
            c = "\\" + c
        out.append(c)
        i += 1
    return ("(?diuU)" if ignore_case else "(?dU)") + "".join(out)


def _quantifier(pattern: str, i: int) -> bool:
    start = pattern.rfind("{", 0, i + 1)
    end = pattern.find("}", start)
    inside = pattern[start + 1 : end]
    return start > 0 and end >= i and bool(inside) and set(inside) <= set("0123456789,")


def replace(text: Column, pattern: str, replacement: str = "", limit: int | None = None) -> Column:
    """re.sub; \\1 in the replacement is a group. With a limit the replacement is literal and the first `limit` matches go."""
    if limit is None:
        return F.regexp_replace(text, F.lit(java(pattern)), F.lit(replacement.replace("\\", "$")))
    return F.array_join(F.split(text, java(pattern), limit + 1), replacement)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """re.search as a condition."""
    return text.rlike(java(pattern, ignore_case))


def strip(text: Column) -> Column:
    """str.strip with white space of any script."""
    return F.btrim(text, F.lit(WHITE))


def let(values: list[Column], body: Callable[..., Column]) -> Column:
    """body of the values, each of which is computed once however often body uses it."""
    bound = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.transform(bound, lambda x: body(*(x[f"v{i}"] for i in range(len(values)))))[0]


def fixpoint(text: Column, step: Callable[[Column], Column], rounds: Column) -> Column:
    """step applied until nothing changes, at most `rounds` times; later rounds cost nothing once it is stable."""
    start = F.struct(text.alias("now"), F.lit(None).cast("string").alias("before"))

    def turn(state: Column, _: Column) -> Column:
        return F.when(state["now"].eqNullSafe(state["before"]), state).otherwise(F.struct(step(state["now"]).alias("now"), state["now"].alias("before")))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, turn, lambda s: s["now"])
