"""What a text must hold for a pattern to match: literals that every match has, found in the pattern itself.

A rule whose literals a text lacks can't change it, and a search for a few bytes costs a fraction of a regular expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals of one choice at most.
CHOICES = 8
#: Stand in nearly every text, alone.
COMMON = set(" .,") | set("abcdefghijklmnopqrstuvwxyz")


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The choice whose shortest literal is longer, of equal ones that without common signs, then that with fewer literals."""
    worth = lambda c: (min(map(len, c)), not COMMON & set(c), -len(c)) if c else (0, False, 0)
    return b if worth(b) > worth(a) else a


def _whole(op, value) -> tuple[str, ...] | None:
    """All texts that a group of alternatives stands for, if they are literals."""
    if op is C.SUBPATTERN and not value[1] and not value[2] and len(value[3]) == 1 and value[3][0][0] is C.BRANCH:
        branches = value[3][0][1][1]
        if all(kind is C.LITERAL for branch in branches for kind, _ in branch):
            return tuple("".join(chr(x) for _, x in branch) for branch in branches)
    return None


def _least(choice: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The choice without literals that hold another one of it."""
    return choice and tuple(x for x in choice if not any(y != x and y in x for y in choice))


def _choice(items) -> tuple[str, ...] | None:
    best: tuple[str, ...] | None = None
    runs: tuple[str, ...] = ("",)  # what may stand together at this place

    def end() -> None:
        nonlocal best, runs
        if all(runs):
            best = _better(best, runs)
        runs = ("",)

    for op, value in items:
        some: tuple[str, ...] | None = None
        if op is C.LITERAL:
            some = (chr(value),)
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in value):
            some = tuple(chr(x) for _, x in value)
        else:
            some = _whole(op, value)
        if some and all(some) and len(runs) * len(some) <= CHOICES:
            runs = tuple(r + s for r in runs for s in some)
            continue
        if op is C.AT:
            continue
        end()
        if some and all(some) and len(some) <= CHOICES:
            best = _better(best, some)
        elif op is C.SUBPATTERN:
            best = _better(best, _choice(value[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _choice(value[2]))
        elif op is C.BRANCH:
            every = [_choice(branch) for branch in value[1]]
            if all(every):
                joined = tuple(dict.fromkeys(x for c in every for x in c))
                best = _better(best, joined if len(joined) <= CHOICES else None)
    end()
    return best


@lru_cache
def required(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern has one; none if there is nothing to go by."""
    found = _least(_choice(parser.parse(pattern))) or ()
    return () if any(len(x) == 1 and x in COMMON for x in found) else found


def _has(text: Column, pattern: str) -> Column:
    literals = required(pattern)
    has = F.lit(True)
    for i, x in enumerate(literals):
        has = F.contains(text, F.lit(x)) if i == 0 else has | F.contains(text, F.lit(x))
    return has


def where_needed(text: Column, *rules: tuple[str, Callable[[Column], Column]]) -> Column:
    """The rules' changes one after another, each where the text has what the rule's pattern needs.

    A fold over the rules' numbers: each rule sees the text as the one before it has left it, the text is computed once, and the expression is as deep for a hundred
    rules as for one.
    """

    def turn(t: Column, k: Column) -> Column:
        out = None
        for i, (pattern, change) in enumerate(rules):
            due = (k == i) & _has(t, pattern)
            out = F.when(due, change(t)) if out is None else out.when(due, change(t))
        return out.otherwise(t)

    return F.aggregate(F.array(*(F.lit(i) for i in range(len(rules)))), text, turn)
