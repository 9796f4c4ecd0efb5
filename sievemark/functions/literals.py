"""Literals that a regular expression can't match without, worked out from the expression: a plain
search for them spares most texts the expression itself."""

from __future__ import annotations

from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that match an ASCII letter when case doesn't matter, but don't become just it in lower case.
FOLDED = ("ſıİ", "sii")


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which any match holds one at least; none if that can't be said."""
    try:
        tree = parser.parse(pattern)
    except parser.error:
        return ()
    return _best(_of(tree)) or ()


def _best(sets: list[tuple[str, ...]]) -> tuple[str, ...] | None:
    """The set whose shortest literal is longest, the smaller of equals."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(tree) -> list[tuple[str, ...]]:
    """Sets of literals of a sequence, each of which is required by itself."""
    sets, run = [], ""
    for op, value in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run += chr(value).lower()
            continue
        if run:
            sets.append((run,))
            run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _best(_of(value[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _best(_of(value[2]))
        elif name == "BRANCH":
            each = [_best(_of(x)) for x in value[1]]
            inner = tuple(dict.fromkeys(x for s in each for x in s)) if all(each) else None
        if inner:
            sets.append(inner)
    return sets


def required_by_any(patterns: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Literals of which a match of any of the patterns holds one at least, without those that hold
    another; none if one of the patterns has none."""
    each = [required(p) for p in patterns]
    if not all(each):
        return ()
    found = {x for s in each for x in s}
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def folded(c: Column) -> Column:
    """A text in lower case, as the literals are searched in it."""
    # few texts have such letters, and looking for them costs less than translating
    return F.lower(F.when(holds_any(c, tuple(FOLDED[0])), F.translate(c, *FOLDED)).otherwise(c))


def holds_any(folded_text: Column, literals: tuple[str, ...]) -> Column:
    """Whether a folded text holds one of the literals; true if there are none to look for."""
    out = F.lit(not literals)
    for x in literals:
        out = out | F.contains(folded_text, F.lit(x))
    return out
