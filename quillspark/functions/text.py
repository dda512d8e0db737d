"""Column functions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words) -> Column:
    return reduce(lambda x, y: x | y, [text.contains(w) for w in words])


def once(x: Column, use) -> Column:
    """use(x) with x computed once a row, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def first_match(text: Column, ladder, default: str | None = None) -> Column:
    """The name of the first rung one of whose substrings occurs; the order of rungs decides."""
    out = F.lit(default).cast("string")
    for name, words in reversed(list(ladder)):
        out = F.when(contains_any(text, words), name).otherwise(out)
    return out


def hits(text: Column, words) -> Column:
    """How many of the substrings occur."""
    return reduce(lambda x, y: x + y, [text.contains(w).cast("int") for w in words])


def pattern_hits(text: Column, patterns) -> Column:
    return reduce(lambda x, y: x + y, [text.rlike(p).cast("int") for p in patterns])


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def whitespace_chunks(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Windows of ``size`` words that overlap; a last window inside the one before it is left out."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    step = size - overlap
    return F.transform(
        F.array(tokens),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - overlap), F.lit(step)), lambda i: F.array_join(F.slice(w, i, size), " "))
        ),
    )[0]


def ladder_sql(text: str, ladder, default: str | None = None) -> str:
    """The CASE expression of ``first_match`` in SQL."""
    arms = " ".join(f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in words)} THEN {name!r}" for name, words in ladder)
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"
