"""Relational operators that Spark has no single call for.

Every one is a composition of DataFrame operations; top-k goes through ``orderBy().limit()``, which
Spark plans as per-partition top-k, and top-k per group through a ranked window, which it prunes
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh_names(columns: Iterable[str]) -> Callable[[str], str]:
    """Names for columns of our own that clash with none of ``columns``, whatever their case."""
    taken, prefix = [c.lower() for c in columns], "_c"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return lambda name: f"{prefix}_{name}"


def n_rows() -> Column:
    return F.count(F.lit(1))


def all_of(conditions: list[Column | None]) -> Column:
    """AND of the conditions that were given; true where none was."""
    return reduce(lambda x, y: x & y, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: list[Column | None]) -> Column:
    """OR of the conditions that were given; false where none was, so no actor sees no row."""
    return reduce(lambda x, y: x | y, [c for c in conditions if c is not None], F.lit(False))


def top_groups(df: DataFrame, key: str, n: int | None, measure: Column | None = None, name: str = "n") -> DataFrame:
    """Groups of ``key`` by falling measure (the count unless given), ties by the key; ``n`` of them or all."""
    out = df.groupBy(key).agg((F.count(F.lit(1)) if measure is None else measure).alias(name)).orderBy(F.desc(name), key)
    return out if n is None else out.limit(n)


def ranked(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).filter(F.col(name) <= n)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; null where the whole is zero."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The new snapshot: rows of ``source`` replace those of ``target`` that share their key."""
    return target.join(source.select(*key), key, "left_anti").unionByName(source)


def insert_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``source`` that an insert which skips conflicts would add, one a key."""
    return source.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def best_at_first_place(df: DataFrame, by: list[str], score: str = "score", pos: str = "pos") -> DataFrame:
    """One row a key: the best score's (ties: earliest), at the place where the key first occurs."""
    window, fresh = Window.partitionBy(*by), fresh_names(df.columns)
    first, rank = fresh("first"), fresh("rank")
    best = df.withColumns({first: F.min(pos).over(window), rank: F.row_number().over(window.orderBy(F.desc(score), pos))})
    return best.filter(F.col(rank) == 1).withColumn(pos, F.col(first)).drop(first, rank)


def join_dealt(rows: DataFrame, found: DataFrame, keys: list[str], rows_a_part: int = 1_000_000) -> DataFrame:
    """``rows.join(found, keys)`` where found has one row a key and in ``n`` how many rows have it.

    Rows of a key with over ``rows_a_part`` of them are dealt over parts, and its row of found is repeated
    once a part.  Only such keys, at most one for each ``rows_a_part`` rows, are broadcast: a few bytes a
    million rows.  n is not returned.
    """
    fresh = fresh_names([*rows.columns, *found.columns])
    part, several = fresh("part"), fresh("parts")
    parts = F.ceil(F.col("n") / F.lit(rows_a_part)).cast("int")
    hot = found.filter(F.col("n") > rows_a_part).select(*keys, parts.alias(several))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(part, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(several)).cast("int"), F.lit(0))).drop(several)
    each = found.withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(each, [*keys, part]).drop(part)
