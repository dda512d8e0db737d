"""Exact quantiles by distributed selection: no task holds more than a bounded number of values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.sinks import written

FEW, ACCURACY = 100_000, 10_000


def value_at(rows: DataFrame, rank: int, n: int, few: int, accuracy: int) -> float:
    """The value of rank ``rank`` (from 0) among the n values ``v`` of rows.

    A sketch names two values around the rank; exact counts below, at and between them say which of the
    values it is or in which open range it lies, and the range is searched in the same way.  Each step
    leaves out both ends, so ties cannot stall it.
    """
    inside, before = F.lit(True), 0
    while n > few:
        share, slack = (rank - before) / max(1, n - 1), 4 / accuracy
        ends = [max(0.0, share - slack), min(1.0, share + slack)]
        low, high = rows.filter(inside).agg(F.percentile_approx("v", ends, accuracy)).first()[0]
        v = F.col("v")
        below, at_low, between, at_high = rows.filter(inside).agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if((v == high) & (v > low))).first()
        k = rank - before
        if k < below:
            inside, n = inside & (v < low), below
        elif k < below + at_low:
            return low
        elif k < below + at_low + between:
            inside, before, n = inside & (v > low) & (v < high), before + below + at_low, between
        elif k < below + at_low + between + at_high:
            return high
        else:
            done = below + at_low + between + at_high
            inside, before, n = inside & (v > high), before + done, n - done
    return rows.filter(inside).orderBy("v").offset(rank - before).limit(1).first()[0]


def exact_quantile(df: DataFrame, value: Column | str, q: float = 0.5, few: int = FEW, accuracy: int = ACCURACY) -> float | None:
    """``percentile_cont(q)`` of a numeric column, as a double; null values are left out.

    None where there is no value.  Up to ``few`` values are sorted by one task; of more, ranges are
    narrowed first.  The values are written once, as every step reads them.  NaN counts as the greatest.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = written(df.select(value.cast("double").alias("v")).filter("v IS NOT NULL"), "quantile")
    n = rows.count()
    if not n:
        return None
    place = q * (n - 1)
    rank = math.floor(place)
    low = value_at(rows, rank, n, few, accuracy)
    if place == rank:
        return low
    upto, after = rows.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    high = low if upto > rank + 1 else after
    return low + (high - low) * (place - rank)
