"""Dense numbers within groups of any size, by two-level prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.relational import fresh_names
from quillspark.sources.sinks import written


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` where a group may hold any share of the rows.

    Rows are range-partitioned by group and order and written with their partition's number, each
    partition is numbered by itself, and the rows that a group has in earlier partitions are added.
    A partition continues at most one group of an earlier one, so the sums that are broadcast are no
    more than the partitions.  ``order`` must tell rows apart for the numbers to be determined; rows
    alike in all of ``by`` and ``order`` meet in one partition.  Null keys are a group.  A column named
    ``name`` is replaced; an empty table gives no rows.
    """
    df = df.drop(name)
    fresh = fresh_names(df.columns)
    part, before, keys = fresh("part"), fresh("before"), [fresh(f"key{k}") for k in range(len(by))]
    places = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *places) if partitions else df.repartitionByRange(*places)
    rows = written(ranged.withColumn(part, F.spark_partition_id()), "numbered")
    here = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order))
    counts = rows.groupBy(part, *[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.count(F.lit(1)).alias(before))
    earlier = F.sum(before).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.withColumn(before, earlier).filter(F.col(before).isNotNull()).withColumnRenamed(part, part + "_of")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.col(part) == F.col(part + "_of"))
    joined = rows.withColumn(name, here).join(F.broadcast(sums), same, "left")
    return joined.select(*df.columns, (F.col(name) + F.coalesce(before, F.lit(0))).alias(name))
