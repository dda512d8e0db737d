"""Shared-folder helpers: lineage is cut through files that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors must reach.

    Where it is unset, a local session, whose executors are the driver, sets a temporary folder of its
    own; on a cluster that is an error.  What is written there stays until the owner of the folder deletes it: later stages, retried tasks
    and lazily read results may still need it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def unused(columns: Iterable[str]) -> Callable[[str], str]:
    """Names for columns of our own that clash with none of ``columns``."""
    taken, prefix = [c.lower() for c in columns], "_q"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return lambda name: f"{prefix}_{name}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later steps reread files instead of recomputing what made them."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, found: DataFrame, keys: list[str], how: str, hottest: int = 512, slices: int = 4096, shuffled: bool = False) -> DataFrame:
    """``rows.join(found, keys, how)`` for an inner or left join, with hot keys dealt over many tasks.

    found holds one row a key, and in ``n`` how many of ``rows`` have that key; n is not returned.  Keys
    with over 1/``hottest`` of the sum of n are cut into parts of about 1/``slices`` of it: their rows are
    numbered into parts, and their row of found is repeated once a part.  Only those keys, of which there
    are fewer than ``hottest``, are broadcast by name; a small found is broadcast where Spark's size
    threshold says so, unless ``shuffled`` asks for the one plan that serves every size.
    """
    found = stored(found, "join-keys")
    name = unused([*rows.columns, *found.columns])
    part, count = name("part"), name("parts")
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / F.lit(max(1, total // slices))).cast("int")
    is_hot = F.col("n") * hottest > total
    hot = found.filter(is_hot).select(*keys, parts.alias(count))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(part, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(count)).cast("int"), F.lit(0))).drop(count)
    each = F.explode(F.sequence(F.lit(0), F.when(is_hot, parts - 1).otherwise(F.lit(0))))
    dealt_out = found.withColumn(part, each).drop("n")
    return dealt.join(dealt_out.hint("merge") if shuffled else dealt_out, [*keys, part], how).drop(part)


def a_task_each(files: DataFrame) -> DataFrame:
    """The rows of a manifest, a task each: the count is explicit, as adaptive execution would merge such
    small rows into one task, though a whole file stands behind each."""
    return files.repartitionByRange(max(1, files.count()), "path")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
