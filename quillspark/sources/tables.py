"""Lazy readers of a folder of Parquet tables, and the clock that queries are pinned to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    """The pinned clock; no query reads the wall clock."""
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def as_turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


class Tables:
    """``t.events`` reads ``events.parquet``; nothing runs until an action does."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def costs(self) -> DataFrame:
        """Cost log: one row an event, its value as a six-digit decimal."""
        return self.events.withColumn("cost_usd", F.col("value").cast("decimal(10,6)"))

    @property
    def turns(self) -> DataFrame:
        """Chat messages in order."""
        return as_turns(self.conversations)

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        """A small literal table."""
        return self.spark.createDataFrame(list(rows), schema)
