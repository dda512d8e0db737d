"""Operators of the library against plain Python, at several sizes of their parts, with nulls, ties and empty input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered
from quillspark.operators.quantiles import exact_quantile
from quillspark.operators.relational import best_at_first_place, join_dealt


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "two", "one", "none"])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile_equals_interpolation(spark, kind, q):
    """Narrowing starts at eleven values, so that every branch of the selection is taken."""
    rng = np.random.default_rng(len(kind))
    values = {
        "spread": rng.normal(size=2001).tolist(),
        "ties": rng.integers(0, 4, 1000).astype(float).tolist(),
        "skewed": (10.0 ** rng.integers(-8, 9, 1500)).tolist() + [1e300],
        "two": [1.0, 2.0],
        "one": [7.5],
        "none": [],
    }[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "x double")
    got = exact_quantile(df, "x", q, few=10, accuracy=20)
    assert got is None if not values else got == pytest.approx(float(np.quantile(values, q)), rel=1e-12)


def test_quantile_of_one_value_over_and_over(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4990, 3).otherwise(F.col("id")).alias("x"))
    assert exact_quantile(df, "x", 0.5, few=10, accuracy=20) == 3.0
    assert exact_quantile(df, "x", 1.0, few=2, accuracy=20) == 4999.0


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_numbers_are_dense_whatever_the_partitions(spark, partitions):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.random(), k, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, v double, id int, _c_part string")
    got = {r["id"]: (r["n"], r["_c_part"]) for r in numbered(df, ["key"], [F.desc("v"), "id"], "n", partitions).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = (n, "x")
    assert got == want
    assert numbered(df.filter("false"), ["key"], ["id"]).collect() == []


def test_numbers_by_several_keys_and_none(spark):
    df = spark.createDataFrame([(k % 3, k % 2, k) for k in range(60)], "a int, b int, id int")
    got = sorted(tuple(r) for r in numbered(df, ["a", "b"], ["id"], "rank", 5).collect())
    assert got == sorted((k % 3, k % 2, k, k // 6 + 1) for k in range(60))
    assert [r["rank"] for r in numbered(df, [], ["id"], "rank", 4).orderBy("id").collect()] == list(range(1, 61))
    assert "Window" in numbered(df, ["a"], ["id"])._jdf.queryExecution().toString()


def test_dealt_join_keeps_the_callers_columns(spark):
    rows = spark.createDataFrame([(k % 2, k, -k) for k in range(40)], "key int, _part int, _parts int")
    found = rows.groupBy("key").agg(F.max("_part").alias("top"), F.count(F.lit(1)).alias("n"))
    got = sorted(tuple(r) for r in join_dealt(rows, found, ["key"], rows_a_part=3).select("key", "_part", "_parts", "top").collect())
    assert got == sorted((k % 2, k, -k, 38 + k % 2) for k in range(40))


def test_best_row_keeps_the_callers_columns(spark):
    rows = spark.createDataFrame([("a", 1.0, 1, 7), ("a", 3.0, 2, 8), ("b", 2.0, 3, 9)], "key string, score double, pos int, _rank int")
    got = sorted(tuple(r) for r in best_at_first_place(rows, ["key"]).select("key", "score", "pos", "_rank").collect())
    assert got == [("a", 3.0, 1, 8), ("b", 2.0, 3, 9)]
