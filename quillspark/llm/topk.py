"""Exact top-k inner products by columnar branch-and-bound.

Candidates are dealt into blocks held column-wise, queries into blocks of their own; each pair of
blocks is one task group of bounded size.  Scores accumulate block of dimensions by block; after each,
the norms of what remains bound every candidate's score from both sides, and candidates that cannot
reach the k-th lower bound are compacted away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAFE = float(1 << 52)
TOP = "query_id long, vec_id long, score long"


def scaled(rows) -> np.ndarray:
    """floor(1024 * x) as doubles, which hold every scaled value exactly."""
    return np.floor(np.asarray(rows, np.float64) * 1024)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def top_of_block(columns: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, step: int, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates of a block (columns: dimension x candidate; tails: norms after each step)."""
    live = np.flatnonzero(ids != query_id)
    score = np.zeros(len(live))
    for b, at in enumerate(range(0, len(query), step)):
        score += query[at : at + step] @ columns[at : at + step, live]
        if at + step >= len(query) or len(live) <= k:
            continue
        slack = tails[b + 1, live] * np.linalg.norm(query[at + step :]) * (1 + 1e-9) + 1
        floor = np.partition(score - slack, len(live) - k)[len(live) - k]
        keep = score + slack >= floor
        if keep.mean() < 0.8:
            live, score = live[keep], score[keep]
    order = best(ids[live], score, k)
    return ids[live[order]], score[order].astype(np.int64)


def exact_top(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in whole Python numbers, for values whose products doubles cannot hold; scores are clipped to long."""
    live = np.flatnonzero(ids != query_id)
    whole = [int(x) for x in query]
    scores = [sum(a * int(b) for a, b in zip(whole, rows[i])) for i in live]
    order = sorted(range(len(live)), key=lambda j: (-scores[j], ids[live[j]]))[:k]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    return ids[live[order]], np.array([clip(scores[j]) for j in order], np.int64)


def exact_topk(vectors: DataFrame, k: int = 10, query_every: int = 100, block_rows: int = 4096, step: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates by integer inner product.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates are all rows but
    those with the query's own vec_id; ties go to the smaller vec_id.  Rows whose vec_id or vector is
    null, or whose vector is empty or holds a null or non-finite component, take no part; a query meets
    candidates of its own dimension only.  Rows repeated in full count once.  An empty table gives no
    rows; other columns are ignored.  Blocks hold about ``block_rows`` rows of either kind.
    """
    spark = vectors.sparkSession
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).filter((F.size("v") > 0) & finite)
    rows = valid.dropDuplicates()
    is_query = F.col("vec_id") % query_every == 0
    n, n_queries = valid.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, query_blocks = -(-n // block_rows) or 1, -(-n_queries // block_rows) or 1
    spread = lambda blocks: F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    dim = F.size("v").alias("dim")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("vec_id", "v", dim, spread(blocks).alias("cb"), all_of(query_blocks).alias("qb"))
    queries = rows.filter(is_query).select("vec_id", "v", dim, spread(query_blocks).alias("qb"), all_of(blocks).alias("cb"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(block):
            ids, data = block["vec_id"].to_numpy(), scaled(block["v"].tolist())
            asked = scaled(queries["v"].tolist())
            safe = np.linalg.norm(data, axis=1).max() * np.linalg.norm(asked, axis=1).max() < SAFE
            columns = np.ascontiguousarray(data.T)
            tails = np.sqrt(np.array([(columns[at:] ** 2).sum(axis=0) for at in range(0, len(columns), step)]))
            for query_id, query in zip(queries["vec_id"].to_numpy(), asked):
                got, scores = top_of_block(columns, ids, query, query_id, k, step, tails) if safe else exact_top(ids, data, query, query_id, k)
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": got, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in TOP.split(", ")})

    keys = ["cb", "qb", "dim"]
    parts = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(search, TOP)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT DISTINCT * FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM d q JOIN d c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
