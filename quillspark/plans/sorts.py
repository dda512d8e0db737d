"""Sorts, limits, top-k and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relational import page, ranked, top_per_group
from quillspark.registry import query
from quillspark.sources.tables import Tables


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id")
def order_desc_created(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id")


@query("SELECT event_id FROM events ORDER BY CASE WHEN event_type <> 'view' THEN ts END ASC NULLS LAST, event_id LIMIT 1")
def order_asc_nulls_last(t: Tables) -> DataFrame:
    queued = F.when(F.col("event_type") != "view", F.col("ts"))
    return t.events.orderBy(queued.asc_nulls_last(), "event_id").limit(1).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def limit_n(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), "event_id").limit(25).select("event_id")


@query("SELECT event_id, (SELECT count(*) FROM events) AS total, CAST(ceil((SELECT count(*) FROM events) / 20.0) AS BIGINT) AS pages FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40)")
def offset_page(t: Tables) -> DataFrame:
    total = t.events.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(t.events, [F.desc("ts"), "event_id"], 3, 20).select("event_id").crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 20))


@query("SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS BIGINT) AS batch FROM orders")
def fixed_batches(t: Tables) -> DataFrame:
    return ranked(t.orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", F.floor((F.col("rank") - 1) / 3).alias("batch"))


SORT_KEYS = {"date": "ts", "cost": "value", "messages": "user_id", "score": "score"}


def sort_by(df: DataFrame, key: str, descending: bool = True) -> DataFrame:
    """Sorted by a named key, an unknown one meaning the date; a null score counts as -1."""
    column = F.coalesce(F.col("score"), F.lit(-1)) if key == "score" else F.col(SORT_KEYS.get(key, "ts"))
    return df.orderBy(column.desc() if descending else column.asc(), "event_id")


@query("SELECT event_id FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS score FROM events) ORDER BY coalesce(score, -1) DESC, event_id LIMIT 50")
def dynamic_sort_key(t: Tables) -> DataFrame:
    return sort_by(t.events.withColumn("score", F.when(F.col("event_type") != "error", F.col("value"))), "score").limit(50).select("event_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def stable_topk_score(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", "n_chars")


@query("WITH l AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents), c AS (SELECT * FROM l WHERE pos <= 6), m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang, pos) AS place FROM c) SELECT doc_id, place FROM m WHERE place <= 15")
def cap_per_lane(t: Tables) -> DataFrame:
    capped = top_per_group(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], 6, "pos")
    return top_per_group(capped, ["source"], ["lang", "pos"], 15, "place").select("doc_id", "place")
