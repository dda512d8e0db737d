"""Window operators: ranks, current versions, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered
from quillspark.operators.relational import n_rows, ranked, top_per_group
from quillspark.registry import query
from quillspark.sources.tables import Tables

TOPICS = "SELECT c_mktsegment AS town, o_orderpriority AS topic, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def topics(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("town"), F.col("o_orderpriority").alias("topic")).agg(n_rows().alias("n"))


@query(f"WITH g AS ({TOPICS}), r AS (SELECT *, row_number() OVER (PARTITION BY town ORDER BY n DESC, topic) AS k FROM g) SELECT town, list(topic ORDER BY k) AS topics FROM r WHERE k <= 5 GROUP BY town")
def topk_per_group(t: Tables) -> DataFrame:
    top = top_per_group(topics(t), ["town"], [F.desc("n"), "topic"], 5)
    return top.groupBy("town").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias("topics"))


@query(f"WITH g AS ({TOPICS}), s AS (SELECT town, sum(n) AS total FROM g GROUP BY town ORDER BY total DESC, town LIMIT 3), r AS (SELECT g.*, row_number() OVER (PARTITION BY town ORDER BY n DESC, topic) AS k FROM g JOIN s USING (town)) SELECT town, topic, n FROM r WHERE k <= 3")
def nested_top3(t: Tables) -> DataFrame:
    counted = topics(t)
    towns = counted.groupBy("town").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "town").limit(3).select("town")
    return top_per_group(counted.join(F.broadcast(towns), "town"), ["town"], [F.desc("n"), "topic"], 3).select("town", "topic", "n")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders")
def current_version_flag(t: Tables) -> DataFrame:
    return ranked(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", (F.col("rank") == 1).alias("is_current"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def find_current(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"))


@query("SELECT conv_id AS session_id, turn AS pos FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def bounded_history(t: Tables) -> DataFrame:
    return top_per_group(t.turns, ["session_id"], [F.desc("pos")], 4).select("session_id", "pos")


@query("SELECT conv_id AS session_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY 1")
def last_by_role(t: Tables) -> DataFrame:
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("pos")))
    return t.turns.groupBy("session_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def keep_last(array, n: int):
    return F.when(F.size(array) <= n, array).otherwise(F.slice(array, -n, n))


@query("WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN len(t) <= 5 THEN t ELSE t[-5:] END AS sources FROM a")
def keep_last_n_array(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("all")).select("conv_id", keep_last(F.col("all"), 5).alias("sources"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def most_recent_source(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT conv_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS title FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def first_message_title(t: Tables) -> DataFrame:
    first = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text")).alias("title"))


@query("SELECT doc_id, '[' || upper(substr(lang, 1, 1)) || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) || ']' AS label FROM documents")
def rank_label(t: Tables) -> DataFrame:
    """A label's number runs over its source and language, which may hold a third of all rows."""
    rows = t.documents.select("doc_id", "source", "lang")
    return numbered(rows, ["source", "lang"], ["doc_id"]).select("doc_id", F.concat(F.lit("["), F.upper(F.substring("lang", 1, 1)), F.col("rank").cast("string"), F.lit("]")).alias("label"))


@query("SELECT doc_id, round(1 - 0.05 * (k - 1), 6)::DOUBLE AS score FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 8")
def score_by_rank(t: Tables) -> DataFrame:
    return top_per_group(t.documents, ["source"], ["doc_id"], 8).select("doc_id", F.round(F.expr("1 - 0.05D * (rank - 1)"), 6).alias("score"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, 0), 2) AS total, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE total / n END, 6) AS per_message, c_custkey IN (SELECT doc_id FROM labels) AS analyzed
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def session_rollup(t: Tables) -> DataFrame:
    sums = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"), F.sum("o_totalprice").alias("total"))
    marks = t.labels.select(F.col("doc_id").alias("c_custkey"), F.lit(True).alias("analyzed")).distinct()
    rows = t.customer.select("c_custkey").join(sums, "c_custkey", "left").join(marks, "c_custkey", "left").na.fill(0, ["n", "total"]).na.fill(False, ["analyzed"])
    return rows.select("c_custkey", "n", F.round("total", 2).alias("total"), F.round(F.coalesce(F.try_divide("total", "n"), F.lit(0.0)), 6).alias("per_message"), "analyzed")
