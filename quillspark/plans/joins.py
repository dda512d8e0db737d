"""Joins: lookups, anti-joins, as-of and containment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.containment import contained
from quillspark.operators.relational import join_dealt, n_rows
from quillspark.registry import query
from quillspark.sources.sinks import written
from quillspark.sources.tables import Tables


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def inner_equi_join(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def join_filter_topk(t: Tables) -> DataFrame:
    found = t.orders.filter("o_orderstatus = 'F'").join(t.customer.filter("c_mktsegment = 'FURNITURE'"), F.col("o_custkey") == F.col("c_custkey"))
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("""SELECT count(DISTINCT c_custkey) AS useful FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) m ON c_custkey = m.o_custkey
LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') e ON c_custkey = e.user_id WHERE n >= 3 OR e.user_id IS NOT NULL""")
def left_join_agg_or(t: Tables) -> DataFrame:
    asked = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"))
    clicked = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("clicked", F.lit(True))
    rows = t.customer.select("c_custkey").join(asked, "c_custkey", "left").join(clicked, "c_custkey", "left")
    return rows.filter("n >= 3 OR clicked").agg(F.countDistinct("c_custkey").alias("useful"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer")
def correlated_scalar_count(t: Tables) -> DataFrame:
    counted = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n_rows().alias("n"))
    return t.customer.select("c_custkey").join(counted, "c_custkey", "left").na.fill(0, ["n"])


@query("SELECT c_custkey, round(coalesce((SELECT sum(CAST(o_totalprice AS DOUBLE)) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'), 0), 2) AS total FROM customer")
def correlated_scalar_sum(t: Tables) -> DataFrame:
    summed = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    return t.customer.join(summed, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("SELECT d.doc_id, quality, l.doc_id IS NOT NULL AS analyzed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def hash_map_left_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality", F.lit(True).alias("analyzed")), "doc_id", "left").na.fill(False, ["analyzed"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def anti_join_keys(t: Tables) -> DataFrame:
    """Keys not yet synced; failed ones come again."""
    return t.documents.select("doc_id").join(t.labels.filter("quality = 1"), "doc_id", "left_anti")


@query("SELECT doc_id, 'pending' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_discovery(t: Tables) -> DataFrame:
    """Keys never seen, whatever became of the seen ones."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").withColumn("status", F.lit("pending"))


@query("""WITH e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS exact, min(doc_id) OVER (PARTITION BY substr(text, 1, 15000)) AS near FROM documents)
SELECT doc_id, CASE WHEN exact < doc_id THEN 'exact_duplicate:' || exact WHEN near < doc_id THEN 'preview_match:' || near END AS warning FROM e""")
def dedupe_lookup_exact_then_preview(t: Tables) -> DataFrame:
    """The earliest row of the same hash, else of the same preview; aggregates first, so no hot text meets in one task.

    The texts are read and hashed once; both aggregates and both joins read the written hashes.
    """
    hashes = t.documents.select("doc_id", F.unhex(F.sha2("text", 256)).alias("raw"), F.xxhash64(F.substring("text", 1, 15_000)).alias("preview"))
    rows = written(hashes, "text-hashes")
    first = lambda key, name: rows.groupBy(key).agg(F.min("doc_id").alias(name), F.count(F.lit(1)).alias("n"))
    found = join_dealt(join_dealt(rows, first("raw", "exact"), ["raw"]), first("preview", "near"), ["preview"])
    text = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return found.select("doc_id", F.when(F.col("exact") < F.col("doc_id"), text("exact_duplicate", "exact")).when(F.col("near") < F.col("doc_id"), text("preview_match", "near")).alias("warning"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders")
def self_join_supersedes(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("supersedes"))


@query("""WITH j AS (SELECT doc_id, coalesce(CAST(quality AS VARCHAR), source) AS key, quality, source FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM j) SELECT doc_id, key, CASE WHEN quality IS NULL THEN source END AS title FROM r WHERE k = 1""")
def n1_citation_lookup(t: Tables) -> DataFrame:
    """One citation a version, or a title where no version is known."""
    key = F.coalesce(F.col("quality").cast("string"), "source")
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", key.alias("key"), F.when(F.col("quality").isNull(), F.col("source")).alias("title"))
    return rows.groupBy("key").agg(F.min_by(F.struct("doc_id", "title"), "doc_id").alias("r")).select("r.doc_id", "key", "r.title")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND l_suppkey = p_size")
def multi_key_lookup(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_suppkey") == F.col("p_size"))).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT c.conv_id, c.turn, (SELECT min(a.turn) FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > c.turn) AS answer_turn FROM conversations c WHERE c.role = 'user'")
def asof_next_assistant(t: Tables) -> DataFrame:
    later = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    answer = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(later)
    return t.conversations.select("conv_id", "turn", "role", answer.alias("answer_turn")).filter("role = 'user'").drop("role")


@query("SELECT c_custkey, coalesce(nullif(n_name, ''), nullif(r.r_name, ''), 'Ossipee') AS town FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10 LEFT JOIN region r ON r_regionkey = c_nationkey - 20")
def cascade_lookup(t: Tables) -> DataFrame:
    """The first named town; an empty name counts as none."""
    given = t.nation.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    session = t.region.select((F.col("r_regionkey") + 20).alias("c_nationkey"), "r_name")
    named = t.customer.join(F.broadcast(given), "c_nationkey", "left").join(F.broadcast(session), "c_nationkey", "left")
    return named.select("c_custkey", F.coalesce(F.nullif("n_name", F.lit("")), F.nullif("r_name", F.lit("")), F.lit("Ossipee")).alias("town"))


@query("SELECT user_id, coalesce(c_name, 'new-' || user_id) AS identity, c_name IS NULL AS created FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 5000")
def identity_resolution(t: Tables) -> DataFrame:
    known = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), "c_name")
    seen = t.events.select("user_id").distinct().join(known, "user_id", "left")
    return seen.select("user_id", F.coalesce("c_name", F.concat(F.lit("new-"), F.col("user_id").cast("string"))).alias("identity"), F.col("c_name").isNull().alias("created"))


ENTITY_SQL = "SELECT DISTINCT unnest(list_concat(string_split(text, ' ')[1:3], [string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2]])) AS e FROM benchmark"


@query(f"""WITH e AS (SELECT e FROM ({ENTITY_SQL}) WHERE e <> '') SELECT doc_id, CASE WHEN text IS NOT NULL THEN (SELECT coalesce(list(e ORDER BY e), []) FROM e WHERE contains(lower(d.text), lower(e))) END AS hits FROM documents d""")
def entity_contains_join(t: Tables) -> DataFrame:
    """The entities of the questions, their first three words and first two together, that each whole text contains."""
    w = F.split("text", " ")
    phrases = t.benchmark.select(F.explode(F.concat(F.slice(w, 1, 3), F.array(F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(1)))))).alias("phrase"))
    return contained(t.documents.select(F.col("doc_id").alias("id"), "text"), phrases).select(F.col("id").alias("doc_id"), "hits")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 5 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 7) ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def store_fanout_union(t: Tables) -> DataFrame:
    shared, town = t.supplier.filter("s_nationkey < 5"), t.supplier.filter("s_nationkey = 7")
    return shared.unionByName(town).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey")
