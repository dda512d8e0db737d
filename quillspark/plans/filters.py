"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relational import all_of, any_of
from quillspark.registry import query
from quillspark.sources.tables import Tables, as_of


@query("SELECT source AS town FROM documents")
def column_projection(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("town"))


@query("SELECT doc_id, source, {'doc_id': doc_id, 'quality': quality} AS version FROM documents JOIN labels USING (doc_id)")
def nested_projection(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", F.struct("doc_id", "quality").alias("version"))


def documents_where(t: Tables, town: str | None = None, category: str | None = None, least: int | None = None) -> DataFrame:
    """Rows that meet every filter that was given; all rows where none was."""
    given = [None if town is None else F.col("source") == town, None if category is None else F.col("lang") == category, None if least is None else F.col("n_chars") >= least]
    return t.documents.filter(all_of(given))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def dynamic_conjunction(t: Tables) -> DataFrame:
    return documents_where(t, category="en", least=1000).select("doc_id")


@query("SELECT event_id FROM events WHERE user_id = 3 OR event_type = 'error'")
def dynamic_disjunction(t: Tables) -> DataFrame:
    return t.events.filter(any_of([F.col("user_id") == 3, F.col("event_type") == "error", None])).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def time_range_closed(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts").between(F.expr("TIMESTAMP_NTZ '2024-01-10'"), F.expr("TIMESTAMP_NTZ '2024-01-12'"))).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def time_range_open(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-28'")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def relative_window(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= date_trunc('day', TIMESTAMP '2024-01-30 15:00:00')")
def since_local_midnight(t: Tables) -> DataFrame:
    midnight = F.date_trunc("DAY", as_of() - F.expr("INTERVAL 9 HOURS")).cast("timestamp_ntz")
    return t.events.filter(F.col("ts") >= midnight).select("event_id")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def not_blank(t: Tables) -> DataFrame:
    return t.documents.filter("text IS NOT NULL AND text <> ''").select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def in_list(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("view", "click")).select("event_id")


@query("SELECT doc_id FROM documents WHERE text LIKE 'The %'")
def like_prefix(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("text").startswith("The ")).select("doc_id")


@query("SELECT page_id FROM pages WHERE url NOT LIKE 'https://m.%' AND url NOT LIKE '%example.net%'")
def not_like(t: Tables) -> DataFrame:
    return t.pages.filter(~F.col("url").startswith("https://m.") & ~F.col("url").contains("example.net")).select("page_id")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars < 1200 AND quality = 1 AND toxic = 0")
def numeric_threshold(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").filter("n_chars < 1200 AND quality = 1 AND toxic = 0").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), lower('ThE')) OR contains(lower(coalesce(source, '')), lower('ThE'))")
def search_contains_ci(t: Tables) -> DataFrame:
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("the")
    return t.documents.filter(has("text") | has("source")).select("doc_id")


def analyzed_where(t: Tables, analyzed: bool | None) -> DataFrame:
    """True: rows with an analysis; false: rows without; None: all."""
    if analyzed is None:
        return t.documents
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi" if analyzed else "left_anti")


@query("SELECT 'yes' AS kind, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'no', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'any', count(*) FROM documents")
def tri_state_filter(t: Tables) -> DataFrame:
    counts = [analyzed_where(t, state).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, state in (("yes", True), ("no", False), ("any", None))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality BETWEEN 1 AND 10")
def null_passes_range(t: Tables) -> DataFrame:
    """Rows without a score pass."""
    return t.documents.join(t.labels, "doc_id", "left").filter(F.col("quality").isNull() | F.col("quality").between(1, 10)).select("doc_id", "quality")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'approved' END AS next, CASE WHEN o_orderstatus <> 'O' THEN 'cannot approve from ' || o_orderstatus END AS error FROM orders")
def status_guard(t: Tables) -> DataFrame:
    allowed = F.col("o_orderstatus") == "O"
    return t.orders.select("o_orderkey", F.when(allowed, "approved").alias("next"), F.when(~allowed, F.concat(F.lit("cannot approve from "), "o_orderstatus")).alias("error"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'meeting_minutes' WHEN lang IN ('en', 'fr') THEN lang ELSE 'misc_other' END AS category, substr(trim(coalesce(text, '')), 1, 200) AS notes FROM documents")
def enum_validate(t: Tables) -> DataFrame:
    category = F.when(F.col("doc_id") % 5 == 0, "meeting_minutes").when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("misc_other")
    return t.documents.select("doc_id", category.alias("category"), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 200).alias("notes"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not approved' WHEN o_totalprice < 10000 THEN 'no category' WHEN o_orderpriority = '5-LOW' THEN 'no town' END AS error FROM orders")
def partition_validity(t: Tables) -> DataFrame:
    """The first failing rule's reason, null for a valid row."""
    error = F.when(F.col("o_orderstatus") == "P", "not approved").when(F.col("o_totalprice") < 10000, "no category").when(F.col("o_orderpriority") == "5-LOW", "no town")
    return t.orders.select("o_orderkey", error.alias("error"))


@query("SELECT n_nationkey FROM nation WHERE lower(trim(n_name)) IN ('nation_1', 'nation_7', 'nation_19')")
def town_validate(t: Tables) -> DataFrame:
    towns = t.rows("town string", (" Nation_1",), ("NATION_7 ",), ("nation_19",)).select(F.lower(F.trim("town")).alias("town"))
    return t.nation.join(F.broadcast(towns), F.lower(F.trim("n_name")) == F.col("town"), "left_semi").select("n_nationkey")


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'pending' ELSE 'load' END AS path FROM documents")
def split_by_ocr_need(t: Tables) -> DataFrame:
    needs = F.col("n_chars") < 500
    part = lambda rows, path: rows.select("doc_id", F.lit(path).alias("path"))
    return part(t.documents.filter(needs), "pending").unionByName(part(t.documents.filter(~needs), "load"))


@query("SELECT conv_id, turn FROM conversations WHERE length(text) > 50")
def min_snippet_length(t: Tables) -> DataFrame:
    return t.conversations.filter(F.length("text") > 50).select("conv_id", "turn")


@query("SELECT o_custkey, bool_and(o_totalprice > 20000) AS batch_ok, count(*) FILTER (WHERE o_totalprice <= 20000) AS errors FROM orders GROUP BY 1")
def job_edit_validate(t: Tables) -> DataFrame:
    """A batch is approved as a whole or not at all."""
    valid = F.col("o_totalprice") > 20000
    return t.orders.groupBy("o_custkey").agg(F.bool_and(valid).alias("batch_ok"), F.count_if(~valid).alias("errors"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'document' WHEN contains(lower(text), 'find') OR contains(lower(text), 'the ') THEN 'search' ELSE 'general' END AS phrase FROM conversations")
def status_phrase_class(t: Tables) -> DataFrame:
    low = F.lower("text")
    phrase = F.when(F.col("turn") % 4 == 3, "document").when(any_of([low.contains(x) for x in ("find", "the ")]), "search").otherwise("general")
    return t.conversations.select("conv_id", "turn", phrase.alias("phrase"))


@query("""WITH u AS (SELECT event_id, user_id, event_type, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, before IS NOT NULL AND ts - before <= INTERVAL 120 SECOND AS repeated FROM u""")
def dup_submit_window(t: Tables) -> DataFrame:
    """A submission repeats the one before it of the same session and text if at most 120 seconds apart."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    seen = t.events.select("event_id", "ts", before.alias("before"))
    return seen.select("event_id", F.coalesce(F.col("ts") - F.col("before") <= F.expr("INTERVAL 120 SECONDS"), F.lit(False)).alias("repeated"))
