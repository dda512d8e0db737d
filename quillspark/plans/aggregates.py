"""Usage, engagement, cost and trust metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.quantiles import exact_quantile
from quillspark.operators.relational import n_rows, percent, top_groups
from quillspark.registry import query
from quillspark.sources.tables import Tables, as_of

DAY, WEEK = "TIMESTAMP '2024-01-30 00:00:00'", "TIMESTAMP '2024-01-24 00:00:00'"
SEVEN_DAYS = "ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'"
COST = "CAST(value AS DECIMAL(10,6))"


def since(days: int):
    return F.col("ts") >= as_of() - F.expr(f"INTERVAL {days} DAYS")


def within(days: int):
    return since(days) & (F.col("ts") <= as_of())


@query(f"SELECT count(*) FILTER (WHERE ts >= {DAY}) AS sessions_24h, count(*) AS sessions_7d, count(*) FILTER (WHERE event_type = 'view' AND ts >= {DAY}) AS questions_24h, count(*) FILTER (WHERE event_type = 'view') AS questions_7d FROM events WHERE {SEVEN_DAYS}")
def count_range(t: Tables) -> DataFrame:
    asked = F.col("event_type") == "view"
    return t.events.filter(within(7)).agg(F.count_if(since(1)).alias("sessions_24h"), n_rows().alias("sessions_7d"), F.count_if(asked & since(1)).alias("questions_24h"), F.count_if(asked).alias("questions_7d"))


@query(f"SELECT count(DISTINCT CASE WHEN ts >= {DAY} THEN coalesce(nullif(user_id, 0), -event_id) END) AS dau, count(DISTINCT coalesce(nullif(user_id, 0), -event_id)) AS wau FROM events WHERE {SEVEN_DAYS}")
def active_users(t: Tables) -> DataFrame:
    """Exact distinct actors; user 0 stands for a visit without a user, told apart by its own id."""
    actor = F.coalesce(F.nullif("user_id", F.lit(0)), -F.col("event_id"))
    return t.events.filter(within(7)).agg(F.countDistinct(F.when(since(1), actor)).alias("dau"), F.countDistinct(actor).alias("wau"))


@query(f"SELECT CAST(coalesce(sum({COST}) FILTER (WHERE ts >= {DAY}), 0) AS DOUBLE) AS cost_24h, CAST(coalesce(sum({COST}), 0) AS DOUBLE) AS cost_7d FROM events WHERE {SEVEN_DAYS}")
def sum_coalesce(t: Tables) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return t.costs.filter(within(7)).agg(total(F.when(since(1), F.col("cost_usd"))).alias("cost_24h"), total("cost_usd").alias("cost_7d"))


@query(f"SELECT user_id, CAST(sum({COST}) AS DOUBLE) AS spent FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id")
def sum_by_actor_today(t: Tables) -> DataFrame:
    today = F.date_trunc("DAY", as_of() - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    return t.costs.filter(F.col("ts") >= today).groupBy("user_id").agg(F.sum("cost_usd").cast("double").alias("spent"))


def questions(t: Tables) -> DataFrame:
    """Messages of users with the town of their session."""
    return t.orders.filter("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter("c_mktsegment IS NOT NULL AND c_mktsegment <> ''").select(F.col("c_mktsegment").alias("town"), "o_totalprice")


TOWN_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY c_mktsegment"


@query(f"SELECT c_mktsegment AS town, count(*) AS question_count {TOWN_SQL} ORDER BY question_count DESC, town LIMIT 1")
def top1_group(t: Tables) -> DataFrame:
    return top_groups(questions(t), "town", 1, name="question_count")


@query(f"SELECT c_mktsegment AS town, count(*) AS question_count {TOWN_SQL} ORDER BY question_count DESC, town LIMIT 10")
def group_topk(t: Tables) -> DataFrame:
    return top_groups(questions(t), "town", 10, name="question_count")


@query(f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum({COST}) AS DOUBLE) AS cost FROM events WHERE {SEVEN_DAYS} GROUP BY 1")
def group_by_day(t: Tables) -> DataFrame:
    """Days without rows are absent: no gap is filled."""
    return t.costs.filter(within(7)).groupBy(F.to_date("ts").alias("day")).agg(n_rows().alias("n"), F.sum("cost_usd").cast("double").alias("cost"))


@query(f"SELECT event_type AS model, CAST(sum({COST}) AS DOUBLE) AS cost FROM events GROUP BY 1 ORDER BY cost DESC, model")
def group_by_sum_desc(t: Tables) -> DataFrame:
    return top_groups(t.costs.withColumnRenamed("event_type", "model"), "model", None, F.sum("cost_usd").cast("double"), "cost")


def per_session(t: Tables) -> DataFrame:
    return t.events.filter(since(30)).groupBy("user_id").agg(n_rows().alias("n"))


PER_SESSION = "(SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY user_id)"


@query(f"SELECT round(avg(n), 6) AS avg_count FROM {PER_SESSION}")
def two_level_avg(t: Tables) -> DataFrame:
    return per_session(t).agg(F.round(F.avg("n"), 6).alias("avg_count"))


@query(f"SELECT CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS DOUBLE) AS median FROM {PER_SESSION}")
def two_level_median(t: Tables) -> DataFrame:
    return t.rows("median double", (exact_quantile(per_session(t), "n"),))


@query(f"SELECT round(CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST({COST} AS DOUBLE)) AS DOUBLE), 6) AS median FROM events WHERE event_type = 'purchase'")
def median_cost(t: Tables) -> DataFrame:
    return t.rows("median double", (exact_quantile(t.costs.filter("event_type = 'purchase'"), "cost_usd"),)).select(F.round("median", 6).alias("median"))


@query(f"SELECT round(avg(CAST({COST} AS DOUBLE)), 6) AS mean FROM events WHERE event_type = 'purchase'")
def avg_cost(t: Tables) -> DataFrame:
    return t.costs.filter("event_type = 'purchase'").agg(F.round(F.avg(F.col("cost_usd").cast("double")), 6).alias("mean"))


@query("SELECT count(CASE WHEN user_id % 10 = 0 THEN 1 END) AS anonymous, count(CASE WHEN user_id % 10 <> 0 THEN 1 END) AS logged_in FROM events")
def conditional_count_case(t: Tables) -> DataFrame:
    anonymous = F.col("user_id") % 10 == 0
    return t.events.agg(F.count(F.when(anonymous, 1)).alias("anonymous"), F.count(F.when(~anonymous, 1)).alias("logged_in"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS synced, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders")
def filtered_count(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.agg(n_rows().alias("total"), n("F").alias("synced"), n("O").alias("pending"), n("P").alias("failed"))


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS queued, count(*) FILTER (WHERE event_type = 'click') AS processing, count(*) FILTER (WHERE event_type = 'signup') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'none') AS blocked FROM events")
def group_count_pivot(t: Tables) -> DataFrame:
    """One record of five fixed statuses; a missing one is 0, an unknown one is dropped."""
    status = F.create_map(*[F.lit(x) for x in ("view", "queued", "click", "processing", "signup", "completed", "error", "failed", "none", "blocked")])
    counted = t.events.select(F.lit(1).alias("one"), F.get(F.array(status[F.col("event_type")]), F.lit(0)).alias("s"))
    return counted.groupBy("one").pivot("s", ["queued", "processing", "completed", "failed", "blocked"]).count().na.fill(0).drop("one")


@query("SELECT user_id AS board, count(CASE WHEN event_type = 'click' THEN 1 END) AS ask, count(CASE WHEN event_type = 'view' THEN 1 END) AS viewed FROM events GROUP BY user_id ORDER BY ask + viewed DESC, board LIMIT 10")
def order_by_agg_sum(t: Tables) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t.events.groupBy(F.col("user_id").alias("board")).agg(n("click").alias("ask"), n("view").alias("viewed")).orderBy((F.col("ask") + F.col("viewed")).desc(), "board").limit(10)


@query("SELECT round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 6) AS usage_percent, round(100.0 * count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'none'), 0), 6) AS rate_of_none FROM events")
def ratio_percent(t: Tables) -> DataFrame:
    """A zero denominator gives null."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t.events.agg(F.round(percent(n("error"), n_rows()), 6).alias("usage_percent"), F.round(percent(n("click"), n("none")), 6).alias("rate_of_none"))


@query("SELECT round(100 - 100.0 * count(*) FILTER (WHERE event_type = 'click') / nullif(count(*), 0), 6) AS no_doc_found FROM events")
def complement_rate(t: Tables) -> DataFrame:
    return t.events.agg(F.round(100 - percent(F.count_if(F.col("event_type") == "click"), n_rows()), 6).alias("no_doc_found"))


@query(f"SELECT round(CAST(sum({COST}) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END), 0), 6) AS cost_per_session FROM events")
def cost_per_useful_session(t: Tables) -> DataFrame:
    useful = F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id")))
    return t.costs.agg(F.round(F.try_divide(F.sum("cost_usd").cast("double"), useful), 6).alias("cost_per_session"))


@query("SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'signup' AND user_id < 50) AS template, count(DISTINCT user_id) - count(DISTINCT user_id) FILTER (WHERE event_type = 'signup' AND user_id < 50) AS free FROM events")
def template_vs_free(t: Tables) -> DataFrame:
    template = F.countDistinct(F.when(F.expr("event_type = 'signup' AND user_id < 50"), F.col("user_id")))
    return t.events.agg(template.alias("template"), (F.countDistinct("user_id") - template).alias("free"))


@query("SELECT CASE WHEN count(DISTINCT user_id) > 0 THEN round(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id), 6) ELSE 0.0 END AS per_user FROM events WHERE event_type = 'click'")
def followups_per_user(t: Tables) -> DataFrame:
    users = F.countDistinct("user_id")
    return t.events.filter("event_type = 'click'").agg(F.when(users > 0, F.round(F.try_divide(n_rows().cast("double"), users), 6)).otherwise(0.0).alias("per_user"))


@query("SELECT count(*) > 0 AS has_data, count(*) AS clicks, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'template_click'")
def has_data_gate(t: Tables) -> DataFrame:
    """One record, all zero with has_data false where no such event exists."""
    return t.events.filter("event_type = 'template_click'").agg((n_rows() > 0).alias("has_data"), n_rows().alias("clicks"), F.countDistinct("user_id").alias("users"))


@query("SELECT json_extract_string(props, '$.k') AS prompt, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, prompt LIMIT 5")
def json_key_group(t: Tables) -> DataFrame:
    prompts = t.events.select(F.get_json_object("props", "$.k").alias("prompt")).filter("prompt IS NOT NULL")
    return top_groups(prompts, "prompt", 5)


@query("SELECT DISTINCT c_mktsegment AS town FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def distinct_values(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("town")).filter("town <> 'MACHINERY'").distinct().orderBy("town")


@query("SELECT count(DISTINCT lower(trim(p_name))) AS n_docs FROM part")
def distinct_docs(t: Tables) -> DataFrame:
    return t.part.agg(F.countDistinct(F.lower(F.trim("p_name"))).alias("n_docs"))


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[ \n])([A-Z][a-z]{4,})', 1)) AS entity FROM documents), n AS (SELECT count(*) AS chunks FROM documents),
e AS (SELECT entity, count(*) AS n FROM m GROUP BY entity HAVING count(*) >= 2) SELECT entity, e.n, e.n >= ceil(0.3 * chunks) AS drift FROM e, n""")
def foreign_entity_count(t: Tables) -> DataFrame:
    entities = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[ \n])([A-Z][a-z]{4,})"), F.lit(1))).alias("entity"))
    chunks = t.documents.agg(n_rows().alias("chunks"))  # one row
    return entities.groupBy("entity").agg(n_rows().alias("n")).filter("n >= 2").crossJoin(F.broadcast(chunks)).select("entity", "n", (F.col("n") >= F.ceil(F.col("chunks") * 0.3)).alias("drift"))


@query("SELECT source AS query_id, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.3 END), 6) AS avg_score FROM documents GROUP BY 1")
def mean_over_chunks(t: Tables) -> DataFrame:
    score = F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.3)
    return t.documents.groupBy(F.col("source").alias("query_id")).agg(F.round(F.avg(score), 6).alias("avg_score"))


@query("SELECT coalesce(a.town, b.town) AS town, coalesce(listed, 0) AS listed, coalesce(synced, 0) AS synced, coalesce(failed, 0) AS failed FROM (SELECT source AS town, count(*) AS listed FROM documents GROUP BY 1) a FULL JOIN (SELECT source AS town, count(*) FILTER (WHERE quality = 1) AS synced, count(*) FILTER (WHERE quality = 0) AS failed FROM documents JOIN labels USING (doc_id) GROUP BY 1) b ON a.town = b.town")
def sync_status_rollup(t: Tables) -> DataFrame:
    listed = t.documents.groupBy(F.col("source").alias("town")).agg(n_rows().alias("listed"))
    synced = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("town")).agg(F.count_if(F.col("quality") == 1).alias("synced"), F.count_if(F.col("quality") == 0).alias("failed"))
    return listed.join(synced, "town", "full").na.fill(0, ["listed", "synced", "failed"])


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS uploaded, count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 490000) AS errors FROM orders")
def batch_result_fold(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    errors = F.sort_array(F.collect_list(F.when(F.expr("o_orderstatus = 'P' AND o_totalprice > 490000"), F.col("o_orderkey"))))
    return t.orders.agg(n("F").alias("uploaded"), n("O").alias("skipped"), n("P").alias("failed"), errors.alias("errors"))


@query("SELECT conv_id AS session_id, string_agg('[' || upper(role) || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def ordered_transcript(t: Tables) -> DataFrame:
    said = F.struct("pos", F.concat(F.lit("["), F.upper("role"), F.lit("]: "), "content").alias("said"))
    return t.turns.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["said"]), "\n\n").alias("transcript"))


@query("SELECT conv_id AS query_id, string_agg('--- Source: ' || role || ' (' || turn || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def context_concat(t: Tables) -> DataFrame:
    block = F.concat(F.lit("--- Source: "), "role", F.lit(" ("), F.col("pos").cast("string"), F.lit(") ---\n"), "content")
    blocks = F.sort_array(F.collect_list(F.struct("pos", block.alias("block"))))
    return t.turns.groupBy(F.col("session_id").alias("query_id")).agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS needs_review, count(*) FILTER (WHERE o_orderstatus = 'F') AS indexed FROM orders")
def client_status_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("needs_review"), F.count_if(F.col("o_orderstatus") == "F").alias("indexed"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, greatest(max(count(*)) OVER (), 1) AS scale FROM events GROUP BY 1")
def chart_scale_max(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(n_rows().alias("n"))
    return daily.crossJoin(F.broadcast(daily.agg(F.greatest(F.max("n"), F.lit(1)).alias("scale"))))  # one row


@query()
def batch_analyze(t: Tables) -> DataFrame:
    """One result a session; a session that cannot be analysed gives its error instead of failing the batch."""
    words = F.sum(F.size(F.split("content", " ")))
    failed = F.max("pos") < 1
    return t.turns.groupBy("session_id").agg(F.struct((~failed).alias("success"), F.when(~failed, words).alias("words"), F.when(failed, F.lit("too short")).alias("error")).alias("result"))


@query(f"SELECT 'daily cost ' || CAST(CAST(sum({COST}) AS DECIMAL(18,2)) AS VARCHAR) || ' is over 10.00' AS alert FROM events WHERE ts >= {DAY} HAVING sum({COST}) > 10")
def threshold_alert(t: Tables) -> DataFrame:
    total = t.costs.filter(since(1)).agg(F.sum("cost_usd").alias("total")).filter("total > 10")
    return total.select(F.concat(F.lit("daily cost "), F.col("total").cast("decimal(18,2)").cast("string"), F.lit(" is over 10.00")).alias("alert"))


@query("""WITH c AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 10.0 END AS quota, round(sum(value) / 1000, 6) AS cost FROM events GROUP BY 1, 2)
SELECT user_id, CAST(quota AS DOUBLE) AS quota, CAST(least(100, floor(cost / quota * 100 + 0.5)) AS BIGINT) AS percent, cost >= quota AS blocked FROM c""")
def usage_tier(t: Tables) -> DataFrame:
    tier = F.col("user_id") % 3
    quota = F.when(tier == 0, 0.1).when(tier == 1, 0.5).otherwise(10.0)
    spent = t.events.groupBy("user_id", quota.alias("quota")).agg(F.round(F.sum("value") / 1000, 6).alias("cost"))
    return spent.select("user_id", "quota", F.least(F.lit(100), F.floor(F.col("cost") / F.col("quota") * 100 + 0.5)).cast("long").alias("percent"), (F.col("cost") >= F.col("quota")).alias("blocked"))


# Model, dollars for a million tokens in and out.
PRICES = (("gemini-2.5-flash", 0.075, 0.30), ("gemini-2.5-pro", 1.25, 10.00), ("gemini-2.0-flash", 0.10, 0.40), ("gemini-1.5-pro", 1.25, 5.00), ("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60))
STAND_IN = {"view": "gemini-2.5-flash", "click": "gpt-4o", "purchase": "gemini-2.5-pro"}
MODEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAND_IN.items()) + " ELSE 'other' END"


@query(f"""WITH p(model, pin, pout) AS (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES)}), e AS (SELECT event_id, {MODEL_SQL} AS model, floor(value * 100) AS tin, floor(value * 10) AS tout FROM events)
SELECT event_id, round(coalesce(tin / 1e6 * pin + tout / 1e6 * pout, (tin * 0.001 + tout * 0.002) / 1000), 10) AS cost FROM e LEFT JOIN p USING (model)""")
def token_cost(t: Tables) -> DataFrame:
    """Price list join; an unknown model costs the default estimate."""
    prices = t.rows("model string, pin double, pout double", *PRICES)
    model = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STAND_IN.items()], F.lit("other"))
    used = t.events.select("event_id", model.alias("model"), F.floor(F.col("value") * 100).cast("double").alias("tin"), F.floor(F.col("value") * 10).cast("double").alias("tout"))
    known = F.expr("tin / 1e6D * pin + tout / 1e6D * pout")
    other = F.expr("(tin * 0.001D + tout * 0.002D) / 1000")
    return used.join(F.broadcast(prices), "model", "left").select("event_id", F.round(F.coalesce(known, other), 10).alias("cost"))
