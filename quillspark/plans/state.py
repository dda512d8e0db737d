"""Queues, retries and state machines as transitions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lex
from quillspark.operators.numbering import numbered
from quillspark.operators.relational import join_dealt, n_rows
from quillspark.plans.audit import entities_of, title_of, transition
from quillspark.plans.classify import any_pattern
from quillspark.registry import query
from quillspark.sources.sinks import fresh_folder, written
from quillspark.sources.snapshots import Snapshots, progress
from quillspark.sources.tables import AS_OF, Tables, as_of, as_turns
from quillspark.streaming import jobs


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def incremental_discovery(t: Tables) -> DataFrame:
    """A listing that a file stream reads, less the keys known before; its checkpoint is the set of seen files.

    Changed objects are not looked at: neither a seen file nor a known key comes again.
    """
    listed = jobs.admit_new(t.spark, f"{t.folder}/pages.parquet", t.pages.schema, fresh_folder(t.spark, "discovery"))
    return listed.join(t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_anti").select("page_id", "url")


@query("SELECT event_id, 'processing' AS status FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
def queue_claim(t: Tables) -> DataFrame:
    """One claim on the queue of errors: the row queued longest is being worked on in the next snapshot."""
    queue = jobs.Queue(t.spark, fresh_folder(t.spark, "queue"))
    queue.submit(t.events.filter("event_type = 'error'").select("event_id", F.col("ts").alias("queued_at")), "submit")
    return queue.claim(1, AS_OF, "claim").select("event_id", F.lit("processing").alias("status"))


@query("SELECT event_id, CASE WHEN value < 10 THEN 'failed' ELSE 'completed' END AS status, 1 AS attempts FROM events WHERE event_type = 'error'")
def poll_loop(t: Tables) -> DataFrame:
    """A file stream's rows queued, claimed, worked on and ended batch by batch; a value under 10 fails."""

    def work(claimed: DataFrame) -> DataFrame:
        return claimed.join(t.events, "event_id").select("event_id", F.when(F.col("value") < 10, "failed").otherwise("completed").alias("outcome"))

    done = jobs.drain(t.spark, f"{t.folder}/events.parquet", t.events.schema, work, fresh_folder(t.spark, "queue"), AS_OF, "event_type = 'error'")
    return done.select("event_id", "status", "attempts")


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN 'completed' WHEN ts < TIMESTAMP '2024-01-30' - INTERVAL 30 MINUTE THEN 'queued' ELSE 'processing' END AS status FROM events")
def stale_recovery(t: Tables) -> DataFrame:
    """A snapshot in which views are being worked on since their time, after a recovery a day before the clock."""
    queue = jobs.Queue(t.spark, fresh_folder(t.spark, "queue"))
    viewed = F.col("event_type") == "view"
    queue.store.write(t.events.select("event_id", F.when(viewed, "processing").otherwise("completed").alias("status"), F.col("ts").alias("queued_at"), F.when(viewed, F.col("ts")).alias("claimed_at"), F.lit(1).alias("attempts")))
    queue.recover("2024-01-30 00:00:00", "recover")
    return queue.rows().select("event_id", "status")


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS reset_stuck, count(*) FILTER (WHERE event_type = 'error' AND contains(props, '\"k\": 1')) AS retried FROM events")
def bulk_transition(t: Tables) -> DataFrame:
    failed = (F.col("event_type") == "error") & F.col("props").contains('"k": 1')
    return t.events.agg(F.count_if(F.col("event_type") == "view").alias("reset_stuck"), F.count_if(failed).alias("retried"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN quality = 1 THEN substr(text, 1, 15000) END AS preview, CASE WHEN quality = 1 THEN sha256(text) END AS preview_hash FROM documents JOIN labels USING (doc_id)")
def ocr_status_update(t: Tables) -> DataFrame:
    """The preview is cut, its hash is of the full text."""
    done = F.col("quality") == 1
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.when(done, "completed").otherwise("failed").alias("status"), F.when(done, F.substring("text", 1, 15_000)).alias("preview"), F.when(done, F.sha2("text", 256)).alias("preview_hash"))


# State, action, next state.
JOB = (("needs_review", "approve", "approved"), ("approved", "index", "indexed"), ("index_failed", "index", "indexed"), ("needs_review", "reject", "rejected"), ("approved", "reject", "rejected"), ("index_failed", "reject", "rejected"))
STATE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'index_failed' ELSE 'indexed' END"
ACTION_SQL = "CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'index' ELSE 'reject' END"


@query(f"""WITH m(state, action, next) AS (VALUES {', '.join(map(str, JOB))}), j AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, {STATE_SQL} AS state, {ACTION_SQL} AS action, doc_id % 5 <> 0 AS link FROM documents),
n AS (SELECT j.doc_id, hash, link, j.state, j.action, coalesce(next, j.state) AS next, next IS NOT NULL AS allowed FROM j LEFT JOIN m ON j.state = m.state AND j.action = m.action),
k AS (SELECT *, min(doc_id) FILTER (WHERE link AND next <> 'rejected') OVER (PARTITION BY hash) AS oldest FROM n),
d AS (SELECT *, CASE WHEN next = 'rejected' THEN NULL WHEN link THEN oldest ELSE doc_id END AS document_id FROM k),
v AS (SELECT doc_id, row_number() OVER (PARTITION BY document_id ORDER BY doc_id) AS version, lag(doc_id) OVER (PARTITION BY document_id ORDER BY doc_id) AS supersedes, lead(doc_id) OVER (PARTITION BY document_id ORDER BY doc_id) IS NULL AS is_current FROM d WHERE next = 'indexed')
SELECT doc_id, state, action, next, allowed, document_id, version, supersedes, coalesce(is_current, false) AS is_current FROM d LEFT JOIN v USING (doc_id)""")
def job_state_machine(t: Tables) -> DataFrame:
    """Ingestion jobs after their action, with the document that each is linked to and the versions of it.

    A job that links (four in five) joins the oldest of the linking jobs of equal content that are not rejected;
    another one is a document of its own; a rejected one has none.  Indexed jobs are a document's versions by
    their id, each superseding the one before, the last being current.  A document may have any number of
    versions: they are numbered by prefix sums, and the version before is found by its number.
    """
    moves = t.rows("state string, action string, to string", *JOB)
    jobs_ = t.documents.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"), F.expr(STATE_SQL).alias("state"), F.expr(ACTION_SQL).alias("action"), (F.col("doc_id") % 5 != 0).alias("link"))
    moved = jobs_.join(F.broadcast(moves), ["state", "action"], "left").select("doc_id", "hash", "link", "state", "action", F.coalesce("to", "state").alias("next"), F.col("to").isNotNull().alias("allowed"))
    rows, links = written(moved, "jobs"), F.col("link") & (F.col("next") != "rejected")
    oldest = rows.groupBy("hash").agg(F.min(F.when(links, F.col("doc_id"))).alias("oldest"), n_rows().alias("n"))
    document = F.when(F.col("next") != "rejected", F.when(F.col("link"), F.col("oldest")).otherwise(F.col("doc_id")))
    linked = join_dealt(rows, oldest, ["hash"]).select("doc_id", "state", "action", "next", "allowed", document.alias("document_id"))
    versions = written(numbered(linked.filter("next = 'indexed'").select("doc_id", "document_id"), ["document_id"], ["doc_id"], "version"), "versions")
    beside = lambda by, name: versions.select("document_id", (F.col("version") + by).alias("version"), F.col("doc_id").alias(name))
    chained = versions.join(beside(1, "supersedes"), ["document_id", "version"], "left").join(beside(-1, "later"), ["document_id", "version"], "left")
    known = chained.select("doc_id", "version", "supersedes", F.col("later").isNull().alias("is_current"))
    return linked.join(known, "doc_id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN 'synced' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sync_state_machine(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 1, "synced").when(F.col("quality") == 0, "failed").otherwise("pending")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 5")
def batch_claim(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti").orderBy("doc_id").limit(5)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS strikes, count(*) FILTER (WHERE event_type = 'error') >= 3 AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1")
def retry_strikes(t: Tables) -> DataFrame:
    strikes = F.count_if(F.col("event_type") == "error")
    return t.events.filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-29'")).groupBy("user_id").agg(strikes.alias("strikes"), (strikes >= 3).alias("failed"))


@query()
def conversation_state(t: Tables) -> DataFrame:
    """The situation folded over a session's turns, one row a turn.

    A user's message that starts or updates a situation sets it; every other turn keeps the one there is, even one that
    speaks of things in general.  A turn without text changes nothing; turns at one place follow by role and text.
    """
    situation = "struct<title: string, entities: array<string>>"
    said = F.sort_array(F.collect_list(F.struct("pos", "role", F.coalesce("content", F.lit("")).alias("x"))))

    def after(log: Column, turn: Column) -> Column:
        old = F.element_at(log, -1)
        m = transition(turn["x"], old["entities"], F.lit(False))
        entities = F.when(m["action"] == "update", F.array_union(old["entities"], m["found"])).otherwise(m["found"])
        new = F.struct(title_of(entities).alias("title"), entities.alias("entities")).cast(situation)
        moves = (turn["role"] == "user") & m["action"].isin("start", "update")
        return F.concat(log, F.array(F.when(moves, new).otherwise(old)))

    nothing = F.array(F.struct(F.lit(None).alias("title"), F.lit(None).alias("entities")).cast(situation))
    folded = t.turns.groupBy("session_id").agg(said.alias("said")).select("session_id", "said", F.aggregate("said", nothing, after).alias("log"))
    rows = folded.select("session_id", F.inline(F.arrays_zip("said", F.slice("log", 2, F.size("said")).alias("now"))))
    return rows.select("session_id", "said.pos", "now.title", F.coalesce(F.size("now.entities"), F.lit(0)).alias("entities"))


def turn_facts(turns: DataFrame) -> DataFrame:
    """What the fold over a session needs of each turn (session_id, pos, role, content)."""
    rows = turns.select("session_id", "pos", "role", F.coalesce("content", F.lit("")).alias("x")).withColumn("found", entities_of(F.col("x")))
    moves = (F.col("role") == "user") & ~any_pattern(F.col("x"), lex.BROADENING)
    event = F.col("x").rlike(f"(?i){lex.EVENT_MARKERS}")
    return rows.select("session_id", "pos", "role", "x", "found", F.transform("found", F.lower).alias("lowered"), F.coalesce(moves, F.lit(False)).alias("moves"), event.alias("event"))


def situations(folded: DataFrame) -> DataFrame:
    title = F.when(F.col("entities").isNotNull(), title_of(F.col("entities")))
    return folded.select("session_id", "pos", title.alias("title"), F.coalesce(F.size("entities"), F.lit(0)).alias("entities"))


@query()
def conversation_state_stream(t: Tables) -> DataFrame:
    """``conversation_state`` by a stream with a keyed state: no session's text is collected."""
    table = t.conversations
    read = jobs.read_stream(t.spark, f"{t.folder}/conversations.parquet", table.schema)
    return situations(jobs.fold_situations(turn_facts(as_turns(read)), fresh_folder(t.spark, "situations")))


TIER_OF = {"click": "messages", "view": "api", "purchase": "uploads", "error": "strict"}
TIER_SQL = f"CASE event_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in TIER_OF.items())} ELSE 'sessions' END"


@query(f"""WITH p(tier, minutes, most) AS (VALUES {', '.join(map(str, lex.RATE_TIERS))}), e AS (SELECT ts, user_id, {TIER_SQL} AS tier FROM events)
SELECT date_trunc('minute', ts) - to_minutes(minute(ts) % minutes) AS start, user_id, tier, count(*) AS n, count(*) > any_value(most) AS limited FROM e JOIN p USING (tier) GROUP BY 1, 2, 3""")
def rate_limit_fixed_window(t: Tables) -> DataFrame:
    """Each tier's requests of a user in its windows, which start at whole minutes; the kind of event stands for the tier."""
    tier = F.lit("sessions")
    for kind, name in TIER_OF.items():
        tier = F.when(F.col("event_type") == kind, name).otherwise(tier)
    tiers = t.rows("tier string, minutes int, most int", *lex.RATE_TIERS)
    counted = t.events.groupBy(F.window("ts", "1 minute").alias("w"), "user_id", tier.alias("tier")).agg(n_rows().alias("n"))
    start = F.col("w.start") - F.make_dt_interval(mins=F.minute("w.start") % F.col("minutes"))
    by_window = counted.join(F.broadcast(tiers), "tier").groupBy(start.alias("start"), "user_id", "tier", "most").agg(F.sum("n").alias("n"))
    return by_window.select("start", "user_id", "tier", "n", (F.col("n") > F.col("most")).alias("limited"))


STALL_SQL = "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND ts < TIMESTAMP '{0}') AS synced, count(*) FILTER (WHERE event_type <> 'purchase' AND ts < TIMESTAMP '{0}') AS pending FROM events GROUP BY 1"


@query(f"""WITH a AS ({STALL_SQL.format('2024-01-28')}), b AS ({STALL_SQL.format('2024-01-31')})
SELECT user_id, b.synced, b.pending, a.synced AS before, b.synced - a.synced AS delta, b.synced <= a.synced AND b.pending > 0 AS stalled FROM b LEFT JOIN a USING (user_id)""")
def stall_detector(t: Tables) -> DataFrame:
    """Two runs with one state folder, three days apart: users with work left and no more of it done than before."""
    store = Snapshots(t.spark, fresh_folder(t.spark, "stalls"), "user_id bigint, synced bigint, pending bigint, before bigint, delta bigint, stalled boolean")

    def now(day: str) -> DataFrame:
        until, done = F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{day}'"), F.col("event_type") == "purchase"
        return t.events.groupBy("user_id").agg(F.count_if(until & done).alias("synced"), F.count_if(until & ~done).alias("pending"))

    progress(store, now("2024-01-28"), ["user_id"])
    return progress(store, now("2024-01-31"), ["user_id"])


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, CAST(floor((k - 1) / 3) AS BIGINT) AS batch, count(*) AS done, count(*) FILTER (WHERE n_chars < 100) AS failed FROM r GROUP BY ALL")
def parallel_batches(t: Tables) -> DataFrame:
    """Groups of three a source, each row with its outcome; tasks, not pauses, bound the concurrency."""
    batch = F.floor((F.col("rank") - 1) / 3)
    rows = numbered(t.documents.select("doc_id", "source", "n_chars"), ["source"], ["doc_id"])
    return rows.groupBy("source", batch.alias("batch")).agg(n_rows().alias("done"), F.count_if(F.col("n_chars") < 100).alias("failed"))
