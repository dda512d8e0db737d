"""Sources and sinks.  A sink query returns what it wrote, read back; mutations return the new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered
from quillspark.operators.relational import insert_missing, upsert
from quillspark.registry import query
from quillspark.sources.files import all_file_texts, dealt, write_files
from quillspark.sources.sinks import fresh_folder, written
from quillspark.sources.snapshots import Snapshots, progress
from quillspark.sources.tables import Tables


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id DESC")
def scan_table(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("doc_id"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND ends_with(lower(url), '.html')")
def object_list_scan(t: Tables) -> DataFrame:
    return t.pages.filter(F.col("url").startswith("https://") & F.lower("url").endswith(".html")).select("page_id", "url")


@query()
def object_read(t: Tables) -> DataFrame:
    """Whole objects as bytes; only the listing columns and the size are returned."""
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{t.folder}/region.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.length("content").cast("long").alias("read"))


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
ENDING_SQL = f"CASE WHEN doc_id % 3 = 0 AND NOT regexp_matches(coalesce(text, ''), '{CONTROL}') THEN 'docx' WHEN doc_id % 3 = 1 THEN 'dat' ELSE 'txt' END"
WORD_SQL = "substr(replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10), 1, 15000)"


def previews(t: Tables, types: tuple[str, ...]) -> DataFrame:
    """Every document written as a file of its own, plain, of a word processor or of an unknown type, and read back by type."""
    folder = fresh_folder(t.spark, "files")
    readable = ~F.coalesce("text", F.lit("")).rlike(CONTROL)
    ending = F.when((F.col("doc_id") % 3 == 0) & readable, "docx").when(F.col("doc_id") % 3 == 1, "dat").otherwise("txt")
    # A row's number tells rows of one doc_id apart.
    rows = dealt(t.documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "row")
    name = F.concat_ws(".", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row", ending)
    write_files(rows.select(name.alias("name"), "text"), folder)
    return all_file_texts(t.spark, folder, types).select(F.split("name", r"\.")[0].try_cast("long").alias("doc_id"), "preview")


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {ENDING_SQL} AS ending FROM documents) SELECT doc_id, CASE ending WHEN 'dat' THEN '' WHEN 'docx' THEN {WORD_SQL} ELSE substr(text, 1, 15000) END AS preview FROM d")
def text_extract_source(t: Tables) -> DataFrame:
    """Plain files as they are, word-processor files a paragraph a line; any other type gives an empty text."""
    return previews(t, (".txt", ".docx"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {ENDING_SQL} AS ending FROM documents) SELECT doc_id, CASE ending WHEN 'txt' THEN substr(text, 1, 15000) ELSE '' END AS preview FROM d")
def legacy_text_extract(t: Tables) -> DataFrame:
    """The older variant reads no word-processor file: those give an empty text."""
    return previews(t, (".txt",))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def ocr_source(t: Tables) -> DataFrame:
    pages = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(pages, lambda x: x["text"]), "\n\n--- Page Break ---\n\n").alias("text"))


@query("SELECT * FROM nation")
def insert_sink(t: Tables) -> DataFrame:
    return written(t.nation, "insert")


@query("SELECT n_nationkey, n_name FROM (SELECT n_nationkey + 20 AS n_nationkey, n_name FROM nation) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def upsert_do_nothing(t: Tables) -> DataFrame:
    batch = t.nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), "n_name")
    return insert_missing(t.nation, batch, ["n_nationkey"])


@query("SELECT coalesce(a.n_nationkey, b.k) AS n_nationkey, coalesce(a.n_name, b.n_name) AS n_name FROM nation a FULL JOIN (SELECT n_nationkey + 20 AS k, 'new ' || n_name AS n_name FROM nation) b ON a.n_nationkey = b.k")
def get_or_create(t: Tables) -> DataFrame:
    """An existing row wins unchanged."""
    fresh = t.nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new "), "n_name").alias("fresh"))
    return t.nation.select("n_nationkey", "n_name").join(fresh, "n_nationkey", "full").select("n_nationkey", F.coalesce("n_name", "fresh").alias("n_name"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 9, 0 FROM documents WHERE doc_id % 4 = 0")
def upsert_analytics(t: Tables) -> DataFrame:
    fresh = t.documents.filter("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(0).alias("toxic"))
    return upsert(t.labels.select("doc_id", "quality", "toxic"), fresh, ["doc_id"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def delete_sink(t: Tables) -> DataFrame:
    """Rows left after a delete of parents that cascades to their children."""
    return t.labels.join(t.documents.filter("lang = 'fr'"), "doc_id", "left_anti").select("doc_id", "quality")


@query("SELECT page_id, CAST(floor((row_number() OVER (PARTITION BY substr(url, 1, 8) ORDER BY page_id) - 1) / 1000) AS BIGINT) AS batch FROM pages WHERE contains(lower(url), 'example.org')")
def object_delete_by_pattern(t: Tables) -> DataFrame:
    """The keys that a purge would name, in batches of 1000 a prefix; nothing is deleted."""
    hit = t.pages.filter(F.lower("url").contains("example.org")).select("page_id", F.substring("url", 1, 8).alias("prefix"))
    return numbered(hit, ["prefix"], ["page_id"]).select("page_id", F.floor((F.col("rank") - 1) / 1000).alias("batch"))


@query("SELECT page_id, '/blobs/' || md5(html) || regexp_extract(url, '(\\.[a-z]+)$', 1) AS path FROM pages")
def content_addressed_save(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.concat(F.lit("/blobs/"), F.md5("html"), F.regexp_extract("url", r"(\.[a-z]+)$", 1)).alias("path"))


@query()
def doc_index_sink(t: Tables) -> DataFrame:
    """A local index: chunks of 200 words that overlap by 20, partitioned by town."""
    from quillspark.functions.text import whitespace_chunks

    chunks = t.documents.select("doc_id", F.col("source").alias("town"), F.posexplode(whitespace_chunks(F.col("text"))).alias("chunk", "content"))
    return written(chunks, "index", partition_by=["town"]).groupBy("town").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs"))


@query()
def json_response_sink(t: Tables) -> DataFrame:
    answer = F.struct(F.lit(True).alias("v2"), F.struct(F.length("content").alias("chars")).alias("answerMeta"), F.array(F.lit("S1")).alias("sources"), F.array().cast("array<string>").alias("suggestedFollowUps"), F.array().cast("array<string>").alias("notices"))
    return t.turns.filter("role = 'assistant'").select("session_id", "pos", F.to_json(answer).alias("citations"))


@query("WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents WHERE lang = 'fr') SELECT doc_id, greatest(n - 20, 0) AS remaining FROM l WHERE k <= 20")
def migrate_batch(t: Tables) -> DataFrame:
    local = t.documents.filter("lang = 'fr'")
    left = local.agg(F.greatest(F.count(F.lit(1)) - 20, F.lit(0)).alias("remaining"))  # one row
    return local.orderBy("doc_id").limit(20).select("doc_id").crossJoin(F.broadcast(left))


@query("SELECT count(*) AS synced, 0 AS pending, count(*) FILTER (WHERE labelled) AS before, count(*) FILTER (WHERE NOT labelled) AS delta, false AS stalled FROM (SELECT doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)")
def state_file(t: Tables) -> DataFrame:
    """Two runs with one state folder: the labelled documents are synced by the first, all by the second."""
    store = Snapshots(t.spark, fresh_folder(t.spark, "progress"), "synced bigint, pending bigint, before bigint, delta bigint, stalled boolean")
    marked = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("labelled")).distinct(), "doc_id", "left")
    progress(store, marked.agg(F.count("labelled").alias("synced"), F.count_if(F.col("labelled").isNull()).alias("pending")), [])
    return progress(store, marked.agg(F.count(F.lit(1)).alias("synced"), F.lit(0).cast("long").alias("pending")), [])


@query()
def request_log_sink(t: Tables) -> DataFrame:
    log = t.events.select(F.lit("GET").alias("method"), F.concat(F.lit("/api/"), "event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.round("value", 2).alias("duration"))
    return written(log, "requests").groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS town, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS category FROM pages")
def audit_dry_run(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("town"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("category"))
