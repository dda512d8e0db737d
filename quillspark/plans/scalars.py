"""Scalar functions: hashes, names, dates, scores, text cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lex
from quillspark.functions import paths
from quillspark.functions.text import contains_any, first_match, half_up, ladder_sql, once
from quillspark.registry import query
from quillspark.sources.tables import Tables

# Keys that hit what the tables' own names rarely do.
KEYS = (
    "ossipee/g/031225zoningordinance2025final_0.pdf",
    "ossipee/g/budget_committee_schedule_2026.pdf",
    "ossipee/g/cemetery_tax_maps_02_10_2014v_3reduced.pdf",
    "ossipee/g/assessment_versus_market_value_19-0327.pdf",
    "conway/minutes/Planning_Board/2023/minutes-1-5-99.pdf",
    "Conway/agendas/Zoning/x/agenda_2024-03-07.PDF",
    "conway/minutes/library.txt",
    "conway/town report 2019 (planning board).docx",
    "conway/selectmen-minutes-3-14-24.pdf",
    "madison/warrant article 1998.doc",
    "madison/ballot",
)
VALUES = ", ".join(f"('{k}')" for k in KEYS)

# Expressions that Spark and DuckDB read alike: the tables hold no municipal files, so a document is filed under a name made of its columns.
MONTH, DAY, YEAR = "CAST(doc_id % 12 + 1 AS STRING)", "CAST(doc_id % 28 + 1 AS STRING)", "CAST(1990 + doc_id % 35 AS STRING)"
STAMP = f"""CASE doc_id % 4 WHEN 0 THEN '-' || {MONTH} || '-' || {DAY} || '-' || lpad(CAST(doc_id % 100 AS STRING), 2, '0')
  WHEN 1 THEN '_' || {YEAR} || '-' || lpad({MONTH}, 2, '0') || '-' || lpad({DAY}, 2, '0') WHEN 2 THEN ' ' || lpad({MONTH}, 2, '0') || '-' || lpad({DAY}, 2, '0') || '-' || {YEAR} ELSE '' END"""
SUFFIX = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.TXT' ELSE '' END"
FOLDER = f"""CASE doc_id % 7 WHEN 0 THEN 'minutes/Planning_Board/' || {YEAR} || '/' WHEN 1 THEN 'agendas/Zoning/x/' WHEN 2 THEN 'misc/' ELSE '' END"""
TITLE = "CASE doc_id % 7 WHEN 0 THEN 'minutes' WHEN 1 THEN 'agenda' WHEN 2 THEN 'warrant article' WHEN 3 THEN 'budget_committee' WHEN 4 THEN 'town report (planning board)' WHEN 5 THEN 'selectmen-meeting' ELSE 'library' END"
DOC_KEY = f"source || '/' || {FOLDER} || {TITLE} || {STAMP} || {SUFFIX}"
DOC_NAME = f"CAST(doc_id AS STRING) || '-' || {TITLE} || {STAMP} || {SUFFIX}"
URL_KEY = "regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '/+$', '')"
PARTS = "list_filter(string_split(key, '/'), lambda x: x <> '')"
NAMED = f"""WITH k(key) AS (SELECT key FROM (SELECT {DOC_KEY} AS key FROM documents UNION ALL SELECT {URL_KEY} FROM pages) WHERE key <> '' UNION ALL VALUES {VALUES}),
n AS (SELECT key, {PARTS} AS p, {PARTS}[-1] AS name FROM k)"""
BOARD_TEXT = "translate(lower(name), '_-', '  ')"


def keys(t: Tables) -> DataFrame:
    """What a bucket listing would give: a key for each document, each page's address, and literal ones; an empty or null key is none."""
    filed, addresses = t.documents.select(F.expr(DOC_KEY).alias("key")), t.pages.select(F.expr(URL_KEY).alias("key"))
    return filed.union(addresses).filter("key <> ''").union(t.rows("key string", *[(k,) for k in KEYS]))


def names(t: Tables) -> DataFrame:
    return keys(t).select("key", F.element_at(F.split("key", "/"), -1).alias("name"))


def empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


@query("SELECT doc_id, sha256(text) AS raw_hash, CASE WHEN substr(text, 1, 500) <> '' THEN sha256(substr(text, 1, 500)) END AS preview_hash FROM documents")
def sha256_bytes_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("raw_hash"), F.sha2(empty(F.substring("text", 1, 500)), 256).alias("preview_hash"))


@query("SELECT page_id, md5(html) AS name FROM pages")
def md5_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5("html").alias("name"))


@query("SELECT count(DISTINCT substr(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')), 1, 500)) AS contents FROM documents")
def rolling_hash_31(t: Tables) -> DataFrame:
    """The hash serves equality only, so the cut text itself is the key."""
    cut = F.substring(F.trim(F.regexp_replace("text", r"[ \n\t\r]+", " ")), 1, 500)
    return t.documents.agg(F.countDistinct(cut).alias("contents"))


MIME_SQL = "CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in paths.MIME) + " ELSE 'application/octet-stream' END"


@query(f"{NAMED} SELECT key, {MIME_SQL} AS mime FROM n")
def mime_from_ext(t: Tables) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in paths.MIME for x in pair])
    return names(t).select("key", F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))), F.lit("application/octet-stream")).alias("mime"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part")
def capitalize_first(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")).alias("name"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type || ' ' || p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part")
def title_case_word(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.initcap(F.concat_ws(" ", "p_type", "p_name")).alias("name"))


@query(f"{NAMED} SELECT key, array_to_string(list_transform(regexp_extract_all(lower(name || chr(39) || 's town'), '([a-z0-9_]+|[^a-z0-9_]+)', 1), lambda w: upper(w[1]) || w[2:]), '') AS title FROM n")
def title_case_boundary(t: Tables) -> DataFrame:
    """Upper case after every word boundary, so that an apostrophe starts a new word."""
    pieces = F.regexp_extract_all(F.lower(F.concat(F.col("name"), F.lit("'s town"))), F.lit("([a-z0-9_]+|[^a-z0-9_]+)"), F.lit(1))
    upper = F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return names(t).select("key", F.array_join(upper, "").alias("title"))


@query(f"{NAMED} SELECT key, lower(p[1]) AS town, CASE WHEN len(p) >= 3 THEN lower(p[2]) ELSE 'misc' END AS category, CASE WHEN len(p) >= 4 THEN replace(p[3], '_', ' ') END AS board, nullif(regexp_extract(key, '/([0-9]{{4}})/', 1), '') AS year, coalesce(lower(p[2]) = 'minutes', false) AS is_minutes FROM n WHERE len(p) >= 2")
def path_metadata_structured(t: Tables) -> DataFrame:
    p = F.array_remove(F.split("key", "/"), "")
    kind = F.lower(F.get(p, F.lit(1)))
    board = F.when(F.size(p) >= 4, F.translate(F.get(p, F.lit(2)), "_", " "))
    return keys(t).filter(F.size(p) >= 2).select("key", F.lower(F.get(p, F.lit(0))).alias("town"), F.when(F.size(p) >= 3, kind).otherwise("misc").alias("category"), board.alias("board"), empty(F.regexp_extract("key", r"/(\d{4})/", 1)).alias("year"), F.coalesce(kind == "minutes", F.lit(False)).alias("is_minutes"))


DATE_SQL = "nullif(regexp_extract(name, '(\\d{1,2}[-_]\\d{1,2}[-_]\\d{2,4}|\\d{4}[-_]\\d{1,2}[-_]\\d{1,2})', 1), '')"
ISO_SQL = """CASE WHEN len(string_split(replace(d, '_', '-'), '-')) <> 3 THEN d WHEN length(string_split(replace(d, '_', '-'), '-')[1]) = 4 THEN replace(d, '_', '-')
  ELSE CASE WHEN length(string_split(replace(d, '_', '-'), '-')[3]) = 2 THEN CASE WHEN string_split(replace(d, '_', '-'), '-')[3]::INT > 50 THEN '19' ELSE '20' END ELSE '' END || string_split(replace(d, '_', '-'), '-')[3] || '-' || lpad(string_split(replace(d, '_', '-'), '-')[1], 2, '0') || '-' || lpad(string_split(replace(d, '_', '-'), '-')[2], 2, '0') END"""


@query(f"""{NAMED}, d AS (SELECT *, {DATE_SQL} AS d, len(p) >= 4 AND lower(p[2]) IN ('minutes', 'agendas', 'budgets') AS deep FROM n), i AS (SELECT *, {ISO_SQL} AS iso FROM d)
SELECT key, lower(p[1]) AS town, CASE WHEN deep THEN lower(p[2]) ELSE {ladder_sql('lower(name)', paths.CATEGORIES, 'document')} END AS category,
  CASE WHEN deep THEN replace(p[3], '_', ' ') ELSE {ladder_sql(BOARD_TEXT, paths.BOARDS)} END AS board,
  coalesce(string_split(iso, '-')[1], nullif(CASE WHEN deep THEN regexp_extract(p[4], '^(\\d{{4}})', 1) ELSE regexp_extract(name, '((?:19|20)\\d{{2}})', 1) END, '')) AS year, iso AS meeting_date FROM i WHERE len(p) >= 2""")
def path_metadata_flat(t: Tables) -> DataFrame:
    return keys(t).select("key", paths.flat_metadata(F.col("key")).alias("m")).filter("m IS NOT NULL").select("key", "m.*")


@query(f"{NAMED} SELECT key, {ladder_sql(BOARD_TEXT, paths.BOARDS)} AS board FROM n")
def board_from_filename(t: Tables) -> DataFrame:
    return names(t).select("key", paths.board_of(F.col("name")).alias("board"))


@query(f"{NAMED} SELECT key, {ladder_sql('lower(name)', paths.CATEGORIES, 'document')} AS category FROM n")
def category_from_filename(t: Tables) -> DataFrame:
    return names(t).select("key", paths.category_of(F.col("name")).alias("category"))


@query(f"{NAMED}, d AS (SELECT key, {DATE_SQL} AS d FROM n) SELECT key, {ISO_SQL} AS day FROM d")
def normalize_date_dash(t: Tables) -> DataFrame:
    return names(t).select("key", paths.iso_date(empty(F.regexp_extract("name", paths.DATE, 1))).alias("day"))


@query(f"{NAMED} SELECT key, coalesce(try_strptime(nullif(regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d'), try_strptime(nullif(regexp_extract(name, '(\\d{{2}}-\\d{{2}}-\\d{{4}})', 1), ''), '%m-%d-%Y'))::DATE AS day FROM n")
def date_from_filename_strict(t: Tables) -> DataFrame:
    found = lambda pattern, form: F.try_to_date(empty(F.regexp_extract("name", pattern, 1)), form)
    return names(t).select("key", F.coalesce(found(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), found(r"(\d{2}-\d{2}-\d{4})", "MM-dd-yyyy")).alias("day"))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATES = ("January 5, 2024", "sept. 3rd 2021", "3/9/2020", "2022-7-4", "13/45/2024", "Mar 31 1999", "no date", "")


def text_date(raw: Column) -> Column:
    """Written and numeric dates as ``YYYY-MM-DD``; nothing checks that the day exists."""
    text = F.lower(F.replace(raw, F.lit("."), F.lit("")))
    written = r"^([a-z]{3,9}) (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"
    two = lambda c: F.lpad(c, 2, "0")
    dash = lambda y, m, d: F.concat_ws("-", y, two(m), two(d))
    group = lambda p, k: F.regexp_extract(text, p, k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(group(written, 1), 1, 3))
    american, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    return (
        F.when(text.rlike(written) & (month > 0), dash(group(written, 3), month.cast("string"), group(written, 2)))
        .when(text.rlike(american), dash(group(american, 3), group(american, 1), group(american, 2)))
        .when(text.rlike(iso), dash(group(iso, 1), group(iso, 2), group(iso, 3)))
    )


@query("""WITH d(raw, day) AS (VALUES ('January 5, 2024', '2024-01-05'), ('sept. 3rd 2021', '2021-09-03'), ('3/9/2020', '2020-03-09'), ('2022-7-4', '2022-07-04'), ('13/45/2024', '2024-13-45'), ('Mar 31 1999', '1999-03-31'), ('no date', NULL), ('', NULL))
SELECT raw, day FROM d UNION ALL SELECT CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%b. %-dth %Y') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE o_orderpriority END,
  CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END FROM orders""")
def parse_date_iso(t: Tables) -> DataFrame:
    """Every order's day, written in one of four ways (or not at all), and literal texts."""
    forms = ("MMMM d, yyyy", "MMM. d'th' yyyy", "M/d/yyyy", "yyyy-M-d")
    raw = F.col("o_orderpriority")
    for k, form in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 5 == k, F.date_format("o_orderdate", form)).otherwise(raw)
    texts = t.orders.select(raw.alias("raw")).union(t.rows("raw string", *[(d,) for d in DATES]))
    return texts.select("raw", text_date(F.col("raw")).alias("day"))


@query(f"""{NAMED}, i AS (SELECT key, name, {ladder_sql('lower(name)', paths.UPLOAD_CATEGORIES, 'misc_other')} AS category, coalesce({ladder_sql('lower(name)', paths.UPLOAD_BOARDS)}, '') AS board, regexp_extract(name, '(20\\d{{2}}|19\\d{{2}})', 1) AS year FROM n)
SELECT key, category, board, year, category = 'meeting_minutes' AS is_minutes, CASE WHEN category = 'meeting_minutes' AND regexp_matches(name, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') THEN
  CASE WHEN length(regexp_extract(name, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', 3)) = 2 THEN CASE WHEN starts_with(regexp_extract(name, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', 3), '9') THEN '19' ELSE '20' END ELSE '' END
  || regexp_extract(name, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', 3) || '-' || lpad(regexp_extract(name, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', 1), 2, '0') || '-' || lpad(regexp_extract(name, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', 2), 2, '0') END AS meeting_date FROM i""")
def infer_from_filename(t: Tables) -> DataFrame:
    low, pattern = F.lower("name"), r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
    part = lambda k: F.regexp_extract("name", pattern, k)
    century = F.when(F.length(part(3)) == 2, F.when(part(3).startswith("9"), "19").otherwise("20")).otherwise("")
    date = F.concat(century, part(3), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
    seen = names(t).select("key", "name", first_match(low, paths.UPLOAD_CATEGORIES, "misc_other").alias("category"), F.coalesce(first_match(low, paths.UPLOAD_BOARDS), F.lit("")).alias("board"), F.regexp_extract("name", r"(20\d{2}|19\d{2})", 1).alias("year"))
    minutes = F.col("category") == "meeting_minutes"
    return seen.select("key", "category", "board", "year", minutes.alias("is_minutes"), F.when(minutes & F.col("name").rlike(pattern), date).alias("meeting_date"))


CATEGORIES = [name for name, _ in paths.UPLOAD_CATEGORIES] + ["misc_other"]
REPLIES = (
    ("budget.pdf", '```json\n{"category": "budget", "year": "2024", "town": " ossipee ", "notes": "n"}\n```'),
    ("a.pdf", 'Sure: {"category": "zoning", "year": 2024, "isMinutes": 0} done'),
    ("b.pdf", '<html><body>{"category": "taxes", "isMinutes": true, "rawDateText": "March 5, 2024"}</body></html>'),
    ("c.pdf", '{"category": "cip", "isMinutes": "yes", "meetingDate": "3/9/2020", "meetingType": "special"}'),
    ("planning board minutes 2023.pdf", "no json"),
    ("warrant 2022.pdf", '{"category": "budget", '),
    ("d.txt", ""),
)


def json_body(reply: Column) -> Column:
    """The object of a reply: fences go, of a page the object before a tag or the end (else its text), else what is between the outer braces."""

    def unwrapped(bare: Column) -> Column:
        page = bare.startswith("<") | bare.contains("<ht")
        inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"\{[\s\S]*?\}(?=\s*$|\s*<)", 0), F.lit("")), F.trim(F.regexp_replace(bare, r"<[^>]*>", "")))
        return F.when(page, inner).otherwise(bare)

    braced = lambda text: F.when(text.startswith("{"), text).otherwise(F.coalesce(F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit("")), text))
    return once(once(F.trim(F.regexp_replace(reply, r"```(?:json)?\n?", "")), unwrapped), braced)


def record_of(reply: Column, name: Column) -> Column:
    """A model's reply as document metadata; one that is no object falls back on the file name."""
    return once(F.try_parse_json(json_body(reply)), lambda v: fields_of(v, name))


def fields_of(v: Column, name: Column) -> Column:
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    said = lambda k: F.when(kind(k) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    blank = lambda x: F.coalesce(x, F.lit(""))
    flag = kind("isMinutes")
    value = F.try_variant_get(v, "$.isMinutes", "string")
    is_minutes = F.coalesce(F.when(flag == "STRING", value != "").when(flag == "VOID", False).when(flag == "BOOLEAN", value == "true").when(flag.rlike("^(?:OBJECT|ARRAY)"), True).otherwise(F.try_variant_get(v, "$.isMinutes", "double") != 0), F.lit(False))
    category = F.when(is_minutes, "meeting_minutes").when(said("category").isin(*CATEGORIES), said("category")).otherwise("misc_other")
    day = F.when(blank(said("meetingDate")) != "", F.coalesce(text_date(said("meetingDate")), said("meetingDate"))).otherwise(text_date(said("rawDateText")))
    parsed = F.schema_of_variant(v).startswith("OBJECT")
    low = F.lower(name)
    guess = first_match(low, paths.UPLOAD_CATEGORIES, "misc_other")
    either = lambda x, y: F.when(parsed, x).otherwise(y)
    nothing = F.lit(None).cast("string")
    return F.struct(
        either(category, guess).alias("category"),
        either(F.initcap(F.trim(blank(said("town")))), F.lit("")).alias("town"),
        either(F.trim(blank(said("board"))), blank(first_match(low, paths.UPLOAD_BOARDS))).alias("board"),
        either(blank(said("year")), F.regexp_extract(name, r"(20\d{2}|19\d{2})", 1)).alias("year"),
        either(F.substring(blank(said("notes")), 1, 200), F.lit("")).alias("notes"),
        either(is_minutes, guess == "meeting_minutes").alias("is_minutes"),
        either(day, nothing).alias("meeting_date"),
        either(said("meetingType"), nothing).alias("meeting_type"),
        either(said("rawDateText"), nothing).alias("raw_date"),
    )


TOWN_SAID, KIND_SAID = "' ' || replace(source, '\"', '') || ' '", "CASE doc_id % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'zoning' WHEN 2 THEN 'taxes' WHEN 3 THEN 'cip' ELSE 'elections' END"
DATE_SAID = f"{MONTH} || '/' || {DAY} || '/' || {YEAR}"
OBJECT = f"""'{{"category": "' || {KIND_SAID} || '", "year": ' || CASE doc_id % 2 WHEN 0 THEN '"' || {YEAR} || '"' ELSE {YEAR} END || ', "town": "' || {TOWN_SAID} || '", "isMinutes": ' || CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE '"yes"' END || ', "rawDateText": "' || {DATE_SAID} || '"}}'"""
REPLY = f"CASE doc_id % 7 WHEN 0 THEN '```json' || chr(10) || {OBJECT} || chr(10) || '```' WHEN 1 THEN 'Sure: ' || {OBJECT} || ' done' WHEN 2 THEN '<html><body>' || {OBJECT} || '</body></html>' WHEN 6 THEN 'no json' ELSE {OBJECT} END"


@query(f"""WITH r AS (SELECT {DOC_NAME} AS name, doc_id % 7 <> 6 AS parsed, doc_id % 3 <> 1 AS im, {KIND_SAID} AS said, trim({TOWN_SAID}) AS town, CASE doc_id % 2 WHEN 0 THEN {YEAR} ELSE '' END AS year, {DATE_SAID} AS raw,
  {YEAR} || '-' || lpad({MONTH}, 2, '0') || '-' || lpad({DAY}, 2, '0') AS day FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT *, {ladder_sql('lower(name)', paths.UPLOAD_CATEGORIES, 'misc_other')} AS guess FROM r)
SELECT name, CASE WHEN NOT parsed THEN guess WHEN im THEN 'meeting_minutes' WHEN said = 'taxes' THEN 'misc_other' ELSE said END AS category, CASE WHEN parsed THEN upper(town[1]) || lower(town[2:]) ELSE '' END AS town,
  CASE WHEN parsed THEN '' ELSE coalesce({ladder_sql('lower(name)', paths.UPLOAD_BOARDS)}, '') END AS board, CASE WHEN parsed THEN year ELSE regexp_extract(name, '(20\\d{{2}}|19\\d{{2}})', 1) END AS year, '' AS notes,
  CASE WHEN parsed THEN im ELSE guess = 'meeting_minutes' END AS is_minutes, CASE WHEN parsed THEN day END AS meeting_date, CAST(NULL AS VARCHAR) AS meeting_type, CASE WHEN parsed THEN raw END AS raw_date FROM g""")
def parse_llm_json(t: Tables) -> DataFrame:
    """Replies about every document with a source, made of its columns: bare, fenced, within prose or a page, or no object at all."""
    rows = t.documents.filter("source IS NOT NULL AND doc_id IS NOT NULL").select(F.expr(DOC_NAME).alias("name"), F.expr(REPLY).alias("reply"))
    return rows.select("name", record_of(F.col("reply"), F.col("name")).alias("m")).select("name", "m.*")


@query("SELECT doc_id, '[' || concat_ws(' - ', nullif(source, ''), CASE WHEN lang <> 'en' THEN lang END, CASE WHEN n_chars > 1000 THEN 'Meeting ' || doc_id END) || '] ' || doc_id || '.txt' AS display FROM documents")
def display_name(t: Tables) -> DataFrame:
    inner = F.concat_ws(" - ", empty(F.col("source")), F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("n_chars") > 1000, F.concat(F.lit("Meeting "), F.col("doc_id").cast("string"))))
    return t.documents.select("doc_id", F.concat(F.lit("["), inner, F.lit("] "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("display"))


@query("SELECT doc_id, k AS key, v AS value FROM (SELECT doc_id, unnest(['town', 'category', 'board']) AS k, unnest([source, lang, CASE WHEN doc_id % 2 = 0 THEN 'b' END]) AS v FROM documents) WHERE v IS NOT NULL")
def metadata_kv(t: Tables) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pairs = F.array(pair("town", F.col("source")), pair("category", F.col("lang")), pair("board", F.when(F.col("doc_id") % 2 == 0, "b")))
    return t.documents.select("doc_id", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("m")).select("doc_id", "m.key", "m.value")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN props END, CASE WHEN event_id % 3 = 1 THEN '{\"s\": 1}' END, '{}') AS metadata FROM events")
def final_or_suggested(t: Tables) -> DataFrame:
    final, suggested = F.when(F.col("event_id") % 3 == 0, F.col("props")), F.when(F.col("event_id") % 3 == 1, '{"s": 1}')
    return t.events.select("event_id", F.coalesce(final, suggested, F.lit("{}")).alias("metadata"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS title FROM pages")
def title_from_docname(t: Tables) -> DataFrame:
    tagged = F.regexp_extract("url", r"^\[[^\]]*\] (.*)$", 1)
    return t.pages.select("page_id", F.when(F.col("url").rlike(r"^\[[^\]]*\] "), tagged).when(F.col("url").contains("/"), F.regexp_extract("url", "([^/]*)$", 1)).otherwise(F.col("url")).alias("title"))


# Fixed value: boards that a document's name may hold.
NAMED_BOARDS = r"(?i)(selectboard|planning\s*board|zoning\s*board|budget\s*committee|trustees)"


@query(rf"""WITH n AS (SELECT source || '/' || (doc_id // 2000) AS query_id, concat_ws(' | ', CASE lang WHEN 'en' THEN 'Statewide law' WHEN 'fr' THEN 'Town  Minutes' ELSE lang END, CASE WHEN doc_id % 7 = 0 THEN 'STATEWIDE' ELSE source END,
  CASE lang WHEN 'de' THEN 'Planning Board minutes' WHEN 'es' THEN 'Budget  Committee' ELSE split_part(text, ' ', 1) END, CAST(2000 + doc_id % 25 AS VARCHAR)) AS name FROM documents WHERE source IS NOT NULL),
p AS (SELECT query_id, name, regexp_replace(lower(trim(string_split(name, ' | ')[1])), '\s+', '_', 'g') AS category, trim(string_split(name, ' | ')[2]) AS town, regexp_replace(lower(regexp_extract(name, '{NAMED_BOARDS}', 1)), '\s+', '_', 'g') AS board FROM n)
SELECT query_id, count(DISTINCT name) AS docs, coalesce(list_sort(list(DISTINCT category) FILTER (WHERE category <> '' AND NOT contains(category, 'statewide'))), []) AS categories,
  coalesce(list_sort(list(DISTINCT town) FILTER (WHERE town <> '' AND NOT contains(lower(town), 'statewide'))), []) AS towns, coalesce(list_sort(list(DISTINCT board) FILTER (WHERE board <> '')), []) AS boards FROM p GROUP BY 1""")
def parse_docname_pipe(t: Tables) -> DataFrame:
    """The categories, towns and boards that the names of a query's documents stand for.

    A name is ``Category | Town | Title | Year``, made here of a document's columns; what is statewide is left out,
    and a board counts wherever in the name it stands.  A query is a source's rows of 2000 ids in a row.
    """
    category = F.when(F.col("lang") == "en", "Statewide law").when(F.col("lang") == "fr", "Town  Minutes").otherwise(F.col("lang"))
    town = F.when(F.col("doc_id") % 7 == 0, "STATEWIDE").otherwise(F.col("source"))
    title = F.when(F.col("lang") == "de", "Planning Board minutes").when(F.col("lang") == "es", "Budget  Committee").otherwise(F.split("text", " ", 2)[0])
    query_id = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 2000).cast("string"))
    names = t.documents.filter("source IS NOT NULL").select(query_id.alias("query_id"), F.concat_ws(" | ", category, town, title, (F.col("doc_id") % 25 + 2000).cast("string")).alias("name"))
    parsed = names.select("query_id", "name", *docname_parts(F.col("name")))
    return parsed.groupBy("query_id").agg(F.countDistinct("name").alias("docs"), *[F.sort_array(F.collect_set(c)).alias(out) for c, out in (("category", "categories"), ("town", "towns"), ("board", "boards"))])


def docname_parts(name: Column) -> tuple[Column, Column, Column]:
    """category, town and board of a name; null where it has none or what it has is statewide."""
    parts = F.split(name, r" \| ")
    joined = lambda x: F.regexp_replace(F.lower(x), r"\s+", "_")
    named = lambda x: F.when((x != "") & ~F.lower(x).contains("statewide"), x)
    category, town = joined(F.trim(F.get(parts, F.lit(0)))), F.trim(F.get(parts, F.lit(1)))
    board = F.nullif(joined(F.regexp_extract(name, NAMED_BOARDS, 1)), F.lit(""))
    return named(category).alias("category"), named(town).alias("town"), board.alias("board")


@query("SELECT doc_id, source || CASE WHEN n_chars > 1000 THEN ' (' || n_chars || ')' ELSE '' END || ' [' || lang || ']' AS citation FROM documents")
def format_citation(t: Tables) -> DataFrame:
    chars = F.when(F.col("n_chars") > 1000, F.concat(F.lit(" ("), F.col("n_chars").cast("string"), F.lit(")"))).otherwise("")
    return t.documents.select("doc_id", F.concat("source", chars, F.lit(" ["), "lang", F.lit("]")).alias("citation"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'exact_duplicate:' || source WHEN quality = 0 THEN 'preview_match:' || source END AS warning FROM documents LEFT JOIN labels USING (doc_id)")
def duplicate_warning_format(t: Tables) -> DataFrame:
    warning = F.when(F.col("quality") == 1, F.concat(F.lit("exact_duplicate:"), "source")).when(F.col("quality") == 0, F.concat(F.lit("preview_match:"), "source"))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", warning.alias("warning"))


@query("SELECT event_id, CAST(greatest(1, least(10, floor(value / 7 - 2 + 0.5))) AS BIGINT) AS score FROM events")
def clamp_round_score(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.greatest(F.lit(1), F.least(F.lit(10), half_up(F.col("value") / 7 - 2))).cast("long").alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 AND value / 50 BETWEEN 0 AND 1 THEN round(value / 50, 6) ELSE 0.5 END AS score FROM events")
def parse_score_01(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.round(F.col("value") / 50, 6).cast("string"))
    score = text.try_cast("double")
    return t.events.select("event_id", F.when(score.between(0, 1) & (F.col("value") / 50 <= 1), score).otherwise(0.5).alias("score"))


@query("SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '/([0-9]+)[^/]*$', 1), '^[0-9]{4}$') THEN regexp_extract(url, '/([0-9]+)[^/]*$', 1)::INT END AS year FROM pages")
def safe_int_year(t: Tables) -> DataFrame:
    digits = F.regexp_extract("url", "/([0-9]+)[^/]*$", 1)
    return t.pages.select("page_id", F.when(digits.rlike("^[0-9]{4}$"), digits.try_cast("int")).alias("year"))


@query("SELECT d.doc_id, coalesce(nullif(quality, 0), nullif(toxic, 0), 7) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_truthy(t: Tables) -> DataFrame:
    zero = lambda c: F.nullif(c, F.lit(0))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(zero("quality"), zero("toxic"), F.lit(7)).alias("score"))


@query("SELECT doc_id, substr(text, 1, 200) AS notes, substr(text, 1, 3000) AS head FROM documents")
def preview_slice(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 200).alias("notes"), F.substring("text", 1, 3000).alias("head"))


@query("SELECT conv_id, turn, '[redacted, length=' || length(text) || ']' AS line FROM conversations")
def redact_log(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("[redacted, length="), F.length("text").cast("string"), F.lit("]")).alias("line"))


@query("SELECT event_id, event_id % 8 AS attempt, CAST(least(1000 * pow(2, event_id % 8), 30000) AS BIGINT) AS delay_ms FROM events")
def backoff_delay(t: Tables) -> DataFrame:
    """Without jitter; the attempt an event stands for is the remainder of its id."""
    attempts = t.events.select("event_id", (F.col("event_id") % 8).alias("attempt"))
    return attempts.select("event_id", "attempt", F.least(F.pow(F.lit(2.0), "attempt") * 1000, F.lit(30_000.0)).cast("long").alias("delay_ms"))


ERRORS = ((503, "overloaded"), (429, "RESOURCE_EXHAUSTED: slow down"), (400, "Quota exceeded for today"), (400, "request Timeout"), (0, "read ECONNRESET"), (404, "not found"), (0, "quota of tokens"), (None, None))
ERROR_SQL = ", ".join(f"({str(i)!r}, {'NULL' if c is None else c}, {'NULL' if m is None else repr(m)})" for i, (c, m) in enumerate(ERRORS))
CODE = "CASE turn % 5 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END"


@query(f"""WITH e(id, code, message) AS (SELECT conv_id || '/' || turn, {CODE}, text FROM conversations UNION ALL VALUES {ERROR_SQL}), f AS (SELECT id, coalesce(code, 0) AS code, coalesce(message, '') AS m FROM e)
SELECT id, code IN {lex.RETRY_CODES} OR {' OR '.join(f"contains(lower(m), '{w}')" for w in lex.RETRY_TEXTS)} AS retry, code = 429 OR {' OR '.join(f"contains(m, '{w}')" for w in lex.QUOTA_TEXTS)} AS quota FROM f""")
def retryable_error(t: Tables) -> DataFrame:
    """By status code or words of the message; quota errors by code 429 or their own words, case and all.

    Turns stand for messages, and their place for the code, beside literal errors.
    """
    told = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.expr(CODE).alias("code"), F.col("text").alias("message"))
    errors = told.union(t.rows("id string, code int, message string", *[(str(i), c, m) for i, (c, m) in enumerate(ERRORS)]))
    code, m = F.coalesce("code", F.lit(0)), F.coalesce("message", F.lit(""))
    return errors.select("id", (code.isin(*lex.RETRY_CODES) | contains_any(F.lower(m), lex.RETRY_TEXTS)).alias("retry"), ((code == 429) | contains_any(m, lex.QUOTA_TEXTS)).alias("quota"))
