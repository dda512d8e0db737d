"""Scoring, merging and selection of retrieved passages.

A passage is (query_id, lane, pos, title, content, score); the order of a list is its ``pos`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lex
from quillspark.functions.text import contains_any
from quillspark.operators.relational import best_at_first_place, n_rows, ranked, top_per_group
from quillspark.plans.classify import any_pattern, any_pattern_sql, any_word_sql, quoted, turns, turns_sql
from quillspark.registry import query
from quillspark.sources.tables import Tables

ENTITIES = ("thnder", "ation", "zoning")
"""What a model's plan names, in ``planner_validate``."""
ASKED = "[a-zà-ÿ]{4,}"
BASE = f"""WITH base AS (SELECT source || '/' || (doc_id // 2000) AS query_id, (doc_id // 2000) * 7 + length(source) AS session, CASE WHEN lang IN ('en', 'es') THEN 'local' ELSE 'state' END AS lane, doc_id, split_part(text, ' ', 1) AS title, text AS content, (n_chars % 97) / 100.0::DOUBLE AS raw FROM documents),
conv AS (SELECT conv_id AS session, regexp_extract_all(lower(arg_min(text, turn)), '{ASKED}') AS w FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1),
asks AS (SELECT query_id, coalesce(w[1:3], []) AS entities, coalesce(w[4:6], []) AS topics, coalesce(w[7:8], []) AS boards, coalesce(w[2:5], []) AS situation FROM (SELECT DISTINCT query_id, session FROM base WHERE query_id IS NOT NULL) LEFT JOIN conv USING (session)),
chunks AS (SELECT query_id, lane, doc_id, title, content, raw AS score, entities, topics, boards, situation, row_number() OVER (PARTITION BY query_id, lane ORDER BY doc_id) AS pos FROM base JOIN asks USING (query_id))"""


def asks(t: Tables) -> DataFrame:
    """What each query is about: entities, topics, boards and situation, the words of four letters or more of the
    question that began its session.  A query whose session is not there asks for nothing."""
    began = t.conversations.filter("role = 'user' AND text IS NOT NULL").groupBy(F.col("conv_id").alias("session")).agg(F.min_by("text", "turn").alias("said"))
    words = began.select("session", F.regexp_extract_all(F.lower("said"), F.lit(ASKED), F.lit(0)).alias("w"))
    block = F.floor(F.col("doc_id") / 2000)
    queries = t.documents.select(F.concat("source", F.lit("/"), block.cast("string")).alias("query_id"), (block * 7 + F.length("source")).alias("session")).filter("query_id IS NOT NULL").distinct()
    part = lambda name, at, n: F.coalesce(F.slice("w", at, n), F.array().cast("array<string>")).alias(name)
    return queries.join(words, "session", "left").select("query_id", part("entities", 1, 3), part("topics", 4, 3), part("boards", 7, 2), part("situation", 2, 4))


def chunks(t: Tables) -> DataFrame:
    """Whole texts as passages of queries of bounded size, each with what its query asks for.

    A query is a source's rows of 2000 ids in a row.
    """
    query_id = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 2000).cast("string"))
    lane = F.when(F.col("lang").isin("en", "es"), "local").otherwise("state")
    rows = t.documents.select(query_id.alias("query_id"), lane.alias("lane"), "doc_id", F.split("text", " ", 2)[0].alias("title"), F.col("text").alias("content"), ((F.col("n_chars") % 97) / F.lit(100.0)).alias("score"))
    return ranked(rows.join(asks(t), "query_id"), ["query_id", "lane"], ["doc_id"], "pos")


def array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def hit_count(words: str, text: Column) -> Column:
    """How many of the words in a column of lower-case arrays a lower-case text contains."""
    return F.size(F.filter(words, lambda w: text.contains(w)))


def hit_sql(words: str, text: str) -> str:
    return f"len(list_filter({words}, lambda w: contains({text}, w)))"


TEXT_SQL = "lower(concat_ws(' ', title, content))"


def full_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", "content"))


CONFIDENCE_SQL = f"round(least(1.0, 0.6 * avg(CASE WHEN score = 0 THEN 0.3 ELSE score END) + 0.3 * least(count(*) / 5.0, 1.0) + CASE WHEN bool_or({hit_sql('entities', TEXT_SQL)} > 0) THEN 0.1 ELSE 0 END)::DOUBLE, 6)"


def confidence() -> Column:
    """Of a group of passages; a missing or zero score counts as 0.3, and one of the query's entities adds a tenth."""
    score = F.avg(F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.3)))
    bonus = F.when(F.bool_or(hit_count("entities", full_text()) > 0), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score * 0.6 + F.least(n_rows() / 5, F.lit(1.0)) * 0.3 + bonus), 6)


@query(f"{BASE} SELECT query_id, {CONFIDENCE_SQL} AS confidence FROM chunks GROUP BY 1")
def retrieval_confidence(t: Tables) -> DataFrame:
    return chunks(t).groupBy("query_id").agg(confidence().alias("confidence"))


def share_sql(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN 0.5::DOUBLE ELSE {hit_sql(words, TEXT_SQL)} / len({words}) END"


ALIGNMENT_SQL = f"round(avg(CASE WHEN len(entities) = 0 AND len(topics) = 0 THEN 1.0::DOUBLE ELSE {share_sql('entities')} * 0.5::DOUBLE + {share_sql('topics')} * 0.3::DOUBLE + {share_sql('boards')} * 0.2::DOUBLE END), 6)"


def aligned() -> Column:
    """Of a passage: the shares of its query's entities, topics and boards that it names, half for a list that is
    empty; 1 where the query names neither entities nor topics."""
    share = lambda words: F.when(F.size(words) == 0, 0.5).otherwise(hit_count(words, full_text()) / F.size(words))
    one = share("entities") * 0.5 + share("topics") * 0.3 + share("boards") * 0.2
    return F.when((F.size("entities") == 0) & (F.size("topics") == 0), 1.0).otherwise(one)


def alignment() -> Column:
    return F.round(F.avg(aligned()), 6)


@query(f"{BASE} SELECT query_id, {ALIGNMENT_SQL} AS alignment FROM chunks GROUP BY 1")
def topic_alignment(t: Tables) -> DataFrame:
    return chunks(t).groupBy("query_id").agg(alignment().alias("alignment"))


FOREIGN_CASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:property|case|appeal|application|variance|subdivision)\b"


def foreign_cases(rows: DataFrame) -> DataFrame:
    """The most mentions that a case foreign to the entities has in a query's passages."""
    named = rows.select("query_id", "entities", F.explode(F.regexp_extract_all(F.concat_ws(" ", "title", "content"), F.lit(FOREIGN_CASE), F.lit(1))).alias("name")).withColumn("name", F.lower("name"))
    foreign = named.filter(~F.array_contains("entities", F.col("name")) & (F.length("name") > 3))
    return foreign.groupBy("query_id", "name").agg(n_rows().alias("n")).groupBy("query_id").agg(F.max("n").alias("most"))


@query(f"""{BASE}, s AS (SELECT query_id, count(*) AS n, {CONFIDENCE_SQL} AS confidence, {ALIGNMENT_SQL} AS alignment FROM chunks GROUP BY 1),
c AS (SELECT query_id, entities, lower(unnest(regexp_extract_all(concat_ws(' ', title, content), '{FOREIGN_CASE}', 1))) AS name FROM chunks),
k AS (SELECT query_id, name, count(*) AS n FROM c WHERE NOT list_contains(entities, name) AND length(name) > 3 GROUP BY query_id, name), m AS (SELECT query_id, max(n) AS most FROM k GROUP BY 1)
SELECT query_id, CASE WHEN confidence < 0.35 THEN 'low confidence' WHEN alignment < 0.30 THEN 'low alignment' WHEN most >= greatest(2, ceil(n * 0.3)) THEN 'drift' WHEN length(query_id) % 2 = 0 AND confidence < 0.5 THEN 'high stakes' END AS reason FROM s LEFT JOIN m USING (query_id)""")
def quality_gate(t: Tables) -> DataFrame:
    """The first rule that trips gives the reason; an id of even length stands for a question of high stakes."""
    rows = chunks(t)
    s = rows.groupBy("query_id").agg(n_rows().alias("n"), confidence().alias("confidence"), alignment().alias("alignment")).join(foreign_cases(rows), "query_id", "left")
    drift = F.col("most") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.3))
    stakes = (F.length("query_id") % 2 == 0) & (F.col("confidence") < 0.5)
    return s.select("query_id", F.when(F.col("confidence") < 0.35, "low confidence").when(F.col("alignment") < 0.30, "low alignment").when(drift, "drift").when(stakes, "high stakes").alias("reason"))


@query("SELECT conv_id, turn, concat_ws(' ', 'Conway', CASE WHEN turn % 2 = 0 THEN 'zoning' END, trim(regexp_replace(substr(text, 1, 100), '[?.,!]', '', 'g'))) AS q FROM conversations WHERE role = 'user'")
def lane_query(t: Tables) -> DataFrame:
    core = F.trim(F.regexp_replace(F.substring("text", 1, 100), "[?.,!]", ""))
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", F.lit("Conway"), F.when(F.col("turn") % 2 == 0, "zoning"), core).alias("q"))


@query("SELECT conv_id, turn, array_to_string(list_filter([text, CASE WHEN turn % 2 = 0 THEN 'Thnder' END, CASE WHEN turn % 3 = 0 THEN 'RSA municipal law' END], lambda x: x IS NOT NULL), ' ') AS q FROM conversations WHERE role = 'user'")
def expanded_query(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", "text", F.when(F.col("turn") % 2 == 0, "Thnder"), F.when(F.col("turn") % 3 == 0, "RSA municipal law")).alias("q"))


# The texts of retrieval prompts.
PASS_PROMPT = """Context: %s municipal governance documents (categories: %s)

Question: %s%s

Provide detailed relevant excerpts from the documents."""
MINUTES_PROMPT = "Find examples in meeting minutes related to: %s. Look for similar cases, precedents, or past decisions."
MERGED_PROMPT = """Question: %s

Context: New Hampshire municipal governance documents
Document categories: %s
%s%s%s%s

Search for comprehensive information including:
- Applicable state law and RSA requirements
- Local ordinances and regulations
- Best practices and NHMA guidance
- Relevant examples or precedents if available

Provide detailed, relevant excerpts with specific section references."""
PREFER_RECENT = '\nIMPORTANT: Prioritize the MOST RECENT documents, especially recent meeting minutes (from the last 6-12 months) and current-year budget documents. Focus on what is happening "currently" or "now", not historical information.'
STATEWIDE_LABEL, MINUTES_LABEL, GENERAL_LABEL, MERGED_LABEL = "Statewide Handbooks & Guides", "Meeting Minutes & Examples", "General Documents", "Comprehensive Document Search"
NO_TOWN = "Include statewide guidance and local examples."
MINUTES_NEEDS = ("example", "precedent", "case")

PASSES = 2
PROMPTED = ("What does recent case law under RSA 674 and RSA 91 hold about variance examples, and minutes?", "Show the current precedent for setback rules in the minutes", "Why?", "")
WHOLE, SINGLE, LISTED = quoted(MERGED_PROMPT), quoted(PASS_PROMPT), "array_to_string(categories, ', ')"
SPECIFIC = "CASE WHEN len(needs) > 0 THEN chr(10) || chr(10) || 'Specifically looking for: ' || array_to_string(needs, '; ') ELSE '' END"


@query(f"""{turns_sql('q', 'user', PROMPTED)}, w AS (SELECT id, x, regexp_extract_all(lower(x), '{ASKED}') AS w FROM q),
p AS (SELECT id, x, w[4:6] AS needs, list_transform(w[7:8], lambda c: CASE WHEN c = 'minutes' THEN 'meeting_minutes' ELSE c END) AS categories, CASE WHEN length(x) % 3 = 0 THEN w[1] END AS town, length(x) % 2 = 0 AS statewide, regexp_extract_all(x, 'RSA ([0-9]+)', 1) AS chapters, {any_word_sql(lex.RECENT)} AS recent FROM w),
l AS (SELECT id, 1 AS passes, 1 AS pos, {quoted(MERGED_LABEL)} AS label, printf({WHOLE}, x, CASE WHEN len(categories) > 0 THEN {LISTED} ELSE 'all relevant' END, coalesce('Focus on ' || town || ' documents when available.', {quoted(NO_TOWN)}),
    CASE WHEN len(chapters) > 0 THEN chr(10) || 'Relevant RSA chapters: ' || array_to_string(chapters, ', ') ELSE '' END, CASE WHEN recent THEN {quoted(PREFER_RECENT)} ELSE '' END,
    CASE WHEN len(needs) > 0 THEN chr(10) || 'Key information needed:' || chr(10) || array_to_string(list_transform(needs, lambda n, i: i || '. ' || n), chr(10)) ELSE '' END) AS prompt FROM p),
e AS (SELECT *, printf({SINGLE}, coalesce(c.town, ''), CASE WHEN len(categories) > 0 THEN {LISTED} ELSE 'all' END, x, {SPECIFIC}) AS about FROM (SELECT p.id, p.x, needs, categories, k, CASE k WHEN 1 THEN 'statewide' ELSE p.town END AS town, statewide, p.town AS there FROM p, range(1, 5) r(k)) c),
f AS (SELECT id, k, CASE k WHEN 1 THEN {quoted(STATEWIDE_LABEL)} WHEN 2 THEN there || ' Local Documents' WHEN 3 THEN {quoted(MINUTES_LABEL)} ELSE {quoted(GENERAL_LABEL)} END AS label, CASE k WHEN 3 THEN printf({quoted(MINUTES_PROMPT)}, x) WHEN 4 THEN x ELSE about END AS prompt,
  CASE k WHEN 1 THEN statewide WHEN 2 THEN there IS NOT NULL WHEN 3 THEN len(list_filter(needs, lambda n: {' OR '.join(f"contains(n, '{n}')" for n in MINUTES_NEEDS)})) > 0 OR list_contains(categories, 'meeting_minutes') ELSE true END AS runs FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS pos FROM f WHERE runs)
SELECT * FROM l UNION ALL SELECT id, {PASSES}, pos, label, prompt FROM g WHERE pos <= {PASSES} AND (k < 4 OR pos = 1)""")
def retrieval_prompts(t: Tables) -> DataFrame:
    """What is asked of the search for each question: one merged prompt, and the first PASSES passes of the plan.

    A plan's passes are statewide, local and minutes, in this order; a general one where it names none.
    A model's plan is not in the tables, so the question stands for it: what is needed and the categories
    are words of it, and its length decides whether the plan is statewide and has a town.
    """
    x, w, n = F.col("x"), F.regexp_extract_all(F.lower("x"), F.lit(ASKED), F.lit(0)), F.length("x")
    category = lambda c: F.when(c == "minutes", "meeting_minutes").otherwise(c)
    plan = turns(t, "user", PROMPTED).select(
        *("id", "x", F.slice(w, 4, 3).alias("needs"), F.transform(F.slice(w, 7, 2), category).alias("categories")),
        *(F.when(n % 3 == 0, F.get(w, F.lit(0))).alias("town"), (n % 2 == 0).alias("statewide")),
        F.regexp_extract_all("x", F.lit("RSA ([0-9]+)"), F.lit(1)).alias("chapters"),
        contains_any(F.lower("x"), lex.RECENT).alias("recent"),
    )
    some = lambda c, text: F.when(F.size(c) > 0, text).otherwise("")
    listed = lambda none: F.when(F.size("categories") > 0, F.array_join("categories", ", ")).otherwise(none)
    prompt = lambda label, text: F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), text.alias("prompt"))
    numbered = F.array_join(F.transform("needs", lambda need, i: F.concat((i + 1).cast("string"), F.lit(". "), need)), "\n")
    merged = F.format_string(
        MERGED_PROMPT,
        *(x, listed("all relevant"), F.coalesce(F.concat(F.lit("Focus on "), "town", F.lit(" documents when available.")), F.lit(NO_TOWN))),
        *(some("chapters", F.concat(F.lit("\nRelevant RSA chapters: "), F.array_join("chapters", ", "))), F.when(F.col("recent"), PREFER_RECENT).otherwise("")),
        some("needs", F.concat(F.lit("\nKey information needed:\n"), numbered)),
    )
    about = lambda town: F.format_string(PASS_PROMPT, town, listed("all"), x, some("needs", F.concat(F.lit("\n\nSpecifically looking for: "), F.array_join("needs", "; "))))
    minutes = F.exists("needs", lambda need: contains_any(need, MINUTES_NEEDS)) | F.array_contains("categories", "meeting_minutes")
    found = F.array_compact(
        F.array(
            F.when(F.col("statewide"), prompt(STATEWIDE_LABEL, about(F.lit("statewide")))),
            F.when(F.col("town").isNotNull(), prompt(F.concat("town", F.lit(" Local Documents")), about(F.col("town")))),
            F.when(minutes, prompt(MINUTES_LABEL, F.format_string(MINUTES_PROMPT, x))),
        )
    )
    several = F.when(F.size(found) > 0, F.slice(found, 1, PASSES)).otherwise(F.array(prompt(GENERAL_LABEL, x)))
    lists = plan.select("id", F.explode(F.create_map(F.lit(1), F.array(prompt(MERGED_LABEL, merged)), F.lit(PASSES), several)).alias("passes", "prompts"))
    return lists.select("id", "passes", F.posexplode("prompts").alias("pos", "p")).select("id", "passes", (F.col("pos") + 1).alias("pos"), "p.label", "p.prompt")


LANE_TITLES = {"local": "=== LOCAL DOCUMENTS (cite as [L1], [L2], etc.) ===", "state": "=== STATE DOCUMENTS (cite as [S1], [S2], etc. for legal framework) ==="}
ANSWER_AS = "\nGenerate a structured answer following the format in your instructions. Cite sources appropriately."
USER_TEXT = "A letter from the board. " * 600
"""A pasted text over the 12,000 characters that a prompt takes of it; queries of even length have it."""


@query(f"""{BASE}, l AS (SELECT query_id, lane, string_agg('[' || upper(lane[1]) || pos || '] ' || title || ' — ' || substr(content, 1, 2000) || chr(10), chr(10) ORDER BY pos) AS papers FROM chunks WHERE pos <= 6 GROUP BY ALL),
p AS (SELECT query_id, max(papers) FILTER (WHERE lane = 'local') AS local, max(papers) FILTER (WHERE lane = 'state') AS state, regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT AS conv_id FROM l GROUP BY 1),
h AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END, chr(10) ORDER BY turn) AS said
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE text IS NOT NULL) WHERE k <= 4 GROUP BY 1)
SELECT query_id, concat_ws(chr(10), '=== RECENT CONVERSATION ===' || chr(10) || said || chr(10), '=== USER QUESTION ===' || chr(10) || 'What of ' || query_id || '?' || chr(10),
  CASE WHEN length(query_id) % 2 = 0 THEN '=== USER-PROVIDED TEXT [USER] ===' || chr(10) || substr({quoted(USER_TEXT)}, 1, 12000) || chr(10) END,
  {quoted(LANE_TITLES['local'])} || chr(10) || local, {quoted(LANE_TITLES['state'])} || chr(10) || state, {quoted(ANSWER_AS)}) AS prompt FROM p LEFT JOIN h USING (conv_id)""")
def prompt_assembly(t: Tables) -> DataFrame:
    """The last four turns cut to 200 characters, the question, the pasted text to 12,000, each lane's passages to 2000.

    The conversation is the one of the query's block number; blocks that are empty are left out.
    """
    label = F.concat(F.lit("["), F.upper(F.substring("lane", 1, 1)), F.col("pos").cast("string"), F.lit("] "))
    paper = F.concat(label, F.col("title"), F.lit(" — "), F.substring("content", 1, 2000), F.lit("\n"))
    in_order = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda x: x["line"]), "\n")
    lane = lambda k: F.concat(F.lit(LANE_TITLES[k] + "\n"), F.nullif(in_order(F.collect_list(F.when((F.col("lane") == k) & paper.isNotNull(), F.struct("pos", paper.alias("line"))))), F.lit("")))
    papers = chunks(t).filter("pos <= 6").groupBy("query_id").agg(lane("local").alias("local"), lane("state").alias("state"))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, 200), F.when(F.length("content") > 200, "...").otherwise(""))
    last = top_per_group(t.turns.filter("content IS NOT NULL"), ["session_id"], [F.desc("pos")], 4, "k")
    said = last.groupBy("session_id").agg(in_order(F.collect_list(F.struct("pos", line.alias("line")))).alias("said"))
    block = F.regexp_extract("query_id", r"([0-9]+)$", 1).cast("long")
    rows = papers.withColumn("session_id", block).join(said, "session_id", "left")
    parts = [
        F.concat(F.lit("=== RECENT CONVERSATION ===\n"), F.col("said"), F.lit("\n")),
        F.concat(F.lit("=== USER QUESTION ===\nWhat of "), F.col("query_id"), F.lit("?\n")),
        F.when(F.length("query_id") % 2 == 0, F.concat(F.lit("=== USER-PROVIDED TEXT [USER] ===\n"), F.substring(F.lit(USER_TEXT), 1, 12000), F.lit("\n"))),
        *("local", "state"),
        F.lit(ANSWER_AS),
    ]
    return rows.select("query_id", F.concat_ws("\n", *parts).alias("prompt"))


@query("SELECT doc_id, CASE WHEN n_chars % 10 >= 5 THEN least(10 + 4, 14) ELSE 10 END AS state_k, CASE WHEN n_chars % 10 >= 5 THEN least(6 + 2, 8) ELSE 6 END AS state_cap FROM documents")
def dynamic_caps(t: Tables) -> DataFrame:
    salient = F.col("n_chars") % 10 >= 5
    return t.documents.select("doc_id", F.when(salient, F.least(F.lit(14), F.lit(10) + 4)).otherwise(10).alias("state_k"), F.when(salient, F.least(F.lit(8), F.lit(6) + 2)).otherwise(6).alias("state_cap"))


def dedupe_sql(key: str, rows: str = "chunks", by: str = "query_id, lane") -> str:
    return f"(SELECT * EXCLUDE (k, first, pos), first AS pos FROM (SELECT *, row_number() OVER (PARTITION BY {by}, {key} ORDER BY score DESC, pos) AS k, min(pos) OVER (PARTITION BY {by}, {key}) AS first FROM {rows}) WHERE k = 1)"


@query(f"{BASE} SELECT query_id, lane, pos, doc_id FROM {dedupe_sql('lower(trim(title))')}")
def dedupe_title(t: Tables) -> DataFrame:
    rows = chunks(t).withColumn("key", F.lower(F.trim("title")))
    return best_at_first_place(rows, ["query_id", "lane", "key"]).select("query_id", "lane", "pos", "doc_id")


@query(f"{BASE} SELECT query_id, lane, pos, doc_id FROM {dedupe_sql('''regexp_replace(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g'), '[^A-Za-z0-9_\\s]', '', 'g')''')}")
def dedupe_title_strict(t: Tables) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("title")), r"\s+", " "), r"[^A-Za-z0-9_\s]", "")
    return best_at_first_place(chunks(t).withColumn("key", key), ["query_id", "lane", "key"]).select("query_id", "lane", "pos", "doc_id")


@query(f"{BASE}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane, substr(content, 1, 100) ORDER BY pos) AS k FROM chunks), o AS (SELECT query_id, lane, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lane, pos) AS place FROM d WHERE k = 1) SELECT query_id, doc_id, place FROM o WHERE place <= 40")
def dedupe_source_prefix(t: Tables) -> DataFrame:
    first = chunks(t).groupBy("query_id", "lane", F.substring("content", 1, 100).alias("key")).agg(F.min_by(F.struct("pos", "doc_id"), "pos").alias("c"))
    return top_per_group(first.select("query_id", "lane", "c.*"), ["query_id"], ["lane", "pos"], 40, "place").select("query_id", "doc_id", "place")


NORMAL_SQL = "trim(regexp_replace(content, '[ \\n\\t]+', ' ', 'g'))"


@query(f"""{BASE}, n AS (SELECT query_id, chunks.lane, pos, doc_id, list_filter([source, lang], lambda x: x IS NOT NULL AND x <> '') AS names, sha256(coalesce({NORMAL_SQL}, '')) AS hash FROM chunks JOIN documents USING (doc_id)),
k AS (SELECT *, CASE WHEN len(names) > 0 THEN 'doc:' || array_to_string(list_sort(names), '|') || ':' || hash ELSE 'content:' || hash END AS key FROM n)
SELECT query_id, key, arg_min(doc_id, CASE lane WHEN 'local' THEN 0 ELSE 1000000 END + pos) AS doc_id FROM k GROUP BY 1, 2""")
def dedupe_docset_hash(t: Tables) -> DataFrame:
    """One passage for each set of names and content, the first of the local pass before any of the further one.

    A passage's names are its source and language, sorted; one without names goes by content alone.  Only hashes
    of the contents are shuffled.
    """
    hash_ = F.sha2(F.coalesce(F.trim(F.regexp_replace("content", r"[ \n\t]+", " ")), F.lit("")), 256)
    named = t.documents.select("doc_id", F.array_sort(F.filter(F.array("source", "lang"), lambda x: x.isNotNull() & (x != ""))).alias("names"))
    rows = chunks(t).select("query_id", "lane", "pos", "doc_id", hash_.alias("hash")).join(named, "doc_id")
    key = F.when(F.size("names") > 0, F.concat_ws(":", F.lit("doc"), F.array_join("names", "|"), "hash")).otherwise(F.concat(F.lit("content:"), "hash"))
    place = F.when(F.col("lane") == "local", 0).otherwise(1_000_000) + F.col("pos")
    return rows.groupBy("query_id", key.alias("key")).agg(F.min_by("doc_id", place).alias("doc_id"))


def merged(t: Tables, salience: float, local_cap: int = 10, state_cap: int = 8) -> DataFrame:
    """Both lanes capped, state scores raised by salience, local first, one a title."""
    state = F.col("lane") == "state"
    kept = chunks(t).filter(F.when(state, F.col("pos") <= state_cap).otherwise(F.col("pos") <= local_cap))
    base = F.coalesce(F.nullif("score", F.lit(0.0)), F.when(state, 0.5).otherwise(0.0))
    scored = kept.withColumns({"score": F.round(base + F.when(state, 0.12 * salience).otherwise(0.0), 6), "pos": F.when(state, F.col("pos") + local_cap).otherwise(F.col("pos")), "key": F.lower(F.trim("title"))})
    return best_at_first_place(scored, ["query_id", "key"]).drop("key")


def merged_sql(salience: float) -> str:
    return f"""{BASE}, s AS (SELECT query_id, lane, doc_id, title, content, CASE WHEN lane = 'state' THEN pos + 10 ELSE pos END AS pos,
  round(CASE WHEN score = 0 AND lane = 'state' THEN 0.5 ELSE score END + CASE WHEN lane = 'state' THEN {0.12 * salience} ELSE 0 END, 6)::DOUBLE AS score FROM chunks WHERE pos <= CASE WHEN lane = 'state' THEN 8 ELSE 10 END), m AS {dedupe_sql('lower(trim(title))', 's', 'query_id')}"""


@query(f"{merged_sql(0.2)} SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM m) WHERE place <= 15")
def merge_rank_plain(t: Tables) -> DataFrame:
    """Low salience and no situation: the merged order itself, not the score, decides."""
    return top_per_group(merged(t, 0.2), ["query_id"], ["pos"], 15, "place").select("query_id", "doc_id", "place")


QUOTA = "q AS (SELECT *, lane = 'state' AND row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, pos) <= 3 AS sure FROM m)"


def with_state_quota(rows: DataFrame, n: int = 3) -> DataFrame:
    sure = (F.col("lane") == "state") & (F.row_number().over(Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "pos")) <= n)
    return rows.withColumn("sure", sure)


@query(f"{merged_sql(0.8)}, {QUOTA} SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sure DESC, score DESC, pos) AS place FROM q) WHERE place <= 15")
def merge_rank_state_quota(t: Tables) -> DataFrame:
    return top_per_group(with_state_quota(merged(t, 0.8)), ["query_id"], [F.desc("sure"), F.desc("score"), "pos"], 15, "place").select("query_id", "doc_id", "place")


def match_score(text: Column, entities="entities", situation="situation") -> Column:
    """Weight of the entities and of the title's long words that a text holds, over the weight there is to have.

    A whole entity weighs 2, else each of its words of over 3 letters a half; a title word a half.  0 without entities.
    """
    half = lambda words: F.size(F.filter(words, lambda w: (F.length(w) > 3) & text.contains(w))) * 0.5
    one = lambda e: F.when(text.contains(e), 2.0).otherwise(half(F.split(e, " ")))
    whole = F.aggregate(F.transform(entities, one), F.lit(0.0), lambda a, x: a + x)
    title = half(F.col(situation))
    return F.when(F.size(entities) == 0, 0.0).otherwise(F.round((whole + title) / (F.size(entities) * 2.0 + title), 6))


def match_sql(text: str) -> str:
    title = f"0.5::DOUBLE * len(list_filter(situation, lambda w: length(w) > 3 AND contains({text}, w)))"
    whole = f"list_sum(list_transform(entities, lambda e: CASE WHEN contains({text}, e) THEN 2.0::DOUBLE ELSE 0.5::DOUBLE * len(list_filter(string_split(e, ' '), lambda w: length(w) > 3 AND contains({text}, w))) END))"
    return f"CASE WHEN len(entities) = 0 THEN 0.0::DOUBLE ELSE round(({whole} + {title}) / (2.0::DOUBLE * len(entities) + {title}), 6) END"


@query(f"{BASE} SELECT doc_id, {match_sql(TEXT_SQL)} AS score FROM chunks")
def situation_match(t: Tables) -> DataFrame:
    return chunks(t).select("doc_id", match_score(full_text()).alias("score"))


@query(f"""{merged_sql(0.8).replace('m AS', 'm0 AS')}, m1 AS (SELECT * EXCLUDE (score, entities, topics, boards, situation), {match_sql(TEXT_SQL)} AS match, score AS old FROM m0 JOIN asks USING (query_id)), m AS (SELECT *, round(CASE WHEN old = 0 THEN 0.5 ELSE old END + 0.3 * match, 6)::DOUBLE AS score FROM m1), {QUOTA},
g AS (SELECT *, count(*) FILTER (WHERE sure) OVER (PARTITION BY query_id) AS n_sure, row_number() OVER (PARTITION BY query_id, sure, match > 0.2 ORDER BY score DESC, pos) AS r FROM q),
o AS (SELECT *, NOT sure AND match > 0.2 AND r <= ceil((15 - n_sure) * 0.4) AS topical FROM g)
SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sure DESC, topical DESC, score DESC, pos) AS place FROM o) WHERE place <= 15""")
def merge_rank_situation(t: Tables) -> DataFrame:
    """Guaranteed state passages, then the on-topic quota of what is left, then the best of the rest."""
    match = match_score(full_text())
    rows = merged(t, 0.8).withColumn("match", match)
    rows = with_state_quota(rows.withColumn("score", F.round(F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.5)) + F.col("match") * 0.3, 6)))
    on_topic = F.col("match") > 0.2
    sure = F.count_if(F.col("sure")).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "sure", on_topic).orderBy(F.desc("score"), "pos"))
    rows = rows.withColumns({"n_sure": sure, "r": place}).withColumn("topical", ~F.col("sure") & on_topic & (F.col("r") <= F.ceil((15 - F.col("n_sure")) * 0.4)))
    return top_per_group(rows, ["query_id"], [F.desc("sure"), F.desc("topical"), F.desc("score"), "pos"], 15, "place").select("query_id", "doc_id", "place")


AUTHORITY = (r"\bRSA\s+\d+", r"\b(NHMA|Municipal\s+Association)\b")


AUTHORITY_SQL = f"({any_pattern_sql(AUTHORITY, 'concat_ws(chr(32), title, content)')} OR {any_pattern_sql(lex.OFFICIAL, 'title')})"


def has_authority() -> Column:
    """A statute or the municipal association in title or content, or an office of the state in the title."""
    return any_pattern(F.concat_ws(" ", "title", "content"), AUTHORITY) | any_pattern(F.col("title"), lex.OFFICIAL)


@query(f"{BASE} SELECT query_id, bool_or({AUTHORITY_SQL}) AS present FROM chunks WHERE lane = 'state' GROUP BY 1")
def authority_present(t: Tables) -> DataFrame:
    return chunks(t).filter("lane = 'state'").groupBy("query_id").agg(F.bool_or(has_authority()).alias("present"))


PAPERS = (("state", "Zoning guide", "See RSA 674:33 for variances"), ("state", "A Municipal Association note", "on roads"), ("state", "Guide", "by the NHMA"), ("state", "RSA 91-A", "open records"), ("state", "Handbook", "of rules"), ("local", "Meeting of May", ""), ("local", "News of RSA 1", ""), ("local", "Budget", "minutes of the board"))
PAPER_SQL = ", ".join(f"(-{k + 1}, {quoted(lane)}, {quoted(title)}, {quoted(text)})" for k, (lane, title, text) in enumerate(PAPERS))
TITLE = "(?i)<title>([^<]*)</title>"


def authority_of(lane: Column, title: Column, text: Column) -> Column:
    """Whose word a passage is, by title and content on the state's lane and by title on the local one."""
    low, both = F.lower(title), F.lower(F.concat_ws(" ", title, text))
    state = F.when(both.rlike(r"\brsa\s+\d+"), "rsa").when(both.rlike(r"\bnhma\b") | low.contains("municipal association"), "nhma").otherwise("official")
    local = F.when(low.contains("minutes") | low.contains("meeting"), "minutes").when(low.contains("news") | low.contains("article") | low.contains("reporter"), "news").otherwise("official")
    return F.when(lane == "state", state).otherwise(local)


@query(rf"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'state' ELSE 'local' END AS lane, regexp_extract(coalesce(html, ''), '{TITLE}', 1) AS title, coalesce(html, '') AS content FROM pages UNION ALL SELECT * FROM (VALUES {PAPER_SQL}))
SELECT page_id, CASE WHEN lane = 'state' THEN CASE WHEN regexp_matches(lower(title || ' ' || content), '\brsa\s+\d+') THEN 'rsa' WHEN regexp_matches(lower(title || ' ' || content), '\bnhma\b') OR contains(lower(title), 'municipal association') THEN 'nhma' ELSE 'official' END
  WHEN contains(lower(title), 'minutes') OR contains(lower(title), 'meeting') THEN 'minutes' WHEN contains(lower(title), 'news') OR contains(lower(title), 'article') OR contains(lower(title), 'reporter') THEN 'news' ELSE 'official' END AS authority FROM p""")
def authority_class(t: Tables) -> DataFrame:
    """Pages by title and whole content, and passages that hit the lists; French pages stand for the state's lane."""
    html = F.coalesce("html", F.lit(""))
    pages = t.pages.select("page_id", F.when(F.col("url").contains("/fr/"), "state").otherwise("local").alias("lane"), F.regexp_extract(html, TITLE, 1).alias("title"), html.alias("content"))
    rows = pages.union(t.rows("page_id bigint, lane string, title string, content string", *[(-k - 1, *p) for k, p in enumerate(PAPERS)]))
    return rows.select("page_id", authority_of(F.col("lane"), F.col("title"), F.col("content")).alias("authority"))


def coverage(found: Column | None = None) -> Column:
    """The share of a query's topics that any of its passages ``found`` names, a passage at a time; 1 without topics."""
    text = F.lower("content")
    has = lambda k: F.coalesce(text.contains(F.get("topics", F.lit(k))), F.lit(False))
    got = [F.max((has(k) if found is None else has(k) & found).cast("int")) for k in range(3)]
    return F.when(F.max(F.size("topics")) == 0, 1.0).otherwise(sum(got) / F.max(F.size("topics")))


def coverage_sql(found: str = "true") -> str:
    got = " + ".join(f"max(CASE WHEN {found} AND contains(lower(content), topics[{k}]) THEN 1 ELSE 0 END)" for k in (1, 2, 3))
    return f"CASE WHEN max(len(topics)) = 0 THEN 1.0::DOUBLE ELSE ({got}) / max(len(topics)) END"


@query(f"{BASE} SELECT query_id, round({coverage_sql()}, 6) AS coverage FROM chunks WHERE lane = 'state' AND pos <= 8 GROUP BY 1")
def topic_coverage(t: Tables) -> DataFrame:
    return chunks(t).filter("lane = 'state' AND pos <= 8").groupBy("query_id").agg(F.round(coverage(), 6).alias("coverage"))


STATE = "lane = 'state'"


@query(f"""{BASE}, f AS (SELECT * FROM chunks WHERE pos <= 10), d AS {dedupe_sql('lower(trim(title))', 'f')},
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE lane = 'state') AS state, count(DISTINCT lower(trim(title))) FILTER (WHERE lane = 'state') AS docs, coalesce(bool_or(lane = 'state' AND {AUTHORITY_SQL}), false) AS authority, {coverage_sql(STATE)} AS coverage FROM d GROUP BY 1)
SELECT query_id, n >= 8 AND (length(query_id) % 2 <> 0 OR ((docs >= 2 OR authority) AND state >= 4 AND coverage >= 0.5)) AS stop FROM g""")
def early_exit(t: Tables) -> DataFrame:
    """Enough documents end the search; a legal question (an id of even length) also asks for state papers, authority or two of them, and coverage."""
    state, key = F.col("lane") == "state", F.lower(F.trim("title"))
    rows = best_at_first_place(chunks(t).filter("pos <= 10").withColumn("key", key), ["query_id", "lane", "key"])
    g = rows.groupBy("query_id").agg(n_rows().alias("n"), F.count_if(state).alias("state"), F.countDistinct(F.when(state, F.col("key"))).alias("docs"), F.coalesce(F.bool_or(state & has_authority()), F.lit(False)).alias("authority"), coverage(state).alias("coverage"))
    lawful = ((F.col("docs") >= 2) | F.col("authority")) & (F.col("state") >= 4) & (F.col("coverage") >= 0.5)
    return g.select("query_id", ((F.col("n") >= 8) & ((F.length("query_id") % 2 != 0) | lawful)).alias("stop"))


@query(f"{BASE}, r AS (SELECT *, {hit_sql('entities', TEXT_SQL)} > 0 AS rel FROM chunks WHERE lane = 'state'), n AS (SELECT *, count(*) FILTER (WHERE rel) OVER (PARTITION BY query_id) >= least(3, count(*) OVER (PARTITION BY query_id)) AS enough, row_number() OVER (PARTITION BY query_id, rel ORDER BY pos) AS k FROM r) SELECT query_id, doc_id FROM n WHERE CASE WHEN enough THEN rel AND k <= 8 ELSE pos <= 8 END")
def select_with_minimum(t: Tables) -> DataFrame:
    """Only relevant passages, where at least the minimum of them exists."""
    w = Window.partitionBy("query_id")
    rows = chunks(t).filter("lane = 'state'").withColumn("rel", hit_count("entities", full_text()) > 0)
    enough = F.count_if(F.col("rel")).over(w) >= F.least(F.lit(3), n_rows().over(w))
    rows = rows.withColumns({"enough": enough, "k": F.row_number().over(Window.partitionBy("query_id", "rel").orderBy("pos"))})
    return rows.filter(F.when(F.col("enough"), F.col("rel") & (F.col("k") <= 8)).otherwise(F.col("pos") <= 8)).select("query_id", "doc_id")


TIER = "CASE WHEN state >= 4 AND (authority OR docs >= 2) AND align >= 0.30 THEN 'A' WHEN state >= 2 AND (align >= 0.20 OR legal) THEN 'B' ELSE 'C' END"


@query(f"{BASE}, s AS (SELECT query_id, count(*) FILTER (WHERE lane = 'state') AS state, count(DISTINCT CASE WHEN lane = 'state' THEN lower(trim(title)) END) AS docs, coalesce(bool_or(lane = 'state' AND {AUTHORITY_SQL}), false) AS authority, {ALIGNMENT_SQL} AS align, length(query_id) % 2 = 0 AS legal FROM chunks GROUP BY 1) SELECT query_id, {TIER} AS tier FROM s")
def record_tier(t: Tables) -> DataFrame:
    """A: four state passages, authority or two documents, alignment.  B: two and some alignment, or a legal question (an id of even length)."""
    state = F.col("lane") == "state"
    s = chunks(t).groupBy("query_id").agg(F.count_if(state).alias("state"), F.countDistinct(F.when(state, F.lower(F.trim("title")))).alias("docs"), F.coalesce(F.bool_or(state & has_authority()), F.lit(False)).alias("authority"), alignment().alias("align"))
    strong, some = (F.col("state") >= 4) & (F.col("authority") | (F.col("docs") >= 2)) & (F.col("align") >= 0.30), F.col("state") >= 2
    return s.select("query_id", F.when(strong, "A").when(some & ((F.col("align") >= 0.20) | (F.length("query_id") % 2 == 0)), "B").otherwise("C").alias("tier"))


@query(f"{BASE} SELECT query_id, CASE WHEN count(*) FILTER (WHERE lane = 'local') > 0 AND count(*) FILTER (WHERE lane = 'state') > 0 THEN 'mixed' WHEN count(*) FILTER (WHERE lane = 'local') > 0 THEN 'local' ELSE 'statewide' END AS kind FROM chunks GROUP BY 1")
def doc_source_type(t: Tables) -> DataFrame:
    local, state = F.count_if(F.col("lane") == "local") > 0, F.count_if(F.col("lane") == "state") > 0
    return chunks(t).groupBy("query_id").agg(F.when(local & state, "mixed").when(local, "local").when(state, "statewide").otherwise("none").alias("kind"))


@query(f"{BASE} SELECT query_id, round(least(1.0, count(DISTINCT lane) / 3.0), 6)::DOUBLE AS categories, least(1.0, count(DISTINCT title) / 2.0)::DOUBLE AS boards, least(1.0, count(*) / 5.0)::DOUBLE AS docs FROM chunks GROUP BY 1")
def diversity_metrics(t: Tables) -> DataFrame:
    share = lambda n, k: F.least(F.lit(1.0), n / k)
    return chunks(t).groupBy("query_id").agg(F.round(share(F.countDistinct("lane"), 3), 6).alias("categories"), share(F.countDistinct("title"), 2).alias("boards"), share(n_rows(), 5).alias("docs"))


@query(f"{BASE} SELECT query_id, CASE WHEN count(*) >= 3 AND count(DISTINCT lane) >= 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS coverage FROM chunks GROUP BY 1")
def coverage_default(t: Tables) -> DataFrame:
    return chunks(t).groupBy("query_id").agg(F.when((n_rows() >= 3) & (F.countDistinct("lane") >= 2), 0.7).otherwise(0.4).alias("coverage"))


@query(f"{BASE}, r AS (SELECT query_id, lane, pos, content, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY lane, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM chunks) SELECT query_id, lane, pos, substr(content, 1, CAST(2000 - used AS INT)) AS snippet FROM r WHERE used < 2000")
def snippet_budget(t: Tables) -> DataFrame:
    """Passages in order until 2000 characters are used; the last is cut."""
    before = Window.partitionBy("query_id").orderBy("lane", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks(t).withColumn("used", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))).filter("used < 2000")
    return rows.select("query_id", "lane", "pos", F.substr("content", F.lit(1), (F.lit(2000) - F.col("used")).cast("int")).alias("snippet"))


@query("SELECT DISTINCT page_id, unnest([url, regexp_extract(url, '//([^/]+)', 1)]) AS name FROM pages")
def grounding_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.array("url", F.regexp_extract("url", "//([^/]+)", 1))).alias("name")).distinct()


PLAN_SQL = f"""WITH p AS (SELECT doc_id, text, list_filter({list(ENTITIES)}, lambda e: contains(lower(text), e)) AS named, list_filter(string_split_regex(text, '\\.\\s'), lambda q: length(trim(q)) > 5)[1:6] AS asked, greatest(0.0, least(1.0, (n_chars - 100) / 3000.0))::DOUBLE AS confidence,
  least(1.0, n_chars % 13 / 10.0)::DOUBLE AS salience, CASE lang WHEN 'de' THEN 'process-first' WHEN 'fr' THEN 'first' END AS wished, CASE WHEN doc_id % 3 = 0 THEN doc_id % 20 END AS k FROM documents),
q AS (SELECT *, CASE WHEN len(asked) = 0 THEN [trim(regexp_replace(substr(text, 1, 100), '[?.,!]', '', 'g'))] ELSE asked END AS queries FROM p)"""


@query(f"""{PLAN_SQL} SELECT doc_id, CASE WHEN len(named) = 0 THEN regexp_extract_all(text, {quoted(lex.PLACE)})[1:5] ELSE named END AS entities, CASE WHEN confidence < 0.4 THEN queries[1:2] ELSE queries END AS queries, coalesce(k, 12) AS k,
  confidence, salience, CASE WHEN salience >= 0.5 THEN 3 ELSE 1 END AS min_state, CASE WHEN wished IN ('law-first', 'facts-first', 'process-first') THEN wished WHEN salience >= 0.6 THEN 'law-first' ELSE 'facts-first' END AS priority FROM q""")
def planner_validate(t: Tables) -> DataFrame:
    """A model's plan made safe, with columns of the documents standing for the plan's fields.

    Entities that the source text lacks go (none left: places of the text); queries of over 5 characters, six at most
    (none: one made of the text), two under a confidence of 0.4; shares are clamped to 0..1; what is missing or unknown
    gets its default.  A null text has null entities and queries.
    """
    low = F.lower("text")
    named = F.filter(array(ENTITIES), lambda e: low.contains(e))
    asked = F.slice(F.filter(F.split("text", r"\.\s"), lambda q: F.length(F.trim(q)) > 5), 1, 6)
    core = F.trim(F.regexp_replace(F.substring("text", 1, 100), "[?.,!]", ""))
    clamped = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    wished = F.when(F.col("lang") == "de", "process-first").when(F.col("lang") == "fr", "first")
    rows = t.documents.select("doc_id", "text", named.alias("named"), asked.alias("asked"), core.alias("core"), wished.alias("wished"), clamped((F.col("n_chars") - 100) / 3000).alias("confidence"), clamped((F.col("n_chars") % 13) / 10).alias("salience"))
    queries = F.when(F.size("asked") == 0, F.array("core")).otherwise(F.col("asked"))
    return rows.select(
        "doc_id",
        F.when(F.size("named") == 0, F.slice(F.regexp_extract_all("text", F.lit(lex.PLACE), F.lit(0)), 1, 5)).otherwise(F.col("named")).alias("entities"),
        F.when(F.col("confidence") < 0.4, F.slice(queries, 1, 2)).otherwise(queries).alias("queries"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 20).otherwise(F.lit(12)).alias("k"),
        "confidence",
        "salience",
        F.when(F.col("salience") >= 0.5, 3).otherwise(1).alias("min_state"),
        F.when(F.col("wished").isin("law-first", "facts-first", "process-first"), F.col("wished")).when(F.col("salience") >= 0.6, "law-first").otherwise("facts-first").alias("priority"),
    )


SCOPES = [(kind, town, n, rsa) for kind in ("local", "statewide", "mixed", "none", None) for town in ("Conway", None) for n in (0, 2) for rsa in (False, True)]
SCOPE_SQL = ", ".join(f"({str(i)!r}, {'NULL' if k is None else repr(k)}, {'NULL' if w is None else repr(w)}, {n}, {r})" for i, (k, w, n, r) in enumerate(SCOPES))


@query(f"""{BASE}, s(id, kind, town, sources, rsa) AS (SELECT query_id, CASE WHEN bool_or(lane = 'local') AND bool_or(lane = 'state') THEN 'mixed' WHEN bool_or(lane = 'local') THEN 'local' WHEN bool_or(lane = 'state') THEN 'statewide' ELSE 'none' END,
  CASE WHEN length(query_id) % 2 = 0 THEN 'Conway' END, count(DISTINCT title) % 3, coalesce(bool_or(contains(lower(content), 'rsa')), false) FROM chunks GROUP BY 1 UNION ALL VALUES {SCOPE_SQL}),
c AS (SELECT *, CASE WHEN sources > 0 THEN CASE WHEN kind = 'mixed' OR (kind = 'statewide' AND town IS NOT NULL) THEN 'mixed' ELSE 'local' END WHEN rsa THEN 'statewide' WHEN kind IN ('local', 'statewide', 'mixed') THEN kind ELSE 'none' END AS scope FROM s)
SELECT id, scope, CASE WHEN scope IN ('local', 'mixed') THEN town END AS town FROM c""")
def scope_notice(t: Tables) -> DataFrame:
    """Which notice an answer carries: sources decide first, then a question about statutes, then the kind of papers.

    Each query's passages tell their kind and whether they name a statute; their distinct titles modulo three stand for
    the sources cited, and a query id of even length for a question that names a town.  Literal cases are added.
    """
    kinds = doc_source_type(t).withColumnRenamed("query_id", "id")
    facts = chunks(t).groupBy(F.col("query_id").alias("id")).agg((F.countDistinct("title") % 3).cast("int").alias("sources"), F.coalesce(F.bool_or(F.lower("content").contains("rsa")), F.lit(False)).alias("rsa"))
    seen = kinds.join(facts, "id").select("id", "kind", F.when(F.length("id") % 2 == 0, "Conway").alias("town"), "sources", "rsa")
    asked = seen.union(t.rows("id string, kind string, town string, sources int, rsa boolean", *[(str(i), *x) for i, x in enumerate(SCOPES)]))
    kind = F.coalesce("kind", F.lit("none"))
    both = (kind == "mixed") | ((kind == "statewide") & F.col("town").isNotNull())
    scope = F.when(F.col("sources") > 0, F.when(both, "mixed").otherwise("local")).when(F.col("rsa"), "statewide").otherwise(kind)
    return asked.select("id", scope.alias("scope"), F.when(scope.isin("local", "mixed"), F.col("town")).alias("town"))
