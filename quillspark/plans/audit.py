"""Situations, drift, minutes and the audit of list-style answers, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lex
from quillspark.functions.paths import UPLOAD_CATEGORIES
from quillspark.functions.text import contains_any, first_match, ladder_sql, once
from quillspark.plans.classify import Q, answers, any_pattern, any_pattern_sql, any_word_sql, questions, quoted, turns, turns_sql
from quillspark.plans.scalars import DAY, DOC_NAME, MONTH, YEAR
from quillspark.registry import query
from quillspark.sources.tables import Tables

# An uploaded page is a document's whole text under a heading made of its columns; Spark and DuckDB read the expression alike.
TOWN = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(lex.NH_TOWNS[:4])) + " ELSE coalesce(source, '') END"
PAGE = f"""CASE doc_id % 6 WHEN 0 THEN 'TOWN OF ' || upper({TOWN}) WHEN 1 THEN {TOWN} || ' Planning Board' || chr(10) || 'Meeting Minutes of March ' || {DAY} || ', ' || {YEAR}
  WHEN 2 THEN 'State of New Hampshire' WHEN 3 THEN 'Budget Committee ' || {MONTH} || '/' || {DAY} || '/' || {YEAR} ELSE '' END || chr(10) || coalesce(text, '')"""
PAGES = f"WITH p(name, text) AS (SELECT {DOC_NAME}, {PAGE} FROM documents WHERE doc_id IS NOT NULL UNION ALL VALUES {', '.join(f'({quoted(n)}, {quoted(x)})' for n, x in lex.PAGES)})"
OBVIOUS = ("budget", "zoning", "town_report", "warrant_article", "ordinance", "cip", "elections")


def pages(t: Tables) -> DataFrame:
    """name and text of every document as an uploaded page, and of literal ones; no text is an empty one."""
    uploaded = t.documents.filter("doc_id IS NOT NULL").select(F.expr(DOC_NAME).alias("name"), F.expr(PAGE).alias("text"))
    return uploaded.union(t.rows("name string, text string", *lex.PAGES))


def words_of(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def found(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def first_found(x: Column, patterns) -> Column:
    """What the first of the patterns that occurs matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 0), F.lit("")) for p in patterns])


def town_of(text: Column) -> Column:
    """The town of the first forty lines: ``TOWN OF X``, then a listed town in a telling context, then the state's own papers."""
    return once(F.slice(F.split(text, r"\r?\n"), 1, 40), town_of_lines)


def town_of_lines(lines: Column) -> Column:
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\bNEW\s*HAMPSHIRE\b|\bNH\b", ""), r"\s+", " "))
    after = F.transform(lines, lambda x: bare(F.regexp_extract(F.upper(x), r"TOWN\s+OF\s+([A-Z][A-Z\s]+)", 1)))
    named = F.get(F.filter(after, lambda x: F.length(x) > 2), F.lit(0))
    said = lambda t: [b + t.lower() for b in lex.TOWN_BEFORE] + [t.lower() + a for a in lex.TOWN_AFTER]
    known = lambda low: F.when(contains_any(low, [*lex.TOWN_BEFORE, *lex.TOWN_AFTER]), first_match(low, [(t, said(t)) for t in lex.NH_TOWNS]))
    listed = lambda low: F.coalesce(known(low), F.when(any_pattern(low, lex.STATE_PAPERS), "statewide"))
    return F.coalesce(F.initcap(named), once(F.lower(F.array_join(lines, " ")), listed))


TOWN_SQL = f"""t AS (SELECT name, string_split_regex(text, '\\r?\\n')[1:40] AS lines FROM p),
u AS (SELECT name, lower(array_to_string(lines, ' ')) AS low, list_filter(list_transform(lines, lambda x: trim(regexp_replace(regexp_replace(regexp_extract(upper(x), 'TOWN\\s+OF\\s+([A-Z][A-Z\\s]+)', 1), '\\bNEW\\s*HAMPSHIRE\\b|\\bNH\\b', '', 'g'), '\\s+', ' ', 'g'))), lambda x: length(x) > 2)[1] AS named FROM t),
v AS (SELECT name, coalesce(array_to_string(list_transform(string_split(lower(named), ' '), lambda w: upper(w[1]) || w[2:]), ' '),
  list_filter([{', '.join(map(quoted, lex.NH_TOWNS))}], lambda n: {' OR '.join([f"contains(low, {quoted(b)} || lower(n))" for b in lex.TOWN_BEFORE] + [f"contains(low, lower(n) || {quoted(a)})" for a in lex.TOWN_AFTER])})[1],
  CASE WHEN {any_pattern_sql(lex.STATE_PAPERS, 'low')} THEN 'statewide' END) AS town FROM u)"""


@query(f"{PAGES}, {TOWN_SQL} SELECT name, town FROM v")
def town_from_text(t: Tables) -> DataFrame:
    return pages(t).select("name", town_of(F.col("text")).alias("town"))


# What a model and a form would say of a document, made of its columns.
MODEL_TOWN = "CASE doc_id % 5 WHEN 0 THEN ' Statewide ' WHEN 1 THEN ' north  ' || source WHEN 2 THEN '  ' END"
FORM_TOWN = "CASE doc_id % 4 WHEN 1 THEN 'Madison' WHEN 2 THEN 'statewide' WHEN 3 THEN '' END"


def final_town(model: Column, rules: Column, form: Column) -> Column:
    """The model's town in title case, then the rules', then the form's; a model's ``statewide`` yields to any town of the others."""
    said = F.trim(F.regexp_replace(model, r"\s+", " "))
    town = lambda x: F.when(x != "statewide", F.nullif(x, F.lit("")))
    any_of = lambda x: F.nullif(x, F.lit(""))
    return F.when(F.lower(said) == "statewide", F.coalesce(town(rules), town(form), F.lit("statewide"))).when(said != "", F.initcap(said)).otherwise(F.coalesce(any_of(rules), any_of(form)))


@query(f"""{PAGES}, {TOWN_SQL}, m AS (SELECT doc_id, {DOC_NAME} AS name, trim(regexp_replace({MODEL_TOWN}, '\\s+', ' ', 'g')) AS said, nullif({FORM_TOWN}, '') AS form FROM documents)
SELECT doc_id, CASE WHEN lower(said) = 'statewide' THEN coalesce(CASE WHEN town <> 'statewide' THEN town END, CASE WHEN form <> 'statewide' THEN form END, 'statewide')
  WHEN said <> '' THEN array_to_string(list_transform(string_split(said, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE coalesce(town, form) END AS town FROM m JOIN v USING (name)""")
def finalize_town(t: Tables) -> DataFrame:
    """Of every document with a doc_id, by the rules over its page; null where nobody names a town."""
    rows = t.documents.filter("doc_id IS NOT NULL").select("doc_id", F.expr(PAGE).alias("text"), F.expr(MODEL_TOWN).alias("model"), F.expr(FORM_TOWN).alias("form"))
    towns = rows.select("doc_id", "model", "form", once(town_of(F.col("text")), lambda x: F.struct(x.alias("town"))).alias("rules"))
    return towns.select("doc_id", final_town(F.col("model"), F.col("rules.town"), F.col("form")).alias("town"))


def minutes_hints(name: Column, text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    by_name, by_text = any_pattern(F.lower(name), lex.MINUTES_NAMES), any_pattern(head, lex.MINUTES_TEXT)
    board = F.coalesce(*[F.when(head.rlike(f"(?i){p}"), n) for n, p in lex.TEXT_BOARDS])
    return F.struct((by_name | by_text).alias("likely"), F.when(by_text, "high").when(by_name, "medium").otherwise("low").alias("confidence"), board.alias("board"), first_found(F.substring(text, 1, 1500), lex.DAYS).alias("day"))


BOARD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(substr(text, 1, 3000), {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in lex.TEXT_BOARDS) + " END"
DAY_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(substr(text, 1, 1500), {quoted(p)}, 0), '')" for p in lex.DAYS) + ")"
HINTS = f"{PAGES}, h AS (SELECT name, {any_pattern_sql(lex.MINUTES_NAMES, 'lower(name)')} AS by_name, {any_pattern_sql(lex.MINUTES_TEXT, 'substr(text, 1, 3000)')} AS by_text, {BOARD_SQL} AS board, {DAY_SQL} AS day FROM p)"


@query(f"{HINTS} SELECT name, by_name OR by_text AS likely, CASE WHEN by_text THEN 'high' WHEN by_name THEN 'medium' ELSE 'low' END AS confidence, board, day FROM h")
def minutes_heuristics(t: Tables) -> DataFrame:
    return pages(t).select("name", minutes_hints(F.col("name"), F.col("text")).alias("m")).select("name", "m.*")


def hinted_pages(t: Tables) -> DataFrame:
    """Pages with their hints of minutes, computed once a page."""
    return pages(t).select("name", "text", F.explode(F.array(minutes_hints(F.col("name"), F.col("text")))).alias("m"))


@query(f"{HINTS}, {TOWN_SQL} SELECT name, town IS NOT NULL AND ((by_text AND board IS NOT NULL AND day IS NOT NULL) OR {ladder_sql('lower(name)', UPLOAD_CATEGORIES, 'misc_other')} IN {OBVIOUS}) AS skip FROM h JOIN v USING (name)")
def can_skip_llm(t: Tables) -> DataFrame:
    """The model is not asked where a town and either all of high-confidence minutes or an obvious category is known."""
    sure = F.expr("m.confidence = 'high' AND m.board IS NOT NULL AND m.day IS NOT NULL")
    obvious = first_match(F.lower("name"), UPLOAD_CATEGORIES, "misc_other").isin(*OBVIOUS)
    return hinted_pages(t).select("name", (town_of(F.col("text")).isNotNull() & (sure | obvious)).alias("skip"))


@query(f"""{HINTS}, {TOWN_SQL} SELECT name, CASE WHEN by_name OR by_text THEN 'meeting_minutes' ELSE {ladder_sql('lower(name)', UPLOAD_CATEGORIES, 'misc_other')} END AS category, coalesce(town, 'statewide') AS town, coalesce(board, '') AS board,
  nullif(regexp_extract(coalesce(day, ''), '((?:19|20)\\d{{2}})', 1), '') AS year, by_name OR by_text AS is_minutes FROM h JOIN v USING (name)""")
def build_heuristic_metadata(t: Tables) -> DataFrame:
    category = F.when(F.col("m.likely"), "meeting_minutes").otherwise(first_match(F.lower("name"), UPLOAD_CATEGORIES, "misc_other"))
    return hinted_pages(t).select(
        "name",
        category.alias("category"),
        F.coalesce(town_of(F.col("text")), F.lit("statewide")).alias("town"),
        F.coalesce("m.board", F.lit("")).alias("board"),
        found(F.coalesce("m.day", F.lit("")), r"((?:19|20)\d{2})").alias("year"),
        F.col("m.likely").alias("is_minutes"),
    )


@query(f"{Q} SELECT id, {ladder_sql('lower(x)', lex.DOMAINS)} AS domain FROM q")
def question_domain(t: Tables) -> DataFrame:
    return questions(t).select("id", first_match(F.lower("x"), lex.DOMAINS).alias("domain"))


SITUATION = ("Septic vote", ("septic", "board"))


POINTED_SQL = any_word_sql(lex.POINTED_AT)
OWN_SQL = any_word_sql([p + e for e in SITUATION[1] for p in ("the ", "that ", "this ")])


@query(f"{Q}, s AS (SELECT id, contains(lower(x), 'septic')::INT + contains(lower(x), 'board')::INT + 0.5 * (contains(lower(x), 'septic')::INT + contains(lower(x), 'vote')::INT) + {POINTED_SQL}::INT + 1.5 * {OWN_SQL}::INT AS hit, coalesce({ladder_sql('lower(x)', lex.DOMAINS)}, 'environmental') <> 'environmental' AS other FROM q) SELECT id, (hit - CASE WHEN other AND hit = 0 THEN 2 ELSE 0 END)::DOUBLE AS score, hit >= 2 AS used FROM s")
def situation_gate(t: Tables) -> DataFrame:
    """Question against situation, used from two points on.

    An entity counts one (a half by a long word of it), a long title word a half, a pointing phrase one, an entity
    pointed at one and a half; a foreign domain without any match minus two.
    """
    low, (title, entities) = F.lower("x"), SITUATION
    long_words = lambda x: [w for w in x.lower().split() if len(w) > 3]
    points = [F.when(low.contains(e), 1.0).when(contains_any(low, long_words(e) or [e]), 0.5).otherwise(0.0) for e in entities]
    points += [F.when(low.contains(w), 0.5).otherwise(0.0) for w in long_words(title)]
    points += [F.when(contains_any(low, lex.POINTED_AT), 1.0).otherwise(0.0)]
    points += [F.when(contains_any(low, [p + e for e in entities for p in ("the ", "that ", "this ")]), 1.5).otherwise(0.0)]
    hit = sum(points, F.lit(0.0))
    own = next(name for name, words in lex.DOMAINS if any(w in " ".join([title, *entities]).lower() for w in words))
    other = F.coalesce(first_match(low, lex.DOMAINS), F.lit(own)) != own
    return questions(t).select("id", (hit - F.when(other & (hit == 0), 2.0).otherwise(0.0)).alias("score"), (hit >= 2).alias("used"))


PAPERS_SQL = f"WITH n(id, name) AS (SELECT regexp_extract(url, '//([^/]+)', 1), url FROM pages UNION ALL VALUES {', '.join(f'({quoted(i)}, {quoted(n)})' for i, n in lex.PAPERS)})"
STATEWIDE_SQL = any_pattern_sql(lex.STATEWIDE_NAMES, "name")


@query(f"{PAPERS_SQL}, k AS (SELECT id, coalesce(bool_or(NOT {STATEWIDE_SQL}), false) AS local, coalesce(bool_or({STATEWIDE_SQL}), false) AS state FROM n GROUP BY 1) SELECT id, CASE WHEN local AND state THEN 'mixed' WHEN local THEN 'local' WHEN state THEN 'statewide' ELSE 'none' END AS kind, CASE WHEN local AND length(id) % 2 = 0 THEN 'Conway' END AS town FROM k")
def doc_source_classify(t: Tables) -> DataFrame:
    """What an answer's papers are (here a host's pages) by their names; local papers are those of the town asked about.

    A host of even length stands for a question that names a town.  Null names say nothing.
    """
    named = t.pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("id"), F.col("url").alias("name")).union(t.rows("id string, name string", *lex.PAPERS))
    state = any_pattern(F.col("name"), lex.STATEWIDE_NAMES)
    k = named.groupBy("id").agg(F.coalesce(F.bool_or(~state), F.lit(False)).alias("local"), F.coalesce(F.bool_or(state), F.lit(False)).alias("state"))
    kind = F.when(F.col("local") & F.col("state"), "mixed").when(F.col("local"), "local").when(F.col("state"), "statewide").otherwise("none")
    return k.select("id", kind.alias("kind"), F.when(F.col("local") & (F.length("id") % 2 == 0), "Conway").alias("town"))


def all_of(x: Column, patterns, group: int = 0) -> Column:
    """What each pattern matches, in the patterns' order."""
    return F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(group)) for p in patterns])


def entities_of(x: Column) -> Column:
    found = all_of(x, [f"(?i){p}" for p in lex.SITUATION_WORDS])
    return F.array_distinct(F.transform(found, lambda e: F.trim(F.regexp_replace(e, r"\s+", " "))))


@query()
def issue_map(t: Tables) -> DataFrame:
    """Property, boards, legal topics, actions and dates of a question, its situation and the first 2000 characters of each source."""
    title, entities = SITUATION
    sources = F.array(F.lit(lex.ISSUE_SOURCE))
    heads = F.transform(sources, lambda x: F.substring(x, 1, 2000))
    x = F.col("text")
    boards = F.array_compact(F.array(*[F.lower(F.nullif(F.regexp_extract(x, f"(?i){p}", 0), F.lit(""))) for p in lex.ISSUE_BOARDS]))
    topics = F.array_compact(F.array(*[F.when(x.rlike(f"(?i){p}"), n) for n, p in lex.ISSUE_TOPICS]))
    actions = all_of(F.lower(x), lex.ISSUE_ACTIONS)
    dates = F.concat(*[F.slice(all_of(x, [f"(?i){p}"]), 1, 3) for p in lex.ISSUE_DATES])
    most = lambda xs, n: F.slice(F.array_distinct(xs), 1, n)
    rows = questions(t).select("id", F.concat_ws(" ", F.col("x"), F.lit(title), *map(F.lit, entities), heads).alias("text"))
    return rows.select(
        "id",
        most(F.array(*map(F.lit, entities)), 10).alias("entities"),
        most(actions, 5).alias("actions"),
        most(topics, 5).alias("legal_topics"),
        most(boards, 4).alias("boards"),
        first_found(x, lex.ISSUE_PROPERTY).alias("property"),
        most(dates, 3).alias("dates"),
    )


HINT = "Ossipee"
FALLBACK = f"""{turns_sql('q', 'user', lex.PLANNED)}, f AS (SELECT id, x, string_split_regex(x, '[.!?]')[1] AS first, regexp_extract_all(x, {quoted(lex.PLACE)})[1:5] AS entities,
  list_filter([{', '.join(map(quoted, lex.PLANNER_TOPICS))}], lambda w: contains(lower(x), w))[1:6] AS topics, list_filter([{', '.join(map(quoted, lex.PLANNER_BOARDS))}], lambda w: contains(lower(x), w)) AS boards,
  (SELECT count(*) FROM (SELECT unnest([{', '.join(map(quoted, lex.PLANNER_LEGAL_WORDS))}]) AS w) WHERE contains(lower(x), w)) AS n FROM q),
g AS (SELECT *, CASE WHEN n >= 4 THEN 0.9 WHEN n >= 2 THEN 0.7 WHEN n >= 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS salience FROM f)"""


@query(f"""{FALLBACK} SELECT id, substr(coalesce(nullif(trim(first), ''), substr(x, 1, 60)), 1, 80) AS title, entities, topics, boards, salience,
  substr(concat_ws(' ', {quoted(HINT)}, entities[1], boards[1], trim(regexp_replace(substr(x, 1, 100), '[?.,!]', '', 'g'))), 1, 200) AS local_query,
  substr(concat_ws(' ', 'New Hampshire', topics[1], topics[2], CASE WHEN salience >= 0.5 THEN 'RSA municipal law' END), 1, 200) AS state_query,
  CASE WHEN salience >= 0.5 THEN 3 ELSE 1 END AS min_state, CASE WHEN salience >= 0.6 THEN 'law-first' ELSE 'facts-first' END AS priority FROM g""")
def planner_fallback(t: Tables) -> DataFrame:
    """The plan made without a model: places, topics and boards named, one query for each lane, and which lane leads."""
    low = F.lower("x")
    named = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    n = F.size(named(lex.PLANNER_LEGAL_WORDS))
    facts = turns(t, "user", lex.PLANNED).select(
        "id",
        "x",
        F.substring(F.coalesce(F.nullif(F.trim(F.get(F.split("x", "[.!?]"), F.lit(0))), F.lit("")), F.substring("x", 1, 60)), 1, 80).alias("title"),
        F.slice(F.regexp_extract_all("x", F.lit(lex.PLACE), F.lit(0)), 1, 5).alias("entities"),
        F.slice(named(lex.PLANNER_TOPICS), 1, 6).alias("topics"),
        named(lex.PLANNER_BOARDS).alias("boards"),
        F.when(n >= 4, 0.9).when(n >= 2, 0.7).when(n >= 1, 0.5).otherwise(0.2).alias("salience"),
    )
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    core, law = F.trim(F.regexp_replace(F.substring("x", 1, 100), "[?.,!]", "")), F.when(F.col("salience") >= 0.5, "RSA municipal law")
    return facts.select(
        *("id", "title", "entities", "topics", "boards", "salience"),
        F.substring(F.concat_ws(" ", F.lit(HINT), at("entities", 0), at("boards", 0), core), 1, 200).alias("local_query"),
        F.substring(F.concat_ws(" ", F.lit("New Hampshire"), at("topics", 0), at("topics", 1), law), 1, 200).alias("state_query"),
        F.when(F.col("salience") >= 0.5, 3).otherwise(1).alias("min_state"),
        F.when(F.col("salience") >= 0.6, "law-first").otherwise("facts-first").alias("priority"),
    )


def title_of(e: Column) -> Column:
    first = lambda p: F.get(F.filter(e, lambda x: x.rlike(f"(?i){p}")), F.lit(0))
    place = F.coalesce(first(lex.FACILITY), first(lex.PROPERTY))
    board = F.when(place.isNull() | first(lex.EVENT).isNull(), first(lex.BOARD))
    title = F.nullif(F.concat_ws(" - ", place, first(lex.EVENT), board), F.lit(""))
    return F.coalesce(title, F.nullif(F.array_join(F.slice(e, 1, 2), " / "), F.lit("")), F.lit("Current discussion"))


@query()
def situation_title(t: Tables) -> DataFrame:
    return questions(t).select("id", title_of(entities_of(F.col("x"))).alias("title"))


def transition(x: Column, held: Column, artifact: Column) -> Column:
    """What a message does to the entities held (null: no situation yet): the first rule that fits decides.

    clear: it speaks of things in general.  start: no situation, and two entities or an attached document.  none: no
    situation and too little for one.  update: two entities that are new and an event.  keep: an entity in common.
    continue: anything else.
    """
    e = entities_of(x)
    lower = F.transform(held, F.lower)
    fresh = F.filter(e, lambda w: ~F.array_contains(lower, F.lower(w)))
    shared = F.exists(e, lambda w: F.exists(lower, lambda h: h.contains(F.lower(w)) | F.lower(w).contains(h)))
    dates = all_of(x, [f"(?i){p}" for p in lex.SITUATION_DATES])
    action = (
        F.when(any_pattern(x, lex.BROADENING), "clear")
        .when(held.isNull() & ((F.size(e) >= 2) | artifact), "start")
        .when(held.isNull(), "none")
        .when((F.size(fresh) >= 2) & x.rlike(f"(?i){lex.EVENT_MARKERS}"), "update")
        .when(shared, "keep")
        .otherwise("continue")
    )
    return F.struct(action.alias("action"), e.alias("found"), F.get(dates, F.lit(0)).alias("first_day"), F.when(F.size(dates) > 1, F.element_at(dates, -1)).alias("last_day"))


CONFIDENCE = {"clear": 0.3, "start": 0.7, "none": 0.5, "update": 0.8, "keep": 0.85, "continue": 0.7}
HELD = (("none", None, False), ("artifact", None, True), ("committee", ["budget committee", "vote"], False))


def moved(rows: DataFrame) -> DataFrame:
    """Rows of (x, held, artifact) with the transition and the situation after it."""
    rows = rows.withColumn("m", transition(F.col("x"), F.col("held"), F.col("artifact")))
    action = rows["m.action"]
    entities = F.when(action == "start", rows["m.found"]).when(action == "update", F.array_union("held", "m.found")).when(action.isin("keep", "continue"), F.col("held"))
    sure = F.when((action == "start") & F.col("artifact"), 0.9)
    for name, value in CONFIDENCE.items():
        sure = sure.when(action == name, value)
    rows = rows.withColumns({"action": action, "entities": entities, "confidence": sure})
    return rows.withColumn("title", F.when(action.isin("start", "update"), title_of(F.col("entities"))))


@query()
def situation_extract(t: Tables) -> DataFrame:
    """Each message against no situation, an attached document, and the budget committee's vote."""
    strings = lambda words: F.array(*map(F.lit, words)) if words else F.lit(None).cast("array<string>")
    held = F.array(*[F.struct(F.lit(k).alias("held_id"), strings(words).alias("held"), F.lit(a).alias("artifact")) for k, words, a in HELD])
    rows = questions(t).select("id", "x", F.inline(held))
    dated = F.col("action").isin("start", "update")
    return moved(rows).select("id", "held_id", "action", "title", "entities", F.when(dated, F.col("m.first_day")).alias("first_day"), F.when(dated, F.col("m.last_day")).alias("last_day"), "confidence")


def drift_of(x: Column) -> Column:
    """Names foreign to the situation, those of them that no analogy phrase within 200 characters frames, and the situation's coverage."""
    _, entities = SITUATION
    low = F.lower(x)
    long_words = lambda e, n: [w for w in e.lower().split() if len(w) > n]
    own = [w for e in entities for w in long_words(e, 2)]
    named = F.filter(F.array_distinct(F.transform(F.concat(all_of(x, lex.PROPER_NOUNS, 1), all_of(x, lex.PROPER_NOUNS)), F.trim)), lambda e: F.length(e) > 2)
    alike = lambda w: reduce(lambda p, q: p | q, [w.contains(o) | F.lit(o).contains(w) for o in own])
    part = lambda e: F.exists(F.split(F.lower(e), r"\s+"), lambda w: (F.length(w) > 2) & alike(w))
    foreign = F.filter(named, lambda e: ~part(e) & ~contains_any(F.lower(e), lex.COMMON_BOARDS))
    at = lambda e: F.instr(low, F.lower(e))
    near = lambda e: F.substr(x, F.greatest(F.lit(1), at(e) - 200), F.least(at(e) - 1, F.lit(200)) + F.length(e) + 200)
    unframed = F.filter(foreign, lambda e: ~any_pattern(near(e), lex.ANALOGY))
    points = [F.when(low.contains(e), 1.0).when(contains_any(low, long_words(e, 3) or [e]), 0.5).otherwise(0.0) for e in entities]
    return F.struct(F.sort_array(foreign).alias("foreign"), F.sort_array(unframed).alias("unframed"), (sum(points, F.lit(0.0)) / len(entities)).alias("coverage"))


def with_severity(rows: DataFrame) -> DataFrame:
    """A coverage under 0.4 is drift by itself, and major."""
    rows = rows.select("id", "d.*")
    many, low = F.size("unframed"), F.col("coverage") < 0.4
    drift = (many > 0) | low
    major = low | (many >= 3)
    return rows.select("id", F.when(drift, F.col("unframed")).otherwise(F.col("foreign")).alias("drifted_to"), (many > 0).alias("unframed"), F.col("coverage"), F.when(drift & major, "major").when(drift, "minor").otherwise("none").alias("severity"))


@query()
def drift_detect(t: Tables) -> DataFrame:
    return with_severity(answers(t).select("id", drift_of(F.col("x")).alias("d")))


@query()
def should_regenerate(t: Tables) -> DataFrame:
    rows = with_severity(answers(t).select("id", drift_of(F.col("x")).alias("d")))
    return rows.select("id", ((F.col("severity") == "major") | F.col("unframed")).alias("regenerate"))


def lists(t: Tables) -> DataFrame:
    return turns(t, "assistant", lex.LISTS)


SECTIONS = [name for name, _, _ in lex.HEADINGS]
BULLET = r"^\s*[-•*]\s+"


def heading(x: Column, place: int) -> Column:
    """Where a heading first stands, in the first of its four forms that occurs: marked, numbered, plain line, hashed line."""
    name, pattern, limit = lex.HEADINGS[place]
    forms = [f"(?i){pattern}", rf"(?i)\d+\.\s*\*\*{name}[^*]*\*\*[:\s]*", rf"(?im)^{name}[:\s]+", rf"(?im)^#+\s*{name}[:\s]*"]
    seen = lambda p: F.struct(F.regexp_instr(x, F.lit(p)).alias("at"), F.lit(place).alias("place"), F.lit(name).alias("name"), F.lit(limit).alias("limit"), F.length(F.regexp_extract(x, p, 0)).alias("n"))
    return F.coalesce(*[F.when(x.rlike(p), seen(p)) for p in forms])


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def with_sections(rows: DataFrame) -> DataFrame:
    """``s``: (at, place, name, limit, content) of each section in text order; it ends where the next heading starts."""
    heads = F.sort_array(F.array_compact(F.array(*[heading(F.col("x"), k) for k in range(len(SECTIONS))])))
    rows = rows.withColumn("heads", heads)
    end = lambda k: F.coalesce(F.get("heads", k + 1)["at"], F.length("x") + 1)
    body = lambda h, k: stripped(F.substr("x", h["at"] + h["n"], F.greatest(F.lit(0), end(k) - h["at"] - h["n"])))
    return rows.withColumn("s", F.transform("heads", lambda h, k: F.struct(h["at"].alias("at"), h["place"].alias("place"), h["name"].alias("name"), h["limit"].alias("limit"), body(h, k).alias("content")))).drop("heads")


def content_of(name: str) -> Column:
    return F.coalesce(F.get(F.filter("s", lambda y: y["name"] == name), F.lit(0))["content"], F.lit(""))


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


@query()
def extract_sections(t: Tables) -> DataFrame:
    return with_sections(lists(t)).select("id", F.posexplode("s").alias("pos", "s")).select("id", "pos", "s.name", "s.content")


def uncited_in(law: Column) -> Column:
    """Statutes of the law section with no state citation from 20 characters before their first mention to 30 after it."""
    near = lambda m: F.substr(law, F.greatest(F.lit(1), F.instr(law, m) - 20), F.least(F.instr(law, m) - 1, F.lit(20)) + F.length(m) + 30)
    return F.filter(F.regexp_extract_all(law, F.lit(r"(?i)\bRSA\s+\d+[-:A-Z]?"), F.lit(0)), lambda m: ~near(m).rlike(r"\[S\d+\]"))


def audited(rows: DataFrame) -> DataFrame:
    """Counts and violations of list-style answers, whose questions all had state passages.

    Violations: over 500 words; headings missing; headings out of order; each section over its bullets; each bullet
    over 20 words; under two state citations in the law section; each statute there without one near; closing phrases;
    user citations in a section.  The first, the sixth and the seventh are errors.
    """
    rows = with_sections(rows)
    bullets = lambda y: F.filter(F.split(y["content"], "\n"), is_bullet)
    law = content_of("What the law generally requires")
    order = F.array_sort("s", lambda p, q: p["place"] - q["place"])
    ats = F.transform(order, lambda y: y["at"])
    rows = rows.select(
        "id",
        F.size(words_of(F.col("x"))).alias("words"),
        F.size("s").alias("headings"),
        (ats == F.sort_array(ats)).alias("ordered"),
        F.size(F.filter("s", lambda y: F.size(bullets(y)) > y["limit"])).alias("crowded"),
        F.size(F.filter(F.flatten(F.transform("s", bullets)), lambda b: F.size(words_of(b)) > 20)).alias("long"),
        F.regexp_count("x", F.lit(r"\[S\d+\]")).alias("state_citations"),
        (F.regexp_count(law, F.lit(r"\[S\d+\]")) >= 2).alias("law_cited"),
        F.size(uncited_in(law)).alias("uncited"),
        any_pattern(F.col("x"), lex.TAILS).alias("tails"),
        F.exists("s", lambda y: y["content"].contains("[USER]")).alias("user_misplaced"),
    )
    wordy = F.col("words") > 500
    flags = [wordy, F.col("headings") < len(SECTIONS), ~F.col("ordered"), ~F.col("law_cited"), F.col("tails"), F.col("user_misplaced")]
    n = sum([f.cast("int") for f in flags], F.col("crowded") + F.col("long") + F.col("uncited"))
    return rows.withColumns({"violations": n, "passed": ~wordy & F.col("law_cited") & (F.col("uncited") == 0)})


@query()
def list_audit(t: Tables) -> DataFrame:
    return audited(lists(t)).select("id", "words", "headings", "ordered", "state_citations", "law_cited", "uncited", "tails", "user_misplaced", "violations", "passed")


def scored(rows: DataFrame) -> DataFrame:
    """Score of each answer, and whether it is complete: all headings and 180 words."""
    short = F.col("words") < 180
    score = F.col("headings") * 10 + F.when(F.col("law_cited"), 20).otherwise(0) - F.col("violations") * 2 - F.when(F.col("tails"), 10).otherwise(0) - F.when(short, 30).otherwise(0) + F.when(F.col("words").between(200, 500), 15).otherwise(0)
    return audited(rows).select("id", score.alias("score"), ((F.col("headings") == len(SECTIONS)) & ~short).alias("complete"))


@query()
def answer_score(t: Tables) -> DataFrame:
    return scored(lists(t))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n_chars <= 1000 AND doc_id % 3 = 0 THEN 'original' WHEN n_chars > 1000 AND doc_id % 2 <> 0 THEN 'repair' WHEN n_chars > 1000 THEN CASE WHEN doc_id % 3 > n_chars % 5 THEN 'repair' ELSE 'original' END WHEN doc_id % 2 = 0 THEN 'original' WHEN doc_id % 3 > n_chars % 5 THEN 'repair' ELSE 'original' END AS selected FROM documents")
def select_better(t: Tables) -> DataFrame:
    """Completeness first, then the higher score; a tie keeps the original."""
    whole, repaired = F.col("doc_id") % 2 == 0, F.col("n_chars") > 1000
    better = (F.col("doc_id") % 3) > (F.col("n_chars") % 5)
    return t.documents.select("doc_id", F.when(~whole & repaired, "repair").when(whole & ~repaired, "original").when(better, "repair").otherwise("original").alias("selected"))


C = turns_sql("c", "assistant", lex.CLAIMS)
STATE_TEXT = "The DOJ reviews complaints."
"""Stands for the state passages that an answer was given."""


def around(pattern: str, before: int, after: int) -> str:
    """A pattern that takes in up to so many characters before and after the match, which is group 1."""
    return rf"(?is).{{0,{before}}}({pattern}).{{0,{after}}}"


@query(f"{C} SELECT id, list_filter([{', '.join(f'trim(regexp_extract(x, {quoted(around(p, 30, 30))}, 0))' for p in lex.ABSOLUTE)}], lambda e: e <> '') AS evidence FROM c")
def absolute_claims(t: Tables) -> DataFrame:
    """The surroundings of each absolute claim's first match, in the patterns' order."""
    seen = F.array(*[F.trim(F.regexp_extract("x", around(p, 30, 30), 0)) for p in lex.ABSOLUTE])
    return turns(t, "assistant", lex.CLAIMS).select("id", F.filter(seen, lambda e: e != "").alias("evidence"))


UNCITED_SQL = ", ".join(f"CASE WHEN NOT regexp_matches(regexp_extract(x, {quoted(around(p, 10, 30))}, 0), '\\[S\\d+\\]') AND NOT contains({quoted(STATE_TEXT.lower())}, lower(regexp_extract(regexp_extract(x, {quoted(around(p, 10, 30))}, 1), '^\\S+'))) THEN trim(regexp_extract(x, {quoted(around(p, 10, 30))}, 0)) ELSE '' END" for p in lex.PROCEDURES)


@query(f"{C} SELECT id, list_filter([{UNCITED_SQL}], lambda e: e <> '') AS evidence FROM c")
def uncited_procedure(t: Tables) -> DataFrame:
    """Procedures with no state citation from 10 characters before to 30 after, whose first word the state passages lack."""

    def evidence(p: str) -> Column:
        near = F.regexp_extract("x", around(p, 10, 30), 0)
        word = F.lower(F.regexp_extract(F.regexp_extract("x", around(p, 10, 30), 1), r"^\S+", 0))
        return F.when(~near.rlike(r"\[S\d+\]") & ~F.contains(F.lit(STATE_TEXT.lower()), word), F.trim(near)).otherwise("")

    seen = F.array(*map(evidence, lex.PROCEDURES))
    return turns(t, "assistant", lex.CLAIMS).select("id", F.filter(seen, lambda e: e != "").alias("evidence"))


def capped_words(x: Column, most: int) -> Column:
    """The text as it is, or its first words joined by blanks and dots."""
    return F.when(F.size(words_of(x)) > most, F.concat(F.array_join(F.slice(words_of(x), 1, most), " "), F.lit("..."))).otherwise(x)


def capped_bullet(x: Column, most: int = 20, keep_citation: bool = False) -> Column:
    """A bullet's first words; a citation that ends it may take the last word's place."""
    w = F.split(x, r"\s+")
    cut = lambda n: F.array_join(F.slice(w, 1, n), " ")
    out = F.when(F.size(w) <= most, x)
    if keep_citation:
        last = F.element_at(w, -1)
        out = out.when(last.rlike(r"^\[(?:S|L|USER)\d*\]$") & (F.size(w) > most + 1), F.concat(cut(most - 1), F.lit("... "), last))
    return out.otherwise(F.concat(cut(most), F.lit("...")))


def without_tails(x: Column) -> Column:
    """The first occurrence of each closing phrase is cut out."""
    return reduce(lambda y, p: F.array_join(F.split(y, f"(?i){p}", 2), ""), lex.TAILS, x)


def kept_bullets(content: Column, limit: int) -> Column:
    return F.slice(F.filter(F.split(content, "\n"), is_bullet), 1, limit)


def normal_section(content: Column, limit: int) -> Column:
    """Up to two lines of plain text as one, then the bullets within their number and words."""
    lines = F.filter(F.transform(F.split(content, "\n"), stripped), lambda y: y != "")
    plain = F.array_join(F.slice(F.filter(lines, lambda y: ~is_bullet(y)), 1, 2), " ")
    bullets = F.transform(F.slice(F.filter(lines, is_bullet), 1, limit), lambda y: capped_bullet(y, keep_citation=True))
    return F.array_join(F.concat(F.when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>")), bullets), "\n")


def normalized(rows: DataFrame) -> DataFrame:
    """All five sections in order; one that is missing or empty says so."""
    parts = []
    for name, _, limit in lex.HEADINGS:
        content = content_of(name)
        body = capped_words(content, 60) if limit == 0 else normal_section(content, limit)
        parts.append(F.concat(F.lit(f"**{name}**\n"), F.when(content == "", "- Information not available in sources.").otherwise(body)))
    text = without_tails(F.concat_ws("\n\n", *parts))
    return with_sections(rows).select("id", stripped(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("x"))


@query()
def normalize_answer(t: Tables) -> DataFrame:
    return normalized(lists(t))


def better_of(original: DataFrame, repair: DataFrame) -> DataFrame:
    """id, ``selected``, and both answers' score and completeness, for rows of (id, x) that share unique ids.

    An answer that alone is complete is taken, else the higher score; a tie keeps the original.  Ids that only one
    side has, and null ids, are left out.
    """
    side = lambda rows, name: scored(rows).select("id", F.struct("score", "complete").alias(name))
    both = side(original, "original").join(side(repair, "repair"), "id")
    gate = F.when(F.col("original.complete") != F.col("repair.complete"), F.col("repair.complete"))
    repaired = F.coalesce(gate, F.col("repair.score") > F.col("original.score"))
    flat = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("original", "repair") for c in ("score", "complete")]
    return both.select("id", F.when(repaired, "repair").otherwise("original").alias("selected"), *flat)


@query()
def select_better_audited(t: Tables) -> DataFrame:
    """Each answer of the conversations against its own text brought into the five sections, both through the audit."""
    return better_of(lists(t), normalized(lists(t)))


@query()
def hard_truncate(t: Tables) -> DataFrame:
    """The sections there are, cut to their bullets, and 500 words in all."""
    parts = []
    for name, _, limit in lex.HEADINGS:
        content = content_of(name)
        body = capped_words(content, 50) if limit == 0 else F.array_join(F.transform(kept_bullets(content, limit), lambda y: capped_bullet(y)), "\n")
        parts.append(F.when(content != "", F.concat(F.lit(f"**{name}**\n"), body)))
    rows = with_sections(lists(t)).select("id", without_tails(F.concat_ws("\n\n", *parts)).alias("x"))
    return rows.select("id", stripped(capped_bullet(F.col("x"), 500)).alias("x"))
