"""Rule-based classification and audit of questions, pastes and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lex
from quillspark.functions.text import contains_any, hits, pattern_hits, whitespace_chunks
from quillspark.registry import query
from quillspark.sources.tables import Tables


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, texts) -> str:
    return f"WITH {name}(id, x) AS (VALUES {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(texts))})"


def turns_sql(name: str, role: str, texts) -> str:
    rows = ", ".join(f"({quoted(f'text {i}')}, {quoted(x)})" for i, x in enumerate(texts))
    return f"WITH {name}(id, x) AS (SELECT conv_id || '/' || turn, coalesce(text, '') FROM conversations WHERE role = '{role}' UNION ALL SELECT * FROM (VALUES {rows}))"


def turns(t: Tables, role: str, texts) -> DataFrame:
    """Every turn of a role, and texts that hit lists which the driver's prose rarely does; no text is an empty one."""
    said = t.conversations.filter(F.col("role") == role).select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("x"))
    return said.union(t.rows("id string, x string", *[(f"text {i}", x) for i, x in enumerate(texts)]))


Q, A = turns_sql("q", "user", lex.QUESTIONS), turns_sql("a", "assistant", lex.ANSWERS)


def questions(t: Tables) -> DataFrame:
    return turns(t, "user", lex.QUESTIONS)


def answers(t: Tables) -> DataFrame:
    return turns(t, "assistant", lex.ANSWERS)


def any_pattern(x: Column, patterns) -> Column:
    return x.rlike("(?i)(?:" + "|".join(patterns) + ")")


def any_pattern_sql(patterns, x: str = "x") -> str:
    return f"regexp_matches({x}, {quoted('(?i)(?:' + '|'.join(patterns) + ')')})"


def any_word_sql(words, x: str = "lower(x)") -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w.lower())})" for w in words) + ")"


def hits_sql(words, x: str = "lower(x)") -> str:
    return "(" + " + ".join(f"contains({x}, {quoted(w.lower())})::INT" for w in words) + ")"


def pattern_hits_sql(patterns, x: str = "x") -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {quoted('(?i)' + p)})::INT" for p in patterns) + ")"


def ci(patterns):
    return ["(?i)" + p for p in patterns]


@query(f"{Q} SELECT id, round(least(least(0.1 * {hits_sql(lex.LEGAL_WORDS)}, 0.6) + least(0.15 * {pattern_hits_sql(lex.LEGAL_PATTERNS)}, 0.45), 1.0)::DOUBLE, 6) AS salience FROM q")
def legal_salience_v2(t: Tables) -> DataFrame:
    words = hits(F.lower("x"), [w.lower() for w in lex.LEGAL_WORDS])
    score = F.least(words * 0.1, F.lit(0.6)) + F.least(pattern_hits(F.col("x"), ci(lex.LEGAL_PATTERNS)) * 0.15, F.lit(0.45))
    return questions(t).select("id", F.round(F.least(score, F.lit(1.0)), 6).alias("salience"))


@query(f"{Q} SELECT id, CASE WHEN n >= 4 THEN 0.9 WHEN n >= 2 THEN 0.7 WHEN n >= 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS salience FROM (SELECT id, {hits_sql(lex.PLANNER_LEGAL_WORDS)} AS n FROM q)")
def legal_salience_v3(t: Tables) -> DataFrame:
    n = hits(F.lower("x"), lex.PLANNER_LEGAL_WORDS)
    return questions(t).select("id", F.when(n >= 4, 0.9).when(n >= 2, 0.7).when(n >= 1, 0.5).otherwise(0.2).alias("salience"))


TOWNS = tuple(w.lower() for w in lex.SCOPE_TOWNS)
SCOPE_HINTS = (None, "local", "statewide", "mixed")
SCOPE_SQL = f"CASE WHEN {any_word_sql(TOWNS)} AND {any_pattern_sql(lex.STATE_LAW)} THEN 'mixed' WHEN {any_pattern_sql(lex.STATE_LAW)} THEN 'statewide' WHEN {any_word_sql(TOWNS)} THEN 'local' END"


def scope_of(x: Column) -> Column:
    """Which papers a question is about by the towns and the state law that it names; null where it names neither."""
    town, state = contains_any(F.lower(x), TOWNS), any_pattern(x, lex.STATE_LAW)
    return F.when(town & state, "mixed").when(state, "statewide").when(town, "local")


def combined_scope(a: Column, b: Column) -> Column:
    """Two hints as one: both kinds are mixed, and a missing one gives way."""
    differ = F.coalesce(a != b, F.lit(False))
    return F.when((a == "mixed") | (b == "mixed") | differ, "mixed").otherwise(F.coalesce(a, b))


@query(f"""{Q}, s AS (SELECT id, {SCOPE_SQL} AS scope, unnest([NULL, 'local', 'statewide', 'mixed']) AS hint FROM q)
SELECT id, hint, scope, CASE WHEN scope = 'mixed' OR hint = 'mixed' OR scope <> hint THEN 'mixed' ELSE coalesce(scope, hint) END AS combined FROM s""")
def scope_hint(t: Tables) -> DataFrame:
    """What each question says of its scope, combined with each hint that a model may give."""
    hints = F.explode(F.array(*[F.lit(h).cast("string") for h in SCOPE_HINTS])).alias("hint")
    rows = questions(t).select("id", hints, scope_of(F.col("x")).alias("scope"))
    return rows.select("id", "hint", "scope", combined_scope(F.col("scope"), F.col("hint")).alias("combined"))


def type_of_answer(x: Column, output: Column) -> Column:
    """The kind of answer to a question: risk, then explanation; a quick one follows the plan's ``output``.

    A question that nothing marks becomes a matter of risk where the plan wants risks and the words weigh 0.7
    or more in law, and an explanation where the plan wants one.
    """
    n = hits(F.lower(x), lex.PLANNER_LEGAL_WORDS)
    planned = F.when((n >= 2) & (output == "risk"), "RISK_DISPUTE").when(output == "explain", "EXPLAINER").otherwise("QUICK_PROCESS")
    return F.when(any_pattern(x, lex.RISK), "RISK_DISPUTE").when(any_pattern(x, lex.EXPLAINER), "EXPLAINER").otherwise(planned)


OUTPUTS = ("explain", "steps", "cite_laws", "risk", "process")
TYPE_SQL = f"CASE WHEN {any_pattern_sql(lex.RISK)} THEN 'RISK_DISPUTE' WHEN {any_pattern_sql(lex.EXPLAINER)} THEN 'EXPLAINER' WHEN {hits_sql(lex.PLANNER_LEGAL_WORDS)} >= 2 AND output = 'risk' THEN 'RISK_DISPUTE' WHEN output = 'explain' THEN 'EXPLAINER' ELSE 'QUICK_PROCESS' END"


@query(f"{Q}, o AS (SELECT *, unnest({list(OUTPUTS)}) AS output FROM q) SELECT id, output, {TYPE_SQL} AS kind FROM o")
def answer_type(t: Tables) -> DataFrame:
    """Each question under each output that a plan may ask for."""
    rows = questions(t).select("id", "x", F.explode(F.array(*map(F.lit, OUTPUTS))).alias("output"))
    return rows.select("id", "output", type_of_answer(F.col("x"), F.col("output")).alias("kind"))


@query(f"{Q} SELECT id, CASE WHEN {any_pattern_sql(lex.LIST_WORDS)} THEN 'LIST' ELSE 'PROSE' END AS style FROM q")
def render_style(t: Tables) -> DataFrame:
    return questions(t).select("id", F.when(any_pattern(F.col("x"), lex.LIST_WORDS), "LIST").otherwise("PROSE").alias("style"))


INTENTS = (("interpretation", lex.INTERPRETATION), ("causal", lex.CAUSAL), ("mechanism", lex.MECHANISM), ("breakdown", lex.BREAKDOWN))


INTENT_SQL = " ".join(f"WHEN {any_pattern_sql(p)} THEN {quoted(n)}" for n, p in INTENTS)


def intent_of(x: Column, complex_one: Column) -> Column:
    """The first intent whose patterns a question has; a complex one that has none is taken by its words."""
    low = F.lower(x)
    why = F.when(low.contains("why"), "causal").when(low.contains("how") & contains_any(low, ("work", "calculate", "determin")), "mechanism")
    intent = F.coalesce(F.when(complex_one, why), F.lit("none"))
    for name, patterns in reversed(INTENTS):
        intent = F.when(any_pattern(x, patterns), name).otherwise(intent)
    return intent


@query(f"""{Q}, c AS (SELECT *, unnest([false, true]) AS complex FROM q)
SELECT id, complex, CASE {INTENT_SQL} WHEN complex AND contains(lower(x), 'why') THEN 'causal' WHEN complex AND contains(lower(x), 'how') AND {any_word_sql(("work", "calculate", "determin"))} THEN 'mechanism' ELSE 'none' END AS intent FROM c""")
def composed_intent(t: Tables) -> DataFrame:
    """Each question, taken as a simple one and as a complex one."""
    rows = questions(t).select("id", "x", F.explode(F.array(F.lit(False), F.lit(True))).alias("complex"))
    return rows.select("id", "complex", intent_of(F.col("x"), F.col("complex")).alias("intent"))


@query(f"{Q} SELECT id, {any_pattern_sql(lex.BROAD)} AS broad FROM q")
def broad_coverage(t: Tables) -> DataFrame:
    return questions(t).select("id", any_pattern(F.col("x"), lex.BROAD).alias("broad"))


@query(f"{Q} SELECT id, {any_word_sql(lex.RECENT)} AS recent FROM q")
def recency_intent(t: Tables) -> DataFrame:
    return questions(t).select("id", contains_any(F.lower("x"), lex.RECENT).alias("recent"))


@query(f"{Q} SELECT id, {any_pattern_sql(lex.STATE_LAW)} OR length(x) % 2 = 0 AS parallel FROM q")
def parallel_state_flag(t: Tables) -> DataFrame:
    """True for statewide questions, else the plan's own flag (here: even ids)."""
    return questions(t).select("id", (any_pattern(F.col("x"), lex.STATE_LAW) | (F.length("x") % 2 == 0)).alias("parallel"))


STARTS_SQL = "(" + " OR ".join(f"starts_with(lower(trim(x)), {quoted(p)})" for p in lex.FOLLOW_UP) + ")"
DOMAIN_SQL = f"CASE {' '.join(f'WHEN {any_word_sql(words)} THEN {quoted(name)}' for name, words in lex.DOMAINS)} END"
ASKED_SQL = f"""WITH w AS (SELECT *, coalesce(bool_or(role = 'assistant') OVER s, false) AS answered, last_value(CASE WHEN role = 'user' THEN coalesce(text, '') END IGNORE NULLS) OVER s AS before FROM conversations
  WINDOW s AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS x, answered, before FROM w WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(f'text {i}')}, {quoted(x)}, {i % 2 == 0}, {quoted(lex.QUESTIONS[i - 1]) if i else 'NULL'})" for i, x in enumerate(lex.QUESTIONS))}) AS v(id, x, answered, before)),
d AS (SELECT id, length(x) <= 120 AND answered AND {STARTS_SQL} AS bypass, {DOMAIN_SQL.replace("lower(x)", "lower(before)")} AS domain FROM q)"""


def asked(t: Tables) -> DataFrame:
    """Every user turn with whether the session has an answer before it, and the user turn before it.

    The literal texts are one session's questions, of which every other one follows an answer.
    """
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    answered = F.coalesce(F.bool_or(F.col("role") == "assistant").over(earlier), F.lit(False))
    before = F.last(F.when(F.col("role") == "user", F.coalesce("text", F.lit(""))), ignorenulls=True).over(earlier)
    said = t.conversations.select("conv_id", "turn", "role", "text", answered.alias("answered"), before.alias("before")).filter("role = 'user'")
    rows = [(f"text {i}", x, i % 2 == 0, lex.QUESTIONS[i - 1] if i else None) for i, x in enumerate(lex.QUESTIONS)]
    return said.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("x"), "answered", "before").union(t.rows("id string, x string, answered boolean, before string", *rows))


def follows_up(x: Column, answered: Column) -> Column:
    """A short question that begins as a follow-up does, after at least one answer."""
    low = F.lower(F.trim(x))
    return (F.length(x) <= 120) & answered & F.exists(F.array(*[F.lit(p) for p in lex.FOLLOW_UP]), lambda p: low.startswith(p))


@query(f"{ASKED_SQL} SELECT id, bypass FROM d")
def followup_bypass(t: Tables) -> DataFrame:
    return asked(t).select("id", follows_up(F.col("x"), F.col("answered")).alias("bypass"))


@query(f"{ASKED_SQL} SELECT id, 'simple' AS complexity, CASE WHEN domain IS NULL THEN {list(lex.BYPASS_DOMAINS)} ELSE [domain] END AS domains FROM d WHERE bypass")
def bypass_defaults(t: Tables) -> DataFrame:
    """The plan of a question that follows up: simple, in the domain of the question before, or the usual three."""
    domain = F.lit(None).cast("string")
    for name, words in reversed(lex.DOMAINS):
        domain = F.when(contains_any(F.lower("before"), words), name).otherwise(domain)
    usual = F.array(*map(F.lit, lex.BYPASS_DOMAINS))
    rows = asked(t).filter(follows_up(F.col("x"), F.col("answered"))).withColumn("domain", domain)
    return rows.select("id", F.lit("simple").alias("complexity"), F.when(F.col("domain").isNull(), usual).otherwise(F.array("domain")).alias("domains"))


def topic_label(text: Column) -> tuple[Column, Column, Column]:
    """The first town and topic that a message names, and the note made of them, null without either."""
    found = lambda p: F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit(""))
    town, topic = found(lex.TOPIC_TOWNS), found(lex.TOPIC_WORDS)
    both = F.concat(F.lit("(Discussing "), town, F.lit(" "), topic, F.lit(")"))
    return town, topic, F.coalesce(both, F.concat(F.lit("(Topic: "), topic, F.lit(")")), F.concat(F.lit("(Town: "), town, F.lit(")")))


@query(f"""WITH u AS (SELECT 'c' || conv_id AS id, arg_max(text, turn) AS x FROM conversations WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT 'q' || id, x FROM ({Q} SELECT * FROM q)),
f AS (SELECT id, nullif(regexp_extract(lower(x), '{lex.TOPIC_TOWNS}', 1), '') AS town, nullif(regexp_extract(lower(x), '{lex.TOPIC_WORDS}', 1), '') AS topic FROM u)
SELECT *, CASE WHEN town IS NOT NULL AND topic IS NOT NULL THEN '(Discussing ' || town || ' ' || topic || ')' WHEN topic IS NOT NULL THEN '(Topic: ' || topic || ')' WHEN town IS NOT NULL THEN '(Town: ' || town || ')' END AS label FROM f""")
def topic_tag(t: Tables) -> DataFrame:
    """Of the last user message of each conversation, and of the literal questions."""
    last = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("x"))
    rows = last.select(F.concat(F.lit("c"), "conv_id").alias("id"), "x").unionByName(questions(t).select(F.concat(F.lit("q"), "id").alias("id"), "x"))
    town, topic, label = topic_label(F.col("x"))
    return rows.select("id", town.alias("town"), topic.alias("topic"), label.alias("label"))


def ocr_facts(text: Column) -> Column:
    """Words, mean length, share of known words and of blanks, and whether the text is likely garbage.

    The share of known words counts all of them over at most a hundred.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    known = lambda w: F.size(F.filter(w, lambda x: x.isin(*[c for c in lex.COMMON_WORDS if len(c) > 1])))
    counts = F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("letters"), known(w).alias("known")),
    )[0]
    short = F.length(text) < 50
    blanks = F.regexp_count(text, F.lit(r"\s")) / F.length(text)

    def judged(c: Column) -> Column:
        mean, share = F.try_divide(c["letters"], c["n"]), F.try_divide(c["known"], F.least(c["n"], F.lit(100)))
        garbage = (mean < 2) | (mean > 15) | (share < 0.08) | ~((blanks > 0.1) & (blanks < 0.3))
        few = short | (c["n"] < 10)
        return F.struct(F.when(short, 0).otherwise(c["n"]).alias("words"), F.when(few, 0.0).otherwise(F.round(share, 4)).alias("share"), (few | garbage).alias("garbage"))

    return F.transform(F.array(counts), judged)[0]


KNOWN_SQL = "[" + ", ".join(map(quoted, dict.fromkeys(lex.COMMON_WORDS))) + "]"
OCR_SQL = f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM documents),
c AS (SELECT doc_id, length(text) AS chars, len(w) AS n, length(array_to_string(w, '')) AS letters, len(list_filter(w, lambda x: list_contains({KNOWN_SQL}, x))) AS known, len(regexp_extract_all(text, '\\s')) / length(text) AS blanks FROM w),
f AS (SELECT *, chars < 50 OR n < 10 AS few FROM c),
o AS (SELECT doc_id, chars, CASE WHEN chars < 50 THEN 0 ELSE n END AS words, CASE WHEN few THEN 0 ELSE round(known / least(n, 100), 4) END::DOUBLE AS share,
  few OR letters / n < 2 OR letters / n > 15 OR known / least(n, 100) < 0.08 OR NOT (blanks > 0.1 AND blanks < 0.3) AS garbage FROM f)"""


@query(f"{OCR_SQL} SELECT doc_id, words, share, garbage FROM o")
def ocr_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ocr_facts(F.col("text")).alias("f")).select("doc_id", "f.*")


def needs_ocr(pdf: Column, chars: Column, garbage: Column, least_chars: int = 1200) -> Column:
    return F.when(~pdf, False).when(chars < 100, True).when(~garbage & (chars >= 500), False).when(garbage & (chars >= least_chars), True).when(~garbage & (chars >= least_chars), False).otherwise(True)


DECISION_SQL = "CASE WHEN doc_id % 4 = 0 THEN false WHEN chars < 100 THEN true WHEN NOT garbage AND chars >= 500 THEN false ELSE true END"


@query(f"{OCR_SQL} SELECT doc_id, {DECISION_SQL} AS queue FROM o")
def ocr_decision(t: Tables) -> DataFrame:
    """Every fourth document stands for a file that is no PDF."""
    facts = t.documents.select("doc_id", F.length("text").alias("chars"), ocr_facts(F.col("text")).alias("f"))
    return facts.select("doc_id", needs_ocr(F.col("doc_id") % 4 != 0, F.col("chars"), F.col("f.garbage")).alias("queue"))


@query(f"{OCR_SQL} SELECT doc_id, CASE WHEN NOT ({DECISION_SQL}) THEN 'none' WHEN doc_id % 2 = 0 THEN 'queued' ELSE 'blocked' END AS status FROM o")
def ocr_initial_status(t: Tables) -> DataFrame:
    enabled = F.col("doc_id") % 2 == 0
    return ocr_decision(t).select("doc_id", F.when(~F.col("queue"), "none").when(enabled, "queued").otherwise("blocked").alias("status"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 20) + 1, 180)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST((i - 1) / 180 AS INT) AS chunk, array_to_string(w[i:i + 199], ' ') AS content FROM s""")
def chunk_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(whitespace_chunks(F.col("text"))).alias("chunk", "content"))


PARAGRAPHS = "len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: length(trim(p)) > 50))"


@query(f"SELECT conv_id, turn, length(text) >= 800 OR {PARAGRAPHS} >= 4 OR (length(text) > 400 AND ({any_pattern_sql(lex.BYLINE, 'text')} OR {pattern_hits_sql(lex.MINUTES, 'text')} >= 2)) AS pasted FROM conversations")
def paste_detect(t: Tables) -> DataFrame:
    text, long = F.col("text"), F.length("text") > 400
    paragraphs = F.size(F.filter(F.split("text", r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 50))
    marked = any_pattern(text, lex.BYLINE) | (pattern_hits(text, ci(lex.MINUTES)) >= 2)
    return t.conversations.select("conv_id", "turn", ((F.length("text") >= 800) | (paragraphs >= 4) | (long & marked)).alias("pasted"))


@query(f"{Q} SELECT id, CASE WHEN {pattern_hits_sql(lex.MINUTES)} >= 3 THEN 'minutes' WHEN {pattern_hits_sql(lex.BYLINE)} >= 2 THEN 'article' WHEN regexp_matches(x, '^(#|\\*|-|\\d+\\.)\\s') OR contains(x, 'WHEREAS') OR contains(x, 'RESOLVED') THEN 'document' ELSE 'paste' END AS kind FROM q")
def paste_type(t: Tables) -> DataFrame:
    return questions(t).select("id", kind_of(F.col("x")).alias("kind"))


def kind_of(x: Column) -> Column:
    document = x.rlike(r"^(#|\*|-|\d+\.)\s") | contains_any(x, ("WHEREAS", "RESOLVED"))
    return F.when(pattern_hits(x, ci(lex.MINUTES)) >= 3, "minutes").when(pattern_hits(x, ci(lex.BYLINE)) >= 2, "article").when(document, "document").otherwise("paste")


KIND_SQL = f"CASE WHEN {pattern_hits_sql(lex.MINUTES)} >= 3 THEN 'minutes' WHEN {pattern_hits_sql(lex.BYLINE)} >= 2 THEN 'article' WHEN regexp_matches(x, '^(#|\\*|-|\\d+\\.)\\s') OR contains(x, 'WHEREAS') OR contains(x, 'RESOLVED') THEN 'document' ELSE 'paste' END"
MONTH_DAY = r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s*\d{4}"
FIRST_LINE = r"(?m)^(.{10,80}?)(?:\n|$)"
PASTED = ("x\nMinutes of the board\nMotion by Ms. Lee, Seconded. Present: all. Held on March 5, 2024.", "Hi\nUpdated Jan 5 by the paper\nmore", "A good first line\nand a second", "abc", "\n \n", "y" * 120 + "\nBy Ann Lee, Published 3/4/24\n")


@query(f"""WITH q AS (SELECT conv_id || '/' || turn AS id, text AS x FROM conversations UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(f'text {i}')}, {quoted(x)})" for i, x in enumerate(PASTED))}) AS v(id, x)),
k AS (SELECT id, x, {KIND_SQL} AS kind, trim(list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '')[1]) AS line FROM q)
SELECT id, CASE WHEN length(line) BETWEEN 6 AND 99 THEN substr(line, 1, 80) WHEN line IS NULL THEN NULL WHEN kind = 'article' AND regexp_matches(x, {quoted(FIRST_LINE)}) THEN trim(regexp_extract(x, {quoted(FIRST_LINE)}, 1))
  WHEN kind = 'minutes' AND regexp_matches(x, {quoted('(?i)' + MONTH_DAY)}) THEN 'Meeting ' || regexp_extract(x, {quoted('(?i)' + MONTH_DAY)}, 0) END AS title FROM k""")
def paste_title(t: Tables) -> DataFrame:
    """The first line with text, if 6 to 99 characters long, cut to 80; else an article's first line of 10 to 80
    characters, or the day of a meeting; else none."""
    said = t.conversations.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("x"))
    rows = said.union(t.rows("id string, x string", *[(f"text {i}", x) for i, x in enumerate(PASTED)]))
    x, first = F.col("x"), F.trim(F.get(F.filter(F.split("x", "\n"), lambda y: F.trim(y) != ""), F.lit(0)))
    article = F.when(x.rlike(FIRST_LINE), F.trim(F.regexp_extract(x, FIRST_LINE, 1)))
    minutes = F.when(x.rlike(f"(?i){MONTH_DAY}"), F.concat(F.lit("Meeting "), F.regexp_extract(x, f"(?i){MONTH_DAY}", 0)))
    by_kind = F.when(kind_of(x) == "article", article).when(kind_of(x) == "minutes", minutes)
    return rows.select("id", F.when(F.length(first).between(6, 99), F.substring(first, 1, 80)).when(first.isNotNull(), by_kind).alias("title"))


REPLIED_SQL = rf"""WITH w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
a AS (SELECT conv_id || '/' || turn AS id, coalesce(text, '') AS x, coalesce(question, '') AS question FROM w WHERE role = 'assistant'
  UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(f'text {i}')}, {quoted(x)}, {quoted(lex.QUESTIONS[i])})" for i, x in enumerate(lex.ANSWERS))}) AS v(id, x, question)),
k AS (SELECT id, x, {TYPE_SQL.replace("output = 'risk'", "false").replace("output = 'explain'", "false").replace("(x", "(question")} AS kind FROM a),
p(kind, least, most) AS (VALUES {', '.join(map(str, lex.PROSE_WORDS))}),
n AS (SELECT id, x, kind, least, most, len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) AS words,
  regexp_matches(x, '(?m)^#+\s+') OR regexp_matches(x, '(?m)^\*\*[^*]+\*\*\s*$') OR regexp_matches(x, '(?im)^\*\*(?:Bottom line|What we know|What the law|Unknowns|What changes)') AS headings, regexp_matches(x, '(?m)^\s*[-•*]\s+') AS bullets,
  list_filter([{', '.join(f"lower(regexp_extract(x, {quoted('(?i)' + p)}, 0))" for p in lex.TAILS)}], lambda e: e <> '') AS tails, list_filter([{', '.join(map(quoted, lex.FORBIDDEN_PROSE))}], lambda w: contains(lower(x), lower(w))) AS phrases FROM k JOIN p USING (kind)),
v AS (SELECT *, list_concat(CASE WHEN words < least THEN ['too short'] ELSE [] END, CASE WHEN words > most * 1.2 THEN ['too long'] ELSE [] END, CASE WHEN headings THEN ['headings'] ELSE [] END, CASE WHEN bullets THEN ['bullets'] ELSE [] END,
  CASE WHEN len(tails) > 0 THEN ['tails'] ELSE [] END, list_transform(phrases, lambda w: 'phrase: ' || w)) AS violations FROM n)"""


def replies(t: Tables) -> DataFrame:
    """Every assistant turn with the user turn that it answers, which gives its kind; no question is an empty one."""
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    question = F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(earlier), F.lit(""))
    said = t.conversations.select("conv_id", "turn", "role", "text", question.alias("question")).filter("role = 'assistant'")
    rows = [(f"text {i}", x, lex.QUESTIONS[i]) for i, x in enumerate(lex.ANSWERS)]
    return said.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("x"), "question").union(t.rows("id string, x string, question string", *rows))


def audited_prose(rows: DataFrame) -> DataFrame:
    """(id, x, question) with the kind of answer, its words, closing phrases and violations in their order.

    Too many words by a fifth is an error; everything else is a warning.
    """
    x, kind = F.col("x"), type_of_answer(F.col("question"), F.lit("process"))
    least, most = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, a, b in lex.PROSE_WORDS:
        least, most = F.when(F.col("kind") == name, a).otherwise(least), F.when(F.col("kind") == name, b).otherwise(most)
    headings = x.rlike(r"(?m)^#+\s+") | x.rlike(r"(?m)^\*\*[^*]+\*\*\s*$") | x.rlike(r"(?im)^\*\*(?:Bottom line|What we know|What the law|Unknowns|What changes)")
    tails = F.filter(F.array(*[F.lower(F.regexp_extract(x, f"(?i){p}", 0)) for p in lex.TAILS]), lambda e: e != "")
    low = F.lower(x)
    phrases = F.filter(F.array(*map(F.lit, lex.FORBIDDEN_PROSE)), lambda w: low.contains(F.lower(w)))
    facts = rows.withColumn("kind", kind).withColumns({"words": F.size(F.filter(F.split("x", r"\s+"), lambda w: w != "")), "tails": tails})
    rules = [(F.col("words") < least, "too short"), (F.col("words") > most * 1.2, "too long"), (headings, "headings"), (x.rlike(r"(?m)^\s*[-•*]\s+"), "bullets"), (F.size("tails") > 0, "tails")]
    broken = F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))
    return facts.withColumn("violations", F.concat(broken, F.transform(phrases, lambda w: F.concat(F.lit("phrase: "), w))))


@query(rf"{REPLIED_SQL} SELECT id, kind, words, tails, violations, len(violations) = 0 AS passed, len(regexp_extract_all(x, '\[S\d+\]')) AS state_citations FROM v")
def prose_audit(t: Tables) -> DataFrame:
    rows = audited_prose(replies(t))
    return rows.select("id", "kind", "words", "tails", "violations", (F.size("violations") == 0).alias("passed"), F.regexp_count("x", F.lit(r"\[S\d+\]")).alias("state_citations"))


ANSWERED = f"""WITH s AS (SELECT 'c' || conv_id || '.' || turn AS id, text AS x, '' AS state FROM conversations WHERE role = 'assistant' UNION ALL SELECT 'a' || id, x, '' FROM ({A} SELECT * FROM a) UNION ALL SELECT 'two', 'Under rsa 674:33 and RSA 675:2 the board may act, and RSA 91-A asks that records be open to all [S2].', 'The text of 675:2 is as follows')"""


def uncited_sql(source: str) -> str:
    return rf"""WITH m AS (SELECT *, regexp_split_to_array(x, '{lex.STATUTE}') AS gaps, regexp_extract_all(x, '{lex.STATUTE}') AS said FROM {source}),
e AS (SELECT id, x, state, i, said[i + 1] AS mention, length(array_to_string(gaps[1:i + 1], '')) + length(array_to_string(said[1:i], '')) AS place_at FROM (SELECT *, unnest(range(len(said))) AS i FROM m)),
n AS (SELECT *, regexp_replace(mention, '(?i)^rsa\s+', '') AS statute FROM e),
w AS (SELECT *, greatest(place_at - 20, 0) AS a, least(place_at + 34 + length(statute), length(x)) AS z FROM n)
SELECT id, CAST(i AS INTEGER) AS place, statute, trim(x[a + 1:z]) AS around, NOT regexp_matches(x[a + 1:z], '\[S\d+\]') AND NOT contains(lower(state), lower(statute)) AS uncited FROM w"""


def uncited_statutes(rows: DataFrame) -> DataFrame:
    """Each statute that an answer of rows (id, x, state) names, and whether neither a state citation stands from
    20 characters before it to 30 after, nor the state passages name it.  Mentions are found first; each window
    is cut from the whole answer by position, so mentions close together each have their own."""
    gaps, said = F.split("x", lex.STATUTE, -1), F.regexp_extract_all("x", F.lit(lex.STATUTE), F.lit(0))
    cut = rows.filter(F.col("x").rlike(lex.STATUTE)).select("id", "x", "state", gaps.alias("gaps"), said.alias("said"))
    each = cut.select("id", "x", "state", "gaps", "said", F.posexplode("said").alias("place", "mention"))
    at = F.length(F.array_join(F.slice("gaps", 1, F.col("place") + 1), "")) + F.length(F.array_join(F.slice("said", F.lit(1), F.col("place")), ""))
    found = each.select("id", "x", "state", "place", F.regexp_replace("mention", r"(?i)^rsa\s+", "").alias("statute"), at.alias("at"))
    begin, end = F.greatest(F.col("at") - 20, F.lit(0)), F.least(F.col("at") + 34 + F.length("statute"), F.length("x"))
    around = F.col("x").substr(begin + 1, end - begin)
    uncited = ~around.rlike(r"\[S\d+\]") & ~F.lower("state").contains(F.lower("statute"))
    return found.select("id", "place", "statute", F.trim(around).alias("around"), uncited.alias("uncited"))


@query(f"{ANSWERED} SELECT * FROM ({uncited_sql('s')})")
def uncited_statute(t: Tables) -> DataFrame:
    turns = t.conversations.filter("role = 'assistant'").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.col("text").alias("x"), F.lit("").alias("state"))
    two = t.spark.createDataFrame([("two", "Under rsa 674:33 and RSA 675:2 the board may act, and RSA 91-A asks that records be open to all [S2].", "The text of 675:2 is as follows")], "id string, x string, state string")
    return uncited_statutes(turns.unionByName(answers(t).select(F.concat(F.lit("a"), "id").alias("id"), "x", F.lit("").alias("state"))).unionByName(two))


@query(f"{A} SELECT id, list_filter([{', '.join(map(quoted, lex.OFF_TOPIC))}], lambda w: contains(lower(x), lower(w))) AS anchors FROM a")
def off_topic_anchor(t: Tables) -> DataFrame:
    low = F.lower("x")
    return answers(t).select("id", F.filter(F.array(*[F.lit(w) for w in lex.OFF_TOPIC]), lambda w: low.contains(F.lower(w))).alias("anchors"))


@query(f"{A} SELECT id, list_filter({list(lex.FORBIDDEN)}, lambda w: contains(lower(x), w)) AS found, list_filter([{', '.join(map(quoted, lex.FORBIDDEN_PROSE))}], lambda w: contains(lower(x), lower(w))) AS prose FROM a")
def forbidden_phrases(t: Tables) -> DataFrame:
    """What an answer must not say anywhere, and what one in prose should not say."""
    low = F.lower("x")
    said = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w)))
    return answers(t).select("id", said(lex.FORBIDDEN).alias("found"), said(lex.FORBIDDEN_PROSE).alias("prose"))


@query(f"""{REPLIED_SQL}, u AS (SELECT id, true AS uncited FROM ({uncited_sql("(SELECT id, x, '' AS state FROM a)")}) WHERE uncited GROUP BY 1)
SELECT id, list_contains(violations, 'too long') AS too_long, coalesce(uncited, false) AS uncited, list_contains(violations, 'too long') OR coalesce(uncited, false) AS repair FROM v LEFT JOIN u USING (id)""")
def repair_flag(t: Tables) -> DataFrame:
    """Any violation of error severity in an answer without state passages: far too long, or a statute that nothing cites."""
    rows = replies(t)
    uncited = uncited_statutes(rows.select("id", "x", F.lit("").alias("state"))).filter("uncited").select("id", "uncited").distinct()
    found = audited_prose(rows).join(uncited, "id", "left")
    too_long, missing = F.array_contains("violations", "too long"), F.coalesce("uncited", F.lit(False))
    return found.select("id", too_long.alias("too_long"), missing.alias("uncited"), (too_long | missing).alias("repair"))


@query(f"{A}, c AS (SELECT id, regexp_extract_all(x, '\\[((?:L|S)\\d+|USER)\\]', 1) AS c FROM a), i AS (SELECT id, unnest(c) AS tag, generate_subscripts(c, 1) AS k FROM c), f AS (SELECT id, tag, min(k) AS k FROM i GROUP BY ALL) SELECT a.id, coalesce((SELECT list(tag ORDER BY k) FROM f WHERE f.id = a.id), []) AS used FROM a")
def citations_used(t: Tables) -> DataFrame:
    return answers(t).select("id", F.array_distinct(F.regexp_extract_all("x", F.lit(r"\[((?:L|S)\d+|USER)\]"), F.lit(1))).alias("used"))


# Complexity, mode, least and most characters aimed at, hard cap.
POLICIES = (("simple", "standard", 450, 750, 950), ("simple", "deep", 900, 1400, 1700), ("complex", "standard", 1100, 1700, 1900), ("complex", "deep", 3200, 4800, 5400))


@query(f"WITH p(complexity, mode, low, high, cap) AS (VALUES {', '.join(map(str, POLICIES))}), d AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 2 = 0 THEN 'simple' ELSE 'complex' END AS complexity, CASE WHEN doc_id % 3 = 0 THEN 'deep' ELSE 'standard' END AS mode FROM documents) SELECT doc_id, n BETWEEN low AND high AS within_target, n * 100 > cap * 105 AS over_cap FROM d JOIN p USING (complexity, mode)")
def answer_policy(t: Tables) -> DataFrame:
    """Aims and caps by complexity and mode; a text is over its cap from five percent on."""
    policies = t.rows("complexity string, mode string, low int, high int, cap int", *POLICIES)
    asked = t.documents.select("doc_id", F.length("text").alias("n"), F.when(F.col("doc_id") % 2 == 0, "simple").otherwise("complex").alias("complexity"), F.when(F.col("doc_id") % 3 == 0, "deep").otherwise("standard").alias("mode"))
    return asked.join(F.broadcast(policies), ["complexity", "mode"]).select("doc_id", F.col("n").between(F.col("low"), F.col("high")).alias("within_target"), (F.col("n") * 100 > F.col("cap") * 105).alias("over_cap"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN 'override' END, CASE WHEN event_type = 'error' THEN 'escalated' END, 'default') AS model FROM events")
def model_for_stage(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.when(F.col("event_id") % 7 == 0, "override"), F.when(F.col("event_type") == "error", "escalated"), F.lit("default")).alias("model"))


@query(f"SELECT conv_id, turn, length(text) > 4000 OR {any_word_sql(lex.HIGH_RISK, 'lower(text)')} AS critic FROM conversations")
def critic_trigger(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", ((F.length("text") > 4000) | contains_any(F.lower("text"), lex.HIGH_RISK)).alias("critic"))


# What may end a text that is cut, the marks of a sentence's end aside.
BREAKS = r"\.\s+(?=[A-Z])|\.\s*$|[!?]\s+|\n\n|\n[-*]\s|\n\d+\.\s"
EDGES = r"^\s+|\s+$"


def whole_fences(x: Column) -> Column:
    """A code fence that the cut left open is closed if over 10 characters follow it, else taken out; so is a lone backtick."""
    tail = r"```(\w*)([^`]*)$"
    opened = (F.regexp_count(x, F.lit("```")) % 2 != 0) & x.rlike(tail)
    inside = F.regexp_replace(F.regexp_extract(x, tail, 2), EDGES, "")
    fenced = F.when(F.length(inside) > 10, F.concat(x, F.lit("\n```"))).otherwise(F.regexp_replace(F.regexp_replace(x, r"```\w*[^`]*$", ""), EDGES, ""))
    odd = F.regexp_count(x, F.lit("`")) % 2 != 0
    paired = x.rlike(r"`[^`]{0,98}`[^`]*$")
    return F.when(opened, fenced).when(odd & ~paired, F.regexp_replace(x, r"`([^`]*)$", "$1")).otherwise(x)


def capped(text: Column, cap: int) -> Column:
    """A text over the cap ends at its last sentence or, where that keeps under half, at its last word; then ``...``."""
    most = cap - 3
    head = F.substring(text, 1, most)
    tidy = lambda x: F.regexp_replace(x, EDGES, "")
    kept = lambda pattern: F.length(F.regexp_extract(head, pattern, 0))
    late = kept(r"(?s)^.*[.!?](?=[ \n]|$)")
    end = F.greatest(kept(rf"(?s)^.*(?:{BREAKS})"), F.when(late - 1 >= most * 0.5, late).otherwise(0))
    sentence = tidy(F.when(end > 1, F.substring(head, F.lit(1), end)).otherwise(head))
    word = F.length(F.regexp_extract(head, r"(?s)^(.*)[ \n]", 1))
    by_word = tidy(F.when(word > most * 0.5, F.substring(head, F.lit(1), word)).otherwise(head))
    cut = F.when(F.length(sentence) < most * 0.5, by_word).otherwise(sentence)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(whole_fences(cut), F.lit("...")))


@query()
def char_cap(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", capped(F.col("text"), 600).alias("text"))
