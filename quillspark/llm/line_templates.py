"""Line dedup by a log-template tree, in DataFrame expressions only.

A line runs down a tree of fixed depth: its token count, then its leading tokens, where tokens that
hold a digit, an ``@`` or ``://`` are variable fields, written ``*``.  What a line is in its leaf is its
template.  Templates of a leaf form groups by token similarity: a group is named after its earliest
template, and others join it that differ in at most a tenth of their tokens (one at least), which are
then fields.  Candidates are found by pigeonhole: tokens after the leading ones are cut into one run
more than may differ, so similar templates share a run.  Most join the earliest template of a run; those
that do not are held against all earlier templates of their runs, which lie in blocks of bounded size.
A template met in several documents, or that joins a group of an earlier document, stays in the first
document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, stored, unused

# What a variable field holds, and how large a share of the tokens may differ (1 / TENTH).
FIELD = "[^ ]*(?:[0-9@]|://)[^ ]*"
TENTH = 10
TOKENS_A_BLOCK = 65536
LAST = (1 << 63) - 1


def then(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """rows with one more column, computed once: an expression over it is not merged into this one."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def tidy(lines: DataFrame, line: str, x: str) -> DataFrame:
    """lines with ``x``: the line with single blanks between its words, variable fields as ``*``.

    Lines without a word, or of fields alone, go: they hold nothing that a template could keep.
    """
    c, e = F.col(line), F.col("_even")
    uneven = c.contains("  ") | c.startswith(" ") | c.endswith(" ") | c.rlike("[\\t-\\r]")
    even = then(lines, F.when(uneven, F.trim(F.regexp_replace(c, "[ \\t-\\r]+", " "))).otherwise(c), "_even").drop(line)
    has_field = e.rlike("[0-9@]") | e.contains("://")
    return then(even, F.when(has_field, F.regexp_replace(e, FIELD, "*")).otherwise(e), x).drop("_even").filter(F.col(x).rlike("[^ *]|[*][*]"))


def may_differ(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / F.lit(TENTH)).cast("int"))


def line_templates(docs: DataFrame, lead: int) -> DataFrame:
    """_doc, _text, _at, leaf, key, check, n and x of every line that has a template."""
    lines = docs.select("_doc", "_text", F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
    n = (F.length("x") - F.length(F.replace("x", F.lit(" "), F.lit(""))) + 1).alias("n")
    return tidy(lines, "_line", "x").select("_doc", "_text", "_at", n, "x").select(
        "_doc", "_text", "_at", F.xxhash64("n", F.substring_index("x", " ", lead)).alias("leaf"), F.xxhash64("x").alias("key"), F.hash("x").alias("check"), "n", "x"
    )


def joined_groups(lines: DataFrame, lead: int) -> DataFrame:
    """key, check, _first and n of templates that join a group of an earlier document.

    Leaves with one template have nothing to merge and are left out first.  Ties between templates
    of one document go to the smaller MD5.
    """
    contested = lines.groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select(F.col("leaf").alias("contested"), "n")
    order = F.conv(F.substring(F.md5("x"), 1, 15), 16, 10).cast("long").alias("id")
    there = join_hot(lines.select("_doc", F.col("leaf").alias("contested"), "key", "check", F.col("n").alias("size"), "x"), contested, ["contested"], "inner", shuffled=True)
    several = there.select("_doc", F.col("contested").alias("leaf"), "key", "check", F.col("size").alias("n"), "x").groupBy("leaf", "key", "check", "n").agg(F.min("_doc").alias("first"), F.count(F.lit(1)).alias("times"), F.min("x").alias("x"))
    templates = stored(several.select("leaf", "key", "check", "n", "first", "times", order, F.split("x", " ").alias("tokens")), "leaf-templates")
    spare, tail = may_differ(F.col("n")), F.greatest(F.col("n") - lead, F.lit(0))
    cut = lambda k: F.floor(k * tail / (spare + 1)).cast("int")
    run = lambda k: F.xxhash64(k, F.slice("tokens", lead + 1 + cut(k), cut(k + 1) - cut(k)))
    runs = templates.select("leaf", "id", "first", F.explode(F.transform(F.sequence(F.lit(0), spare), run)).alias("run"))
    earliest = stored(runs.groupBy("leaf", "run").agg(F.min(F.struct("first", "id")).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaf-runs")
    met = join_hot(runs, earliest, ["leaf", "run"], "inner").filter("e.first < first").select("leaf", "id", F.col("e.id").alias("group")).distinct()
    named = templates.select("leaf", F.col("id").alias("group"), F.col("tokens").alias("named"), F.col("first").alias("_first"))
    both = met.join(templates, ["leaf", "id"]).join(named, ["leaf", "group"]).filter(alike(F.col("tokens"), F.col("named"), F.col("n")))
    joined = stored(both.groupBy("leaf", "id").agg(F.min("_first").alias("_first")), "leaf-groups")
    alone = join_hot(runs, earliest.filter("n > 2"), ["leaf", "run"], "inner").filter("e.first < first").join(joined, ["leaf", "id"], "left_anti")
    late = late_joiners(stored(alone.select("leaf", "run", "id", "first"), "leaf-alone"), runs, templates)
    return joined.unionByName(late).join(templates, ["leaf", "id"]).groupBy("key", "check").agg(F.min("_first").alias("_first"), F.max("times").alias("n"))


def alike(tokens: Column, others: Column, n: Column) -> Column:
    """Whether two arrays of n tokens differ in no more of them than may."""
    return F.size(F.filter(F.arrays_zip(tokens.alias("a"), others.alias("b")), lambda p: p["a"] == p["b"])) >= n - may_differ(n)


def late_joiners(alone: DataFrame, runs: DataFrame, templates: DataFrame) -> DataFrame:
    """leaf, id and _first of templates of ``alone`` (leaf, run, id, first) that join one of their runs.

    The earlier templates of a run with such a one are laid in blocks of about TOKENS_A_BLOCK tokens, and
    each template of alone meets the blocks of its runs: a row a block, none for a pair.
    """
    asked = stored(alone.groupBy("leaf", "run").agg(F.max("first").alias("latest")), "leaf-asked")
    there = runs.join(asked, ["leaf", "run"]).filter("first < latest")
    counted = there.groupBy("leaf", "run").agg(F.count(F.lit(1)).alias("n"))
    words = templates.select("leaf", "id", F.col("n").alias("size"), "tokens")
    held = join_hot(there.select("leaf", "run", "id", "first"), counted.select("leaf", "run", "n", F.col("n").alias("members")), ["leaf", "run"], "inner").join(words, ["leaf", "id"])
    blocks = F.ceil(F.col("members") * F.col("size") / F.lit(TOKENS_A_BLOCK)).cast("int")
    laid = held.withColumn("block", F.pmod("id", blocks).cast("int")).groupBy("leaf", "run", "block").agg(F.collect_list(F.struct("first", "tokens")).alias("held"))
    seek = alone.join(counted.select("leaf", "run", F.col("n").alias("members")), ["leaf", "run"]).join(words, ["leaf", "id"])
    seek = seek.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    earlier = F.filter("held", lambda h: (h["first"] < F.col("first")) & alike(F.col("tokens"), h["tokens"], F.col("size")))
    found = seek.join(laid, ["leaf", "run", "block"]).select("leaf", "id", F.array_min(F.transform(earlier, lambda h: h["first"])).alias("_first"))
    return found.filter("_first IS NOT NULL").groupBy("leaf", "id").agg(F.min("_first").alias("_first"))


def drop_recurring_lines(docs: DataFrame, lead: int = 3) -> DataFrame:
    """The rows of ``docs`` with recurring lines taken out of ``text``, and n_lines and n_dropped.

    A line goes when its template, or the template of the group that it joins, is also met in a
    document of smaller doc_id; lines of that first document stay, repeats inside it included.  Blank
    lines and lines of fields alone stay.  Rows that share a doc_id count as one document; null doc_ids
    count as one document that comes last.  A null text stays null with no lines; every row stays, if
    need be with an empty text; an empty table gives none.  Columns named n_lines or n_dropped in the
    input are replaced; any other column passes through.
    """
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    name = unused(docs.columns)
    who, what = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("text")
    lines = stored(line_templates(docs.filter("text IS NOT NULL").select(who.alias("_doc"), what.alias("_text"), "text"), lead), "line-templates")
    met = lines.groupBy("key", "check").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.count(F.lit(1)).alias("n"))
    exact = met.filter("_first < _last").select("key", "check", "_first", "n")
    first = exact.unionByName(joined_groups(lines, lead)).groupBy("key", "check").agg(F.min("_first").alias("_first"), F.max("n").alias("n"))
    repeats = join_hot(lines.select("_doc", "_text", "_at", "key", "check"), first, ["key", "check"], "inner").filter("_doc > _first")
    dropped = repeats.groupBy(F.col("_doc").alias(name("doc")), F.col("_text").alias(name("hash"))).agg(F.collect_set("_at").alias(name("drop")))
    drop = F.col(name("drop"))

    def without(rows: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), drop)
        return F.array_join(F.transform(stays, lambda i: F.get(rows, i)), "\n")

    marked = docs.select(*[F.col(f"`{c}`") for c in others], who.alias(name("doc")), what.alias(name("hash"))).join(dropped, [name("doc"), name("hash")], "left")
    text = F.when(drop.isNull(), F.col("text")).otherwise(without(F.split("text", "\n")))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in others]
    return marked.select(*kept, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))


ORACLE = f"""WITH l AS (SELECT doc_id, text, coalesce(doc_id, {LAST}) AS d, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g'), ' ') AS even FROM l),
m AS (SELECT d, text, pos, regexp_replace(even, '[^ ]*(?:[0-9@]|://)[^ ]*', '*', 'g') AS x FROM e),
k AS (SELECT d, text, pos, x, string_split(x, ' ') AS w FROM m WHERE regexp_matches(x, '[^ *]|[*][*]')),
t AS (SELECT x, w, len(w) AS n, array_to_string(w[1:3], ' ') AS head, greatest(1, len(w) // {TENTH}) AS f, min(d) AS first, max(d) AS last FROM k GROUP BY ALL),
r AS (SELECT *, w[4 + (i * greatest(n - 3, 0)) // (f + 1):3 + ((i + 1) * greatest(n - 3, 0)) // (f + 1)] AS run FROM (SELECT *, unnest(range(f + 1)) AS i FROM t)),
a AS (SELECT r.x, g.first FROM r JOIN r g ON r.n = g.n AND r.head = g.head AND r.i = g.i AND r.run = g.run AND g.first < r.first WHERE len(list_filter(list_zip(r.w, g.w), lambda p: p[1] = p[2])) >= r.n - r.f
  UNION ALL SELECT x, first FROM t WHERE first < last),
f AS (SELECT x, min(first) AS first FROM a GROUP BY x),
z AS (SELECT DISTINCT d, text, pos FROM k JOIN f USING (x) WHERE d > first),
s AS (SELECT d, text, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS clean, count(*) FILTER (WHERE gone) AS n_dropped
  FROM (SELECT l.*, z.pos IS NOT NULL AS gone FROM (SELECT DISTINCT d, text, line, pos FROM l) l LEFT JOIN z ON l.d = z.d AND l.text = z.text AND l.pos = z.pos) GROUP BY d, text)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(s.clean, '') END AS text, CASE WHEN o.text IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END AS n_lines, CAST(coalesce(s.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents o LEFT JOIN s ON coalesce(o.doc_id, {LAST}) = s.d AND o.text = s.text"""
