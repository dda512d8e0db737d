"""Set operations over rows and over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered
from quillspark.registry import query
from quillspark.sources.tables import Tables


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS pos FROM documents WHERE lang IN ('en', 'fr')")
def union_ordered(t: Tables) -> DataFrame:
    """The state lane first, then the local one; the place is a column."""
    lane = lambda lang, k: t.documents.filter(F.col("lang") == lang).select("doc_id", "source", F.lit(k).alias("lane"))
    return numbered(lane("fr", 0).unionByName(lane("en", 1)), ["source"], ["lane", "doc_id"], "pos").drop("lane")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000 END AS pos FROM documents")
def union_passes(t: Tables) -> DataFrame:
    first = t.documents.filter("doc_id % 2 = 0").select("doc_id", F.col("doc_id").alias("pos"))
    second = t.documents.filter("doc_id % 2 <> 0").select("doc_id", (F.col("doc_id") + 1_000_000).alias("pos"))
    return first.unionByName(second)


NAME = r"[A-ZÀ-Þ][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*)*"
LEAD_SQL, BODY_SQL = "coalesce(string_split(text, chr(10))[1], '')", "substr(text, length(string_split(text, chr(10))[1]) + 2)"
NAMES_SQL = f"""WITH n AS (SELECT doc_id, text, regexp_extract_all({LEAD_SQL}, '{NAME.replace("'", "''")}') AS lead, regexp_extract_all({BODY_SQL}, '{NAME.replace("'", "''")}') AS body FROM documents WHERE text IS NOT NULL)"""


def names(x: Column) -> Column:
    """Capitalised words that stand together, wherever in the text they do."""
    return F.regexp_extract_all(x, F.lit(NAME), F.lit(0))


def named(t: Tables) -> DataFrame:
    """lead, the names of a text's first line, and body, those of all that follows; null texts have no row."""
    first = F.get(F.split("text", "\n", 2), F.lit(0))
    rest = F.coalesce(F.get(F.split("text", "\n", 2), F.lit(1)), F.lit(""))
    return t.documents.filter("text IS NOT NULL").select("doc_id", "text", names(first).alias("lead"), names(rest).alias("body"))


@query(f"{NAMES_SQL}, i AS (SELECT doc_id, unnest(list_concat(lead, body)) AS x, generate_subscripts(list_concat(lead, body), 1) AS k FROM n), f AS (SELECT doc_id, x, min(k) AS k FROM i GROUP BY ALL), g AS (SELECT doc_id, list(x ORDER BY k)[1:10] AS names FROM f GROUP BY 1) SELECT n.doc_id, coalesce(names, []) AS names FROM n LEFT JOIN g USING (doc_id)")
def distinct_preserve_order(t: Tables) -> DataFrame:
    """The first ten distinct names of a whole text."""
    return named(t).select("doc_id", F.slice(F.array_distinct(F.concat("lead", "body")), 1, 10).alias("names"))


@query(f"{NAMES_SQL} SELECT doc_id, list_sort(list_distinct(list_filter(body, lambda e: NOT list_contains(list_transform(lead, lambda x: lower(x)), lower(e))))) AS fresh FROM n")
def set_difference_entities(t: Tables) -> DataFrame:
    """Names of the body that the first line lacks, whatever their case."""
    known = F.transform("lead", F.lower)
    return named(t).select("doc_id", F.sort_array(F.filter(F.array_distinct("body"), lambda e: ~F.array_contains(known, F.lower(e)))).alias("fresh"))


@query(f"{NAMES_SQL} SELECT doc_id, list_sort(list_distinct(list_filter(body, lambda e: len(list_filter(lead, lambda x: contains(lower(x), lower(e)) OR contains(lower(e), lower(x)))) > 0))) AS shared FROM n")
def overlap_entities(t: Tables) -> DataFrame:
    """Distinct names of the body that hold a name of the first line, or are held by one.

    A body's name is looked for in all the lead's names at once, joined by a mark that no name has.
    """
    held = F.array_join(F.transform("lead", F.lower), "\n")
    low = F.array_distinct(F.transform("lead", F.lower))
    fits = lambda e: F.instr(held, F.lower(e)).cast("boolean") | F.exists(low, lambda x: F.lower(e).contains(x))
    return named(t).select("doc_id", F.sort_array(F.filter(F.array_distinct("body"), fits)).alias("shared"))


@query(f"{NAMES_SQL} SELECT doc_id, list_sort(list_distinct(list_concat(lead, body))) AS entities FROM n")
def union_entities(t: Tables) -> DataFrame:
    return named(t).select("doc_id", F.sort_array(F.array_union("lead", "body")).alias("entities"))


@query(f"{NAMES_SQL} SELECT DISTINCT unnest(list_concat(lead, body)) AS name FROM n")
def flatmap_distinct_names(t: Tables) -> DataFrame:
    """Every name of every text once; texts drop their own repeats before the shuffle."""
    return named(t).select(F.explode(F.array_union("lead", "body")).alias("name")).distinct()
