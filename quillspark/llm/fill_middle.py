"""Fill-in-middle transformation in Spark SQL functions only.

A text is cut into an array of units; words of its SHA-256 key choose two cuts and the arrangement;
slices of the array, joined again, are the three pieces between sentinels.  Splitting the output at its
sentinels gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

# The sentinels, the unit (a code point), and the forms of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s)."
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits (from 0) as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of; null where either is null."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    piece = lambda k: F.get(pieces, F.lit(k))
    by_form = F.when(form == PSM, F.concat(piece(1), piece(3), piece(2))).when(form == SPM, F.concat(piece(2), piece(3), piece(1)))
    return F.when(form == PLAIN, output).otherwise(by_form)


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = CODE_POINT, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """The rows of ``docs`` with n, form, prefix_chars, middle_chars and output.

    ``unit`` is a pattern whose matches, left to right, are the units between which a text may be cut;
    n counts them, and together they must cover the text.  ``percent`` of the texts are transformed, of
    which ``spm_percent`` put the suffix first; the rest, empty texts and texts that hold a sentinel are
    plain: the output is the text, and the piece lengths (in code points) are null.  The draws depend on
    ``seed`` and doc_id alone, so rows of one doc_id share them; a null doc_id is drawn as an empty
    string.  A null text is an empty one.  A very long text is one array of its units, as large as its
    task's memory must hold.  Every row stays, repeats included; an empty table gives none.  Input
    columns of the five names are replaced, in any case of letters; others pass through.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    name = unused([*docs.columns, *made])
    text, units, digest, a, b = (F.col(name(x)) for x in ("text", "units", "digest", "a", "b"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(*others, F.coalesce("text", F.lit("")).alias(name("text")), F.sha2(key, 256).alias(name("digest")))
    rows = rows.withColumn(name("units"), F.regexp_extract_all(text, F.lit(unit), F.lit(0))).withColumn("n", F.size(units).cast("long"))
    one, two = (draw(digest, k) % (F.col("n") + 1) for k in (0, 1))
    has_sentinel = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((F.col("n") == 0) | has_sentinel | (draw(digest, 2) % 100 >= percent), PLAIN).when(draw(digest, 3) % 100 < spm_percent, SPM).otherwise(PSM)
    rows = rows.withColumns({"form": form, name("a"): F.least(one, two).cast("int"), name("b"): F.greatest(one, two).cast("int")})
    piece = lambda at, n: F.when(F.col("form") != PLAIN, F.array_join(F.slice(units, at + 1, n), ""))
    prefix, middle, suffix = (name(x) for x in ("prefix", "middle", "suffix"))
    rows = rows.withColumns({prefix: piece(F.lit(0), a), middle: piece(a, b - a), suffix: piece(b, F.col("n").cast("int") - b)})
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(text)
    return rows.select(*others, "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
