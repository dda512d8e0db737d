"""Metadata of a file from its key and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import first_match

# Formal names and the substrings that name them; the first that occurs decides.
BOARDS = (
    ("Board of Selectmen", ("selectmen", "bos", "select board")),
    ("Planning Board", ("planning",)),
    ("Zoning Board", ("zoning", "zba")),
    ("School Board", ("school board", "school dist")),
    ("Budget Committee", ("budget comm", "budget cmte")),
    ("Conservation Commission", ("conservation",)),
    ("Library Trustees", ("library",)),
    ("Trustees of Trust Funds", ("trustee of trust", "trustees of trust")),
    ("Fire Precinct", ("fire precinct", "fire comm")),
)
CATEGORIES = (
    ("minutes", ("minute", "min_")),
    ("agendas", ("agenda",)),
    ("financials", ("budget", "expenditure", "revenue")),
    ("reports", ("report", "audit")),
    ("ordinances", ("ordinance", "regulation", "policy")),
    ("permits", ("permit", "application")),
    ("warrants", ("warrant",)),
    ("tax_records", ("tax",)),
)
UPLOAD_CATEGORIES = (
    ("budget", ("budget",)),
    ("zoning", ("zoning",)),
    ("meeting_minutes", ("minutes", "meeting")),
    ("town_report", ("town report", "annual report")),
    ("warrant_article", ("warrant",)),
    ("ordinance", ("ordinance",)),
    ("policy", ("policy", "policies")),
    ("planning_board_docs", ("planning board", "planning")),
    ("zba_docs", ("zba", "zoning board")),
    ("licensing_permits", ("license", "permit")),
    ("cip", ("cip", "capital improvement")),
    ("elections", ("election", "ballot", "vote")),
)
UPLOAD_BOARDS = (
    ("Planning Board", ("planning board",)),
    ("School Board", ("school board",)),
    ("Select Board", ("select board", "selectboard")),
    ("Zoning Board of Adjustment", ("zoning board", "zba")),
    ("Conservation Commission", ("conservation",)),
    ("Board of Selectmen", ("bos", "selectmen")),
    ("Budget Committee", ("budget committee",)),
)
STRUCTURED = ("minutes", "agendas", "budgets")
DATE = r"(\d{1,2}[-_]\d{1,2}[-_]\d{2,4}|\d{4}[-_]\d{1,2}[-_]\d{1,2})"
MIME = (("pdf", "application/pdf"), ("txt", "text/plain"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("doc", "application/msword"), ("png", "image/png"), ("jpg", "image/jpeg"))


def board_of(name: Column) -> Column:
    return first_match(F.translate(F.lower(name), "_-", "  "), BOARDS)


def category_of(name: Column) -> Column:
    return first_match(F.lower(name), CATEGORIES, "document")


def iso_date(text: Column) -> Column:
    """``M-D-YY`` and ``M-D-YYYY`` as ``YYYY-MM-DD``; a date that starts with its year stays as it is."""
    clean = F.translate(text, "_", "-")
    parts = F.split(clean, "-")
    year = F.get(parts, F.lit(2))
    full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") > 50, "19").otherwise("20"), year)).otherwise(year)
    american = F.concat(full, F.lit("-"), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lit("-"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    return F.when(F.size(parts) != 3, text).when(F.length(F.get(parts, F.lit(0))) == 4, clean).otherwise(american)


def flat_metadata(key: Column) -> Column:
    """Town, category, board, year and meeting date of a key, of which only the file name may tell; null for a key of one part."""
    parts = F.array_remove(F.split(key, "/"), "")
    name = F.element_at(parts, -1)
    kind = F.lower(F.get(parts, F.lit(1)))
    deep = (F.size(parts) >= 4) & kind.isin(*STRUCTURED)
    empty = lambda c: F.nullif(c, F.lit(""))
    folder_year = empty(F.regexp_extract(F.get(parts, F.lit(3)), r"^(\d{4})", 1))
    date = iso_date(empty(F.regexp_extract(name, DATE, 1)))
    year = F.coalesce(F.get(F.split(date, "-"), F.lit(0)), F.when(deep, folder_year).otherwise(empty(F.regexp_extract(name, r"((?:19|20)\d{2})", 1))))
    return F.when(
        F.size(parts) >= 2,
        F.struct(
            F.lower(F.get(parts, F.lit(0))).alias("town"),
            F.when(deep, kind).otherwise(category_of(name)).alias("category"),
            F.when(deep, F.translate(F.get(parts, F.lit(2)), "_", " ")).otherwise(board_of(name)).alias("board"),
            year.alias("year"),
            date.alias("meeting_date"),
        ),
    )
