"""Known answers of the rules over questions, answers and passages."""

import pytest
from pyspark.sql import functions as F

from quillspark.plans.classify import audited_prose, combined_scope, follows_up, intent_of, scope_of, type_of_answer, uncited_statutes
from quillspark.plans.retrieval import aligned, authority_of, coverage, has_authority, match_score
from quillspark.plans.scalars import docname_parts

RISKY = "Can they appeal?"


def values(spark, schema, rows, column):
    """One value a row of a column over literal rows, in their order."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def test_scope(spark):
    said = {"What of zoning in Sugar Hill?": "local", "Does RSA 91-A apply?": "statewide", "state law in BROOKFIELD": "mixed", "How are you?": None, "": None}
    assert values(spark, "x string", [(x,) for x in said], scope_of(F.col("x"))) == list(said.values())
    lattice = [("local", "statewide", "mixed"), ("statewide", "local", "mixed"), ("mixed", None, "mixed"), (None, "mixed", "mixed"), ("local", None, "local"), (None, "statewide", "statewide"), ("local", "local", "local"), (None, None, None)]
    assert values(spark, "a string, b string", [x[:2] for x in lattice], combined_scope(F.col("a"), F.col("b"))) == [x[2] for x in lattice]


def test_answer_type(spark):
    rows = [(RISKY, "explain", "RISK_DISPUTE"), ("What is a setback?", "risk", "EXPLAINER"), ("Is there negligence and a statute?", "risk", "RISK_DISPUTE"), ("Is there negligence?", "risk", "QUICK_PROCESS"), ("When is trash day?", "explain", "EXPLAINER"), ("When is trash day?", "steps", "QUICK_PROCESS")]
    assert values(spark, "x string, o string", [r[:2] for r in rows], type_of_answer(F.col("x"), F.col("o"))) == [r[2] for r in rows]


def test_intent_of_complex_questions(spark):
    rows = [("Tell me why, and how fees work", True, "causal"), ("Tell me of how they determine it", True, "mechanism"), ("Tell me of how they determine it", False, "none"), ("Trash day", True, "none")]
    assert values(spark, "x string, c boolean", [r[:2] for r in rows], intent_of(F.col("x"), F.col("c"))) == [r[2] for r in rows]


def test_follow_ups(spark):
    rows = [("What about trash?", True, True), ("What about trash?", False, False), ("  so THEN what?", True, True), ("what about " + "x" * 120, True, False), ("Trash?", True, False)]
    assert values(spark, "x string, a boolean", [r[:2] for r in rows], follows_up(F.col("x"), F.col("a"))) == [r[2] for r in rows]


@pytest.mark.parametrize(
    "question,answer,kind,violations",
    [
        ("When is it?", "word " * 119, "QUICK_PROCESS", ["too short"]),
        ("When is it?", "word " * 120, "QUICK_PROCESS", []),
        ("When is it?", "word " * 264, "QUICK_PROCESS", []),
        ("When is it?", "word " * 265, "QUICK_PROCESS", ["too long"]),
        (RISKY, "word " * 250 + "\n## Heading\n- point\nConsult counsel.", "RISK_DISPUTE", ["headings", "bullets", "tails", "phrase: consult counsel"]),
        ("What is it?", "word " * 180 + "\n**Bottom line** and more", "EXPLAINER", ["headings", "phrase: Bottom line"]),
        ("When is it?", "", "QUICK_PROCESS", ["too short"]),
    ],
)
def test_prose_audit(spark, question, answer, kind, violations):
    row = audited_prose(spark.createDataFrame([("a", answer, question)], "id string, x string, question string")).first()
    assert (row["kind"], row["violations"]) == (kind, violations)


def test_uncited_statutes_need_repair(spark):
    rows = [("near", "RSA 674:33 applies [S1] here", ""), ("bare", "RSA 674:33 applies", ""), ("given", "RSA 674:33 applies", "the text of 674:33"), ("none", "nothing", "")]
    got = {r["id"]: r["uncited"] for r in uncited_statutes(spark.createDataFrame(rows, "id string, x string, state string")).collect()}
    assert got == {"near": False, "bare": True, "given": False}


def test_authority(spark):
    rows = [("state", "Guide", "under RSA 674:33", "rsa", True), ("state", "Guide", "see the rsa", "official", False), ("state", "Municipal Association", "", "nhma", True), ("state", "Guide", "by NHMA", "nhma", True), ("state", "Department of roads", "", "official", True), ("state", "Guide", "the Department", "official", False), ("local", "Meeting", "RSA 1", "minutes", True), ("local", "A reporter writes", "", "news", False)]
    schema, cells = "lane string, title string, content string", [r[:3] for r in rows]
    assert values(spark, schema, cells, authority_of(F.col("lane"), F.col("title"), F.col("content"))) == [r[3] for r in rows]
    assert values(spark, schema, cells, has_authority()) == [r[4] for r in rows]


ON = "the select board discussed the constitution park boardwalk project and its ada compliance requirements at the january meeting."
OFF = "the brown property rv enforcement case resulted in significant zoning violations and cesspool issues."
ABOUT, TITLE = ["constitution park", "boardwalk", "ada", "select board"], ["constitution", "park", "boardwalk", "ada", "vote"]


def test_situation_match(spark):
    """On topic over a half, off topic under a fifth, without a situation nothing; words of a phrase count a half each."""
    cells = [(ON, ABOUT, TITLE), (OFF, ABOUT, TITLE), ("some content", [], []), ("a park", ["constitution park"], []), ("constitution park", ["constitution park"], [])]
    got = values(spark, "x string, entities array<string>, situation array<string>", cells, match_score(F.col("x")))
    assert got[0] > 0.5 and got[1] < 0.2 and got[2:] == [0.0, 0.25, 1.0]


def test_alignment_follows_each_query(spark):
    schema = "title string, content string, entities array<string>, topics array<string>, boards array<string>"
    cells = [("A", "park and zoning", ["park", "road"], ["zoning"], []), ("A", "park", [], [], ["zba"]), ("PARK", "", ["park"], [], []), ("A", "none", ["park"], ["zoning"], ["zba"])]
    assert values(spark, schema, cells, F.round(aligned(), 6)) == [0.65, 1.0, 0.75, 0.0]


def test_coverage_of_topics(spark):
    rows = [("q", "on zoning", ["zoning", "roads"], True), ("q", "on ROADS", ["zoning", "roads"], False), ("r", "x", [], True)]
    df = spark.createDataFrame(rows, "id string, content string, topics array<string>, state boolean")
    got = {r["id"]: (r["a"], r["s"]) for r in df.groupBy("id").agg(coverage().alias("a"), coverage(F.col("state")).alias("s")).collect()}
    assert got == {"q": (1.0, 0.5), "r": (1.0, 1.0)}


def test_names_of_documents(spark):
    rows = ["Meeting  Minutes | Conway | Planning  Board, May | 2024", "Statewide laws | STATEWIDE | Trustees | 2020", "Budget", " | ", ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, name string").select("k", *docname_parts(F.col("name"))).orderBy("k")
    assert [tuple(r)[1:] for r in df.collect()] == [("meeting_minutes", "Conway", "planning_board"), (None, None, "trustees"), ("budget", None, None), (None, None, None), (None, None, None)]
