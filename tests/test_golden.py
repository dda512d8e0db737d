"""Known answers, and the streaming jobs against their batch form."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from quillspark.functions.paths import flat_metadata
from quillspark.plans.audit import audited, capped_bullet, drift_of, moved, normal_section, with_sections, with_severity, without_tails
from quillspark.plans.classify import capped, needs_ocr, ocr_facts, topic_label, uncited_statute
from quillspark.plans.scalars import REPLIES, record_of
from quillspark.plans.state import conversation_state
from quillspark.sources.tables import Tables
from quillspark.streaming.jobs import rate_limits
from tests.compare import DATA


def test_flat_metadata(spark):
    want = {
        "ossipee/g/031225zoningordinance2025final_0.pdf": ("ossipee", "ordinances", "Zoning Board", "2025"),
        "ossipee/g/budget_committee_schedule_2026.pdf": ("ossipee", "financials", "Budget Committee", "2026"),
        "ossipee/g/cemetery_tax_maps_02_10_2014v_3reduced.pdf": ("ossipee", "tax_records", None, "2014"),
        "ossipee/g/assessment_versus_market_value_19-0327.pdf": ("ossipee", "document", None, None),
    }
    keys = spark.createDataFrame([(k,) for k in want], "key string")
    got = {r["key"]: (r["town"], r["category"], r["board"], r["year"]) for r in keys.select("key", flat_metadata(F.col("key")).alias("m")).select("key", "m.*").collect()}
    assert got == want


def test_ocr_decision(spark):
    rows = [(1, "x" * 17, False), (2, "x" * 100, True), (3, "", True), (4, "x" * 1500, True), (5, "x" * 600, True), (6, "the town board will vote on the budget and the water tax for the new fire road " * 12, True)]
    texts = spark.createDataFrame(rows, "id int, text string, pdf boolean")
    got = texts.select("id", needs_ocr(F.col("pdf"), F.length("text"), ocr_facts(F.col("text"))["garbage"]).alias("queue")).collect()
    assert {r["id"]: r["queue"] for r in got} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_rate_limit_stream(spark):
    t = Tables(spark, str(DATA / "sf0.001"))
    got = {(r["start"], r["user_id"]): r["n"] for r in rate_limits(spark, f"{t.folder}/events.parquet", t.events.schema, window="1 day").collect()}
    day = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "user_id").count()
    want = {(r["w"]["start"], r["user_id"]): r["count"] for r in day.collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) * 0.8  # the last day stays open behind the watermark


def test_char_cap(spark):
    code = "Words come first here. Then `" + "a" * 5 + "``" + "b" * 40
    want = {
        "short": "short",
        "One two three four five six. Seven eight nine ten eleven": "One two three four five six....",
        "one two three four five six seven eight nine ten eleven": "one two three four five six seven eig...",
        "Ab. X" + "x" * 19 + " " + "y" * 40: "Ab. X" + "x" * 19 + "...",
        "Ab. " + "x" * 20 + " " + "y" * 40: "Ab. " + "x" * 20 + " " + "y" * 12 + "...",
        "y" * 60: "y" * 37 + "...",
        "abcdefghij klmnopqrst uv ```sql " + "z" * 40: "abcdefghij klmnopqrst uv...",
        "abc ```py\nselect 1 from table_of_things where": "abc ```py\nselect 1 from table_of_thin\n```...",
        code: "Words come first here....",
        "": "",
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", capped(F.col("x"), 40).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == want


def test_topic_label(spark):
    want = {
        "What did the Ossipee planning board say?": "(Discussing ossipee planning board)",
        "Does RSA 674:33-a allow a variance": "(Topic: rsa 674:33-a)",
        "news from North Conway": "(Town: north conway)",
        "the zbas of Eaton": None,
        "": None,
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", topic_label(F.col("x"))[2].alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == want


def test_statutes_close_together_have_windows_of_their_own(spark):
    rows = [r for r in uncited_statute(Tables(spark, str(DATA / "sf0.001"))).collect() if r["id"] == "two"]
    assert [(r["statute"], r["uncited"]) for r in sorted(rows, key=lambda r: r["place"])] == [("674:", True), ("675:", False), ("91-A", True)]


def test_hot_keys_join_in_parts(spark):
    from quillspark.operators.relational import join_dealt

    rows = spark.range(5000).selectExpr("id", "CASE WHEN id < 3000 THEN 'hot' ELSE concat('k', id % 9) END AS key")
    found = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(found.drop("n"), "key").select("id", "first").collect()))
    assert sorted(map(tuple, join_dealt(rows, found, ["key"], rows_a_part=100).select("id", "first").collect())) == want
    assert join_dealt(rows.limit(0), found.limit(0), ["key"]).count() == 0


def answered(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, x string")


def test_sections_in_their_four_forms(spark):
    text = "Intro\n# Unknowns that matter: \n- cost\n2. **What we know so far**: \nfacts\nBottom line: yes\n**How this typically works** \n- slow"
    got = with_sections(answered(spark, text)).select(F.inline("s")).collect()
    assert [(r["name"], r["content"]) for r in got] == [
        ("Unknowns that matter", "- cost"),
        ("What we know", "facts"),
        ("Bottom line", "yes"),
        ("What changes", "** \n- slow"),
    ]


def test_list_audit(spark):
    law = "**What the law generally requires**\n- RSA 674:33 says so [S1]\n- As for papers that one asks for, RSA 91-A is silent here and nothing is cited near\n- more [S2]\n"
    good = "**Bottom line**\nYes.\n**What we know**\n- a [USER]\n" + law + "**What changes**\n- b\n**Unknowns that matter**\n" + "- c\n" * 5
    rows = {r["id"]: r for r in audited(answered(spark, good, "- " + "w " * 501 + "next steps", "")).collect()}
    got = rows[0]
    assert (got["headings"], got["ordered"], got["law_cited"], got["state_citations"], got["uncited"], got["crowded"], got["user_misplaced"]) == (5, True, True, 2, 1, 1, True)
    assert (got["violations"], got["passed"]) == (3, False)
    assert (rows[1]["words"], rows[1]["violations"], rows[1]["passed"]) == (504, 4, False)  # length, headings, law, closing phrase
    assert (rows[2]["words"], rows[2]["headings"], rows[2]["violations"]) == (0, 0, 2)


def test_transitions(spark):
    rows = [
        ("How does this work statewide?", None, False, "clear", 0.3),
        ("Did the planning board deny the variance at the hearing?", None, False, "start", 0.7),
        ("What is this?", None, True, "start", 0.9),
        ("What is this?", None, False, "none", 0.5),
        ("The school board hearing on the road, a new project", ["budget committee", "vote"], False, "update", 0.8),
        ("And the Vote?", ["budget committee", "vote"], False, "keep", 0.85),
        ("Why?", ["budget committee", "vote"], False, "continue", 0.7),
    ]
    given = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, x string, held array<string>, artifact boolean")
    got = {r["id"]: r for r in moved(given).collect()}
    assert [(got[i]["action"], got[i]["confidence"]) for i in range(len(rows))] == [r[3:] for r in rows]
    assert got[4]["entities"] == ["budget committee", "vote", "school board", "school", "hearing", "road"]
    assert got[0]["entities"] is None and got[6]["entities"] == ["budget committee", "vote"]


def test_drift(spark):
    texts = ["The septic vote of the board.", "The board met on septic. The Miller property has a barn.", "The septic board. For comparison, the Miller property has a barn.", "Nothing here."]
    got = {r["id"]: r for r in with_severity(answered(spark, *texts).select("id", drift_of(F.col("x")).alias("d"))).collect()}
    assert [got[i]["severity"] for i in range(4)] == ["none", "minor", "none", "major"]
    assert got[1]["unframed"] and "Miller property" in got[1]["drifted_to"] and "Miller property" in got[2]["drifted_to"]


def test_bullets_keep_their_citation(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = answered(spark, f"- {words} [S1]", f"- {words}", "- short [S1]").select("id", capped_bullet(F.col("x"), keep_citation=True).alias("y")).collect()
    first = lambda n: "- " + " ".join(f"w{i}" for i in range(n))
    assert [r["y"] for r in sorted(rows)] == [first(18) + "... [S1]", first(19) + "...", "- short [S1]"]


def test_normal_section(spark):
    text = "one\ntwo\nthree\n  - a\n\n* b\n- c"
    assert answered(spark, text).select(normal_section(F.col("x"), 2).alias("y")).collect()[0]["y"] == "one two\n- a\n* b"
    assert answered(spark, "a I recommend b I recommend c").select(without_tails(F.col("x")).alias("y")).collect()[0]["y"] == "a  b I recommend c"


def test_situation_over_turns(spark):
    said = [("user", "Why did the select board table the warrant article?"), ("assistant", "The library meeting at the town hall."), ("user", "In general, what is a vote at a hearing?"), ("user", None), ("user", "The vote on the road and the bridge")]
    rows = spark.createDataFrame([(7, i, r, x) for i, (r, x) in enumerate(said)], "session_id long, pos int, role string, content string")
    got = conversation_state(SimpleNamespace(turns=rows)).orderBy("pos").collect()
    assert [(r["session_id"], r["pos"], r["entities"]) for r in got] == [(7, 0, 3), (7, 1, 3), (7, 2, 3), (7, 3, 3), (7, 4, 6)]
    assert got[0]["title"] == got[3]["title"] and got[4]["title"] != got[0]["title"]


def test_model_reply(spark):
    rows = spark.createDataFrame(REPLIES, "name string, reply string").select("name", record_of(F.col("reply"), F.col("name")).alias("m")).select("name", "m.*")
    got = {r["name"]: (r["category"], r["town"], r["board"], r["year"], r["is_minutes"], r["meeting_date"], r["meeting_type"]) for r in rows.collect()}
    assert got == {
        "budget.pdf": ("budget", "Ossipee", "", "2024", False, None, None),
        "a.pdf": ("zoning", "", "", "", False, None, None),
        "b.pdf": ("meeting_minutes", "", "", "", True, "2024-03-05", None),
        "c.pdf": ("meeting_minutes", "", "", "", True, "2020-03-09", "special"),
        "planning board minutes 2023.pdf": ("meeting_minutes", "", "Planning Board", "2023", True, None, None),
        "warrant 2022.pdf": ("warrant_article", "", "", "2022", False, None, None),
        "d.txt": ("misc_other", "", "", "", False, None, None),
    }


def test_better_answer(spark):
    from quillspark.plans.audit import SECTIONS, better_of

    body = " ".join(["word"] * 40)
    whole = "\n\n".join(f"**{name}**\n{body}" for name in SECTIONS)
    cited = whole + "\n- a [S1]\n- b [S2]"
    pairs = {"alone": ("short", whole), "kept": (whole, "short"), "tie": (whole, whole), "both short": ("short", "**" + SECTIONS[0] + "**\nshort"), "worse": (cited, whole + "\n" + "Let me know if you need more. " * 90)}
    side = lambda k: spark.createDataFrame([(i, p[k]) for i, p in pairs.items()], "id string, x string")
    rows = {r["id"]: r for r in better_of(side(0), side(1)).collect()}
    assert rows["alone"]["repair_complete"] and not rows["alone"]["original_complete"]
    assert {i: r["selected"] for i, r in rows.items()} == {"alone": "repair", "kept": "original", "tie": "original", "both short": "repair", "worse": "original"}


def test_better_answer_follows_both_audits(spark):
    """Every answer of the conversations: the rule worked out again from the two scores."""
    from quillspark.plans.audit import answer_score, select_better_audited

    t = Tables(spark, str(DATA / "sf0.001"))
    alone = {r["id"]: (r["score"], r["complete"]) for r in answer_score(t).collect()}
    rows = select_better_audited(t).collect()
    assert {r["id"]: (r["original_score"], r["original_complete"]) for r in rows} == alone
    for r in rows:
        want = ("repair" if r["repair_complete"] else "original") if r["repair_complete"] != r["original_complete"] else "repair" if r["repair_score"] > r["original_score"] else "original"
        assert r["selected"] == want


def test_final_town(spark):
    from quillspark.plans.audit import final_town

    cases = [(" Statewide ", "Conway", "Madison", "Conway"), ("STATEWIDE", "statewide", "Madison", "Madison"), ("statewide", None, "statewide", "statewide"), ("statewide", "", None, "statewide"), (" hart's  LOCATION ", "Conway", None, "Hart's Location"), ("  ", "statewide", "Madison", "statewide"), (None, "", "Madison", "Madison"), (None, None, "", None), (None, None, None, None)]
    rows = spark.createDataFrame(cases, "model string, rules string, form string, want string")
    for r in rows.withColumn("got", final_town(F.col("model"), F.col("rules"), F.col("form"))).collect():
        assert r["got"] == r["want"], r
