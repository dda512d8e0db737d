"""Golden rows of the prompts that are asked of the search."""

from quillspark.plans.retrieval import retrieval_prompts
from quillspark.sources.tables import Tables


def test_prompts_of_a_plan(spark):
    said = [(1, "Which towns hear appeals over setback examples near roads?"), (2, "Show some latest rules about precedent from old minutes"), (3, "Why is RSA 12 so?"), (4, None)]
    spark.createDataFrame(said, "conv_id long, text string").selectExpr("conv_id", "0L AS turn", "'user' AS role", "text").createOrReplaceTempView("said")

    class Said(Tables):
        conversations = property(lambda self: spark.table("said"))

    rows = [r for r in retrieval_prompts(Said(spark, "unused")).collect() if "/" in r["id"]]
    got = {(r["id"], r["passes"], r["pos"]): (r["label"], r["prompt"]) for r in rows}
    assert got["1/0", 2, 1] == ("Statewide Handbooks & Guides", "Context: statewide municipal governance documents (categories: examples, near)\n\nQuestion: Which towns hear appeals over setback examples near roads?\n\nSpecifically looking for: appeals; over; setback\n\nProvide detailed relevant excerpts from the documents.")
    assert [k for k in got if k[1] == 2 and k[0] == "1/0"] == [("1/0", 2, 1)]
    assert [got["2/0", 2, k][0] for k in (1, 2) if ("2/0", 2, k) in got][-1] == "Meeting Minutes & Examples"
    assert got["3/0", 2, 1] == ("General Documents", "Why is RSA 12 so?")
    label, prompt = got["2/0", 1, 1]
    assert label == "Comprehensive Document Search" and "MOST RECENT" in prompt and "\nKey information needed:\n1. rules\n2. about\n3. precedent\n" in prompt
    assert "\nRelevant RSA chapters: 12\n" in got["3/0", 1, 1][1] and "Document categories: all relevant\nInclude statewide" in got["3/0", 1, 1][1]
    assert {r["passes"] for r in rows if r["id"] == "4/0"} == {1, 2}
