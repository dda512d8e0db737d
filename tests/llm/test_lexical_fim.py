"""Ranked lexical search against brute force, fill-in-middle round trips, and the edge cases of both."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.fill_middle import fill_in_middle, restored
from quillspark.llm.lexical import Shard, build_index, corpus_size, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(rows, text, k):
    docs = [(doc, Counter(words(t)), len(words(t))) for doc, t in rows if words(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for doc, tf, size in docs:
        m = 100 - 25 + 25 * size * n // total
        score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, times in Counter(words(text)).items() if t in tf)
        out.append((-score, doc is None, doc or 0))
    return [(rank, None if last else doc, -s) for rank, (s, last, doc) in enumerate(sorted(x for x in out if x[0] < 0)[:k], 1)]


@pytest.mark.parametrize("shard_docs,block_items", [(4096, 256), (7, 2), (1, 1)])
def test_search_equals_brute_force(spark, shard_docs, block_items):
    """Over many shards and blocks, with ties, repeats, null texts and ids, and clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 90)), " ".join(f"T{min(int(rng.zipf(1.4)), 40)}" for _ in range(rng.integers(1, 30)))) for _ in range(150)]
    rows += rows[:5] + [(None, "t1 t2 T3"), (3, None), (4, ""), (5, ",.;"), (200, "Éa é中 t1"), (201, "t1 " * 5000)]
    asked = [(0, "T1 t2 T2 t3"), (0, "T1 t2 T2 t3"), (0, "t5"), (1, None), (2, "nowhere"), (3, "É中 éa ... É"), (None, "t1 t4 t6 t7 t8 t9 t10"), (4, "")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, score int, terms string").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in asked], "item_id int, text string, rank int")
    got = sorted(map(tuple, ranked_search(docs, items, 20, block_items, shard_docs=shard_docs).collect()), key=repr)
    want = sorted([(i, *x) for i, t in set(asked) for x in ranking(rows, t, 20)], key=repr)
    assert got == want
    assert ranked_search(docs.filter("false"), items).collect() == [] == ranked_search(docs, items.filter("false")).collect()


def test_tree_keeps_impact_order(spark):
    """At every node of the tree a term's range begins with its highest impact there."""
    docs = spark.createDataFrame([(k, "a " * (1 + k * 7 % 11) + "b " * (k % 3)) for k in range(100)], "doc_id long, text string").coalesce(1)
    row = build_index(docs, corpus_size(docs)).first()
    shard = Shard(np.frombuffer(row["ids"], "<i8"), row["vocabulary"].split(" "), np.array(row["counts"]), np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["impacts"], "<i4"))
    lo, hi = shard.starts[shard.place["a"]], shard.starts[shard.place["a"] + 1]
    ranges = [(int(lo), int(hi))]
    for level in range(shard.depth):
        for a, b in ranges:
            assert shard.best[level, a] == shard.best[level, a:b].max()
        ra = [(int(shard.rank[level, a]), int(shard.rank[level, b])) for a, b in ranges]
        z = int(shard.zeros[level])
        ranges = [x for (a, b), (p, q) in zip(ranges, ra) for x in ((a - p, b - q), (z + p, z + q)) if x[0] < x[1]]
    assert len(ranges) == 100 and all(b - a == 1 for a, b in ranges)


def test_terms(spark):
    texts = ["Don't STOP-now 3x É_é", "", None, "中文,ok"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(terms(F.col("text"))).collect()]
    assert got == [None if t is None else words(t) for t in texts]


TEXTS = [(1, "plain ascii text"), (2, "😀 naïve 中文 é"), (3, None), (4, ""), (5, "holds <S> already"), (6, "<P"), (7, "a\nb\r\nc\td"), (None, "no id"), (8, "y" * 200_000), (1, "plain ascii text"), (9, "x")]


@pytest.mark.parametrize("unit", ["(?s).", r"\S+|\s+", r"\n|[^\n]+"])
@pytest.mark.parametrize("percent,spm", [(90, 20), (100, 0), (100, 100)])
def test_text_is_restored(spark, unit, percent, spm):
    docs = spark.createDataFrame([(*r, 1, "c") for r in TEXTS for _ in range(2)], "doc_id long, text string, N int, _q_text string")
    made = fill_in_middle(docs, 1, unit, percent, spm)
    rows = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert made.columns == ["doc_id", "text", "_q_text", "n", "form", "prefix_chars", "middle_chars", "output"] and len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["back"] == text and r["_q_text"] == "c"
        if unit == "(?s).":
            assert r["n"] == len(text)
        if r["form"] == "plain":
            assert r["output"] == text and r["prefix_chars"] is None
        else:
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            p, m, s = text[:a], text[a:b], text[b:]
            assert r["output"] == (f"<P>{p}<S>{s}<M>{m}" if r["form"] == "psm" else f"<S>{s}<P>{p}<M>{m}")
    forms = {r["doc_id"]: r["form"] for r in rows}
    assert forms[4] == forms[5] == forms[3] == "plain"
    if percent == 100:
        assert forms[1] == forms[6] == ("spm" if spm else "psm")
    assert fill_in_middle(docs.filter("false")).collect() == []
