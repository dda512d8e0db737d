"""Substring dedup against brute force over whole texts, and its edge cases."""

import hashlib
import re

import numpy as np
import pytest

from quillspark.llm import substring_dedup as sd
from quillspark.llm.queries import QUERIES
from quillspark.llm.substring_dedup import Block, anchors_of, remove_repeats, run_hashes, word_hashes
from tests.compare import DATA
from tests.llm.test_contracts import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window=13):
    """(n_words, n_removed, kept text) of (doc_id, text) rows; null ids are one document that comes last."""
    first, split = {}, []
    for doc, text in rows:
        words, rank = WORDS.findall(text or ""), (doc is None, doc or 0)
        split.append((rank, words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, rank), rank)
    out = []
    for rank, words in split:
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < rank for j in range(i, i + window)}
        out.append((len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return out


def test_op13_brute_force(spark):
    docs = table("documents", DATA / "sf0.01")
    want = {d["doc_id"]: x for d, x in zip(docs, brute_force([(d["doc_id"], d["text"]) for d in docs]))}
    got = {r["doc_id"]: r for r in QUERIES["op13_substring_dedup"](spark, str(DATA / "sf0.01")).collect()}
    assert set(got) == set(want) and sum(x[1] for x in want.values()) > 0
    for k, (n, removed, kept) in want.items():
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("block_rows", [20_000, 3])
def test_overlapping_passages(spark, block_rows):
    """Passages cut from one another at every place, by blocks of anchors and by blocks of windows."""
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(60)}" for _ in range(400)]
    rows = []
    for k in range(80):
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        c = rng.integers(0, 380)
        rows.append((int(rng.integers(0, 60)), " ".join([*base[a:b], "own", str(k), *base[c : c + 20]])))
    rows += [(None, " ".join(base[:40])), (None, " ".join(base[:40]) + " more"), (7, None), (8, ""), (9, " \t\n"), (10, "one two")]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows).collect()), key=repr)
    assert got == sorted([(doc, *x) for (doc, _), x in zip(rows, brute_force(rows))], key=repr)


def test_edges(spark):
    long = " ".join(f"word{i % 9973}" for i in range(400_000))
    rows = [(2, long, 1, 1), (5, long, 1, 1), (5, long, 1, 1), (6, "x" * 3_000_000 + " " + long, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, route int, n_words int")
    got = sorted(map(tuple, remove_repeats(docs).collect()))
    assert [(r[0], r[1], r[2]) for r in got] == [(2, 400_000, 0), (5, 400_000, 400_000), (5, 400_000, 400_000), (6, 400_001, 400_000)]
    assert remove_repeats(docs.filter("false")).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(docs, window=3)


def test_factors_cross_boundaries():
    """A window that straddles the end of a factor is found in another stretch of the block."""
    words = [b"%d" % i for i in range(40)]
    block = Block(13)
    block.add(words[:20])
    block.add(words[10:32])
    assert block.factors(words) == [(0, 32)]
    assert block.factors([b"x", *words[:12], b"y", *words[3:17]]) == [(14, 14)]
    assert block.factors(words[:12]) == []


def test_anchors_follow_windows():
    """Equal windows have equal anchors wherever they stand, and pieces hash as the whole does."""
    text = b" ".join(b"w%d" % (i * i % 91) for i in range(3000))
    words = text.split()
    anchors, runs = anchors_of(word_hashes(text), 13), run_hashes(word_hashes(text), 13)
    assert len(anchors) == len(runs) == len(words) - 12
    seen = {}
    for i in range(len(anchors)):
        key = tuple(words[i : i + 13])
        assert seen.setdefault(key, (anchors[i], runs[i])) == (anchors[i], runs[i])
    long = text * 200
    assert np.array_equal(word_hashes(long), sd.piece_hashes(long))
    assert len(anchors_of(word_hashes(b"a b"), 13)) == 0 and len(word_hashes(b"")) == 0
