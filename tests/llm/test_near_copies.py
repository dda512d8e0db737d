"""The pipeline's near-dedup against brute force: Jaccard of five-word runs, 0.8 or more."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import near_copies
from quillspark.llm.near_copies import band_keys, keep_one_similar, set_bits, shingle_set, similar, spanning_pairs
from quillspark.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_force(rows, least=0.8):
    """doc_ids that stay: the least of each group that similar pairs join."""
    runs = {}
    for doc_id, text in rows:
        words = (text or "").lower().split()
        runs[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {d: d for d in runs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in runs:
        for b in runs:
            if a < b and len(runs[a] & runs[b]) >= least * len(runs[a] | runs[b]) - 1e-9:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in runs if top(d) == d)


def variants(seed=7):
    """Texts of 200 words, each with copies that differ in one word up to many."""
    draw = random.Random(seed)
    rows = [(0, ""), (1, None), (2, "one two"), (3, "One  two")]
    for _ in range(12):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        for changed in (0, 1, 2, 3, 4, 5, 6, 8, 12):
            other = list(words)
            for at in draw.sample(range(200), changed):
                other[at] = f"x{draw.randrange(5000)}"
            rows.append((len(rows), " ".join(other)))
    return rows


def kept(spark, rows, run=lambda docs: corpus_pipeline.near_dedup(docs.sparkSession, docs, "")):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    return sorted(r["doc_id"] for r in run(docs).collect())


def test_stage_equals_brute_force(spark):
    rows = variants()
    assert kept(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("shard_size", [300, 1500])
def test_shards_in_parts_lose_no_pair(spark, shard_size):
    rows = variants(11)
    assert kept(spark, rows, lambda docs: keep_one_similar(docs, shard_size=shard_size)) == brute_force(rows)


def test_similar_texts_beyond_three_bits_are_one(spark):
    words = [f"w{k}" for k in range(100)]
    other = words[:50] + ["x"] + words[51:]
    a, b = " ".join(words), " ".join(other)
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() > 3
    assert kept(spark, [(1, a), (2, b)]) == [1]


def test_bands_find_pairs_at_the_threshold():
    draw = np.random.default_rng(5)
    for _ in range(300):
        found = draw.integers(0, 1 << 64, 180, np.uint64)
        a, b = np.sort(found[:162]), np.sort(np.concatenate([found[:144], found[162:]]))  # 144 of 180
        assert np.any(band_keys(a) == band_keys(b))


def test_sets_of_no_and_few_words():
    assert len(shingle_set("")) == 0 and len(shingle_set("a b")) == 1 and len(shingle_set("a b c d e f")) == 2


def groups_of(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("radius,pairs", [(20, 1 << 18), (20, 40), (3, 40), (0, 1), (64, 7)])
@pytest.mark.parametrize("whole", [True, False])
def test_shards_searched_by_trees_equal_all_pairs(monkeypatch, radius, pairs, whole):
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    texts = [t or "" for _, t in variants(3)]
    sets = [shingle_set(t) for t in texts] + [shingle_set("a b c d e f"), shingle_set("a b c d e f g")]
    n = len(sets)
    group = np.sort(np.random.default_rng(2).integers(0, 3, n)) if whole else np.sort(np.arange(n) % 4)
    order = np.random.default_rng(3).permutation(n)
    sets = [sets[k] for k in order]
    fp = np.array([set_bits(s) for s in sets], np.uint64)
    is_tree = np.ones(n, bool) if whole else np.random.default_rng(4).random(n) < 0.5
    near = [(a, b) for a in range(n) for b in range(n) if a != b and group[a] == group[b] and (whole or is_tree[a] < is_tree[b]) and similar(sets[a], sets[b], 0.8)]
    found = list(spanning_pairs(group, fp, is_tree, sets, 0.8, radius))
    assert set(found) <= set(near) and groups_of(n, found) == groups_of(n, near)
    assert len(found) == n - len(set(groups_of(n, found)))  # a forest, not all pairs


def test_stage_finds_its_pairs_in_trees_of_fingerprints(spark):
    """A set's bits are those of op2's fingerprint, and similar texts lie within the radius."""
    words = [f"w{k}" for k in range(100)]
    a, b = " ".join(words), " ".join(words[:50] + ["x"] + words[51:])
    assert set_bits(shingle_set(a)) == fingerprint(a, 5) and set_bits(shingle_set("")) == 0
    sets = [shingle_set(a), shingle_set(b)]
    fp = np.array([set_bits(s) for s in sets], np.uint64)
    assert 3 < int(np.bitwise_count(fp[0] ^ fp[1])) <= near_copies.RADIUS
    assert list(spanning_pairs(np.zeros(2, int), fp, np.ones(2, bool), sets, 0.8)) == [(1, 0)]
