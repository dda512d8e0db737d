"""Packing looks for neighbours by content, not by the order of the table, and with every term."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm.packing import ShardIndex, pack_documents, sketches_of
from quillspark.llm.word_memo import UnitIds, text_ids

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_copies_far_apart_share_windows(spark):
    words = [[f"w{d}x{k}" for k in range(30)] for d in range(64)]
    rows = [(d, " ".join(w)) for d, w in enumerate(words)] + [(100 + d, " ".join([*w[:-1], f"v{d}"])) for d, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = defaultdict(set)
    for r in pack_documents(docs, BYTE, 0, window=256, shard_docs=8).collect():
        held[r["doc_id"]].add(r["sequence_id"])
    assert set(held) == {d for d, _ in rows}
    met = sum(bool(held[d] & held[100 + d]) for d in range(64))
    assert met >= 16, met  # none where shards follow the order of the table


def test_neighbours_count_every_term():
    own = np.arange(100, 130, dtype=np.uint32)  # 30 ids that no other document holds
    shared = np.arange(20, dtype=np.uint32)
    docs = [np.concatenate([own, shared]), np.arange(200, 250, dtype=np.uint32), shared, np.arange(300, 350, dtype=np.uint32)]
    assert ShardIndex(docs).neighbours(0)[:2].tolist() == [0, 2]


def test_sketches_of_a_slice_are_those_of_its_texts():
    draw = np.random.default_rng(1)
    starts = np.arange(50) % 3 == 0
    texts = [draw.integers(0, 50, n).astype("<u4") for n in (0, 1, 2, 40, 0, 300, 7, 0)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = sketches_of(np.concatenate(texts), offsets, starts, 4)
    assert got.shape == (8, 4) and not got[[0, 4, 7]].any()
    for row, ids in zip(got, texts):
        assert (row == sketches_of(ids, np.array([0, len(ids)]), starts, 4)[0]).all()
        cuts = [k for k in range(len(ids)) if k == 0 or starts[ids[k]]]
        words = {tuple(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)])}
        assert (row != 0).sum() == min(4, len(words))


def test_units_of_any_text_give_the_ids_of_the_library():
    draw = random.Random(5)
    kinds = ["a", "B", "é", "ƿ", "7", ",", "'", "'s", "'re", "-", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "×", "÷", "中", "é", "😀", "\x00", "\x1c", "\x85", "½", "ɐ", "<|", "<|endoftext|>"]
    library = Tokenizer.from_file(BYTE)
    for most in (len(kinds) - 2, len(kinds)):  # slices without and with the spelling of special tokens
        texts = ["".join(draw.choices(kinds[:most], k=draw.randint(0, 12))) for _ in range(4000)] + ["", " ", "\n", "  ", " a", "a ", "\nb", "b\n"]
        for part in (texts, texts[:1], ["", ""], texts[7:]):
            got = text_ids(pa.array(["x y", *part], pa.large_string())[1:], UnitIds(BYTE, spaced=True))
            assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_a_word_is_held_once_whatever_marks_follow_it():
    memo = UnitIds(BYTE, spaced=True)
    ends = ["", ",", ".\n", "?!", "\n", ")", ";\n", "...", "-\n", "1"]
    list(text_ids(pa.array(["x word" + a for a in ends] + [f"word{a}Word x" for a in ends[1:]], pa.large_string()), memo))
    assert {u for u in memo if "ord" in u} == {" word", "word", "Word"} and len(memo) < 20, list(memo)


def test_postings_of_used_documents_are_dropped_and_the_rest_ranks_the_same():
    draw = np.random.default_rng(3)
    docs = [draw.integers(0, 60, n).astype("<u4") for n in draw.integers(1, 80, 40)]
    whole, part, wanted = ShardIndex(docs), ShardIndex(docs), draw.random(40) < 0.4
    part.keep(wanted)
    assert len(part.owner) == sum(len(t) for t, w in zip(part.terms, wanted) if w)
    for k in np.flatnonzero(wanted):
        same = [r[wanted[r]].tolist() for r in (whole.neighbours(k), part.neighbours(k))]
        assert same[0] == same[1]
