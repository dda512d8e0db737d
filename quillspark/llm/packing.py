"""Lexical retrieval packing: windows filled with the BM25 neighbours of a seed document.

Texts are encoded once and their ids stored with a sketch of their content, the smallest hashes of
the distinct words.  Documents are then routed by content: sorted, over
all tasks, by the sketch, so that texts of the same passages follow each other.  Each task streams its
documents into shards bounded in documents and tokens.  A shard has its own inverted index over token
ids.  A seed opens a window, its best unused neighbours fill it, and the last one is cut where the
window ends; what is left of it stays in the pool.  Documents longer than a window first fill windows
of their own.  What a shard leaves over is cut into windows whose lengths are powers of two, so no
window carries padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .word_memo import LETTERS, encoded, memo_for, texts_of

K1, B = 1.2, 0.75
# The letters of blanks in byte-level vocabularies, and the multipliers of the sketch's hash.
BLANK_LETTERS = tuple(LETTERS[ord(b)] for b in " \t\n\r")
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """BM25 inverted index of a shard: postings of each distinct id, weights ready to be summed."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        pairs = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in pairs]
        terms = np.concatenate(self.terms)
        counts = np.concatenate([c for _, c in pairs]).astype(np.float32)
        owner = np.repeat(np.arange(self.n), [len(t) for t in self.terms])
        size = np.array([len(d) for d in docs], np.float32)
        weight = counts * (K1 + 1) / (counts + K1 * (1 - B + B * size / size.mean())[owner])
        order = np.argsort(terms, kind="stable")
        self.vocabulary, self.first, found = np.unique(terms[order], return_index=True, return_counts=True)
        self.last = self.first + found
        self.idf = np.log1p((self.n - found + 0.5) / (found + 0.5)).astype(np.float32)
        self.owner, self.weight = owner[order], weight[order] * np.repeat(self.idf, found)

    def neighbours(self, doc: int) -> np.ndarray:
        """Documents by falling score against all distinct ids of ``doc``, ties by position."""
        at = np.searchsorted(self.vocabulary, self.terms[doc])
        spans = [slice(self.first[k], self.last[k]) for k in at]
        scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return np.argsort(-scores, kind="stable")

    def keep(self, wanted: np.ndarray) -> None:
        """Drop the postings of all other documents, which then score nothing; the other scores stay the same."""
        kept = wanted[self.owner]
        before = np.concatenate(([0], np.cumsum(kept)))
        self.first, self.last = before[self.first], before[self.last]
        self.owner, self.weight = self.owner[kept], self.weight[kept]


def fill_windows(docs: list[np.ndarray], window: int):
    """Windows of a shard, each a list of (document, start, length); every id lies in exactly one."""
    left = [0] * len(docs)  # where the unused part of each document starts
    for d, ids in enumerate(docs):
        while len(ids) - left[d] >= window:
            yield [(d, left[d], window)]
            left[d] += window
    unused = np.array([len(ids) > left[d] for d, ids in enumerate(docs)])
    if not unused.any():
        return
    index, indexed, rest = ShardIndex(docs), len(docs), []
    for seed in range(len(docs)):
        while unused[seed]:
            if unused.sum() < 0.8 * indexed:
                index.keep(unused)
                indexed = unused.sum()
            pieces, room = [], window
            ranked = index.neighbours(seed)
            for d in (seed, *ranked[unused[ranked]].tolist()):
                if unused[d] and room:
                    n = min(room, len(docs[d]) - left[d])
                    pieces.append((d, left[d], n))
                    left[d], room = left[d] + n, room - n
                    unused[d] = left[d] < len(docs[d])
            if room == 0:
                yield pieces
            else:
                rest = pieces
    size = 1 << (window.bit_length() - 1)
    while rest:
        room = min(size, 1 << (sum(n for *_, n in rest).bit_length() - 1))
        pieces = []
        while room:
            d, start, n = rest[0]
            took = min(room, n)
            pieces.append((d, start, took))
            room -= took
            rest[0] = (d, start + took, n - took)
            if took == n:
                rest.pop(0)
        yield pieces


def word_starts(memo) -> np.ndarray:
    """Whether each id of the vocabulary begins with a blank or a line end, and so begins a word."""
    starts = np.zeros(memo.tokenizer.get_vocab_size(), bool)
    starts[[i for t, i in memo.tokenizer.get_vocab().items() if t[0] in BLANK_LETTERS]] = True
    return starts


def sketches_of(ids: np.ndarray, offsets: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A row a text: the ``size`` smallest hashes of the distinct words of its ids, zeros where there are fewer."""
    least = np.zeros((len(offsets) - 1, size), np.uint64)
    if len(ids):
        first = starts[ids]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(first)
        place = np.arange(1, len(ids) + 1, dtype=np.uint64) - np.repeat(at, np.diff(at, append=len(ids))).astype(np.uint64)
        h = (ids + FIRST * place) * SECOND
        h = np.add.reduceat((h ^ h >> np.uint64(32)) * FIRST, at)
        h = (h ^ h >> np.uint64(32)) * SECOND
        words = np.searchsorted(at, offsets)
        held = np.flatnonzero(np.diff(words))
        counts, none = np.diff(words)[held], np.uint64(2**64 - 1)
        for k in range(size):  # the least hash of every text at once, which then no longer counts
            found = np.minimum.reduceat(h, words[held])
            least[held, k] = np.where(found == none, 0, found)
            h[h == np.repeat(found, counts)] = none
    return least.view(np.int64)


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int, sketch: int) -> DataFrame:
    """doc_id, ids (little-endian, two bytes each where the vocabulary allows) and the sketch of every row."""
    names = [f"k{i}" for i in range(sketch)]

    def encode(batches):
        memo = memo_for(tokenizer_path, spaced=True)
        kind, starts = id_type(memo, end_id), word_starts(memo)
        end = np.array(end_id, kind)
        for batch in batches:
            packed, sketches = [], [np.zeros((0, sketch), np.int64)]
            for ids, offsets in encoded(texts_of(batch, "text"), memo):
                data, width, at = ids.astype(kind).tobytes(), end.itemsize, offsets.tolist()
                packed += [data[a * width : b * width] + end.tobytes() for a, b in zip(at[:-1], at[1:])]
                sketches.append(sketches_of(ids, offsets, starts, sketch))
            columns = [pa.array(c) for c in np.concatenate(sketches).T]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), *columns], ["doc_id", "ids", *names])

    schema = "doc_id long, ids binary, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def id_type(memo, end_id: int) -> str:
    return "<u2" if max(memo.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def routed(encoded: DataFrame) -> DataFrame:
    """doc_id and ids, dealt over the tasks and sorted by the sketch.

    A hash of the ids and the doc_id come after the sketch, so a large group is split over tasks.
    """
    order = [*[c for c in encoded.columns if c not in ("doc_id", "ids")], F.xxhash64("ids"), "doc_id"]
    return encoded.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 1024, shard_docs: int = 512, shard_tokens: int = 1 << 20, sketch: int = 4) -> DataFrame:
    """Pack every document's ids, ``end_id`` appended, into windows of ``window`` ids.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    sequence_id is the task's number shifted by 40 bits plus a counter.  A null text counts as empty;
    repeated and null doc_ids are packed row by row; an empty table gives no row; other columns are
    ignored.  A shard ends at ``shard_docs`` documents or ``shard_tokens`` ids, so a task holds one
    shard, or one document if that is larger.
    """

    def pack(batches):
        from pyspark import TaskContext

        kind, sequence = id_type(memo_for(tokenizer_path, spaced=True), end_id), TaskContext.get().partitionId() << 40
        names, shard, tokens = [], [], 0

        def flush():
            nonlocal sequence
            rows = []
            for pieces in fill_windows(shard, window):
                at = 0
                for d, start, n in pieces:
                    rows.append((names[d], start, n, zlib.crc32(shard[d][start : start + n].tobytes()), len(shard[d]), sequence, at))
                    at += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(packed.as_buffer(), kind).astype("<u4")
                if shard and (len(shard) >= shard_docs or tokens + len(ids) > shard_tokens):
                    yield flush()
                    names, shard, tokens = [], [], 0
                names.append(doc_id)
                shard.append(ids)
                tokens += len(ids)
        if shard:
            yield flush()

    return routed(stored(encoded_documents(docs, tokenizer_path, end_id, sketch), "packing-ids")).mapInArrow(pack, PIECES)
