"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_memo import BoundedMemo, MEMO_BYTES, as_letters, drop_blank_units, slices, texts_of, word_units


class MergeTable:
    """Vocabulary and merge ranks of a tokenizer file whose pieces end in a word-end suffix.

    ``encode`` and ``decode`` work on one text; ``pieces`` holds the ids of pieces met, bounded in bytes.
    """

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.strings = {i: s for s, i in self.ids.items()}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special, self.marks = set(special), regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.pieces = BoundedMemo(limit)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece after all merges.

        The queue holds (rank, left position); an entry is stale, and skipped, when its pair has
        changed since it was pushed.
        """
        symbols: list[str | None] = list(as_letters(piece))
        symbols[-1] += self.suffix
        ranks, last = self.ranks, len(symbols) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        queue = [(rank, i) for i in range(last) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            left = symbols[i]
            if left is None or (j := after[i]) > last or ranks.get((left, symbols[j])) != rank:
                continue
            symbols[i], symbols[j] = left + symbols[j], None
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h))
        return [self.ids[s] for s in symbols if s is not None and s in self.ids]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens stand for themselves."""
        if text.isascii() and text.isalpha() and text.islower():
            return list(self.piece(text))
        out: list[int] = []
        for part in self.marks.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.ids[part])
            elif part:
                for piece in word_units(part):
                    out += self.piece(piece)
        return out

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces.older.get(piece)
            if found is None:
                found = tuple(self.merge(piece))
            self.pieces.hold(piece, found, 40 + 8 * len(found))
        return found

    def decode(self, ids) -> str:
        """Vocabulary strings in a row, a blank between two; this vocabulary names no decoder."""
        return " ".join([self.strings[i] for i in ids])


TABLES: dict[str, MergeTable] = {}


def table_for(path: str) -> MergeTable:
    if path not in TABLES:
        TABLES[path] = MergeTable(path)
    return TABLES[path]


def encoded_units(texts: pa.Array, table: MergeTable):
    """For each slice of texts: per text the count of ids, the ids and the decoded ids, blank-joined.

    A unit between blanks is encoded once for all its occurrences in the slice, and its ids are
    decoded once; a decoded text is the decoded units with a blank between two, as is that of all ids.
    """
    for part in slices(texts):
        special = pc.any(pc.match_substring(part, "<|")).as_py()
        units, offsets = drop_blank_units(part if special else pc.ascii_lower(part))
        coded = units.dictionary_encode()
        encoded = [table.encode(u) if u else () for u in coded.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = pa.array([" ".join(map(str, x)) for x in encoded], pa.large_string())
        strings = pa.array([table.decode(x) for x in encoded], pa.large_string())
        at = np.asarray(coded.indices)
        full = lengths[at] > 0
        ends = np.concatenate(([0], np.cumsum(full)))[offsets]
        n = np.concatenate(([0], np.cumsum(lengths[at])))[offsets]
        take, bounds, blank = pa.array(at[full]), pa.array(ends, pa.int32()), pa.scalar(" ", pa.large_string())
        join = lambda words: pc.binary_join(pa.ListArray.from_arrays(bounds, words.take(take)), blank)
        yield np.diff(n), join(ids), join(strings)
    pa.default_memory_pool().release_unused()


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the blank-joined ids and of the decoded text.

    ``decoded_sha256`` is of the ids looked up in the vocabulary and joined.  A null
    or empty text has no ids and decodes to the empty text; rows, repeated or with a null doc_id,
    are kept one for one; other columns are ignored.
    """

    def digest(batches):
        table = table_for(tokenizer_path)
        hexes = lambda a: [hashlib.sha256(x.as_buffer()).hexdigest() for x in a.cast(pa.large_binary())]
        for batch in batches:
            at = 0
            for n, ids, strings in encoded_units(texts_of(batch, "text"), table):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(n)), "n_tokens": pa.array(n), "ids_sha256": hexes(ids), "decoded_sha256": hexes(strings)})
                at += len(n)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id and ids as array<int>, empty for a null or empty text; rows are kept one for one."""

    def encode(batches):
        table = table_for(tokenizer_path)
        for batch in batches:
            ids = [table.encode(x) for x in texts_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the decoded text (null ids: null)."""

    def decode(batches):
        table = table_for(tokenizer_path)
        for batch in batches:
            texts = [None if x is None else table.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
