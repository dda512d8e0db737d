"""Exact ranked lexical search over dual-sorted wavelet trees.

Documents are dealt into shards of bounded size.  A shard's postings lie term after term, each term's
by falling impact, and the sequence of their doc numbers is held as a wavelet tree in matrix layout: a
level splits doc numbers by one bit and keeps the order of what goes each way.  So at every node a
term's range still begins with its highest impact in that node's doc numbers, which bounds the subtree,
and going down level by level intersects the lists by doc_id.  A search expands the nodes of highest
bound first until no bound reaches the k-th score; what a task has found in earlier shards counts too.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# What a term is made of, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
LAST = (1 << 63) - 1
INDEX = "shard_docs int, ids binary, vocabulary string, counts array<int>, bits binary, impacts binary"


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z lower-cased; null without a text."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and how many terms they hold together."""
    n = docs.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"))
    found = n.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return found[0], found[1]


def impacts_of(tf: np.ndarray, lengths: list[int], sizes: np.ndarray, corpus: tuple[int, int]) -> np.ndarray:
    """The share of a term's weight that a document earns by tf occurrences; ``sizes`` postings a document,
    ``lengths`` terms.  It stays under 2^20."""
    m = np.array([100 - 25 + 25 * n * corpus[0] // corpus[1] for n in lengths], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))


class Shard:
    """A wavelet tree over the doc numbers of some documents, which are numbered by rising doc_id."""

    def __init__(self, ids: np.ndarray, vocabulary: list[str], counts: np.ndarray, bits: np.ndarray, impacts: np.ndarray):
        self.ids, self.depth = ids, max(1, (len(ids) - 1).bit_length())
        self.place = {t: k for k, t in enumerate(vocabulary)}
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        n = len(impacts)
        ones = np.unpackbits(bits.reshape(self.depth, -1), axis=1, count=n).astype(bool)
        self.rank = np.zeros((self.depth, n + 1), np.int32)
        np.cumsum(ones, axis=1, out=self.rank[:, 1:])
        self.zeros = (n - self.rank[:, -1]).astype(np.int32)
        self.best = np.zeros((self.depth + 1, n + 1), np.int32)
        self.best[0, :n] = impacts
        for level, one in enumerate(ones):
            here, below = self.best[level, :n], self.best[level + 1]
            z = self.zeros[level]
            below[:z], below[z:n] = here[~one], here[one]

    def search(self, words: list[str], weights: np.ndarray, k: int, scores: np.ndarray, docs: np.ndarray, beam: int = 64):
        """``scores`` and ``docs``, at most k in rank order, after this shard's documents joined them."""
        at = [(self.place[t], w) for t, w in zip(words, weights) if t in self.place]
        if not at:
            return scores, docs
        place, weight = np.array([p for p, _ in at]), np.array([w for _, w in at], np.int64)
        lo, hi = self.starts[place][None].astype(np.int32), self.starts[place + 1][None].astype(np.int32)
        bound = np.array([LAST])
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(bound):
            if len(bound) > beam:
                chosen = np.argpartition(-bound, beam)[:beam]
                rest = np.ones(len(bound), bool)
                rest[chosen] = False
            else:
                chosen, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            depth, a, b, number = level[chosen], lo[chosen], hi[chosen], first[chosen]
            ra, rb, z = self.rank[depth[:, None], a], self.rank[depth[:, None], b], self.zeros[depth][:, None]
            a, b = np.concatenate((a - ra, z + ra)), np.concatenate((b - rb, z + rb))
            depth = np.concatenate((depth, depth)) + 1
            number = np.concatenate((number, number + (1 << (self.depth - depth[: len(number)]))))
            some = np.where(a < b, self.best[depth[:, None], a], 0) @ weight
            leaf = (depth == self.depth) & (some > 0)
            if leaf.any():
                scores, docs = np.concatenate((scores, some[leaf])), np.concatenate((docs, self.ids[number[leaf]]))
                order = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[order], docs[order]
            grow = (depth < self.depth) & (some > 0)
            lo, hi = np.concatenate((lo[rest], a[grow])), np.concatenate((hi[rest], b[grow]))
            bound, level, first = np.concatenate((bound[rest], some[grow])), np.concatenate((level[rest], depth[grow])), np.concatenate((first[rest], number[grow]))
            if len(scores) == k:
                live = (bound > scores[-1]) | ((bound == scores[-1]) & (self.ids[first] < docs[-1]))
                if not live.all():
                    lo, hi, bound, level, first = lo[live], hi[live], bound[live], level[live], first[live]
        return scores, docs


def shard_row(ids: list[int], postings: list[dict[int, int]], lengths: list[int], vocabulary: dict[bytes, int], corpus: tuple[int, int]) -> list:
    """One row of the index: see INDEX.  ``postings`` has each document's count by term number."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    sizes = np.array([len(p) for p in postings])
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    doc = np.repeat(number, sizes)
    term = np.fromiter((t for p in postings for t in p), np.int64, len(doc))
    tf = np.fromiter((c for p in postings for c in p.values()), np.int64, len(doc))
    earned = impacts_of(tf, lengths, sizes, corpus)
    by_impact = np.lexsort((doc, -earned, term))
    doc, earned = doc[by_impact], earned[by_impact]
    bits = []
    for shift in range(max(1, (len(ids) - 1).bit_length()) - 1, -1, -1):
        one = (doc >> shift & 1).astype(bool)
        bits.append(np.packbits(one))
        doc = np.concatenate((doc[~one], doc[one]))
    counts = np.bincount(term, minlength=len(vocabulary))
    return [len(ids), np.array(ids, "<i8")[order].tobytes(), b" ".join(vocabulary).decode("utf-8", "replace"), counts.tolist(), np.concatenate(bits).tobytes(), earned.astype("<i4").tobytes()]


def build_index(docs: DataFrame, corpus: tuple[int, int], shard_docs: int = 4096, shard_postings: int = 1 << 20) -> DataFrame:
    """A stored table of shards, each of at most ``shard_docs`` documents of one partition and closed at
    ``shard_postings`` postings, which a single very long text may exceed.  Every text with a term is in it."""

    def build(batches):
        vocabulary, ids, postings, lengths, held = {}, [], [], [], 0

        def row():
            columns = zip(*[shard_row(ids, postings, lengths, vocabulary, corpus)])
            kinds = (pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(BYTES).split()
                if not words:
                    continue
                found = Counter(words)
                postings.append({vocabulary.setdefault(t, len(vocabulary)): c for t, c in found.items()})
                ids.append(key)
                lengths.append(len(words))
                held += len(found)
                if len(ids) >= shard_docs or held >= shard_postings:
                    yield row()
                    vocabulary, ids, postings, lengths, held = {}, [], [], [], 0
        if ids:
            yield row()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), "text")
    return stored(keyed.mapInArrow(build, INDEX), "lexical-index")


def weighted_items(items: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """item_id, item (a hash that tells apart texts of one item_id) and terms: (term, weight times its repeats)."""
    asked = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("item"), F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "item", "term").agg(F.count(F.lit(1)).alias("times"))
    held = index.select(F.explode(F.arrays_zip(F.split("vocabulary", " ").alias("term"), F.col("counts").alias("df"))).alias("p")).select("p.term", "p.df")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long") * F.col("times")
    return asked.join(df, "term").select("item_id", "item", F.struct("term", weight.alias("weight")).alias("t")).groupBy("item_id", "item").agg(F.collect_list("t").alias("terms"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = 256, block_terms: int = 1 << 16, shard_docs: int = 4096) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents among all of ``docs``.

    Only scores above 0 rank, ties by smaller doc_id.  Null texts and texts without a term are in no
    count; an item without a known term returns no rows.  Rows of ``docs`` that share a doc_id
    are documents of their own; a null doc_id comes last among equal scores.  Equal rows of ``items``
    are one item; texts that share an item_id are ranked each by itself.  A very long text is one
    document, its counts as large as its vocabulary.  Empty tables give no rows; other columns are
    ignored.  Items go to all shards in blocks of about ``block_items`` items and ``block_terms`` terms,
    so what is sent to every task is bounded, and the index is read once a block.
    """
    corpus = corpus_size(docs)
    index = build_index(docs, corpus, shard_docs)
    asked = stored(weighted_items(items, index, corpus[0]), "lexical-items")
    n_items, n_terms = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n_items // block_items), -(-n_terms // block_terms))
    mine = F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks))

    def search(batches):
        found, queries = {}, None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row] for c in batch.schema.names}
                if queries is None:
                    queries = [(q["item_id"], q["item"], [t["term"] for t in q["terms"]], np.array([t["weight"] for t in q["terms"]], np.int64)) for q in row["asked"].as_py()]
                shard = Shard(np.frombuffer(row["ids"].as_py(), "<i8"), row["vocabulary"].as_py().split(" "), row["counts"].values.to_numpy(), np.frombuffer(row["bits"].as_py(), np.uint8), np.frombuffer(row["impacts"].as_py(), "<i4"))
                for q, (_, _, words, weights) in enumerate(queries):
                    scores, ids = found.get(q, (np.zeros(0, np.int64),) * 2)
                    found[q] = shard.search(words, weights, k, scores, ids)
        rows = [(*queries[q][:2], d, s) for q, (scores, ids) in found.items() for d, s in zip(ids.tolist(), scores.tolist())]
        if rows:
            kinds = (item_type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["item_id", "item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema["item_id"].dataType)
    shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, item long, doc_id long, score long"
    parts = None
    for block in range(blocks):
        block_row = asked.filter(mine == block).agg(F.collect_list(F.struct("item_id", "item", "terms")).alias("asked"))
        part = index.join(F.broadcast(block_row)).mapInArrow(search, shape)
        parts = part if parts is None else parts.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id", "item").orderBy(F.desc("score"), "doc_id"))
    top = parts.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.select("item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), c AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
i AS (SELECT item_id, item, term, count(*) AS times FROM (SELECT DISTINCT item_id, text AS item, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term, generate_subscripts(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'), 1) AS pos FROM benchmark) GROUP BY ALL),
q AS (SELECT item_id, item, term, times * CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term), c),
s AS (SELECT item_id, item, n.r, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN n ON n.r = p.r, c GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20"""
