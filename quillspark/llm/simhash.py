"""SimHash near-duplicates: sharded BK-trees find the links, alternating stars the components.

Equal fingerprints are one node.  Two fingerprints within ``radius`` bits agree on two whole blocks of
five, so nodes meet in shards keyed by two blocks, ten ways.  A shard's fingerprints hang in BK-trees
(a child's edge is its Hamming distance to the parent) and a search follows edges within the radius
only.  Shards reach their tasks by the shuffle, not by a broadcast, since the trees grow with the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relational import join_dealt

from .shared import join_hot, stored, unused

SEED, BLOCK, LAST = 42, 1 << 16, (1 << 63) - 1
# The widths of the five blocks that make up 64 bits.
WIDTHS = (13, 13, 13, 13, 12)
BUFFER = 1 << 16


def shingle_hashes(text: str, shingle: int):
    """Hashes of a text's word shingles, in order, at most ``BLOCK`` at a time; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK][: n - at].tolist(), last[at : at + BLOCK].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")


def majority_bits(parts) -> int:
    """The bits set in over half of all hashes of ``parts``, arrays of them, as an unsigned number."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the hashes of a text's word shingles, as an unsigned number; 0 without words."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one doc_id apart) and fp (a long whose bits are the
    fingerprint) of every row; a null text has no words."""

    def hashed(batches):
        for batch in batches:
            fps = [fingerprint(x or "", shingle) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(hashed, "doc_id long, text_key long, fp long")


class Forest:
    """BK-trees over the distinct values of several groups at once; ``child[i, d]`` is i's child at distance d."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        self.value, n = value, len(value)
        self.child = np.full((n, 65), -1, np.int32)
        self.groups, self.root = np.unique(group, return_index=True)
        at = self.root[np.searchsorted(self.groups, group)]
        waiting = np.flatnonzero(at != np.arange(n))
        at = at[waiting]
        while len(waiting):
            d = np.bitwise_count(value[waiting] ^ value[at]).astype(np.int64)
            edge = at.astype(np.int64) * 65 + d
            held = self.child.ravel()
            free = np.flatnonzero(held[edge] < 0)
            _, first = np.unique(edge[free], return_index=True)
            held[edge[free[first]]] = waiting[free[first]]
            at = held[edge]
            more = at != waiting
            waiting, at = waiting[more], at[more]

    def within(self, group: np.ndarray, value: np.ndarray, radius: int):
        """(query, node) pairs at most ``radius`` bits apart, level by level along the edges that can lead to one."""
        where = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        query = np.flatnonzero(self.groups[where] == group)
        node = self.root[where[query]]
        found = []
        while len(query):
            d = np.bitwise_count(value[query] ^ self.value[node]).astype(np.int64)
            near = d <= radius
            found.append((query[near], node[near]))
            steps = []
            for delta in range(-radius, radius + 1):
                edge = d + delta
                ok = (edge >= 0) & (edge <= 64)
                to = self.child[node[ok], edge[ok]]
                steps.append((query[ok][to >= 0], to[to >= 0]))
            query, node = (np.concatenate(x) for x in zip(*steps))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def spanning_links(group: np.ndarray, value: np.ndarray, is_tree: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) that join what lies within ``radius`` inside each group: a forest, not all pairs."""
    n = len(value)
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree = np.flatnonzero(is_tree)
    if not len(tree):
        return value[:0], value[:0]
    forest = Forest(group[tree], value[tree])
    whole = bool(is_tree.all())
    queries = tree if whole else np.flatnonzero(~is_tree)
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        q, node = forest.within(group[part], value[part], radius)
        q, node = part[q], tree[node]
        keep = node < q if whole else node != q
        q, node = q[keep], node[keep]
        roots = np.array([top(i) for i in np.unique(node)]) if len(node) else node
        labels = roots[np.searchsorted(np.unique(node), node)] if len(node) else node
        for a, b in np.unique(np.stack([q, labels], axis=1), axis=0).tolist() if len(q) else ():
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([top(i) for i in range(n)], np.int64)
    moved = np.flatnonzero(roots != np.arange(n))
    return value[moved], value[roots[moved]]


def shard_keys(fp, radius: int):
    """Keys of the shards that ``fp`` belongs to: any two fingerprints within 3 bits share one."""
    if not 0 <= radius <= 3:
        raise ValueError("five blocks of which two must agree serve a radius of 0 to 3")
    masks, low = [], 0
    for width in WIDTHS:
        masks.append(((1 << width) - 1) << low)
        low += width
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(a | b)))) for k, (a, b) in enumerate(combinations(masks, 2))])


def links(nodes: DataFrame, radius: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """a, b: links that connect exactly what chains of steps of ``radius`` bits connect among distinct ``fp``.

    A shard of over ``shard_rows`` fingerprints is cut into parts, and each part's trees meet each part:
    no task holds more than two parts, and no pair is lost.
    """
    keyed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    met = keyed.join(shared, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    dealt = met.select("key", "fp", "part", F.explode(pairs).alias("p")).select("key", "fp", F.col("p.i").alias("i"), F.col("p.j").alias("j"), (F.col("part") == F.col("p.i")).alias("is_tree"))

    def search(batches):
        held, n = [], 0

        def out(table):
            key = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            new = np.ones(len(key[0]), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            same = key[1] == key[2]
            is_tree = table.column("is_tree").to_numpy() | same
            group, value = np.cumsum(new), table.column("fp").to_numpy().view(np.uint64)
            whole = np.flatnonzero(same)
            for rows in (whole, np.flatnonzero(~same)):
                a, b = spanning_links(group[rows], value[rows], is_tree[rows], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BUFFER:
                table = pa.Table.from_batches(held).combine_chunks()
                last = [table.column(c)[n - 1].as_py() for c in ("key", "i", "j")]
                open_group = np.all([table.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)], axis=0)
                cut = n - int(open_group.sum())
                if cut:
                    yield from out(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).to_batches()
                    n -= cut
        if n:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    where = ["key", "i", "j"]
    return dealt.repartition(*where).sortWithinPartitions(*where).select("key", "i", "j", "is_tree", "fp").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of every node that an edge touches, by alternating large-star and small-star rounds.

    A round is written to the shared folder, so lineage stays short; the rounds end when the edges no
    longer change, and an error is raised should that take over ``max_rounds``.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_dealt(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "stars")
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_dealt(large, floor, ["a"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(small.filter("a <> b").distinct(), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def labelled(docs: DataFrame, radius: int, shingle: int) -> DataFrame:
    """doc_id, text_key, fp and component_id of every row."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "fingerprint-nodes")
    root = components(links(nodes, radius))
    joined = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_hot(joined, smallest, ["root"], "inner").select("fp", "root", "component_id", F.col("rows").alias("n"))
    return join_hot(rows, named, ["fp"], "inner")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Rows link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that links
    reach, null where every row reached has a null doc_id.  A null or wordless text has fingerprint
    zero and links like any other.  Repeated rows each keep theirs; an empty table gives no row; other
    columns are ignored.
    """
    return labelled(docs, radius, shingle).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate component.

    The row of the smallest doc_id stays, null ids last; among rows that share it, the one of the
    smallest text hash, and one of equal rows.
    """
    first = labelled(docs, radius, shingle).select("root", F.coalesce("doc_id", F.lit(LAST)).alias("key"), "text_key").groupBy("root").agg(F.min(F.struct("key", "text_key")).alias("r"))
    return chosen_rows(docs, first.select("r.key", "r.text_key"))


def chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (key, text_key) of ``chosen``: doc_id, ``LAST`` for null, and the text's hash."""
    name = unused(docs.columns)
    keys = [name("key"), name("text_key")]
    keyed = docs.withColumns({keys[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), keys[1]: F.xxhash64("text")})
    return keyed.join(chosen.toDF(*keys), keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
