"""Near-copies by SimHash, beyond the radius of op2: BK-trees find them in shards, exact Jaccard decides.

Texts of equal shingle sets are one node.  At a similarity of 0.8 fingerprints differ in some ten bits
of 64 and up to twenty, more than equal blocks of bits can be cut for, so shards are dealt by bands of
min-hashes: with 40 bands of five, a pair at 0.8 shares none with a chance of 1.3e-7.  Shards of the
same members are one.  The fingerprints of a shard hang in a BK-tree and a search follows the edges
within ``RADIUS``; what it finds is linked where the Jaccard similarity of the sets says so.  Pairs of
a shard beyond the radius that are in no common group by then are compared too, so none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .simhash import LAST, Forest, chosen_rows, components, majority_bits, shingle_hashes

# Bands, min-hashes a band, and the multipliers and offsets that make them.
BANDS, ROWS, BLOCK = 40, 5, 1024
# Bits that fingerprints of similar texts differ in, pairs held at once, and shingles of the shards searched at once.
RADIUS, PAIRS, BUFFER = 20, 1 << 18, 1 << 18
FACTORS, OFFSETS = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
FACTORS |= np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles in rising order; empty without words."""
    found = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """One number a band, which two sets share where all its min-hashes are the same."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK] * FACTORS + OFFSETS).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(32)
    return key


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def set_bits(found: np.ndarray) -> int:
    """The SimHash fingerprint of a shingle set."""
    return majority_bits(found[at : at + (1 << 16)] for at in range(0, len(found), 1 << 16))


def spread(of: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``of`` beside every number from its start to before its stop."""
    n = stop - start
    return np.repeat(of, n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def spanning_pairs(group: np.ndarray, fp: np.ndarray, is_tree: np.ndarray, sets: list[np.ndarray], least: float, radius: int = RADIUS):
    """Pairs (query, tree) of similar rows that join all that similar pairs inside each group join.

    Rows come group by group.  Each query is compared with what its group's BK-tree holds within
    ``radius`` of it, the nearest first, until it is joined; then with the rest of the group that it is
    not joined with.  Where all rows are trees, each is a query to the rows before it.
    """
    parent = list(range(len(fp)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def joined(q: np.ndarray, t: np.ndarray):
        """The pairs that join: of each query and each group of trees joined before, up to the first similar one."""
        rows, at = np.unique(t, return_inverse=True)
        label = np.array([top(i) for i in rows.tolist()], np.int64)[at]
        order = np.lexsort((np.bitwise_count(fp[q] ^ fp[t]), label, q))
        q, t, label = q[order], t[order], label[order]
        starts = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (label[1:] != label[:-1])))[: len(q)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(q)]):
            x, y = top(int(q[a])), top(int(label[a]))
            if x != y:
                k = next((k for k in range(a, b) if similar(sets[q[k]], sets[t[k]], least)), None)
                if k is not None:
                    parent[max(x, y)] = min(x, y)
                    yield int(q[k]), int(t[k])

    def possible(q: np.ndarray, t: np.ndarray):
        """Pairs in order, whose sizes allow for the similarity."""
        keep = np.minimum(size[q], size[t]) >= least * np.maximum(size[q], size[t]) - 1e-9
        keep &= (t < q) | (not whole)
        return q[keep], t[keep]

    tree, size = np.flatnonzero(is_tree), np.fromiter(map(len, sets), np.int64, len(sets))
    whole = len(tree) == len(fp)
    queries = tree if whole else np.flatnonzero(~is_tree)
    if not len(tree) or not len(queries):
        return
    leaves, leaf = np.unique(np.stack([group[tree].astype(np.uint64), fp[tree]]), axis=1, return_inverse=True)
    forest, held = Forest(*leaves), np.argsort(leaf.ravel(), kind="stable")
    first = np.searchsorted(leaf.ravel()[held], np.arange(leaves.shape[1] + 1))
    low, high = (np.searchsorted(group[tree], group[queries], side) for side in ("left", "right"))
    block = max(1, PAIRS // max(1, int((high - low).max())))
    for at in range(0, len(queries), block):
        part = queries[at : at + block]
        q, node = forest.within(group[part].astype(np.uint64), fp[part], radius)
        q, t = spread(part[q], first[node], first[node + 1])
        yield from joined(*possible(q, tree[held[t]]))
        q, t = spread(part, low[at : at + block], high[at : at + block])
        q, t = possible(q, tree[t])
        rest = np.bitwise_count(fp[q] ^ fp[t]) > radius
        yield from joined(q[rest], t[rest])


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """_key, text_key, node (a hash of the shingle set), size and bands of every row of (_key, text_key, text)."""

    def sketched(batches):
        for batch in batches:
            sets = [shingle_set(x or "", shingle) for x in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64)
            keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64)))
            columns = [batch.column("_key"), batch.column("text_key"), pa.array(node.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "text_key", "node", "size", "bands"])

    return docs.select("_key", "text_key", "text").mapInArrow(sketched, "_key long, text_key long, node long, size long, bands array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, found (the shingle set as bytes) and fp (its fingerprint's bits as a long) of every row of (node, text)."""

    def hashed(batches):
        for batch in batches:
            sets = [shingle_set(x or "", shingle) for x in batch.column("text").to_pylist()]
            fps = np.array(list(map(set_bits, sets)), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(fps)], ["node", "found", "fp"])

    return docs.select("node", "text").mapInArrow(hashed, "node long, found binary, fp long")


def similar_links(nodes: DataFrame, keyed_docs: DataFrame, least: float, shingle: int, shard_size: int) -> DataFrame:
    """a, b: links that connect exactly what chains of similar pairs that share a band connect.

    nodes: node, r (the _key and text_key of a row that holds it), size, bands.  A shard of over
    ``shard_size`` shingles is cut into parts, and each part meets each part.
    """
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    shards = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), *same).filter("n > 1")
    shards = shards.groupBy("n", "volume", "m1", "m2").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("volume") / F.lit(shard_size)).cast("int")
    met = stored(keyed.join(shards.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "band-shards")
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", "r._key", "r.text_key")
    sets = stored(shingle_sets(keyed_docs.join(wanted, ["_key", "text_key"]).dropDuplicates(["node"]), shingle), "shingle-sets")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    dealt = met.select("key", "node", "part", F.explode(pairs).alias("p")).select("key", "node", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "part")

    def search(batches):
        rows, now, number, volume = [], None, -1, 0

        def out():
            group, same, is_tree, node, fp, found = map(list, zip(*rows))
            group, same, is_tree, fp = np.array(group), np.array(same), np.array(is_tree), np.array(fp, np.int64).view(np.uint64)
            ends = []
            for of in (np.flatnonzero(same), np.flatnonzero(~same)):
                sets = [np.frombuffer(found[k], np.uint64) for k in of]
                ends += [(node[of[q]], node[of[t]]) for q, t in spanning_pairs(group[of], fp[of], is_tree[of], sets, least)]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, i, j, part, node, fp, found in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "node", "fp", "found")]):
                if (key, i, j) != now:
                    if volume >= BUFFER:
                        yield out()
                        rows, volume = [], 0
                    now, number = (key, i, j), number + 1
                rows.append((number, i == j, part == i, node, fp, found))
                volume += len(found) // 8 + 1
        if rows:
            yield out()

    where = ["key", "i", "j"]
    brought = dealt.join(sets, "node").repartition(*where).sortWithinPartitions(*where)
    return brought.select("key", "i", "j", "part", "node", "fp", "found").mapInArrow(search, "a long, b long").distinct()


def keep_one_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, shard_size: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` less all but one of each group that similar pairs join.

    Two texts are similar where their sets of ``shingle``-word runs have a Jaccard similarity of
    ``least`` or more (0.8 at least, which the bands are made for); a text of fewer words is one run,
    and texts without words, or null, are the same.  The row of the smallest doc_id stays, null ids
    last; among rows that share it, the one of the smallest text hash, and one of equal rows.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bands serve similarities of 0.8 to 1")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"), F.xxhash64("text").alias("text_key"), "text")
    rows = stored(sketches(keyed, shingle), "sketches")
    best = rows.groupBy("node").agg(F.min(F.struct("_key", "text_key", "size", "bands")).alias("r"))
    nodes = stored(best.select("node", "r", "r.size", "r.bands"), "sketch-nodes")
    root = components(similar_links(nodes, keyed, least, shingle, shard_size))
    joined = nodes.select("node", "r._key", "r.text_key").join(root, "node", "left")
    chosen = joined.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("_key", "text_key")).alias("r")).select("r._key", "r.text_key")
    return chosen_rows(docs, chosen)
