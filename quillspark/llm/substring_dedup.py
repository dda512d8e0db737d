"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A run of ``window`` words that also starts in a document of smaller doc_id is repeated text.  Every
window holds an anchor, the least hash of its shorter word runs, so equal windows have equal anchors;
neighbouring windows of one anchor are one stretch.  Anchors met in one document only are left out
first.  The stretches of an anchor make up a reference block.  Where all of them are equal, the stretch
is a factor as it stands, and a block of one text needs no parse; neighbouring ones make one longer
factor.  Otherwise the block's stretches are parsed in order of doc_id, each greedily into the longest
factors that the block indexes so far, and the windows that cross a factor's end are looked up too.
What the block did not hold is then appended to it.  Blocks compare words; elsewhere 128 bits of hashes
tell which stretches are equal.  An anchor with many different stretches is routed by whole windows, a
block each, so no block grows with the corpus.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, PIECE = (1 << 63) - 1, 1 << 20
GRAM, HOT_SHARE, SAMPLE_DOCS = 4, 4096, 20_000
WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTOR = 0x100000001B3
POWERS = np.cumprod(np.full(4096, FACTOR, np.uint64), dtype=np.uint64)


def doc_number() -> Column:
    return F.coalesce("given", F.lit(LAST)).alias("doc")


def pieces_of(text: bytes):
    """The text in pieces of about ``PIECE`` bytes, cut between words; a longer word is a piece of its own."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in (b" ", b"\n"))
        if cut <= at:
            cut = min((x for x in (text.find(c, at + PIECE) for c in (b" ", b"\n")) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def piece_hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    inside = WORD[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    sizes = edge[1::2] - edge[::2]
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    offset = np.arange(begin[-1] + sizes[-1]) - np.repeat(begin, sizes)
    h = np.add.reduceat((a[inside].astype(np.uint64) + np.uint64(1)) * POWERS[offset & 4095], begin)
    h ^= h >> np.uint64(31)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text, for routing."""
    return np.concatenate([piece_hashes(x) for x in pieces_of(text)])


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out ^= words[k : k + n]
        out *= MIX
        out ^= out >> np.uint64(29)
    return out


def anchors_of(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: the least hash of its word runs."""
    least, have, want = run_hashes(words, GRAM), 1, window - GRAM + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[: max(0, len(least) - step)], least[step:]), have + step
    return least


def bounds(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class StretchHashes:
    """A hash of any run of words, by prefix sums of one polynomial; its powers are kept and grown."""

    def __init__(self):
        self.up = self.down = powers(1, 1)

    def __call__(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(words) > len(self.up):
            self.up, self.down = (powers(f, 2 * len(words)) for f in (FACTOR, pow(FACTOR, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)))
        out = (sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)
        out ^= out >> np.uint64(32)
        return out * MIX


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def packed(docs: DataFrame) -> DataFrame:
    """The rows with their text compressed, for the shuffle that brings documents together with what is found."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([press.compress(utf8(x.as_py())) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("route", "check", "given")], texts], ["route", "check", "given", "packed"])

    return docs.select("route", "check", "given", "text").mapInArrow(pack, "route long, check long, given long, packed binary")


def document_anchors(docs: DataFrame, window: int, hot: dict[int, int]) -> DataFrame:
    """anchor, same (a hash of the stretch), route, doc and deal of each distinct stretch of each document.

    ``hot`` has in how many parts the rows of hot anchors are dealt; deal is the part, -1 for others.
    """
    keys, parts = np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)

    def found(batches):
        hashed = StretchHashes()

        def each(text):
            words = word_hashes(utf8(text))
            anchor = anchors_of(words, window)
            edge = bounds(anchor)
            start, end = edge[:-1], edge[1:] + window - 1
            pairs = np.stack((anchor[start], hashed(words, start, end)), axis=1) if len(anchor) else np.zeros((0, 2), np.uint64)
            return np.unique(pairs, axis=0) if len(np.unique(pairs[:, 0])) < len(pairs) else pairs

        for batch in batches:
            rows = [each(x.as_py()) for x in batch.column("text")]
            route, doc = (np.repeat(batch.column(c).to_numpy(), [len(x) for x in rows]) for c in ("route", "doc"))
            anchor, same = np.concatenate([*rows, np.zeros((0, 2), np.uint64)]).view(np.int64).T
            deal = np.full(len(anchor), -1, np.int32)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                mixed = (route.view(np.uint64) * MIX) >> np.uint64(33)
                deal = np.where(keys[at] == anchor, mixed.astype(np.int64) % parts[at], -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x.copy()) for x in (anchor, same, route, doc, deal)], ["anchor", "same", "route", "doc", "deal"])

    return docs.select("route", doc_number(), "text").mapInArrow(found, "anchor long, same long, route long, doc long, deal int")


def hot_anchors(docs: DataFrame, window: int) -> dict[int, int]:
    """Anchors that hold over 1/HOT_SHARE of the stretches of a sample, so under HOT_SHARE of them, and in how
    many parts to deal their rows.  They steer how rows are dealt, and no result."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    sample = document_anchors(docs.filter(F.pmod(F.xxhash64("route", "check"), F.lit(step)) == 0), window, {})
    counted = sample.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = counted.agg(F.sum("n")).first()[0] or 0
    return {r["anchor"]: -(-r["n"] * HOT_SHARE // rows) for r in counted.filter(F.col("n") * HOT_SHARE > rows).collect()}


def contested_anchors(anchors: DataFrame) -> DataFrame:
    """route and anchors: of each document, what anchors it shares with others, and a fact about each.

    The fact is how many stretches an anchor has where these differ; where all are equal, it is -1 less
    the first document.  Hot anchors, whose rows are dealt, are summed up by themselves.
    """
    dealt = anchors.repartition("anchor", "deal")
    facts = {"n": F.count(F.lit(1)), "first": F.min("doc"), "last": F.max("doc"), "least": F.min("same"), "most": F.max("same")}
    # All columns are asked for and nothing is filtered before, so that this and the windows below read one
    # exchange; anchors that are not hot are one group of it, which is left out after.
    hot = dealt.groupBy(F.when(F.col("deal") >= 0, F.col("anchor")).alias("hot")).agg(*[f.alias(f"all_{k}") for k, f in facts.items()], F.max("route").alias("any"), F.max("deal").alias("deals"))
    hot = hot.filter("deals >= 0").drop("any", "deals")
    here = Window.partitionBy("anchor", "deal")
    met = dealt.select("anchor", "route", *[f.over(here).alias(k) for k, f in facts.items()])
    known = met.join(F.broadcast(hot), met["anchor"] == hot["hot"], "left")
    value = {k: F.coalesce(f"all_{k}", k) for k in facts}
    fact = F.when(value["least"] < value["most"], value["n"]).otherwise(-1 - value["first"])
    return known.filter(value["first"] < value["last"]).select("route", F.struct("anchor", fact.alias("fact")).alias("a")).groupBy("route").agg(F.collect_set("a").alias("anchors"))


CUT = "key long, body binary, n int, parts int, doc long, check long, route long, at int"


def stretches(docs: DataFrame, window: int, block_rows: int, by_window: bool) -> DataFrame:
    """The rows CUT of contested stretches; n counts words.

    Those of anchors with more than ``block_rows`` come window by window, keyed by their own hash, where
    ``by_window``, and parts says in how many parts to deal their rows.  Else the others come: whole, keyed by the anchor, where its stretches differ; and
    without a body where they are equal and an earlier document has them, run together where they touch.
    """

    def cut(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in CUT.split(", ")]
            for doc, check, route, text, shared in zip(*[batch.column(c).to_pylist() for c in ("doc", "check", "route", "packed", "anchors")]):
                held = {a["anchor"]: a["fact"] for a in shared}
                text = press.decompress(text)
                hashes = word_hashes(text)
                anchor = anchors_of(hashes, window).view(np.int64)
                whole = run_hashes(hashes, window).view(np.int64) if by_window else None
                edge = bounds(anchor)
                rows, words, run = [], None, None
                for a, b, k in zip(edge[:-1].tolist(), edge[1:].tolist(), anchor[edge[:-1]].tolist()):
                    fact = held.get(k, 0)
                    if by_window and fact > block_rows:
                        words = words or text.split()
                        rows += [(int(whole[i]), b" ".join(words[i : i + window]), [i, i + window], -(-fact // block_rows)) for i in range(a, b)]
                    elif not by_window and 0 < fact <= block_rows:
                        words = words or text.split()
                        rows.append((k, b" ".join(words[a : b + window - 1]), [a, b + window - 1], None))
                    elif not by_window and fact < 0 and doc > -1 - fact:
                        if run and a <= run[1]:
                            run[1] = b + window - 1
                        else:
                            run = [a, b + window - 1]
                            rows.append((route, None, run, None))
                for key, body, (i, j), parts in rows:
                    for column, value in zip(out, (key, body, j - i, parts, doc, check, route, i)):
                        column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in CUT.split(", ")])

    return docs.select(doc_number(), "check", "route", "packed", "anchors").mapInArrow(cut, CUT)


class Block:
    """A reference block: words in stretches, and where each window of them begins."""

    def __init__(self, window: int):
        self.window, self.words, self.place = window, [], {}

    def add(self, words: list[bytes]) -> None:
        """Append a stretch where it holds a window that the block does not."""
        new = [i for i in range(len(words) - self.window + 1) if b" ".join(words[i : i + self.window]) not in self.place]
        if new:
            base = len(self.words)
            self.words += [*words, None]
            for i in new:
                self.place.setdefault(b" ".join(words[i : i + self.window]), base + i)

    def factors(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, length) of the parts of ``words`` that windows of the block cover.

        Greedy: the factor at a place runs on while the reference does.  The windows that cross its end
        begin in its last words; they are looked up before the parse goes on behind it.
        """
        found, i = [], 0
        while i + self.window <= len(words):
            at = self.place.get(b" ".join(words[i : i + self.window]))
            if at is None:
                i += 1
                continue
            n = self.window
            while i + n < len(words) and self.words[at + n] == words[i + n]:
                n += 1
            if found and i <= sum(found[-1]):
                found[-1] = (found[-1][0], i + n - found[-1][0])
            else:
                found.append((i, n))
            i += n - self.window + 1
        return found


SPANS = "route long, check long, at int, n int"


def parsed(found: DataFrame, window: int) -> DataFrame:
    """The spans of stretches that earlier documents of their block hold; those without a body are spans already."""

    def parse(batches):
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("key", "doc", "body", "n", "check", "route", "at")]))
        out = []

        def full():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], [c.split()[0] for c in SPANS.split(", ")])

        for _, group in groupby(rows, lambda r: r[0]):
            block = Block(window)
            for _, of_document in groupby(group, lambda r: r[1]):
                added = []
                for _, _, body, n, check, route, at in of_document:
                    if body is None:
                        out.append((route, check, at, n))
                        continue
                    words = body.split(b" ")
                    out += [(route, check, at + a, k) for a, k in block.factors(words)]
                    added.append(words)
                for words in added:
                    block.add(words)
                if len(out) >= 4096:
                    yield full()
                    out.clear()
        if out:
            yield full()

    placed = found.repartition("key").sortWithinPartitions("key", "doc")
    return placed.select("key", "doc", "body", "n", "check", "route", "at").mapInArrow(parse, SPANS)


def repeated_windows(found: DataFrame) -> DataFrame:
    """The spans of windows that an earlier document holds; equal ones are aggregated first, and hot ones dealt."""
    rows = found.select("key", F.xxhash64("body").alias("same"), F.pmod(F.xxhash64("route"), "parts").cast("int").alias("part"), "parts", "doc", "route", "check", "at", "n")
    first = rows.groupBy("key", "same").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("parts").alias("parts")).filter(F.col("first") < F.col("last"))
    each = first.select("key", "same", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.drop("parts").join(each, ["key", "same", "part"]).filter(F.col("doc") > F.col("first")).select("route", "check", "at", "n")


def remove_repeats(docs: DataFrame, window: int = 13, block_rows: int = 4_000) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words that stay, single blanks between) of every row.

    A word goes where a run of ``window`` words covers it that also starts in a document of smaller
    doc_id; runs are judged on the input.  Words are what blanks, tabs and line ends separate, compared
    as they are.  Rows that share a doc_id, repeated rows too, count as one document; null doc_ids count
    as one document that comes last.  A null or empty text has no words and stays empty; texts under
    ``window`` words stay whole.  An anchor of over ``block_rows`` documents is split.  A very long text is hashed in pieces; its words are one task's.  An
    empty table gives no rows; other columns are ignored.
    """
    if window < GRAM:
        raise ValueError(f"a window holds {GRAM} words at least")
    number, check = F.col("doc_id").cast("long"), F.xxhash64("text")
    keyed = docs.select(F.coalesce(number, check).alias("route"), check.alias("check"), number.alias("given"), "text")
    anchors = document_anchors(keyed, window, hot_anchors(keyed, window))
    at_home = packed(keyed).repartition("route")
    shared = at_home.join(contested_anchors(anchors), "route")
    many = shared.filter(F.exists("anchors", lambda a: a["fact"] > block_rows))
    blocks = parsed(stretches(shared, window, block_rows, False), window)
    spans = blocks.unionByName(repeated_windows(stretches(many, window, block_rows, True)))
    gone = spans.groupBy("route").agg(F.collect_list(F.struct("check", "at", "n")).alias("gone"))

    def keep(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for check, text, gone in zip(*[batch.column(c).to_pylist() for c in ("check", "packed", "gone")]):
                words = press.decompress(text).split()
                stays = np.ones(len(words), bool)
                for s in gone or ():
                    if s["check"] == check:
                        stays[s["at"] : s["at"] + s["n"]] = False
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                texts.append(b" ".join([w for w, s in zip(words, stays.tolist()) if s] if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    rows = at_home.join(gone, "route", "left").select("given", "check", "packed", "gone")
    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, text string")
