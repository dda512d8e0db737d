"""Language identification by rank-order profiles of n-grams and the out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .word_memo import slices, texts_of

UNKNOWN = "und"
TABLE, MOST = 1 << 16, (1 << 63) - 1


class Grams:
    """Counts of the 1-, 2- and 3-grams of a text's lower-case letters, words parted by one blank.

    The ``TABLE`` most usual BMP letters get codes of their own; grams are 64-bit numbers, so none
    collide.  Counting sorts nothing but the distinct grams of one text.
    """

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3)):
        self.orders = orders
        codes = np.zeros(TABLE, np.uint32)
        for i in range(TABLE):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                codes[i] = ord(low) if len(low) == 1 else i
        self.codes = codes

    def letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = self.codes[np.minimum(points, TABLE - 1)]
        if len(points) and points.max() >= TABLE:
            far = np.flatnonzero(points >= TABLE)
            low[far] = [p if chr(p).isalpha() else 0 for p in points[far]]
        keep = np.ones(len(low) + 2, bool)
        padded = np.zeros(len(low) + 2, np.uint32)
        padded[1:-1] = low
        keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
        return padded[keep].astype(np.uint64)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams and their counts; the lone blank is no gram."""
        x = self.letters(text)
        if len(x) < 3:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts = [x[1:-1][x[1:-1] != 0]]
        if 2 in self.orders:
            parts.append((x[:-1] << np.uint64(21) | x[1:]) | np.uint64(1 << 63))
        if 3 in self.orders:
            three = x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]
            parts.append(three[x[1:-1] != 0])
        return np.unique(np.concatenate(parts), return_counts=True)

    def ranked(self, text: str, size: int) -> np.ndarray:
        """The ``size`` most frequent grams, most frequent first, ties by the gram."""
        grams, n = self.counts(text)
        if len(grams) > size:
            floor = np.partition(n, len(n) - size)[len(n) - size]
            keep = n >= floor
            grams, n = grams[keep], n[keep]
        return grams[np.lexsort((grams, -n))[:size]]


def fold_of(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4


def learn_profiles(labelled: DataFrame, size: int = 400, max_documents: int = 5_000) -> dict[str, np.ndarray]:
    """Per language its ``size`` most frequent grams over a bounded sample of (text, lang) rows.

    The sample holds about ``max_documents`` distinct texts of each language, chosen by a hash of the
    text, so it depends neither on the order of rows nor on their repeats; a language with no more texts
    is used whole.  Rows of a null text or lang teach nothing; without labelled rows the result is empty.
    Languages are taken to be few: a count and ``size`` grams of each reach the driver.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    hashed = F.xxhash64("text")
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.02).alias("n")).collect()}
    least = F.lit(0).cast("long")
    for lang, n in sorted(texts.items()):
        if n > max_documents:
            least = F.when(F.col("lang") == lang, F.lit(MOST - MOST * max_documents // n)).otherwise(least)
    rows = rows.filter(hashed.bitwiseAND(MOST) >= least).dropDuplicates()

    def count(batches):
        grams, held = Grams(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                totals = held.setdefault(lang, {})
                for g, c in zip(*[a.tolist() for a in grams.counts(text)]):
                    totals[g] = totals.get(g, 0) + c
            for lang, totals in held.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(totals), "gram": pa.array(np.array(list(totals), np.uint64).view(np.int64)), "n": pa.array(list(totals.values()), pa.int64())})
            held = {}

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    unsigned = F.col("gram") < 0
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), unsigned, "gram"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect()  # size rows a language
    profiles: dict[str, list[int]] = {}
    for row in top:
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in profiles.items()}


class Profiles:
    """Ranks of every profile's grams in one sorted table, so a text is compared to all at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size, self.grams = sorted(profiles), size, Grams()
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.uint64)]))
        self.ranks = np.full((len(self.langs), len(self.known)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        """Nearest language, ties to the first by name, and 1 - distance / greatest distance."""
        ranked = self.grams.ranked(text, self.size)
        if not len(ranked) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, ranked), len(self.known) - 1)
        ranks = np.where(self.known[at] == ranked, self.ranks[:, at], -1)
        places = np.where(ranks >= 0, np.abs(ranks - np.arange(len(ranked))), self.size)
        distance = places.sum(axis=1)
        k = int(np.argmin(distance))
        return self.langs[k], float(1 - distance[k] / (self.size * len(ranked)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score (0 to 1) of each whole text.

    ``und`` and 0 for a text that is null or has no letter.  Rows are judged one by one, so repeats,
    ties and null ids need no rule; lang_pred and score columns of the input are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")
    fields = list(docs.schema.fields)
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches):
        table = Profiles(profiles, size)
        for batch in batches:
            said = [table.predict(text) for part in slices(texts_of(batch, "text")) for text in part.to_pylist()]
            columns = [*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(judge, schema)


def held_out_languages(docs: DataFrame, size: int = 400, max_documents: int = 5_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles are learned from the folds that are not held out.

    A null doc_id is in no fold and so not held out.  Every row is judged, repeats and all; a text that is
    null or without letters, or any text where nothing could be learned, is ``und`` with score 0; ties go
    to the first language by name; an empty table gives no row; other columns are ignored.
    """
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    profiles = learn_profiles(docs.filter(~held_out), size, max_documents)
    said = identify(docs.select("doc_id", "text"), profiles, size)
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
