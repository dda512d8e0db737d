"""Which of many phrases each of many texts contains, without a pair of every text and phrase."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(texts: DataFrame, phrases: DataFrame, block_chars: int = 4_000_000) -> DataFrame:
    """``texts`` (id, text) with hits, the distinct phrases (phrase) that a text contains in any case, sorted.

    A task builds one automaton of a block of phrases and reads each text once, however many phrases there
    are; phrases are dealt into blocks of about ``block_chars`` characters, and the texts are read once a
    block.  A phrase counts anywhere, also within a word.  Phrases that are null or empty are left out; a
    null text has null hits; phrases that differ in case only are hits of their own.  Rows that share an
    id must be told apart by the caller where there are several blocks.
    """
    known = phrases.select("phrase").filter("phrase <> ''").distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("phrase") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    rows = texts.select("id", F.lower("text").alias("low"))
    id_type = rows.schema["id"].dataType.simpleString()

    def search(batches):
        tree = None
        for batch in batches:
            if tree is None and batch.num_rows:
                tree = ahocorasick.Automaton()
                by_low = {}
                for p in batch.column("block")[0].as_py():
                    by_low.setdefault(p["low"], []).append(p["phrase"])
                for low, found in by_low.items():
                    tree.add_word(low, found)
                tree.make_automaton()
            hits = [None if low is None else sorted({p for _, found in tree.iter(low) for p in found} if len(tree) else ()) for low in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hits, pa.list_(pa.string()))], ["id", "hits"])

    parts = []
    for k in range(blocks):
        mine = known.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("phrase", F.lower("phrase").alias("low"))).alias("block"))
        parts.append(rows.join(F.broadcast(mine)).mapInArrow(search, f"id {id_type}, hits array<string>"))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.count("hits").alias("n"))
    return joined.select("id", F.when(F.col("n") > 0, F.col("hits")).alias("hits"))
