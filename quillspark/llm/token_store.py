"""Token ids in fixed-width bit-packed files.

File: a 32-byte header, the packed blocks, then a footer of document rows and block offsets and
a 16-byte tail that holds the footer's place and size.  Each id takes ``bits_for(vocabulary)``
bits, least significant bit first; every block but the last holds ``block_ids`` ids, so any id's
place follows from its number and blocks are unpacked by numpy alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import a_task_each, fresh_path, stored
from .shared_files import create, open_random
from .word_memo import memo_for, text_ids, texts_of

HEADER, TAIL = struct.Struct("<8sIIQQ"), struct.Struct("<QQ")
MAGIC = b"IDPACK01"
DOC_ROW = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n", "<u8")])


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class IdWriter:
    """Writes documents one after another; holds one open block and the document rows."""

    def __init__(self, sink, vocabulary: int, block_ids: int):
        self.sink, self.bits, self.block_ids = sink, bits_for(vocabulary), block_ids
        self.pending, self.n_pending, self.n_ids, self.rows, self.offsets, self.at = [], 0, 0, [], [], HEADER.size
        sink.write(HEADER.pack(MAGIC, self.bits, block_ids, vocabulary, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            self.flush(self.n_pending // self.block_ids)

    def flush(self, blocks: int) -> None:
        ids = np.concatenate(self.pending)
        for k in range(blocks):
            self.write(ids[k * self.block_ids : (k + 1) * self.block_ids])
        rest = ids[blocks * self.block_ids :]
        self.pending, self.n_pending = [rest], len(rest)

    def write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(data)
        self.sink.write(data)

    def close(self) -> None:
        if self.n_pending:
            self.write(np.concatenate(self.pending))
        rows, offsets = np.array(self.rows, DOC_ROW), np.array(self.offsets, "<u8")
        footer = struct.pack("<QQQ", len(rows), len(offsets), self.n_ids) + rows.tobytes() + offsets.tobytes()
        self.sink.write(footer + TAIL.pack(self.at, len(footer)))
        self.sink.close()


class IdReader:
    """Random access to a file: ``ids(start, n)`` reads the blocks that hold the range, no others."""

    def __init__(self, source):
        self.source, size = source, source.size()
        magic, self.bits, self.block_ids, self.vocabulary, _ = HEADER.unpack(source.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at, n = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        footer = source.read_at(n, at)
        n_docs, n_blocks, self.n_ids = struct.unpack_from("<QQQ", footer)
        self.docs = np.frombuffer(footer, DOC_ROW, n_docs, 24)
        self.offsets = np.append(np.frombuffer(footer, "<u8", n_blocks, 24 + n_docs * DOC_ROW.itemsize), at).astype(np.int64)
        self.block, self.block_no = np.zeros(0, "<u4"), -1

    def read_block(self, k: int) -> np.ndarray:
        if k != self.block_no:
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            data = self.source.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.block, self.block_no = unpack(data, self.bits, n), k
        return self.block

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, end = [], start + n
        while start < end:
            k, inside = divmod(start, self.block_ids)
            parts.append(self.read_block(k)[inside : inside + end - start])
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("file", T.IntegerType()), ("path", T.StringType()), ("docs", T.LongType()), ("ids", T.LongType()))])


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int | None = None, block_ids: int = 1 << 16, file_ids: int = 1 << 26, file_docs: int = 1 << 18) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending doc_id order.

    Returns the manifest (part, file, path, docs, ids), one row a file, in doc_id order by part and file.
    Ids take the bits of ``vocabulary``, by default that of the tokenizer.  A file is closed at ``file_ids``
    ids or ``file_docs`` documents, so a task holds one block and at most that many document rows.  A null
    text counts as empty; null doc_ids come first; repeated doc_ids each keep their row, texts in order;
    an empty table gives no file; other columns are ignored.
    """
    folder = fresh_path(docs.sparkSession, "packed-ids")

    def write(batches):
        from pyspark import TaskContext

        memo, writer, uri, file = memo_for(tokenizer_path, spaced=False), None, "", 0
        n_vocabulary = vocabulary or max(memo.tokenizer.get_vocab_size(), end_id + 1)

        def finish():
            writer.close()
            part = TaskContext.get().partitionId()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [uri], "docs": [len(writer.rows)], "ids": [writer.n_ids]})

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, text_ids(texts_of(batch, "text"), memo)):
                if writer is None:
                    uri, sink = create(folder, ".ids")
                    writer = IdWriter(sink, n_vocabulary, block_ids)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if writer.n_ids >= file_ids or len(writer.rows) >= file_docs:
                    yield finish()
                    writer, file = None, file + 1
        if writer:
            yield finish()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "packed-ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    One row for each row that was written, null and repeated doc_ids included; no file gives no row.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = IdReader(open_random(path))
                for at in range(0, len(reader.docs), 10_000):
                    rows = reader.docs[at : at + 10_000]
                    crcs = [zlib.crc32(reader.ids(int(r["start"]), int(r["n"])).tobytes()) for r in rows]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(rows["doc_id"], pa.int64(), mask=rows["has_id"] == 0),
                            "start": pa.array(rows["start"].astype(np.int64) + base),
                            "n_tokens": pa.array(rows["n"].astype(np.int64)),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    return a_task_each(files.select("path", "base")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
