"""WARC archives, one Zstandard frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import a_task_each, fresh_path, join_hot, stored
from .shared_files import create, open_stream

# Fixed values of the formats: the dictionary's skippable frame, the records' version line and end.
DICTIONARY_FRAME = 0x184D2A5D
# Fixed value: the magic number of skippable frames, whose last four bits are free.
SKIPPABLE = 0x184D2A50
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
READ, STEP = 1 << 20, 1 << 13


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` with headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}').urn}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
        ("WARC-Page-ID", record_name(page_id)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To-Page", record_name(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError where a header or a length is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"bad header line {name!r}")
        headers[name] = value.strip()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise ValueError(f"missing {missing}")
    length = int(headers["Content-Length"])
    if len(rest) != length + len(END) or not rest.endswith(END):
        raise ValueError("Content-Length does not match the record")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    said = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not said or int(said[1]) != int(headers.setdefault("WARC-Payload-Length", said[1].decode())):
        raise ValueError("bad HTTP header")
    if headers["WARC-Type"] == "response":
        if len(payload) != int(said[1]) or headers["WARC-Payload-Digest"] != "sha1:" + digest_of(payload):
            raise ValueError("payload does not match its length or digest")
    elif payload:
        raise ValueError("a revisit carries a payload")
    return headers, payload


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


class ArchiveWriter:
    """The dictionary's skippable frame, then one frame a record.

    The dictionary is trained on the file's first records, at most ``sample_bytes`` of them; where
    there are too few to train on, their bytes are the dictionary as they are.
    """

    def __init__(self, sink, sample: list[bytes], dictionary_bytes: int, level: int):
        try:
            trained = zstandard.train_dictionary(dictionary_bytes, sample).as_bytes()
        except zstandard.ZstdError:
            trained = b"".join(sample)[:dictionary_bytes].ljust(8, b"\0")
        self.sink = sink
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
        sink.write(struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained)

    def add(self, record: bytes) -> None:
        self.sink.write(self.packer.compress(record))


def read_archive(stream):
    """Records of an archive, decoded frame by frame; holds one record and one read buffer.

    Further skippable frames are passed over.  Raises ValueError where the archive is cut short, or a frame
    cannot be decoded or is no record.
    """
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (None, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    trained = stream.read(size)
    if len(trained) != size:
        raise ValueError("the dictionary is cut short")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    data, at = stream.read(READ), 0
    while data:
        if len(data) - at < 8:
            data, at = data[at:] + stream.read(READ), 0
        magic, size = struct.unpack("<II", data[at : at + 8]) if len(data) - at >= 8 else (0, 0)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + size
            while at >= len(data) and (more := stream.read(READ)):
                data, at = more, at - len(data)
            if at > len(data):
                raise ValueError("a skippable frame is cut short")
            data, at = (data, at) if at < len(data) else (b"", 0)
            continue
        frame, parts = reader.decompressobj(), []
        while True:
            piece = data[at : at + STEP]  # a small view, as what a frame leaves of its input is copied
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame cannot be decoded: {e}") from e
            at += len(piece) - (len(frame.unused_data) if frame.eof else 0)
            if at >= len(data):
                data, at = stream.read(READ), 0
            if frame.eof:
                break
            if not data:
                raise ValueError("the last frame is cut short")
        yield parse_record(b"".join(parts))


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id with an equal payload, null for itself."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("key", F.sha1("payload"))
    firsts = keyed.filter(F.length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first", "n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return join_hot(keyed, firsts, ["key"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 256 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page into archives of the shared folder; returns the manifest (path, records).

    The payload is html in UTF-8, empty for null.  Of equal payloads of ``min_bytes`` or more, the
    smallest page_id is a response and the others revisit it (rows that share that page_id are all
    responses, and so are rows whose equals all have a null page_id).  Repeated rows each get a record;
    an empty table gives no file; other columns are ignored.  A file is closed at ``file_bytes`` of
    payload.
    """
    folder = fresh_path(pages.sparkSession, "warc")

    def write(batches):
        writer, sink, uri, n, held, sample = None, None, "", 0, 0, []

        def begin():
            nonlocal writer, sink, uri
            uri, sink = create(folder, ".warc.zst")
            writer = ArchiveWriter(sink, sample, dictionary_bytes, level)
            for record in sample:
                writer.add(record)
            sample.clear()

        def finish():
            nonlocal writer, n, held
            sink.close()
            row = pa.RecordBatch.from_pydict({"path": [uri], "records": [n]})
            writer, n, held = None, 0, 0
            return row

        for batch in batches:
            payloads = batch.column("payload")
            for i, (page_id, url, refers_to) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")])):
                payload = payloads[i].as_py()
                record = record_bytes(page_id, url, payload, refers_to, date)
                n, held = n + 1, held + len(payload)
                if writer:
                    writer.add(record)
                else:
                    sample.append(record)
                    if held >= sample_bytes:
                        begin()
                if writer and held >= file_bytes:
                    yield finish()
        if sample:
            begin()
        if writer:
            yield finish()

    return stored(with_revisits(pages, min_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated and null page_ids each keep their record; a record whose headers, lengths or digest are wrong,
    or an archive that is cut short, raises ValueError; no archive gives no row.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for headers, _ in read_archive(open_stream(path)):
                    refers_to = page_of(headers.get("WARC-Refers-To-Page"))
                    rows.append((page_of(headers["WARC-Page-ID"]), int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], refers_to))
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [f.split() for f in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])

    return a_task_each(manifest.select("path")).mapInArrow(read, RECORDS)


def read_payloads(manifest: DataFrame) -> DataFrame:
    """page_id and html of every record; a revisit takes the payload of the response it refers to.

    A null html was written, and is read, as an empty one; repeated and null page_ids keep their rows.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for headers, payload in read_archive(open_stream(path)):
                    revisit = headers["WARC-Type"] == "revisit"
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array([page_of(headers["WARC-Page-ID"])], pa.int64()), "digest": [headers["WARC-Payload-Digest"]], "html": pa.array([None if revisit else payload.decode()], pa.string())})

    records = a_task_each(manifest.select("path")).mapInArrow(read, "page_id long, digest string, html string")
    full = records.filter("html IS NOT NULL").groupBy("digest").agg(F.first("html").alias("full"))
    return records.join(full, "digest", "left").select("page_id", F.coalesce("html", "full").alias("html"))
