"""Files as rows: whole objects listed and read by the tasks, their text taken out by type."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespace of a word-processor document, and the part that holds its text.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "word/document.xml"
# Files in a folder that ``write_files`` deals, folders in a task, tasks a core that ``dealt`` makes at least, and bytes read before rows go out.
FILES, FOLDERS, WRITERS, READ_BYTES = 1000, 4, 4, 8 << 20


class PageText(HTMLParser):
    """The text of a page without its scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def word_text(data: bytes) -> str:
    """Each paragraph's text and two line ends; tabs and breaks are kept as such."""
    with zipfile.ZipFile(io.BytesIO(data)) as packed:
        tree = ElementTree.fromstring(packed.read(DOCUMENT))
    own = {f"{WORD}tab": "\t", f"{WORD}br": "\n"}
    return "".join("".join(own.get(x.tag, x.text or "" if x.tag == f"{WORD}t" else "") for x in p.iter()) + "\n\n" for p in tree.iter(f"{WORD}p"))


def page_text(data: bytes) -> str:
    reader = PageText()
    reader.feed(data.decode("utf-8", "replace"))
    reader.close()
    return "".join(reader.parts)


READERS = {".txt": lambda data: data.decode("utf-8", "replace"), ".docx": word_text, ".html": page_text, ".htm": page_text}


def text_of(name: str, data: bytes, types=tuple(READERS), most: int = 15_000) -> str:
    """The first ``most`` characters of a file's text, by its ending in any case; empty for other ``types`` and for files that cannot be read."""
    kind = posixpath.splitext(name.lower())[1]
    if kind not in types:
        return ""
    try:
        return READERS[kind](data)[:most]
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, OSError, EOFError):
        return ""


def below(where: fs.FileSystem, path: str):
    """(path, size) of the files at or below a path, but for names that begin with ``_`` or ``.``, as in Spark's sources."""
    found = where.get_file_info(path)
    for info in where.get_file_info(fs.FileSelector(path)) if found.type == fs.FileType.Directory else [found]:
        if info.base_name[:1] not in ("_", "."):
            if info.type == fs.FileType.Directory:
                yield from below(where, info.path)
            elif info.type == fs.FileType.File:
                yield info.path, info.size


def all_file_texts(spark: SparkSession, folder: str, types=tuple(READERS), most: int = 15_000) -> DataFrame:
    """name, size and preview of every file below a folder, empty ones too.

    The driver lists the folder itself; what is in the folders below it is listed by the tasks, about a
    thousand files a task where ``write_files`` made them.  A file's bytes are in one task's memory;
    those of other ``types`` are not read.
    """
    where, root = fs.FileSystem.from_uri(folder)
    found = [f for f in where.get_file_info(fs.FileSelector(root)) if f.base_name[:1] not in ("_", ".")]
    folders = sum(f.type == fs.FileType.Directory for f in found)
    parts = max(spark.sparkContext.defaultParallelism, -(-folders // FOLDERS), -(-len(found) // (FOLDERS * FILES)))

    def read(batches):
        where, _ = fs.FileSystem.from_uri(folder)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["name", "size", "preview"])

        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for at, size in below(where, path):
                    name = posixpath.basename(at)
                    data = b""
                    if posixpath.splitext(name.lower())[1] in types:
                        with where.open_input_stream(at) as opened:
                            data = opened.read()
                    rows.append((name, size, text_of(name, data, types, most)))
                    held += len(data)
                    if held >= READ_BYTES or len(rows) >= FILES:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    paths = spark.createDataFrame([(f.path,) for f in found], "path string").repartition(parts)
    return paths.mapInArrow(read, "name string, size long, preview string")


def file_texts(spark: SparkSession, folder: str, types=tuple(READERS), most: int = 15_000) -> DataFrame:
    """name and preview of every file below a folder that holds a byte, as Spark's own source lists them."""
    return all_file_texts(spark, folder, types, most).filter("size > 0").select("name", "preview")


def word_file(text: str) -> bytes:
    """A word-processor file with a paragraph for each line of a text."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr(DOCUMENT, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD[1:-1]}"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key, for costly work on each, where one task holds over twice its share.

    A table of one row group is read by one task alone, whatever its size.  The rows of each task are counted
    without their columns; evenly held rows stay where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most, total = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) * cores <= 2 * (total or 0):
        return rows
    return rows.repartition(max(rows.rdd.getNumPartitions(), WRITERS * cores), key)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, text) as a file, a word-processor one where the name ends so; returns how many.

    The files of a task go to folders of its own, ``FILES`` in each, so no folder grows with the table.
    A task that is run again writes the same names with the same bytes.
    """

    def write(batches):
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                at = f"{root}/{part}-{done // FILES}"
                if done % FILES == 0:
                    where.create_dir(at, recursive=True)
                done += 1
                data = word_file(text or "") if name.endswith(".docx") else (text or "").encode("utf-8", "surrogatepass")
                with where.open_output_stream(f"{at}/{name}") as out:
                    out.write(data)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    return rows.select("name", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
