"""Files read by type, and phrases found in texts, against plain Python."""

import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quillspark.operators.containment import contained
from quillspark.plans import scans
from quillspark.plans.scans import legacy_text_extract, text_extract_source
from quillspark.sources.files import all_file_texts, file_texts, text_of, word_file, write_files
from quillspark.sources.sinks import fresh_folder
from quillspark.sources.tables import Tables


@pytest.mark.parametrize(
    "name,data,text",
    [
        ("a.txt", "naïve 中文\n".encode(), "naïve 中文\n"),
        ("a.TXT", b"x" * 20_000, "x" * 15_000),
        ("a.txt", b"\xff\xfe ok", "�� ok"),
        ("a.docx", word_file("one <&> \"two\"\n\n tab\tend\r"), "one <&> \"two\"\n\n\n\n tab\tend\r\n\n"),
        ("a.docx", b"not a zip", ""),
        ("a.docx", b"", ""),
        ("a.docx", word_file("x")[:-30], ""),
        ("a.html", b"<html><style>p{}</style><script>var a='<p>'</script><p>One &amp; two</p>", "One & two"),
        ("a.pdf", b"%PDF-1.4", ""),
        ("noending", b"x", ""),
    ],
)
def test_text_by_type(name, data, text):
    assert text_of(name, data) == text


def test_files_round_trip(spark):
    folder = fresh_folder(spark, "files")
    rows = [("1.txt", "plain\ntext"), ("2.docx", "para\ngraphs"), ("3.dat", "x"), ("4.txt", None), ("5.docx", "")]
    assert write_files(spark.createDataFrame(rows, "name string, text string"), folder) == 5
    got = {r["name"]: r["preview"] for r in file_texts(spark, folder).collect()}
    assert got == {"1.txt": "plain\ntext", "2.docx": "para\n\ngraphs\n\n", "3.dat": "", "5.docx": "\n\n"}
    assert {r["preview"] for r in file_texts(spark, folder, (".txt",)).filter("name LIKE '%.docx'").collect()} == {""}


def test_many_files_are_read_by_few_tasks(spark):
    folder = fresh_folder(spark, "files")
    rows = spark.range(2600).selectExpr("concat(id, '.txt') AS name", "if(id % 5 = 0, NULL, concat('t', id)) AS text").coalesce(1)
    assert write_files(rows, folder) == 2600
    read = all_file_texts(spark, folder)
    assert {r["name"]: r["preview"] for r in read.collect()} == {f"{k}.txt": f"t{k}" if k % 5 else "" for k in range(2600)}
    assert file_texts(spark, folder).count() == 2080 and read.rdd.getNumPartitions() <= 8


def test_extracts_keep_rows_of_equal_and_null_ids(spark, tmp_path):
    rows = [(3, "a\nb"), (3, "c"), (None, "d"), (None, None), (4, "e"), (5, "f"), (5, ""), (-3, "g"), (6, "x" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    t = Tables(spark, f"file://{tmp_path}")
    got = lambda df: sorted((str(r["doc_id"]), r["preview"]) for r in df.collect())
    plain = [("5", "f"), ("5", ""), ("None", "d"), ("None", ""), ("4", "")]
    assert got(text_extract_source(t)) == sorted([("3", "a\n\nb\n\n"), ("3", "c\n\n"), ("-3", "g\n\n"), ("6", "x" * 15_000), *plain])
    assert got(legacy_text_extract(t)) == sorted([("3", ""), ("3", ""), ("-3", ""), ("6", ""), *plain])


@pytest.mark.parametrize("block_chars", [10**6, 40])
def test_contained_equals_brute_force(spark, block_chars):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randint(1, 4)))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(60, None), (61, "")]
    phrases = sorted({word() for _ in range(12)} | {f"{word()} {word()}" for _ in range(6)}) + ["", None, "zz"]
    got = {r["id"]: r["hits"] for r in contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), block_chars).collect()}
    assert got == {k: None if t is None else sorted(p for p in phrases if p and p.lower() in t.lower()) for k, t in texts}
    none = contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "phrase string"))
    assert none.filter(F.size("hits") > 0).count() == 0 and none.count() == len(texts)


def test_legacy_extract_is_read_by_few_tasks(spark, tmp_path):
    spark.range(600).selectExpr("id AS doc_id", "concat('t', id) AS text").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    df = legacy_text_extract(Tables(spark, f"file://{tmp_path}"))
    assert "BinaryFile" not in df._jdf.queryExecution().toString() and df.rdd.getNumPartitions() <= 8
    assert {r["doc_id"]: r["preview"] for r in df.collect()} == {k: f"t{k}" if k % 3 == 2 else "" for k in range(600)}


def test_rows_of_one_task_are_written_by_all(spark, tmp_path, monkeypatch):
    spark.range(900).selectExpr("id AS doc_id", "concat('t', id) AS text").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(scans, "fresh_folder", lambda *_: f"file://{tmp_path}/files")
    assert legacy_text_extract(Tables(spark, f"file://{tmp_path}")).count() == 900
    held = [len(os.listdir(f)) for f in (tmp_path / "files").iterdir()]
    assert sum(held) == 900 and len(held) >= spark.sparkContext.defaultParallelism > 1 and max(held) < 450, held


def test_files_of_other_types_are_listed_and_not_opened(spark, tmp_path):
    os.symlink("/proc/self/mem", tmp_path / "a.docx")  # fails when it is read
    (tmp_path / "b.txt").write_text("b")
    got = {r["name"]: r["preview"] for r in all_file_texts(spark, f"file://{tmp_path}", (".txt",)).collect()}
    assert got == {"a.docx": "", "b.txt": "b"}
