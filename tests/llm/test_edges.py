"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from quillspark.llm.language_id import held_out_languages
from quillspark.llm.line_templates import drop_recurring_lines
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality_rules import quality_rules
from quillspark.llm.shared import join_hot
from quillspark.llm.simhash import components, keep_one, near_duplicates, spanning_links
from quillspark.llm.token_store import read_ids, write_ids
from quillspark.llm.topk import exact_topk
from quillspark.llm.url_filters import url_filter
from quillspark.llm.warc import read_payloads, read_warc, write_warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASH = "key string, check int, fp long, kept boolean, n_lines long, lang_pred string, seg string, template string, first int, _facts int, _lines int, _doc int, _text int, _drop int, _key int, text_key int, _text_key int, _part int, _parts int, _q_doc int, _q_part int, _at int, x int, leaf int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
LONG = " ".join(f"word{i % 9973}" for i in range(60_000)) + "."


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "k", 1, 2, False, 3, "x", "s", "t", 4, *range(15))


@pytest.fixture(scope="module")
def docs(spark):
    prose = "A plain sentence with enough ordinary words to be kept by every rule of this list, and then a few more words."
    rows = [row(1, prose + "\n" + prose.upper()), row(1, prose + "\n" + prose.upper()), row(2, None), row(3, ""), row(4, " \t\n\r"), row(5, LONG), row(None, prose), row(None, None), row(6, "Ünïcode ß 中文 Σίσυφος 😀 a�b"), row(7, "one two", None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


PER_ROW = {
    "simhash": near_duplicates,
    "quality": quality_rules,
    "language": held_out_languages,
    "lines": drop_recurring_lines,
    "bpe": lambda d: bpe_digests(d, WORD),
    "ids": lambda d: read_ids(write_ids(d, WORD, 2, 49_408)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(docs, nothing, name):
    out = PER_ROW[name](docs)
    assert len(out.collect()) == docs.count()
    if name in ("quality", "lines"):
        assert {tuple(r) for r in out.select("_facts", "text_key", "_q_part", "leaf").collect()} == {(0, 6, 11, 14)}
    assert PER_ROW[name](nothing).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, name, stage):
    out = stage(spark, docs, "")
    out.collect()
    assert stage(spark, nothing, "").collect() == []
    if name != "packing":
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_simhash_values(docs):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in near_duplicates(docs).collect()}
    assert got[2, "0" * 16] == got[3, "0" * 16] == got[4, "0" * 16] == got[None, "0" * 16] == 2
    kept = [r["doc_id"] for r in keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 5, 6, 7] and kept.count(None) <= 1


def test_same_id_in_two_groups(spark):
    rows = [row(5, "alpha beta gamma delta epsilon zeta eta theta"), row(5, "nine ten eleven twelve thirteen fourteen fifteen"), row(3, "alpha beta gamma delta epsilon zeta eta theta")]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"][:4]) for r in kept) == [(3, "alph"), (5, "nine")]


def test_dense_shard_is_cut_into_parts(spark):
    """Parts of a shard meet each other: the components are those of brute force."""
    from quillspark.llm.simhash import links

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (120, 4), dtype=np.uint64), axis=1) for b in base]))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components(links(nodes, 3, shard_rows=10)).collect()}
    label = list(range(len(values)))
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 3).tolist():
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    ids = values.view(np.int64).tolist()
    want = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(ids[i])
    found = {}
    for i in ids:
        found.setdefault(got.get(i, i), set()).add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_spanning_links_empty():
    none = np.zeros(0, np.uint64)
    assert all(len(x) == 0 for x in spanning_links(np.zeros(0, np.int64), none, np.zeros(0, bool), 3))


def test_names_differ_by_case_only(spark):
    """Columns of the input that differ from an added one in case are replaced like it."""
    text = "A plain sentence with enough ordinary words to be kept by every rule of this list, and then a few more words."
    rows = spark.createDataFrame([(1, text, "x", 7)], "doc_id long, text string, KEPT string, N_Lines int")
    assert quality_rules(rows).filter("kept").count() == 1
    assert [r["n_lines"] for r in drop_recurring_lines(rows).select("n_lines").collect()] == [1]


def test_lines_keep_the_first(spark):
    menu, number = "All rights reserved here", "Page 3 of 14 in this report"
    rows = [row(2, f"{menu}\nbody of two\n{menu}"), row(9, f"{menu}\nbody of nine"), row(4, f"x\n{number}"), row(8, "Page 5 of 20 in this report\ny"), row(11, "Posted on the board by Alice today"), row(12, "Posted on the board by Robert today")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == (f"{menu}\nbody of two\n{menu}", 3, 0)
    assert got[9] == ("body of nine", 2, 1)
    assert got[4] == (f"x\n{number}", 2, 0) and got[8] == ("y", 2, 1)
    assert got[11][2] == 0 and got[12] == ("", 1, 1)


@pytest.mark.parametrize("n", [4, 5, 12, 13, 19, 20, 60, 200])
def test_lines_of_any_length_generalise(spark, n):
    """A tenth of the tokens after the leading ones, one at least, may differ; a line of fields alone stays."""
    words, spare = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}w" for i in range(n)], max(1, n // 10)
    other = lambda k, word: [*words[:-k], *[word] * k]
    rows = [row(1, " ".join(words)), row(2, " ".join(other(spare, "else"))), row(3, " ".join(["lead", *words[1:]])), row(4, "1 2 3"), row(5, "4 5 6"), row(6, "own line")]
    rows += [row(7, " ".join(other(spare + 1, "more")))] if n > spare + 4 else []
    got = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0} | ({7: 0} if n > spare + 4 else {})


def test_lines_join_later_members_of_a_run(spark, monkeypatch):
    """A line that is unlike the earliest of its runs, and like a later one, recurs; in blocks of any size."""
    monkeypatch.setattr("quillspark.llm.line_templates.TOKENS_A_BLOCK", 40)
    words = [f"{chr(97 + i)}w" for i in range(20)]
    line = lambda *ends: " ".join([*words[: 20 - len(ends)], *ends])
    texts = [line(), line("x", "y", "z"), line("p", "q", "r", "s"), line("x", "y", "v"), line("k", "l", "m", "n", "o"), line("p", "q", "t", "s")]
    rows = spark.createDataFrame([row(k + 1, text) for k, text in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1}


@pytest.mark.parametrize("text", ["Menu", "one two"])
def test_short_lines_recur_like_others(spark, text):
    got = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(spark.createDataFrame([row(1, text), row(2, text)], SCHEMA)).collect()}
    assert got == {1: 0, 2: 1}


def test_packing_edges(docs, nothing):
    rows = pack_documents(docs, BYTE, 0).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert pack_documents(nothing, BYTE, 0).collect() == []


def test_bpe_round_trip(spark):
    texts = ["hello world's 12 cats", "", "naïve café <|endoftext|> x", "ΑΣ ΟΔΟΣ", "a\u0301 b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    for r in bpe_encode(docs, WORD).collect():
        assert r["ids"] == tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    for r in bpe_decode(bpe_encode(docs, WORD), WORD).collect():
        assert r["text"] == tok.decode(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, skip_special_tokens=False)


def test_urls(spark):
    rows = [(1, None, 0), (2, "no scheme/x", 0), (3, "HTTP://A.Example.NET/en/1?q#f", 0), (3, "HTTP://A.Example.NET/en/1?q#f", 0), (None, "x://h", 0), (5, "http://EXAMPLE.com/de/a/b/c/d/e", 0), (6, "", 0), (7, "http://fooexample.net/en/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, template int")
    got = [tuple(r)[:5] for r in url_filter(pages).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), *[(3, "a.example.net", "/en/1", "example.net/en/", "allow")] * 2, (None, "h", "", None, "allow"), (5, "example.com", "/de/a/b/c/d/e", "example.com/de/", "block"), (6, "", "", None, "allow"), (7, "fooexample.net", "/en/", "net/", "block")], key=repr
    )
    assert url_filter(pages.filter("false")).collect() == []


def test_topk(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, -1.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (7, [1.0], 1), (8, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in exact_topk(vectors, k=2).collect()]
    assert sorted(got) == [(0, 1, 1, 5 * 1024**2), (0, 2, 2, 5 * 1024**2), (100, 1, 0, -(1024**2)), (100, 2, 1, -(1024**2))]
    assert exact_topk(vectors.filter("false")).collect() == []


def test_warc(spark):
    rows = [(1, "http://a", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u v", None, 0), (4, "http://b", "", 0), (None, "http://c", "<p>x</p>", 0), (5, "http://d", "é" * 100_000, 0), (1, "http://a", "<p>x</p>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    manifest = write_warc(pages)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in read_warc(manifest).collect()), key=repr)
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (None, "revisit", 1), (5, "response", None)], key=repr)
    texts = {(r["page_id"], r["html"]) for r in read_payloads(manifest).collect()}
    assert texts == {(p, h or "") for p, _, h, _ in rows}
    assert read_warc(write_warc(pages.filter("false"))).collect() == []


def test_quality_lines(spark):
    lines = ["The harbour master wrote a long report about tides and moorings.", "Nobody expected rain, yet the picnic went ahead under grey skies.", "Seven engineers measured the bridge twice before they signed anything."]
    rows = [row(1, "\n".join([*lines, "Home | About | Contact", "cookie policy"])), row(2, "\n".join(["cookie policy"] * 3 + ["Home | About"] * 9))]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == "\n".join(lines)
    assert not got[2]["kept"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_out(spark, how):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id < 3000 THEN 'hot' WHEN id < 5000 THEN concat('k', id % 700) END AS key")
    found = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("key IS NOT NULL AND n > 1")
    want = sorted(map(tuple, rows.join(found.drop("n"), "key", how).select("id", "key", "first").collect()))
    assert sorted(map(tuple, join_hot(rows, found, ["key"], how).select("id", "key", "first").collect())) == want
    assert join_hot(rows.limit(0), found.limit(0), ["key"], how).count() == 0


def test_url_tree_blocks_unlabelled_branches(spark):
    """Labels reach URLs that no rule decides through branches of the same shape, and no others."""
    rules = [("block", "shop.test/sale/"), ("allow", "shop.test/help/")]
    urls = [f"http://shop.test/sale/{i}" for i in range(30)] + [f"http://shop.test/offer/{i}" for i in range(5)]
    urls += [f"http://shop.test/help/{w}/faq" for w in ("pay", "ship", "return")] * 10 + ["http://shop.test/guide/size/faq"] * 4 + ["http://shop.test/", "http://other.test/offer/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: (r["verdict"], r["rule"], r["template"]) for r in url_filter(pages, rules).collect()}
    assert all(got[f"http://shop.test/offer/{i}"] == ("block", None, "/{offer}/*") for i in range(5))
    assert got["http://shop.test/guide/size/faq"][0] == got["http://shop.test/"][0] == got["http://other.test/offer/1"][0] == "allow"


def test_url_branches_with_opposed_labels_stay_apart(spark):
    rules = [("block", "a.test/x/"), ("allow", "a.test/y/")]
    urls = [f"http://a.test/x/{i}" for i in range(40)] + [f"http://a.test/y/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["template"] for r in url_filter(pages, rules).collect()} == {"/x/*", "/y/*"}


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_url_labels_below_the_third_segment(spark, depth):
    """Labels deep in a path decide there and not for branches beside them; past ``depth`` only equal rests share."""
    rules = [("block", "a.test/x/y/z/bad/"), ("allow", "a.test/x/y/z/good/")]
    urls = [f"http://a.test/x/y/z/bad/{i}" for i in range(40)] + [f"http://a.test/x/y/z/good/{i}" for i in range(40)]
    urls += ["http://a.test/x/y/z/fine/a", "http://a.test/x/y/z/fine/b/c/d/e/f/g", "http://a.test/x/y/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_filter(pages, rules, depth=depth).collect()}
    assert {got[u]["verdict"] for u in urls[:40]} == {"block"} and {got[u]["verdict"] for u in urls[40:]} == {"allow"}
    assert got[urls[0]]["template"] == "/x/y/z/bad/*" and got[urls[40]]["template"] == "/x/y/z/good/*"
    assert got[urls[0]]["purity"] > 0.8 and got[urls[40]]["purity"] < 0.2 and got[urls[80]]["purity"] == 0.5


@pytest.mark.parametrize("children", [2, 17])
def test_url_rare_children_vary_in_nodes_of_any_width(spark, children):
    """A child under a share of 1 % is variable whether its node has two children or many; at 1 % it is named."""
    urls = [f"http://a.test/{chr(97 + k)}x/p" for k in range(children - 1) for _ in range(100 // (children - 1) + 1)]
    many = urls * 4 + ["http://a.test/rare/z/q/r"]
    for rows, want in ((urls[:99] + ["http://a.test/rare/z/q/r"], "/rare/z/q/r"), (many, "/*/z/q/r")):
        pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
        assert url_filter(pages).filter("path = '/rare/z/q/r'").first()["template"] == want


def test_url_many_children_and_long_paths(spark):
    urls = [f"http://a.test/{chr(97 + i % 26)}{chr(97 + i // 26)}x/p" for i in range(300)] + ["http://a.test/" + "long/" * 5000, "http://a.test/" + "q" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter(pages).collect()
    assert len(got) == len(urls) and all(r["verdict"] == "allow" for r in got)


@pytest.mark.parametrize("bits", [*range(1, 21), 32])
def test_packed_widths_and_random_access(tmp_path, bits):
    from pyarrow import OSFile

    from quillspark.llm.token_store import IdReader, IdWriter, pack, unpack

    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 77, 300, 1, 129)]
    for ids in docs:
        assert unpack(pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    writer = IdWriter(OSFile(str(tmp_path / "f"), "wb"), 1 << bits, block_ids=64)
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader, flat = IdReader(OSFile(str(tmp_path / "f"), "rb")), np.concatenate(docs)
    for start, n in [(0, len(flat)), (63, 2), (64, 64), (500, 8), (len(flat), 0), (1, 200)]:
        assert reader.ids(start, n).tolist() == flat[start : start + n].tolist()


def test_id_files_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"word number {k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    files = write_ids(docs, WORD, 2, file_ids=20, file_docs=100)
    assert files.count() > 5 and max(r["ids"] for r in files.collect()) < 40
    rows = sorted(map(tuple, read_ids(files).collect()))
    assert [r[0] for r in rows] == list(range(40)) and all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_bad_archives(spark):
    import io

    from quillspark.llm.warc import ArchiveWriter, parse_record, read_archive, record_bytes

    class Sink(io.BytesIO):
        pass

    records = [record_bytes(k, f"http://a/{k}", b"<p>%d</p>" % k * 900, None, "2024-01-01T00:00:00Z") for k in range(300)]
    sink = Sink()
    writer = ArchiveWriter(sink, [], 64, 3)
    for r in records:
        writer.add(r)
    data = sink.getvalue()
    assert [p for _, p in read_archive(io.BytesIO(data))] == [parse_record(r)[1] for r in records]
    import struct

    skip = lambda n: struct.pack("<II", 0x184D2A5E, n) + b"x" * n
    size = struct.unpack("<II", data[:8])[1] + 8
    more = data[:size] + skip(3) + skip(3_000_000) + data[size:] + skip(0)
    assert [p for _, p in read_archive(io.BytesIO(more))] == [parse_record(r)[1] for r in records]
    unnamed = b"\r\n".join(x for x in records[0].split(b"\r\n") if not x.startswith(b"WARC-Payload-Length"))
    assert parse_record(unnamed)[1] == parse_record(records[0])[1]
    flipped = data[: size + 40] + bytes([data[size + 40] ^ 255]) + data[size + 41 :]
    for bad in (data[:-9], b"\0" * 8 + data[8:], data[:12], data[:5], b"", flipped, data + skip(9)[:-2]):
        with pytest.raises(ValueError):
            list(read_archive(io.BytesIO(bad)))
    one = records[0]
    for bad in (b"HTTP" + one, one.replace(b"WARC-Date", b"WARC-Dote"), one.replace(b"<p>", b"<q>", 1), one[:-1], one.replace(b"WARC-Type: ", b"WARC-Type "), one.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            parse_record(bad)


def test_memo_evicts_but_keeps_results():
    from quillspark.llm.bpe import MergeTable
    from quillspark.llm.word_memo import UnitIds

    words = [f" w{k}" for k in range(3000)] + [" word.", " naïve,", " x!!", " a1,"]
    small, large = UnitIds(BYTE, True, limit=40_000), UnitIds(BYTE, True)
    assert [small[w] for w in words * 2] == [large[w] for w in words * 2]
    assert len(small) + len(small.older) < 500 and small.held <= 40_000
    assert b"".join(large[w] for w in words) == large.library("".join(words))
    a, b = MergeTable(WORD, limit=40_000), MergeTable(WORD)
    assert [a.encode(w.strip()) for w in words * 2] == [b.encode(w.strip()) for w in words * 2]


def test_language_scores_ties_and_no_labels(spark):
    """Score by the definition of the out-of-place distance; languages learned from equal texts tie."""
    from collections import Counter

    from quillspark.llm.language_id import identify, learn_profiles

    texts = {"en": "the cat sat on the mat and the dog ran", "de": "der hund und die katze sitzen auf der matte"}
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")

    def ranked(text, size):
        padded = " " + " ".join(text.split()) + " "
        grams = Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip() and padded[i : i + n][n // 2 if n != 2 else 0 : n if n == 2 else n // 2 + 1].strip())
        code = lambda g: (len(g) == 2, sum(ord(c) * (c != " ") << 21 * (len(g) - 1 - i) for i, c in enumerate(g)))
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:size]

    profiles = learn_profiles(docs, size=40)
    asked = "the dog and the hund"
    want = {}
    for lang, text in texts.items():
        ranks = {g: i for i, g in enumerate(ranked(text, 40))}
        mine = ranked(asked, 40)
        want[lang] = 1 - sum(abs(ranks[g] - i) if g in ranks else 40 for i, g in enumerate(mine)) / (40 * len(mine))
    got = identify(spark.createDataFrame([(9, asked)], "doc_id long, text string"), profiles, 40).first()
    assert (got["lang_pred"], round(got["score"], 9)) == max(((k, round(v, 9)) for k, v in want.items()), key=lambda x: x[1])
    tied = learn_profiles(spark.createDataFrame([("la la", "xx"), ("la la", "aa")], "text string, lang string"))
    assert identify(docs, tied).first()["lang_pred"] == "aa"
    assert {(r["lang_pred"], r["score"]) for r in identify(docs, learn_profiles(docs.filter("false"))).collect()} == {("und", 0.0)}


def test_sample_is_bounded_by_language(spark):
    """A hot text counts once, and a rare language is used whole."""
    from quillspark.llm.language_id import learn_profiles

    rows = [(f"text number {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", "en") for k in range(600)] + [("hot text", "en")] * 300 + [("rare zzz", "xx")]
    profiles = learn_profiles(spark.createDataFrame(rows, "text string, lang string"), max_documents=50)
    assert set(profiles) == {"en", "xx"}


def test_quality_by_brute_force(spark):
    """kept and clean_text of whole texts against the same rules in plain Python."""
    import re

    from quillspark.llm.quality_rules import BOILERPLATE, LINK, MENU

    from tests.compare import DATA

    def passes(line):
        n = len(re.split(" ", line.strip(" \t\n\x0b\x0c\r")))
        if len(re.findall(r"[#*$%&|<>]|!!", line)) * 10 > n * 3:
            return False
        if n < 4 and not re.search(r"[.!?:;…\"'”’»)\]][ \t-\r]*$", line):
            return False
        menus = len(re.findall(MENU, line))
        if menus >= 2 and n <= (menus + 1) * 4 or len(re.findall(LINK, line.lower())) * 3 > n:
            return False
        return n > 30 or not any(p in line.lower() for p in BOILERPLATE)

    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    changed = 0
    for r in quality_rules(docs.withColumn("given", F.col("text"))).collect():
        lines = (r["given"] or "").split("\n")
        full = [x for x in lines if re.search(r"[^ \t-\r]", x)]
        stay = [x for x in full if passes(x)]
        assert r["clean_text"] == "\n".join(x for x in lines if x not in full or x in stay)
        before, after = sum(map(len, full)), sum(map(len, stay))
        assert r["kept"] == (not r["base_failed"] and before - after <= before * 0.5)
        changed += r["kept"] and r["clean_text"] != r["given"]
    assert changed > 0
