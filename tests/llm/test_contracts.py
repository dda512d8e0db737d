"""The numbered queries against brute force or SQL on a small table set."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillspark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import DATA, same

SF = DATA / "sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(name, folder=SF):
    r = duckdb.connect().execute(f"SELECT * FROM '{folder}/{name}.parquet'")
    names = [d[0] for d in r.description]
    return [dict(zip(names, row)) for row in r.fetchall()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, str(DATA / "sf0.01")), ORACLE_SQL[name], DATA / "sf0.01")


def test_op1_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r["page_id"]: r for r in QUERIES["op1_url_filters"](spark, str(SF)).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    for p in pages:
        url, r = p["url"] or "", got[p["page_id"]]
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + x), h + x, v) for v, h, x in rules if (host == h or host.endswith("." + h)) and path.startswith(x)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")


def test_op2_brute_force(spark):
    docs = table("documents", DATA / "sf0.01")
    fps = {}
    for d in docs:
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3).tolist():
            a, b = sorted((parent[i], parent[j]))
            if a != b:
                parent = [a if x == b else x for x in parent]
    want = {d: (f"{fps[d]:016x}", ids[parent[k]]) for k, d in enumerate(ids)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash"](spark, str(DATA / "sf0.01")).collect()}
    assert got == want


def test_op3_base(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, str(SF)).collect()}
    for d in table("documents"):
        text, r = d["text"] or "", got[d["doc_id"]]
        words = WORDS.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op5(spark):
    pages = table("pages")
    groups = defaultdict(list)
    for p in pages:
        groups[(p["html"] or "").encode()].append(p["page_id"])
    got = {r["page_id"]: r for r in QUERIES["op5_warc"](spark, str(SF)).collect()}
    assert len(got) == len(pages)
    for payload, ids in groups.items():
        for i in ids:
            r, first = got[i], min(ids)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))


def test_op6(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation(), tok.no_padding()
    at, want = 0, set()
    for d in sorted(table("documents"), key=lambda d: d["doc_id"]):
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_token_ids"](spark, str(SF)).collect()}
    assert got == want


def test_op7_held_out_accuracy(spark):
    docs = {d["doc_id"]: d for d in table("documents", DATA / "sf0.01")}
    rows = QUERIES["op7_language_id"](spark, str(DATA / "sf0.01")).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_op8_pieces(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation(), tok.no_padding()
    ids = {d["doc_id"]: np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4") for d in table("documents")}
    rows = QUERIES["op8_packing"](spark, str(SF)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= 0.02 * sum(map(len, ids.values()))


def test_op10(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation(), tok.no_padding()
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, str(SF)).collect()}
    for d in table("documents"):
        ids, r = tok.encode(d["text"] or "", add_special_tokens=False).ids, got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
