"""Archives and fingerprints against plain versions of their whole results."""

import base64
import collections
import hashlib

import regex
import xxhash

from quire.llm import simhash, warc

DATA = "/root/testdata/sf0.001"


def test_archives_are_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    top = max(r[0] for r in rows)
    rows += [(top + 1 + i, r[1], r[2]) for i, r in enumerate(rows[:20])]
    rows += [(top + 100, "http://long.example/", "<p>long</p>é" * 300_000), (top + 101, "http://long.example/", "<p>long</p>é" * 300_000), (top + 102, None, None), (top + 103, "http://empty.example/", "")]
    payload = {i: (html or "").encode() for i, _, html in rows}
    largest = {p: i for i, p in sorted(payload.items())}
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if largest[p] == i else "revisit", None if largest[p] == i else largest[p]) for i, p in payload.items()}
    found = warc.op5_warc_archives(spark.createDataFrame(rows, pages.schema)).collect()
    assert len(found) == len(rows) and len({k for _, _, k, _ in want.values()}) == 2
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want


def fingerprint(text):
    words = regex.split(r"[^\p{L}\p{N}]+", text.lower())
    terms = collections.Counter(zip(["", *words], [*words, ""]))
    sums = [0] * 64
    for (a, b), n in terms.items():
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        for i in range(64):
            sums[i] += n if h >> i & 1 else -n
    return f"{sum(1 << i for i, s in enumerate(sums) if s > 0):016x}"


def test_fingerprints_are_recomputed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = sorted([tuple(r) for r in docs.collect()] + [(10**6, "one two " * 20_000), (10**6 + 1, ""), (10**6 + 2, None), (10**6 + 3, "one")])
    texts = [t or "" for _, t in rows]
    found = {r.doc_id: r for r in simhash.op7_fingerprints(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len(found) == len(rows)
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        assert found[i].fingerprint == fingerprint(text)
        assert found[i].edited_fingerprint == fingerprint(text[: len(text) - cut] + after[:cut])
