"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import collections

import pytest

from quire.llm import bpe, langid, linededup, mixing, mtree, omh, paragraphs, simhash, tokenbin, warc

DOC_OPS = {
    "op1": bpe.op1_bpe_round_trip, "op3": tokenbin.op3_token_files, "op4": langid.op4_language_id, "op6": paragraphs.op6_paragraph_dedup,
    "op7": simhash.op7_fingerprints, "op8": omh.op8_near_duplicates, "op9": mixing.op9_mix_sources, "op10": linededup.op10_line_dedup,
}


@pytest.mark.parametrize("name", DOC_OPS)
def test_one_row_per_row(name, awkward):
    found = DOC_OPS[name](awkward).collect()
    want = collections.Counter(r.doc_id for r in awkward.select("doc_id").collect())
    assert collections.Counter(r.doc_id for r in found) == want


@pytest.mark.parametrize("name", DOC_OPS)
def test_empty_table(name, nothing):
    assert DOC_OPS[name](nothing).collect() == []


def test_near_classes(awkward):
    found = collections.defaultdict(set)
    for r in omh.op8_near_duplicates(awkward).collect():
        found[r.doc_id].add(r.class_id)
    assert found[1] == found[2] == found[3] == {1}
    assert found[4] == {4} and found[5] == {5} and found[6] == {6} and found[None] == {None}
    assert found[14] == {13} or 13 in found[14]
    assert found[9] == {9} and found[10] == {10} and found[11] == {11}


def test_shared_passage(awkward):
    found = {r.doc_id: r for r in paragraphs.op6_paragraph_dedup(awkward).collect() if r.doc_id is not None}
    assert found[11].first_docs == [10] and found[11].n_removed >= 60
    assert found[10].n_removed == 0 and found[10].n_shared >= 60
    assert found[9].n_shared == 0 and found[4].n_shared == 0
    kept = {r.doc_id: r["__kept"] for r in paragraphs.dedup_paragraphs(awkward).collect()}
    assert len(kept[11].split()) == 490 - found[11].n_removed and kept[10] == next(r.text for r in awkward.collect() if r.doc_id == 10)


def test_pages(spark):
    schema = "page_id long, url string, html string, sha string, refers_to long"
    rows = [(1, "http://a.b/x", "<p>1</p>", "s", 9), (2, None, None, None, None), (3, "http://a.b/x", "<p>1</p>", None, None), (None, "ftp://[bad", "<p>1</p>", None, None),
            (4, "", "", None, None), (5, "https://Ä.example:8080/ü?q=1#f\n", "é" * 1000, None, None), (3, "http://a.b/x", "<p>1</p>", None, None), (None, None, "only", None, None)]
    pages = spark.createDataFrame(rows, schema)
    found = sorted(warc.op5_warc_archives(pages).collect(), key=repr)
    assert len(found) == len(rows)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert kinds == {(1, "revisit", 3, 8): 1, (3, "response", None, 8): 2, (None, "revisit", 3, 8): 1, (None, "response", None, 4): 1, (2, "revisit", 4, 0): 1, (4, "response", None, 0): 1, (5, "response", None, 2000): 1}
    assert warc.op5_warc_archives(pages.limit(0)).collect() == []


def test_lookup(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p{i}", f"<p>{i}</p>") for i in range(500)], "page_id long, url string, html string")
    shards = warc.write_index(warc.write_archives(pages))
    wanted = spark.createDataFrame([("http://h3.example.com/p10",), ("http://h0.example.com/p7#x",), ("http://none.example.com/",)], "url string")
    assert sorted((r.page_id, bytes(r.payload)) for r in warc.lookup(shards, wanted).collect()) == [(7, b"<p>7</p>"), (10, b"<p>10</p>")]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, 0.2], "q"), (50, [0.1, 0.2], "q"), (1, [0.1, 0.2], "a"), (2, [0.1, 0.2], "b"), (3, None, "c"), (4, [0.1, None], "d"), (5, [nan, 0.0], "e"), (6, [inf, 0.0], "f"),
            (7, [-0.5, 0.9], "g"), (None, [0.1, 0.1], "h"), (8, [0.3], "i"), (9, [], "j"), (1, [0.1, 0.2], "a")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, tree string")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.op2_top_k(v).collect()}
    assert found[0, 1] == (7, -128 * 25 + 230 * 51) and [found[0, k][0] for k in (2, 3, 4)] == [1, 1, 2]
    assert found[50, 1][0] == 7 and found[0, 5][0] == 50 and found[50, 2][0] == 0
    assert mtree.op2_top_k(v.limit(0)).collect() == []


def test_read_documents(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(100)] + [(None, "x")], "doc_id long, text string")
    manifest = tokenbin.write_token_files(docs, tokenbin.default_vocabulary())
    found = tokenbin.read_documents(manifest, spark.createDataFrame([(5,), (77,), (500,)], "doc_id long")).collect()
    one = {r.doc_id: r.ids for r in found}
    assert sorted(one) == [5, 77] and one[5][-1] == 2


def test_encode_decode(awkward):
    ids = bpe.encode(awkward, bpe.default_vocabulary())
    texts = bpe.decode(ids, bpe.default_vocabulary()).collect()
    assert len(texts) == awkward.count() and {r.text for r in texts if r.doc_id == 5} == {""}


def test_learns_nothing(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.op4_language_id(docs).collect()} == {("und", 0.0)}
