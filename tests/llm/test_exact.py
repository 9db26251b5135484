"""The dealt operators against brute force, the tokenizers library, round trips and held-out accuracy."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import bpe, graph, langid, linededup, mixing, mtree, omh, paragraphs, rare, simhash, tokenbin
from .conftest import passage

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_is_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.Codec(open(path, "rb").read())
    r = random.Random(5)
    letters = "aA'sStTéÉß İıΣσς́ \n\t\x1c\x85 日本語한글ก1٣²½…!?.,​　😀"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) + r.choice(["", "", "<|endoftext|> a", "<|startoftext|>"]) for _ in range(800)]
    for text in [*texts, "ab" * 3000, "xyzé" * 300 + " " + "!" * 600]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.asarray(ids)).decode() == library.decode(ids, skip_special_tokens=False)
    got = {x.doc_id: x for x in bpe.op1_bpe_round_trip(docs).collect()}
    for d in docs.collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_character_is_encoded_as_by_the_library():
    import unicodedata

    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.Codec(open(path, "rb").read())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    differ = own.unlike.lower.keys() | own.unlike.stand_in.keys()
    some = [c for c in every if ord(c) in differ or unicodedata.category(c) not in ("Cn", "Co", "Lo")]
    assert len(differ) > 1000
    for form, chars in (("a{}b", every), ("{}", some), ("1{}!", some), ("{}{}Σ", some)):
        texts = [form.replace("{}", c) for c in chars]
        for at in range(0, len(texts), 50_000):
            part = texts[at : at + 50_000]
            want = library.encode_batch_fast(part, add_special_tokens=False)
            assert [t for t, w in zip(part, want) if own.encode_plain(t) != np.asarray(w.ids, "<u4").tobytes()] == [], form


def test_short_and_long_words_merge_alike():
    own = bpe.Codec(open(bpe.default_vocabulary(), "rb").read())
    r = random.Random(2)
    for _ in range(300):
        word = "".join(r.choice("theinanorst") for _ in range(r.randint(1, 60)))
        parts = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + "</w>"]]
        assert own.merge_short(list(parts)) == own.merge_long(list(parts))


def test_token_files_are_the_library(docs):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(tokenbin.default_vocabulary()), 0
    got = {x.doc_id: x for x in tokenbin.op3_token_files(docs).collect()}
    for d in docs.orderBy("doc_id").collect():
        ids = np.asarray([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_are_the_library():
    from tokenizers import Tokenizer

    path = tokenbin.default_vocabulary()
    library, own = Tokenizer.from_file(path), tokenbin.PieceEncoder(open(path, "rb").read())
    r = random.Random(7)
    for _ in range(5000):
        text = "".join(r.choice("aA'st Té   \n\n\t\r\x1c\x85 日1٣.!,　​ ") for _ in range(r.randint(0, 16))) + r.choice(["", "", " <|endoftext|> ", "<|endoftext|>x"])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_damaged_frame_is_found(tmp_path):
    out = tokenbin.FrameWriter(f"{tmp_path}/a.zst")
    for i in range(20):
        out.add(i, np.arange(i * 50, dtype="<u4").tobytes())
    out.close()
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    raw[out.frames[0][0] + 30] ^= 255
    (tmp_path / "a.zst").write_bytes(raw)
    reader = tokenbin.FrameReader(f"{tmp_path}/a.zst")
    assert len(reader.frame(19)[1]) == 950
    with pytest.raises(Exception):
        list(reader.all())


def test_top_k_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 2, (900, 1))
    x[::3] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = collections.defaultdict(list)
    for r in mtree.op2_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    q = np.floor(256 * x).astype("i8")
    for i in range(0, 900, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(900) if j != i), key=lambda j: (-scores[j], j))[:5]
        assert found[i] == [(j, scores[j]) for j in order]


def test_top_k_of_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 60)
    x = np.random.default_rng(2).normal(size=(900, 4))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    q = np.floor(256 * x).astype("i8")
    found = collections.defaultdict(list)
    for r in mtree.op2_top_k(spark.createDataFrame([*rows, rows[50], rows[50]], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    scores = q @ q[50]
    assert found[50] == [(j, scores[j]) for j in sorted((j for j in range(900) if j != 50), key=lambda j: (-scores[j], j))[:5]]


def test_rare_items_lose_no_pair(spark):
    r, bags = random.Random(9), []
    for base in range(40):
        own = [r.randint(0, 400) for _ in range(r.randint(1, 30))] + [7] * r.choice([0, 0, 20])
        for _ in range(3):
            bags.append([x if r.random() > 0.15 else r.randint(0, 400) for x in own])
    rows = [(i, i % 50, b) for i, b in enumerate(bags)]
    made = rare.prefixes(spark.createDataFrame(rows, "id long, label long, items array<long>"), 0.8)
    found = {(x.a, x.b) for x in rare.pairs_of(made, 0.8, lambda a, b: F.lit(True)).collect()}
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[i + 1 :], i + 1):
            common = sum((collections.Counter(a) & collections.Counter(b)).values())
            if i % 50 != j % 50 and common >= max(len(a), len(b)) - int(0.2 * max(len(a), len(b)) + 1e-9):
                assert (i, j) in found
    assert len(found) < len(bags) ** 2 / 4


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.15, 0.18])
def test_near_duplicates_at_every_distance(spark, share):
    r, rows = random.Random(13), []
    for base in range(40):
        text = passage(base + 300, 200).split(" ")
        copy = list(text)
        for k in r.sample(range(200), int(200 * share)):
            copy[k] = f"new{r.randint(0, 10**6)}"
        rows += [(2 * base, " ".join(text)), (2 * base + 1, " ".join(copy))]
    found = {x.doc_id: x.class_id for x in omh.op8_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] in (i, i - i % 2) for i, _ in rows)
    assert sum(found[2 * b + 1] == 2 * b for b in range(40)) >= 36


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (20 if i % 2 else 400), f"s{i % 3}") for i in range(6000)]
    found = mixing.op9_mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for k in range(3):
        own = [x for x in found if x.doc_id % 3 == k]
        target, size = own[0].target, own[0].source_size
        assert abs(sum(x.taken for x in own) - target) <= 400
        p = target / size - target // size
        d = min(p, 1 - p) / 2
        lifts = {n: n * 1000 // (n + 100) / 1000 for n in (20, 400)}
        mean = sum(lifts[x.size] * x.size for x in own) / size
        for n in (20, 400) if p else ():
            rate = np.mean([x.taken // n - target // size for x in own if x.size == n])
            assert abs(rate - (p + d * (lifts[n] - mean))) < 0.05


def test_language_on_held_out(docs):
    lang = {d.doc_id: d.lang for d in docs.collect()}
    found = langid.op4_language_id(docs).collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_fingerprints_are_brute_force(docs):
    rows = docs.orderBy("doc_id").collect()
    texts = [d.text for d in rows]
    got = {r.doc_id: r for r in simhash.op7_fingerprints(docs).collect()}
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    for i, d in enumerate(rows):
        nxt, q, r = texts[(i + 1) % len(texts)], len(texts[i]) // 4, got[d.doc_id]
        edited = texts[i][: len(texts[i]) - q] + nxt[:q]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == near(r.fingerprint, got[rows[(i + 1) % len(rows)].doc_id].fingerprint) and r.near_edited == near(r.fingerprint, r.edited_fingerprint)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_block_tables_find_all(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(6)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = [signed(v) for v in values]
    found = {(x.a, x.b) for x in simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert found == want and want


def test_alignment_is_edit_distance():
    r = random.Random(4)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(500):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 4)] * r.randint(0, 3)
        limit, true = r.randint(0, 12), plain(a, b)
        assert omh.distance_within(np.array(a, "u8"), np.array(b, "u8"), limit) == (true if true <= limit else None)


def test_near_duplicates_are_brute_force(spark):
    r, rows = random.Random(6), []
    for base in range(25):
        text = passage(base, r.randint(60, 200)).split(" ")
        for _ in range(4):
            copy = list(text)
            for _ in range(len(text) // 40):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, passage(1000 + i, 80) + " " + passage(77, 60)) for i in range(40)]
    words = {i: omh.word_hashes(t) for i, t in rows}
    least = {i: i for i, _ in rows}
    for a in words:
        for b in words:
            if a < b and omh.similar(words[a], words[b]):
                least[b] = min(least[b], least[a])
    found = {x.doc_id: x.class_id for x in omh.op8_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == least


def with_sketches(spark, monkeypatch, texts, numbers):
    """Classes of the texts as if their sketches were these numbers."""
    rows = [(i, i, i, len(t.split()), s) for i, (t, s) in enumerate(zip(texts, numbers))]
    monkeypatch.setattr(omh, "sketches", lambda docs, text: spark.createDataFrame(rows, "doc_id long, h1 long, h2 long, n long, sketch array<long>"))
    found = omh.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [c for _, c in sorted((x.doc_id, x.class_id) for x in found)]


def revised(text, at, n):
    words = text.split(" ")
    return " ".join(words[:at] + [f"new{at}-{i}" for i in range(n)] + words[at + n :])


def test_sketches_find_scattered_edits():
    r, hits = np.random.default_rng(12), 0
    for _ in range(100):
        a = r.integers(1, 1 << 62, 300).astype("u8")
        b = a.copy()
        b[r.choice(300, 54, replace=False)] = r.integers(1, 1 << 62, 54).astype("u8")
        assert omh.similar(a, b)
        hits += bool((omh.sketch(a) == omh.sketch(b)).any())
    assert hits >= 95


def test_one_shared_number_is_enough(spark, monkeypatch):
    other, text = passage(21, 100), passage(22, 100)
    numbers = [[5, *range(100 * i, 100 * i + 31)] for i in (1, 2, 3)]
    assert with_sketches(spark, monkeypatch, [other, text, revised(text, 40, 15)], numbers) == [0, 1, 1]


def test_links_to_settled_members_count(spark, monkeypatch):
    first = passage(23, 100)
    second = revised(first, 10, 15)
    numbers = [[5, *range(100 * i, 100 * i + 31)] for i in (1, 2, 3)]
    assert with_sketches(spark, monkeypatch, [first, second, revised(second, 50, 15)], numbers) == [0, 0, 0]


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    parent = {v: v for e in links for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {x.node: x.label for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(found.get(v, v) == root(v) for v in parent)


def test_mix_reaches_targets(docs):
    found = mixing.op9_mix_sources(docs).collect()
    total, by = sum(r.size for r in found), collections.defaultdict(list)
    source = {d.doc_id: d.source for d in docs.collect()}
    for r in found:
        by[source[r.doc_id]].append(r)
        assert r.taken <= 2 * r.size
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    assert sorted(found) == sorted(mixing.op9_mix_sources(docs.repartition(7)).collect())


def test_line_dedup_is_brute_force(spark):
    long = "This line is long enough to count as one, yes"
    rows = [(i, f"short\n {long.upper() if i % 2 else long}\t\nown {i}") for i in range(6)] + [(9, None), (10, ""), (11, f"{long}\n{long}\nÄ" + "ä" * 50)] + [(20 + i, "Ä" + "ä" * 50) for i in range(3)]
    got = {r.doc_id: r for r in linededup.op10_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 1 and got[11].n_dropped == 0 and got[9].n_lines == 1 and got[20].n_dropped == 0
    assert got[3].kept_sha256 == hashlib.sha256(b"short\nown 3").hexdigest()


def test_passages_are_caught(docs):
    words, seen = {d.doc_id: d.text.lower().split() for d in docs.collect()}, collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 54):
            seen[tuple(w[k : k + 55])].add(i)
    repeated = {i for ids in seen.values() if len(ids) > 1 for i in ids if i != min(ids)}
    found = {r.doc_id for r in paragraphs.op6_paragraph_dedup(docs).collect() if r.n_removed}
    assert len(repeated - found) <= 0.02 * len(repeated)


def test_links_to_settled_paragraphs_count(spark, monkeypatch):
    first = passage(31, 60)
    second = revised(first, 0, 5)
    docs = spark.createDataFrame(list(enumerate([first, second, revised(second, 55, 5)])), "doc_id long, text string")
    segs = docs.selectExpr("doc_id", "xxhash64(text) t", "0 seg", "0 start", "60 n", "doc_id f", "array(5L) keys")
    monkeypatch.setattr(paragraphs, "segments", lambda docs, text: segs)
    assert sorted((x.doc_id, x["first"].doc_id) for x in paragraphs.shared_paragraphs(docs).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_pipeline_stages(spark, docs):
    current = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        made = step(spark, current, DATA)
        assert made.columns == docs.columns, name
        current = spark.createDataFrame(made.collect(), docs.schema)
    kept = {r.doc_id for r in current.collect()}
    assert len(kept) > 0.5 * docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, current, DATA).collect()
    assert len(last) == current.count()


def test_pipeline_on_awkward(spark, awkward, nothing):
    for table in (awkward, nothing):
        current = table
        for _, step in corpus_pipeline.STAGES:
            made = step(spark, current, DATA)
            rows = made.collect()
            current = spark.createDataFrame(rows, made.schema)
    assert current.count() == 0


def test_lines_of_a_text_of_very_many(spark):
    import time

    from quire.llm import linededup

    shared = "a line that many documents share, long enough to count"
    took = []
    for n in (50_000, 100_000):
        text = "\n".join([shared, *(f"line {i}" for i in range(n))])
        docs = spark.createDataFrame([(i, text if i == 1 else f"{shared}\n{i}") for i in range(1, 7)], "doc_id long, text string")
        began = time.perf_counter()
        found = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
        took.append(time.perf_counter() - began)
        assert found[1]["__kept"] == "\n".join(f"line {i}" for i in range(n)) and found[1]["__n_dropped"] == 1 and found[6]["__n_dropped"] == 0
    assert took[1] < 4 * took[0] + 5


def test_unlike_texts_of_one_repeated_passage_seldom_meet(spark, monkeypatch):
    r, rows = random.Random(5), []
    common = [f"w{i}" for i in range(40)]
    for i in range(90):
        own = [r.choice(common) if r.random() < 0.3 else f"own{r.randint(0, 900)}" for _ in range(r.randint(44, 64))]
        rows.append((i, " ".join(own + ["is", "on"] * 100)))
    words = {i: omh.word_hashes(t) for i, t in rows}
    labels, met, pairs_of = {i: i for i, _ in rows}, [], rare.pairs_of
    like = {(a, b) for a in words for b in words if a < b and omh.similar(words[a], words[b])}
    could = {(a, b) for a in words for b in words if a < b and omh.shared(words[a], words[b]) >= 0.8 * max(len(words[a]), len(words[b])) - 1e-9}

    def watched(made, least, near):
        met.append(pairs_of(made, least, near).collect())
        full = {tuple(x) for x in pairs_of(made, least, lambda a, b: F.lit(True)).collect()}
        named = {x.id: x.label for x in made.select("id", "label").distinct().collect()}
        assert all((a, b) in full for a, b in could if a in named and b in named and named[a] != named[b])
        return pairs_of(made, least, near)

    monkeypatch.setattr(omh, "pairs_of", watched)
    found = {x.doc_id: x.class_id for x in omh.op8_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for _ in rows:
        for a, b in like:
            labels[a] = labels[b] = min(labels[a], labels[b])
    assert found == labels
    assert like and len(met) == 1 and len(met[0]) < 3500  # of 4005 pairs, some met at several items


@pytest.mark.parametrize("bags", [[], [[1], [2]], [[1, 1, 1], [1, 1, 1]]])
def test_commonest_occurrences_of_few_bags(spark, bags):
    made = rare.prefixes(spark.createDataFrame([(i, i, b) for i, b in enumerate(bags)], "id long, label long, items array<long>"), 0.8, after=True)
    found = [(x.a, x.b) for x in rare.pairs_of(made, 0.8, lambda a, b: F.lit(True)).collect()]
    assert found == ([(0, 1)] if len(bags) == 2 and bags[0] == bags[1] else [])


def test_signs_after_a_known_word_do_not_encode_the_word_again():
    from tokenizers import Tokenizer

    path, r = tokenbin.default_vocabulary(), random.Random(8)
    library, own = Tokenizer.from_file(path), tokenbin.PieceEncoder(open(path, "rb").read())
    own.encode("a word word$$$ word.&&& word***")
    assert " word" not in own.by_token and "word***" in own.after_blank
    signs = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "é¡ \n\t1'<"
    for _ in range(3000):
        text = " ".join("".join(r.choice("abWé") for _ in range(r.randint(0, 4))) + "".join(r.choice(signs) for _ in range(r.randint(0, 4))) for _ in range(5))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in (" it's", "word's", "x<|endoftext|>", "a <|endoftext|> b<|endoftext|>.", "word._", "w\\|~`^ x[]@", "isn't!!!"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
