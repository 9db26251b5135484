"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import collections
import hashlib
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, omh
from quire.llm.util import stage

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900001, "1234 --- ###", None, "odd", 12), (900002, None, "en", None, None), (900003, "", "en", "odd", 0)], docs.schema)
    frames = [docs.unionByName(odd)]
    for name, step in corpus_pipeline.STAGES:
        frames.append(stage(step(spark, frames[-1], DATA), name))
    return [[r.asDict() for r in f.collect()] for f in frames]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language_id_keeps_prose_and_drops_what_has_no_letters(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert all(before[i] == after[i] for i in after)
    assert not {900001, 900002, 900003} & after.keys()
    prose = {i for i, r in before.items() if len(re.findall(r"[^\W\d_]{2,}", r["text"] or "")) >= 20}
    assert len(prose) > 150 and not prose - after.keys()


def test_lines_are_dropped_as_by_hand(stages):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    holders = collections.defaultdict(set)
    for r in stages[1]:
        for line in r["text"].split("\n"):
            holders[key(line)].add(r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == r["doc_id"]) for r in stages[1]}
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])
    assert any(len(r["text"]) < len(by_id(stages[1])[r["doc_id"]]["text"]) for r in stages[2])


def test_one_of_each_group_of_near_duplicates_stays(stages):
    words = {r["doc_id"]: omh.word_hashes(r["text"]) for r in stages[2]}
    ids = sorted(words)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b])) and omh.similar(words[a], words[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    kept = {r["doc_id"] for r in stages[3]}
    assert kept == {i for i in ids if top(i) == i} and len(kept) < len(ids)


def test_sources_come_near_their_targets(stages):
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    own, longest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in stages[3]:
        own[r["source"]] += size(r["text"])
        longest[r["source"]] = max(longest[r["source"]], size(r["text"]))
    for r in stages[4]:
        taken[r["source"]] += size(r["text"])
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total, open_ = {}, 1.5 * sum(own.values()), set(order)
    while open_:
        rest = total - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * own[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * own[s] for s in over}
        open_ -= over
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in order)
    copies = collections.Counter(r["doc_id"] for r in stages[4])
    assert max(copies.values()) <= 2 and all(by_id(stages[3])[r["doc_id"]] == r for r in stages[4])


def test_tokens_are_the_library_s(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    want = []
    for r in stages[4]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5]) == sorted(want)


def test_rows_of_awkward_tables(spark, awkward):
    """Nulls, ties and repeated rows: only texts in a learned language go on; columns that clash with names inside pass through all stages but the last."""
    rows, frames = awkward.withColumn("__row", F.monotonically_increasing_id()), []
    for _, step in corpus_pipeline.STAGES[:4]:
        rows = stage(step(spark, rows, DATA), "awkward")
        frames.append(rows)
        assert rows.columns == [*awkward.columns, "__row"]
    assert all(r["text"] and re.search(r"[^\W\d_]", r["text"]) for r in frames[0].collect())
    assert frames[2].count() <= frames[1].count() == frames[0].count()
