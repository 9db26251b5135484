"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest

from quire.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rising(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def by_hand(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(framed(r[f]) for f in ("doc_id", "source", "lang", "n_chars", "text")))
    langs = {}
    for r in rows:
        altered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        langs.setdefault(r["lang"], []).append((r["doc_id"], leaf(r), leaf(r | {"text": low}) if altered else leaf(r)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[x] = rising([r[1] for r in langs[x]])
    top = rising([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for i, (doc, leaf_, cur) in enumerate(langs[x]):
            proof = []
            for levels, j in ((trees[x], i), (top, k)):
                for level in levels[:-1]:
                    low, high = level[j // 8 * 8 : j], level[j + 1 : j // 8 * 8 + 8]
                    proof += low + high
                    cur, j = h("".join([*low, cur, *high])), j // 8
            out.append((doc, leaf_, trees[x][-1][0], top[-1][0], h("".join(proof)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, idx int, tree int, path string"


def rows_of(n, langs, seed):
    r = random.Random(seed)
    return [(None if i % 97 == 0 else i * 7919 % 3001, r.choice([None, "", f"Text {i % 50} Ä"]), r.choice(langs), r.choice([None, "s"]), r.choice([None, 5]), "x", 1, 2, "p") for i in range(n)]


@pytest.mark.parametrize("rows", [
    [], rows_of(1, ["en"], 1), rows_of(8, ["en"], 2), rows_of(9, [None], 3), rows_of(1200, [None, "en", "é", *(f"l{k}" for k in range(70))], 4),
    rows_of(700, ["en"], 5) + [(6, "Same", "en", None, None, "x", 1, 1, "p")] * 40 + [(7, "alone", "zz", None, 3, "x", 1, 1, "p")]], ids=["none", "one", "run", "two_runs", "many_groups", "ties"])
def test_equals_a_plain_tree(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, merkle.op11_merkle_manifest(docs).collect()), key=str)
    assert got == by_hand([r.asDict() for r in docs.collect()])


def test_awkward(spark, awkward):
    got = sorted(map(tuple, merkle.op11_merkle_manifest(awkward).collect()), key=str)
    assert got == by_hand([r.asDict() for r in awkward.collect()])


def test_only_some_levels_are_stored(spark):
    leaves = spark.range(600).selectExpr("0L AS tree", "600L AS n", "id AS idx", "sha2(string(id), 256) AS node")
    forest = merkle.grown(leaves)
    assert [s.count() for s in forest.strata] == [600, 2, 1]
    assert forest.tops.first()["node"] == rising([h(str(i)) for i in range(600)])[-1][0]
