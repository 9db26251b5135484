"""Many terms at once, edits of lines, and texts with very many hits."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S
from quire.operators.terms import Terms, rewritten, united


def alone(text, term):
    """Hits of one term from left to right."""
    out, at = [], text.find(term)
    while at >= 0:
        out.append((at, at + len(term)))
        at = text.find(term, at + len(term))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_hits_equal_each_term_searched_alone(seed):
    r = random.Random(seed)
    terms = list(dict.fromkeys("".join(r.choice("abA") for _ in range(r.randint(1, 4))) for _ in range(40)))
    for _ in range(30):
        text = "".join(r.choice("abA") for _ in range(r.randint(0, 60)))
        got = {i: [] for i in range(len(terms))}
        for i, a, b in Terms(terms).hits(text):
            got[i].append((a, b))
        assert got == {i: alone(text, t) for i, t in enumerate(terms)}
        low = {i: [] for i in range(len(terms))}
        for i, a, b in Terms(terms, True).hits(text):
            low[i].append((a, b))
        assert low == {i: alone(text.lower(), t.lower()) for i, t in enumerate(terms)}


def test_case_is_kept_where_lower_case_is_longer():
    assert Terms(["X", "İ"], True).hits("İx") == [(1, 0, 1)]
    assert Terms(["İ", "A"], True).hits("aİ"[:1]) == [(1, 0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_lines_after_edits(seed):
    r = random.Random(seed)
    for _ in range(100):
        lines = ["".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 6))]
        text, new = "".join(lines), r.choice(["", "X", "YYY"])
        spans = united([(0, *sorted(r.sample(range(len(text) + 1), 2))) for _ in range(3)]) if text else []
        ends = [sum(map(len, lines[: k + 1])) for k in range(len(lines) - 1)]
        moved = []
        for e in ends:
            at = e
            for a, b in spans:
                if b <= e:
                    at += len(new) - (b - a)
                elif a < e:
                    at += a - e + len(new)
            moved.append(at)
        flat, last = "", 0
        for a, b in spans:
            flat, last = flat + text[last:a] + new, b
        flat += text[last:]
        assert rewritten(lines, spans, new) == [flat[a:b] for a, b in zip([0, *moved], [*moved, len(flat)])]


def test_many_terms_equal_few(spark):
    segs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    terms = [a + b for a in "bcdfghjklmnp" for b in "aeiou"]
    many = {(x.doc_id, x.ord, x.term, x["count"]) for x in S.term_hits(segs, terms).collect()}
    few = {(x.doc_id, x.ord + k, x.term, x["count"]) for k in (0, 30) for x in S.term_hits(segs, terms[k : k + 30]).collect()}
    assert many == few and len(many) > 1000


def test_time_grows_with_the_hits_of_a_text(spark):
    took = []
    for n in (20_000, 20_000, 80_000):
        rows = spark.createDataFrame([(1, ["ab" * 50 + "c"] * (n // 50))], "doc_id long, lines array<string>")
        began = time.perf_counter()
        done = S.replace_all(rows, "ab", "xyz").first()
        assert done["occurrences"] == n and done["new_lines"] == ["xyz" * 50 + "c"] * (n // 50)
        assert rows.select(F.size(T.find_spans(T.flat("lines"), F.lit("ab"))).alias("n")).first()["n"] == n
        took.append(time.perf_counter() - began)
    assert took[2] < 12 * took[1] + 5
