"""Literal cases of searching, replacing and deleting."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "term", "fold", "want"), [
    ("aaaa", "aa", False, [(0, 2), (2, 4)]), ("aXbx", "x", True, [(1, 2), (3, 4)]), ("İx", "X", True, []), ("a.b.c", ".", False, [(1, 2), (3, 4)]),
    (r"x\Ey\E", r"\E", False, [(1, 3), (4, 6)]), ("", "a", False, []), ("abc", "", False, []), ("日本日本", "日", False, [(0, 1), (2, 3)])])
def test_find_spans(spark, text, term, fold, want):
    assert [tuple(s) for s in one(spark, T.find_spans(F.lit(text), F.lit(term), fold))] == want


@pytest.mark.parametrize(("lines", "term", "new", "want"), [
    (["abc", "def"], "cd", "XY", ["abXY", "ef"]), (["abc", "def"], "a", "ZZZ", ["ZZZbc", "def"]), (["abc", "def"], "cd", "", ["ab", "ef"]), (["a", "b", "c"], "abc", "x", ["x", "", ""]), (["abc"], "b", "", ["ac"])])
def test_replace_keeps_lines(spark, lines, term, new, want):
    rows = spark.createDataFrame([(1, lines)], "doc_id long, lines array<string>")
    assert S.replace_all(rows, term, new).first()["new_lines"] == want


def test_merge_spans(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((6, 8), (0, 2), (2, 4))])
    assert [tuple(s) for s in one(spark, T.merge_spans(spans))] == [(0, 4), (6, 8)]


def test_merge_spans_of_odd_rows(spark, tmp_path):
    """Null and broken numbers as in the SQL, whose windows are spelt out here."""
    import __spark_entry__ as entry

    rows = [(1, 2.5, 1), (1, 3.5, 1), (2, None, 1), (2, None, 2), (2, 1.0, 2), (2, 9.0, None), (2, 9.6, 1), (3, None, 1), (3, None, 1), (4, 5.0, None), (4, 5.0, None), (4, 6.0, 2), (5, 3e9, 1), (None, 1.0, 1), (None, 2.0, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = sorted(((r.doc_id, r.a, r.b) for r in entry.queries()["w12_merge_spans"](spark, str(tmp_path)).collect()), key=str)
    want = [(1, 2, 3), (1, 4, 5), (2, 1, 3), (2, 9, None), (2, 10, 11), (3, None, None), (3, None, None), (4, 5, None), (4, 5, None), (4, 6, 8), (5, 3000000000, 3000000001), (None, 1, 3)]
    assert found == sorted(want, key=str)


def test_delete_counts(spark):
    rows = spark.createDataFrame([(1, ["abab", "xx"]), (2, ["none"])], "doc_id long, lines array<string>")
    done = S.delete_terms(rows, ["ab", "x"]).first()
    assert (done["new_lines"], done["hits"], done["removed"]) == (["", ""], 4, 1)
    after = S.delete_terms(rows, ["ab", "x"]).select("doc_id", F.col("new_lines").alias("lines"))
    assert S.residue(after, ["ab", "x"]).count() == 0


def test_terms(spark):
    rows = spark.createDataFrame([(1, ["the cat"]), (2, ["a dog"])], "doc_id long, lines array<string>")
    assert [r.term for r in S.missing_terms(rows, [" cat ", "cow", "cat"]).collect()] == ["cow"]
    assert {r.term: r.total for r in S.term_counts(rows, ["cat", "cow"]).collect()} == {"cat": 1, "cow": 0}
    with pytest.raises(ValueError):
        S.clean_terms([" "])
    with pytest.raises(ValueError):
        S.clean_terms(["x" * 201])


def test_preview(spark):
    assert one(spark, T.preview(F.lit("a" * 30 + "HIT" + "b" * 30), F.lit(30), F.lit(33))) == "…" + "a" * 18 + "HIT" + "b" * 18 + "…"


def test_null_cells_are_equal(spark):
    hits = spark.createDataFrame([(1, 1, 0, None, None), (1, 1, 1, 2, 3)], "doc_id long, page int, para int, cell_row int, cell_col int")
    assert S.restrict_to_targets(hits, hits.limit(1)).count() == 1
