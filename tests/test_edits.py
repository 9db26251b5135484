"""Edits of pages keep what they should: rows, lengths of bars, distances; rule and thin bands by hand."""

import pytest
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import pagemodel as M

ROWS = "doc_id long, page int, col int, row_y double, is_footer boolean, at int, shift string"
RECTS = "doc_id long, page int, col int, seq int, x0 double, y0 double, x1 double, y1 double, rotated boolean"


def page(spark):
    rows = [(1, 1, c, 700.0 - 20 * i, i == 9, i, "s") for c in (0, 1) for i in range(10)]
    rects = [(1, 1, 0, i, 50.0, 709.5 - 20 * i, 300.0, 710.5 - 20 * i, False) for i in range(10)] + [(1, 1, 0, 100, 50.0, 530.0, 51.0, 710.0, False), (1, 1, 0, 101, 60.0, 540.0, 90.0, 545.0, True)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(rects, RECTS)


def edits(spark, rows, kind):
    return E.row_edits(spark.createDataFrame(rows, "doc_id long, page int, col int, high double, low double"), kind)


def test_a_copied_and_a_deleted_row(spark):
    rows, rects = page(spark)
    both = edits(spark, [(1, 1, 0, 690.0, 670.0)], "insert").unionByName(edits(spark, [(1, 1, 0, 650.0, 630.0), (1, 1, 0, 9.0, 8.5)], "delete"))
    assert both.count() == 2
    done = E.edit_rows(rows, both).where("col = 0").collect()
    got = {(r.at, r.copied): r.new_y for r in done}
    assert got[1, False] == 680.0 and got[1, True] == 660.0 and got[2, False] == 640.0 and (3, False) not in got
    # Below both, a row in and a row out cancel each other; the footer never moves.
    assert got[4, False] == 620.0 and got[9, False] == 520.0 and len(done) == 10 and all(r.fits for r in done)
    assert all(r.new_y == r.row_y for r in E.edit_rows(rows, both).where("col = 1").collect())
    after = {(r.seq, r.added): (r.new_y0, r.new_y1) for r in E.edit_rects(rects, both).collect()}
    assert after[100, False] == (530.0, 710.0) and after[101, False] == (540.0, 545.0)
    # The rule below row 3 is gone, that below row 1 comes again, one band lower.
    assert (4, False) not in after and after[2, False] == (669.5, 670.5) and after[2, True] == (649.5, 650.5) and len(after) == 12


def test_bars_grow_by_what_is_put_in(spark):
    _, rects = page(spark)
    for kind, delta in (("insert", 20.0), ("delete", -20.0)):
        after = {r.seq: r for r in E.edit_rects(rects, edits(spark, [(1, 1, 0, 690.0, 670.0)], kind)).where("NOT added").collect()}
        assert (after[100].new_y0, after[100].new_y1) == (530.0 - delta, 710.0) and after[8].new_y0 == 549.5 - delta


def test_too_little_room_and_no_edits(spark):
    rows, rects = page(spark)
    tall = edits(spark, [(1, 1, 0, 690.0, 20.0)], "insert")
    assert not any(r.fits for r in E.edit_rows(rows, tall).where("col = 0").collect())
    none = tall.limit(0)
    assert all(r.new_y == r.row_y for r in E.edit_rows(rows, none).collect()) and E.edit_rects(rects, none).count() == 12


def test_rewrapped_lines_push_down_what_is_below(spark):
    paragraphs = spark.createDataFrame([(1, 1, 0, 0, 700.0, 685.0, 50.0, 65.0, 10.0, 15.0, 2), (1, 1, 0, 1, 670.0, 670.0, 50.0, 65.0, 10.0, 15.0, 1)], "doc_id long, page int, col int, para int, top double, bottom double, left double, right double, size double, gap double, lines int")
    made = E.rewraps(paragraphs, spark.createDataFrame([(1, 1, 0, 0, "aa bb aa bb aa")], "doc_id long, page int, col int, para int, text string"))
    assert [(r.new_lines, r.delta) for r in made.collect()] == [(5, 45.0)]
    rows = spark.createDataFrame([(1, 1, 0, y, False) for y in (700.0, 685.0, 670.0)], "doc_id long, page int, col int, row_y double, is_footer boolean")
    assert sorted(r.new_y for r in E.edit_rows(rows, made).collect()) == [625.0, 685.0, 700.0]


@pytest.mark.parametrize(("counts", "want"), [([2, 1, 3, 1], [0, 0, 1, 1]), ([1, 1, 1, 2], [0, 0, 0, 1]), ([1, 5, 1], [0, 0, 0]), ([1], [0]), ([1, 1], [0, 0]), ([3, 3], [0, 1])])
def test_thin_bands(spark, counts, want):
    rows = [(1, 1, b, 100.0 - k) for b, n in enumerate(counts) for k in range(n)]
    found = M.merge_thin_bands(spark.createDataFrame(rows, "doc_id long, page int, band int, row_y double")).select("band", "col").distinct().orderBy("band").collect()
    assert [r.col for r in found] == want


def test_rule_bands(spark):
    rows = spark.createDataFrame([(1, 1, y, 10.0) for y in (100.0, 90.0, 80.0, 60.0, 125.0)], "doc_id long, page int, row_y double, size double")
    rules = spark.createDataFrame([(1, 1, y) for y in (105.0, 85.0, 75.0, 400.0)], "doc_id long, page int, rule_y double")
    found = lambda **how: [r.rule_band for r in M.rule_bands(rows, rules, **how).orderBy(F.desc("row_y")).collect()]
    assert found() == [None, 0, 0, 1, None]
    assert found(outside=True) == [-1, 0, 0, 1, 2]
    few = rules.where("rule_y > 300")
    assert [r.rule_band for r in M.rule_bands(rows, few, outside=True).orderBy(F.desc("row_y")).collect()] == [0, 1, 2, 3, 4]
