"""Literal cases of measuring, wrapping, rows and rules."""

import random

from pyspark.sql import functions as F

from quire.operators import glyphs as G
from quire.operators import pagemodel as M
from quire.operators import reflow as R


def test_measure(spark):
    assert round(spark.range(1).select(G.measure_text(F.lit("Hi"), 10.0)).first()[0], 4) == 9.44


def test_wrap(spark):
    assert R.wrap_line("aa bb", 10, 15) == ["aa", "bb"]
    r = random.Random(1)
    for _ in range(300):
        line = "".join(r.choice("ab c日本") for _ in range(r.randint(0, 40)))
        parts = R.wrap_line(line, 10, 60)
        assert "".join(parts).replace(" ", "") == line.replace(" ", "")
        assert all(len(p) == 1 or sum(map(R.width, p)) / 100 <= 60 for p in parts if p)
        assert "".join(x for x, _ in R.wrap_kinsoku_line(line, 10, 60, 60)) == line
    assert spark.range(1).select(R.wrap_text(F.lit("aa bb\ncc"), F.lit(10), F.lit(15))).first()[0] == ["aa", "bb", "cc"]


def test_kinsoku():
    assert R.wrap_kinsoku_line("日日日日日。日", 10, 50, 50)[0] == ("日日日日日。", True)
    assert R.wrap_kinsoku_line("日日日日（日", 10, 50, 50)[0] == ("日日日日", True)
    # One closing mark is what does not fit, two more may follow; the rest goes down.
    for marks, lines in ((2, [12]), (3, [13]), (4, [13, 1]), (7, [13, 4])):
        assert [len(x) for x, _ in R.wrap_kinsoku_line("日" * 10 + "。" * marks, 10, 100, 100)] == ([10 + marks] if marks < 4 else lines)
    # A blank that does not fit is no place to break at later.
    assert R.wrap_kinsoku_line("aa bb", 10, 15, 15) == [("aa ", True), ("bb", False)]


def test_rows_follow_the_anchor(spark):
    g = spark.createDataFrame([(1, 1, i, 0, 10.0 * i, y, 10.0 * i + 5, y + 10, "x", "F") for i, y in enumerate((100.0, 98.5, 97.0))], "doc_id long, page int, op_index int, char_index int, x0 double, y0 double, x1 double, y1 double, text string, font_alias string")
    assert sorted((r.y0, r.row_y) for r in M.build_rows(g).collect()) == [(97.0, 97.0), (98.5, 100.0), (100.0, 100.0)]


def test_open_intersection(spark):
    g = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    at = lambda x: spark.createDataFrame([(1, 1, x, 0.0, 5.0, 5.0)], "doc_id long, page int, x double, y double, w double, h double")
    assert G.glyphs_in_regions(g, at(10.0)).count() == 0 and G.glyphs_in_regions(g, at(9.9)).count() == 1
    assert G.redact_glyphs(g, at(10.0)).count() == 1 and G.redact_glyphs(g, at(9.9)).count() == 0


def test_footer(spark):
    rows = spark.createDataFrame([(1, 1, float(y)) for y in (20, 100, 115, 130, 145)], "doc_id long, page int, row_y double")
    found = M.footer_row(rows).collect()
    assert [(r.row_y, r.gap, r.body) for r in found] == [(20.0, 80.0, 15.0)]


def test_pages_of_lines(spark):
    lines = spark.range(100).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line"))
    found = {r.line: (r.page, r.y) for r in R.paginate_lines(lines, 12.0).collect()}
    assert found[0] == (0, 798.72) and found[48][0] == 0 and found[49] == (1, 798.72) and found[99][0] == 2


def test_flow(spark):
    rows = spark.createDataFrame([(1, 1, i, 40.0) for i in range(5)], "doc_id long, page int, n int, height double")
    found = {r.n: (r.new_page, r.new_y) for r in R.flow_pages(rows, 120.0, 24.0).collect()}
    assert found == {0: (1, 120.0), 1: (1, 80.0), 2: (2, 120.0), 3: (2, 80.0), 4: (3, 120.0)}
