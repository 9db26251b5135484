"""Queries on rows of glyphs: nothing that texts explode into goes to the driver, and odd geometry."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import pagemodel as M
from quire.plans import glyph_plans

SMALL = "/root/testdata/sf0.001"
GLYPH = "doc_id long, page int, op_index int, char_index int, x0 double, y0 double, x1 double"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w2_split_columns", "w3_build_rows", "w17_items_to_lines", "a4_left_margin", "w5_paragraphs", "a2_paragraph_stats", "w10_footer_row"])
def test_no_glyphs_are_broadcast(spark, name):
    assert "Broadcast" not in plan_of(entry.queries()[name](spark, SMALL))


def test_glyphs_of_a_page_are_moved_as_texts(spark):
    plan = plan_of(M.build_rows(glyph_plans.glyph_table(spark, SMALL)))
    assert all("op_index" not in line and "y0" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_columns_of_repeated_and_turned_spans(spark):
    spans = [(0.0, 10.0), (0.0, 10.0), (30.0, 40.0), (30.0, 40.0), (35.0, 36.0), (80.0, 60.0), (80.0, 60.0), (80.0, 60.0), (None, 5.0)]
    g = spark.createDataFrame([(1, 1, 0, i, a, 0.0, b) for i, (a, b) in enumerate(spans)] + [(None, 1, 0, 0, 0.0, 0.0, 1.0)], GLYPH)
    assert sorted((r.x0, r.band) for r in M.split_columns(g).collect()) == [(0.0, 0)] * 2 + [(30.0, 1)] * 2 + [(35.0, 1)] + [(80.0, 2)] * 3


def test_rows_of_many_heights(spark):
    r = random.Random(3)
    heights = [None, -0.0, 0.0, *[k * 0.75 for k in range(40)]]
    rows = [(d, p, 0, i, 0.0, r.choice(heights), 1.0) for d in (1, 2) for p in (1, 2) for i in range(60)]
    want = []
    for page in {x[:2] for x in rows}:
        last = None
        for y in sorted((x[5] for x in rows if x[:2] == page and x[5] is not None), reverse=True):
            last = y if last is None or last - y > 2.0 else last
            want.append((*page, y, last))
    found = M.build_rows(spark.createDataFrame(rows, GLYPH)).select("doc_id", "page", "y0", "row_y").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_paragraphs_of_equal_margins(spark):
    rows = [(1, 1, 100.0, 50.0, 10.0, 1), (1, 1, 85.0, 40.0, 10.0, 2), (1, 1, 70.0, 40.0, 10.0, 2), (1, 1, 55.0, 50.0, 10.0, 1), (1, 2, 9.0, None, 10.0, 1)]
    found = M.paragraphs(spark.createDataFrame(rows, "doc_id long, page int, row_y double, x0 double, size double, cols int"))
    assert found.columns == ["doc_id", "page", "row_y", "x0", "size", "cols", "gap", "para"]
    assert [r.para for r in found.where("page = 1").orderBy(F.desc("row_y")).collect()] == [0, 0, 0, 1]
    stats = M.paragraph_stats(found.withColumn("x1", F.lit(1.0))).orderBy("page", "para").collect()
    assert [(r.page, r.para, r.lines, r.table_like, r.gap) for r in stats] == [(1, 0, 3, True, 15.0), (1, 1, 1, False, 15.0), (2, 0, 1, False, 0.0)]


def test_cells_keep_no_glyphs_on_disk(spark, monkeypatch):
    kept = {}
    for part in (M, glyph_plans):
        monkeypatch.setattr(part, "staged", lambda df, name, real=part.staged: kept.setdefault(name, real(df, name)))
    found = entry.queries()["w6_table_cells"](spark, SMALL)
    pages = spark.read.parquet(f"{SMALL}/conversations.parquet").where("text <> ''")
    n_rows = pages.selectExpr("sum(ceil(char_length(text) / 60))").first()[0]
    assert set(kept) == {"rows", "cell-rows", "cell-columns"} and not any({"text", "char_index", "x0"} & set(df.columns) for df in kept.values())
    assert kept["rows"].count() == n_rows and max(kept[k].count() for k in ("cell-rows", "cell-columns")) <= pages.count()
    assert "Broadcast" not in plan_of(found) and found.count() > 0
