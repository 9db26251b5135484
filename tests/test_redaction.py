"""Redaction by terms end to end: boxes, what goes, what is left, titles that repeat it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import glyphs as G
from quire.operators import redaction as R

GLYPHS = "doc_id long, page int, op_index int, char_index int, x0 double, y0 double, x1 double, y1 double, row_y double, font_alias string, text string"


def page(lines, doc=1):
    return [(doc, 1, r, i, 10.0 * i, 700.0 - 20 * r, 10.0 * i + 10, 710.0 - 20 * r, 700.0 - 20 * r, "F1", c) for r, line in enumerate(lines) for i, c in enumerate(line)]


def redacted(spark, lines, terms, **how):
    return R.redact_terms(spark.createDataFrame(page(lines), GLYPHS), terms, **how).collect()


def test_hits_across_lines_and_what_is_left(spark):
    row = redacted(spark, ["see the se", "cret here"], ["secret", "SEE"])[0]
    assert row.left == " the  here" and row.removed == 9 and row.residue == 0 and dict(row.hits) == {0: 1, 1: 1}
    assert [tuple(b) for b in row.regions] == [(0.02, 680.02, 39.98, 689.98), (0.02, 700.02, 29.98, 709.98), (80.02, 700.02, 99.98, 709.98)]
    assert redacted(spark, ["nothing here"], ["secret"]) == []


def test_modes(spark):
    lines = ["one secret", "two", "three"]
    assert [redacted(spark, lines, ["secret"], mode=m)[0].left for m in ("term", "line", "para")] == ["one twothree", "twothree", ""]
    with pytest.raises(ValueError):
        redacted(spark, lines, ["secret"], mode="word")


def test_what_a_redaction_makes_is_told_or_redacted(spark):
    assert redacted(spark, ["sesecretcret"], ["secret"])[0].residue == 1
    row = redacted(spark, ["sesecretcret!"], ["secret"], until_clean=True)[0]
    assert (row.left, row.residue, row.removed, row.hits) == ("!", 0, 12, {0: 2})


def test_boxes_meet_as_they_should():
    boxes = np.array([[0, 10, 5, 20], [5, 10, 9, 20], [12, 10, 15, 20], [0, 30, 5, 40.0]])
    assert R.merged(boxes).tolist() == [[0, 30, 5, 40], [0, 10, 9, 20], [12, 10, 15, 20]]
    assert R.drawn(np.array([[0, 0, 0.05, 9.0], [0, 0, 9, 9], [0, 0, 9, 9]])).tolist() == [[0.02, 0.02, 8.98, 8.98]]
    assert len(R.merged(np.empty((0, 4)))) == 0


def test_titles_that_repeat_what_was_removed(spark):
    found = R.redact_terms(spark.createDataFrame(page(["my Secret"]) + page(["nothing"], 2), GLYPHS), ["secret"])
    outline = spark.createDataFrame([(1, 1, "The SECRET plan"), (1, 2, "Other"), (2, 3, "The secret plan")], "doc_id long, node_id long, title string")
    assert {r.node_id: r.redacted for r in G.redact_outline(outline, R.killed_texts(found)).collect()} == {1: True, 2: False, 3: False}


def test_found_boxes(spark):
    row = R.find_boxes(spark.createDataFrame(page(["a the", "the b th", "e"]), GLYPHS), "the").first()
    assert row["count"] == 3 and [tuple(b) for b in row["boxes"]] == [(20.0, 700.0, 50.0, 710.0), (0.0, 680.0, 30.0, 690.0), (60.0, 680.0, 80.0, 690.0), (0.0, 660.0, 10.0, 670.0)]


@pytest.mark.parametrize("mode", ["term", "line"])
def test_no_residue_on_whole_pages(spark, mode):
    from quire.plans.glyph_plans import _even

    pages = _even(spark, "/root/testdata/sf0.001").withColumn("row_y", F.col("y0"))
    done = R.redact_terms(pages, ["the", "tion", "he"], mode=mode, until_clean=True).cache()
    assert done.count() > 0 and done.where("residue > 0 OR removed = 0").count() == 0
