"""Edits of pages as three tables: rows of text, rectangles, and what is done to them.

An edit stands at a height of a column and pushes all below it down, or pulls it up: a
paragraph that gets more or fewer lines, a table row that is copied or taken out. All edits of
a column apply together. One running sum of their heights, from the top of the column down,
says how far anything at a height moves; rows, both ends of upright bars and the centres of
all other rectangles are looked up in it at once, in windows that never hold more than a
column of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.reflow import wrap_text

COLUMN = ["doc_id", "page", "col"]
#: How far below its line an edit takes hold, how near a dropped rule lies, and how wide bars are at most.
BELOW, NEAR, BAR = 0.5, 1.5, 1.5


def rewraps(paragraphs: DataFrame, texts: DataFrame) -> DataFrame:
    """Edits from new texts (doc_id, page, col, para, text) of paragraphs (the same keys, top, bottom, left, right, size, gap, lines): as many lines as the text takes in the paragraph's width."""
    keys = [*COLUMN, "para"]
    made = paragraphs.join(texts.select(*keys, F.col("text").alias("__text")), keys)
    new = F.size(wrap_text(F.col("__text"), F.col("size"), F.col("right") - F.col("left")))
    return made.withColumn("new_lines", new).select(
        *COLUMN, F.lit("rewrap").alias("kind"), F.col("top").alias("high"), F.col("bottom").alias("low"), ((F.col("new_lines") - F.col("lines")) * F.col("gap")).alias("delta"), "para", "new_lines")


def row_edits(bands: DataFrame, kind: str) -> DataFrame:
    """Edits that copy (`insert`) or take out (`delete`) the table rows between two rules (doc_id, page, col, high, low); bands of 1 or less are none."""
    sign = {"insert": 1.0, "delete": -1.0}[kind]
    return bands.where("high - low > 1").select(*COLUMN, F.lit(kind).alias("kind"), "high", "low", ((F.col("high") - F.col("low")) * sign).alias("delta"))


def shifted(points: DataFrame, edits: DataFrame) -> DataFrame:
    """points (doc_id, page, col, __at, ...) with shift: how far down all edits above them push."""
    sums = edits.groupBy(*COLUMN, (F.col("low") - BELOW).alias("__at")).agg(F.sum("delta").alias("__delta"))
    down = Window.partitionBy(*COLUMN).orderBy(F.col("__at").desc(), F.col("__delta").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = points.withColumn("__point", F.lit(True)).unionByName(sums, allowMissingColumns=True)
    return both.withColumn("shift", F.coalesce(F.sum("__delta").over(down), F.lit(0.0))).where("__point").drop("__point", "__delta")


def _bands(edits: DataFrame, kind: str) -> DataFrame:
    return edits.where(F.col("kind") == kind).select(*[F.col(c).alias(f"__{c}") for c in COLUMN], F.col("high").alias("__high"), F.col("low").alias("__low")).distinct()


def _column() -> Column:
    met = F.lit(True)
    for c in COLUMN:
        met = met & (F.col(c) == F.col(f"__{c}"))
    return met


def edit_rows(rows: DataFrame, edits: DataFrame, bottom: float = 24.0) -> DataFrame:
    """Rows (doc_id, page, col, row_y, is_footer, ...) after all edits: new_y, copied, and fits, false for columns in which a row would pass the bottom.

    Rows of deleted bands go; each row of an inserted band comes twice, the copy a band lower.
    Footers stay where they are. What is below an edited paragraph moves; its own rows are
    for the caller to set anew.
    """
    inside = (F.col("row_y") < F.col("__high")) & (F.col("row_y") > F.col("__low"))
    kept = rows.join(_bands(edits, "delete"), _column() & inside & ~F.col("is_footer"), "left_anti")
    moved = shifted(kept.withColumn("__at", F.col("row_y")), edits).drop("__at")
    moved = moved.withColumn("new_y", F.when(F.col("is_footer"), F.col("row_y")).otherwise(F.col("row_y") - F.col("shift"))).drop("shift")
    twice = moved.join(_bands(edits, "insert"), _column() & inside & ~F.col("is_footer"))
    copies = twice.withColumn("new_y", F.col("new_y") - (F.col("__high") - F.col("__low"))).select(*moved.columns, F.lit(True).alias("copied"))
    every = moved.withColumn("copied", F.lit(False)).unionByName(copies)
    low = F.min(F.when(~F.col("is_footer"), F.col("new_y"))).over(Window.partitionBy(*COLUMN))
    return every.withColumn("fits", F.coalesce(low >= bottom, F.lit(True)))


def edit_rects(rects: DataFrame, edits: DataFrame) -> DataFrame:
    """Rectangles (doc_id, page, col, seq, x0, y0, x1, y1, rotated) after all edits: new_y0, new_y1 and added.

    Bars (at most BAR wide) are stretched or shortened, as their ends move each for itself; other
    rectangles move with their centre; rotated ones stay. The rule under a deleted row goes, and
    that under a copied one comes again below the copy (flat ones only, others are not rules).
    """
    centre, flat = (F.col("y0") + F.col("y1")) / 2, (F.col("x1") - F.col("x0") > BAR) & ~F.col("rotated")
    under = F.abs(centre - F.col("__low")) <= NEAR
    kept = rects.join(_bands(edits, "delete"), _column() & flat & under, "left_anti")
    bar = (F.col("x1") - F.col("x0") <= BAR)
    ends = F.array(F.struct(F.lit("low").alias("end"), F.when(bar, F.col("y0")).otherwise(centre).alias("__at")), F.struct(F.lit("high").alias("end"), F.when(bar, F.col("y1")).otherwise(centre).alias("__at")))
    points = shifted(kept.select(*COLUMN, "seq", "y0", "y1", "rotated", F.inline(ends)), edits)
    moved = points.groupBy(*COLUMN, "seq").agg(*[F.first(c).alias(c) for c in ("y0", "y1", "rotated")], *[F.max(F.when(F.col("end") == e, F.col("shift"))).alias(e) for e in ("low", "high")])
    stay = F.col("rotated")
    moved = moved.select(*COLUMN, "seq", F.when(stay, F.col("y0")).otherwise(F.col("y0") - F.col("low")).alias("new_y0"), F.when(stay, F.col("y1")).otherwise(F.col("y1") - F.col("high")).alias("new_y1"))
    again = kept.join(_bands(edits, "insert"), _column() & flat & under).select(*COLUMN, "seq", (F.col("__high") - F.col("__low")).alias("__more"))
    added = moved.join(again, [*COLUMN, "seq"]).select(*COLUMN, "seq", (F.col("new_y0") - F.col("__more")).alias("new_y0"), (F.col("new_y1") - F.col("__more")).alias("new_y1"), F.lit(True).alias("added"))
    return moved.withColumn("added", F.lit(False)).unionByName(added)
