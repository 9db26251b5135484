"""The page model: columns, rows, paragraphs, cells and rules from the geometry of glyphs.

All windows are keyed by page (and column), so a task sorts pages, never documents. Rows
come from anchors: the distinct heights of a page are folded from the top, and each starts
a row unless it lies within reach of the last start.

Glyphs exploded from texts are far more than Spark supposes from the size of the file, which
it would then broadcast by way of the driver. So nothing that is made of glyphs is joined to
them but a row for a page, with the hint to merge; what can be is a window over the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.staging import staged

PAGE = ["doc_id", "page"]


def anchors(values: Column, reach: float, descending: bool = False) -> Column:
    """Starts of clusters of sorted values: a value starts one unless within reach of the last start."""
    ordered = F.sort_array(F.array_distinct(values), asc=not descending)
    return F.aggregate(ordered, F.array().cast("array<double>"), lambda acc, v: F.when(
        (F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1)) - v) <= reach), acc).otherwise(F.concat(acc, F.array(v))))


def split_columns(glyphs: DataFrame, gap: float = 12.0) -> DataFrame:
    """glyphs with band: columns of the page, parted where no glyph reaches over a gap of more than `gap`."""
    across = Window.partitionBy(*PAGE).orderBy("x0", "x1")
    far = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce((F.lag("x0").over(across) == F.col("x0")) & (F.lag("x1").over(across) == F.col("x1")), F.lit(False))
    flagged = glyphs.dropna(subset=[*PAGE, "x0", "x1"]).withColumn("fresh", F.coalesce(((F.col("x0") - far > gap) & ~again).cast("int"), F.lit(0)))
    return flagged.withColumn("band", F.sum("fresh").over(across.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def merge_thin_bands(rows: DataFrame) -> DataFrame:
    """rows (band, row_y) with col: bands of a single row go with the column to their left, or at the left edge with the band to their right."""
    across = Window.partitionBy(*PAGE).orderBy("band")
    sized = rows.groupBy(*PAGE, "band").agg(F.count_distinct("row_y").alias("n")).withColumns({"at": F.row_number().over(across), "first": F.first("n").over(across)})
    starts = (F.col("at") == 1) | ((F.col("n") >= 2) & ~((F.col("at") == 2) & (F.col("first") == 1)))
    cols = sized.withColumn("starts", starts.cast("int")).select(*PAGE, "band", (F.sum("starts").over(across) - 1).alias("col"))
    return rows.join(cols, [*PAGE, "band"])


def build_rows(glyphs: DataFrame, reach: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """glyphs with row_y: the height of the first glyph of their row.

    A page's distinct heights and the rows they are of come to its glyphs as an array, in which a glyph's place is the rank of its height.
    """
    keys = keys or PAGE
    heights = glyphs.select(*keys, "y0").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("y0"), asc=False).alias("ys"))
    of = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(
        F.when(F.abs(F.try_element_at(acc, F.lit(-1)) - v) <= reach, F.try_element_at(acc, F.lit(-1))).otherwise(v))))
    down = Window.partitionBy(*keys).orderBy(F.col("y0").desc())
    ranked = glyphs.withColumn("__at", F.dense_rank().over(down))
    found = ranked.join(heights.select(*keys, of.alias("__rows")).hint("merge"), keys)
    return found.withColumn("row_y", F.get("__rows", F.col("__at") - 1)).where(F.abs(F.col("row_y") - F.col("y0")) <= reach).drop("__at", "__rows")


def row_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per text row: x0 of its first glyph, x1 of its last by x0, exact median size, fonts, text, cols and maxgap.

    A gap of more than max(2 * size, 6) starts a column.
    """
    keys = [*(keys or PAGE), "row_y"]
    place = F.struct("x0", "op_index", "char_index")
    stats = rows.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.max_by("x1", place).alias("x1"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("size"),
        F.array_sort(F.collect_set("font_alias")).alias("fonts"), F.array_sort(F.collect_list(F.struct("x0", "op_index", "char_index", "x1", "text"))).alias("g"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("g") - 1), lambda i: F.get("g", i)["x0"] - F.get("g", i - 1)["x1"])
    gaps = F.when(F.size("g") > 1, pairs).otherwise(F.array().cast("array<double>"))
    limit = F.greatest(F.col("size") * 2, F.lit(6.0))
    made = stats.withColumn("gaps", gaps)
    return made.withColumns({
        "text": F.array_join(F.transform("g", lambda x: x["text"]), ""), "cols": F.size(F.filter("gaps", lambda d: d > limit)) + 1,
        "maxgap": F.greatest(F.coalesce(F.array_max("gaps"), F.lit(0.0)), F.lit(0.0)), "n": F.size("g")}).drop("g", "gaps")


def left_margin(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The most frequent start of rows, to one place; the least of equally frequent ones."""
    keys = keys or PAGE
    counts = rows.groupBy(*keys, F.round("x0", 1).alias("left")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("left", F.struct(-F.col("n"), F.col("left"))).alias("left"))


def paragraphs(rows: DataFrame, keys: list[str] | None = None, indent: float = 3.0, share: float = 0.25) -> DataFrame:
    """rows with para (from 0, top down).

    A row goes on with the paragraph above if it starts at the left margin, its distance is
    the usual one and its size the same; rows of one rule band (column band, if present)
    always stay together.
    """
    keys = keys or PAGE
    page = Window.partitionBy(*keys)
    down = page.orderBy(F.col("row_y").desc())
    spaced = rows.withColumns({"gap": F.lag("row_y").over(down) - F.col("row_y"), "above": F.lag("size").over(down), "start": F.round("x0", 1)})
    counted = spaced.withColumns({"body": F.percentile("gap", 0.5).over(page), "n_start": F.count(F.lit(1)).over(Window.partitionBy(*keys, "start"))})
    base = counted.withColumn("left", F.min_by("start", F.struct(-F.col("n_start"), F.col("start"))).over(page))
    same_gap = (F.col("body") > 0) & (F.abs(F.col("gap") - F.col("body")) <= F.greatest(F.lit(1.2), F.col("body") * share))
    same = same_gap & (F.abs(F.col("x0") - F.col("left")) <= indent) & (F.abs(F.col("size") - F.col("above")) <= 0.6)
    if "rule_band" in rows.columns:
        same = same | (F.col("rule_band") == F.lag("rule_band").over(down))
    fresh = (~F.coalesce(same, F.lit(False))).cast("int")
    return base.withColumn("fresh", fresh).withColumn("para", (F.sum("fresh").over(down) - 1).cast("int")).drop("fresh", "above", "body", "left", "start", "n_start")


def paragraph_stats(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per paragraph: top, bottom, left, right, lines, cols, table_like (two rows and half of them with columns), and gap: between its rows on average, of a single row the page's usual one (from the column `gap` of rows; 0 without any)."""
    keys = [*(keys or PAGE), "para"]
    many = F.count_if(F.col("cols") >= 2)
    usual = F.percentile("gap", 0.5).over(Window.partitionBy(*PAGE))
    stats = rows.withColumn("usual", usual).groupBy(*keys).agg(
        F.max("row_y").alias("top"), F.min("row_y").alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.count(F.lit(1)).alias("lines"),
        F.max("cols").alias("cols"), ((many >= 2) & (many * 2 >= F.count(F.lit(1)))).alias("table_like"), F.first("usual").alias("usual"))
    own = (F.col("top") - F.col("bottom")) / F.nullif(F.col("lines") - 1, F.lit(0))
    return stats.withColumn("gap", F.coalesce(own, "usual", F.lit(0.0))).drop("usual")


def dominant_font(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent font; of equally frequent ones that seen first."""
    counts = glyphs.groupBy(*keys, "font_alias").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("op_index", "char_index")).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by("font_alias", F.struct(-F.col("n"), F.col("first"))).alias("font_alias"))


def horizontal_rules(rects: DataFrame, thin: float = 2.0, wide: float = 30.0, reach: float = 0.6) -> DataFrame:
    """Rules: painted flat rectangles, those within reach of the first one's centre taken together."""
    flat = rects.where("painted AND NOT rotated").withColumn("y", (F.col("y0") + F.col("y1")) / 2).where((F.col("y1") - F.col("y0") <= thin) & (F.col("x1") - F.col("x0") >= wide))
    starts = flat.groupBy(*PAGE).agg(F.collect_set("y").alias("ys")).select(*PAGE, F.explode(anchors(F.col("ys"), reach, True)).alias("rule_y"))
    near = flat.join(starts, PAGE).where(F.abs(F.col("rule_y") - F.col("y")) <= reach)
    own = near.groupBy(*PAGE, "seq").agg(F.max("rule_y").alias("rule_y"))
    return flat.join(own, [*PAGE, "seq"]).groupBy(*PAGE, "rule_y").agg(F.max("y1").alias("top"), F.min("y0").alias("bottom"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("parts"))


def enclosing_rules(points: DataFrame, rules: DataFrame, slack: float = 0.6) -> DataFrame:
    """The nearest rule above and below each point (doc_id, page, id, top, bottom); no rows without both or where they are 1 apart or less."""
    joined = points.join(rules.select(*PAGE, F.col("rule_y").alias("y")), PAGE)
    above = F.min(F.when(F.col("y") >= F.col("top") - slack, F.col("y")))
    below = F.max(F.when(F.col("y") <= F.col("bottom") + slack, F.col("y")))
    found = joined.groupBy(*PAGE, "id").agg(above.alias("above"), below.alias("below"))
    return found.withColumn("height", F.col("above") - F.col("below")).where(F.col("height") > 1)


def row_rule_band(rows: DataFrame, rules: DataFrame, reach: float = 1.5) -> DataFrame:
    """rows with rule_band: the first pair of neighbouring rules, from the top, that the row lies between; null outside."""
    down = Window.partitionBy(*PAGE).orderBy(F.col("rule_y").desc())
    bands = rules.select(*PAGE, F.col("rule_y").alias("high"), F.lead("rule_y").over(down).alias("low"), (F.row_number().over(down) - 1).alias("band")).where("low IS NOT NULL")
    inside = rows.select(*PAGE, "row_y").distinct().join(bands, PAGE).where((F.col("row_y") <= F.col("high") + reach) & (F.col("row_y") > F.col("low") - reach))
    return rows.join(inside.groupBy(*PAGE, "row_y").agg(F.min("band").alias("rule_band")), [*PAGE, "row_y"], "left")


def rule_bands(rows: DataFrame, rules: DataFrame, keys: list[str] | None = None, reach: float = 1.5, pad: Column | float = 30.0, outside: bool = False) -> DataFrame:
    """rows with rule_band: the first pair of neighbouring rules, from the top, that the row lies between, of the rules within `pad` of the rows of the same keys.

    Without two rules there, or outside of all, it is null. With `outside` it is the number of
    the last rule for rows below it, -1 above the first, and without two rules the row's own
    place from the top. The rules of a page, which are few, come to its rows as an array.
    """
    keys = keys or PAGE
    ends = rows.groupBy(*keys).agg(F.min("row_y").alias("__low"), F.max("row_y").alias("__high"), F.max_by("size", "row_y").alias("__size"))
    lists = rules.groupBy(*PAGE).agg(F.sort_array(F.collect_set("rule_y"), asc=False).alias("__all"))
    wide = F.greatest(F.col("__size") * 2.5, F.lit(20.0)) if outside else F.lit(pad)
    near = F.filter("__all", lambda y: (y >= F.col("__low") - wide) & (y <= F.col("__high") + wide))
    held = ends.join(lists, PAGE, "left").withColumn("__near", F.coalesce(near, F.array().cast("array<double>"))).select(*keys, "__near")
    here, last = F.col("row_y"), F.size("__near") - 1
    inside = F.filter(F.sequence(F.lit(0), last - 1), lambda i: (here <= F.get("__near", i) + reach) & (here > F.get("__near", i + 1) - reach))
    joined = rows.join(held, keys)
    band = F.when(last >= 1, F.get(inside, F.lit(0)))
    if outside:
        beyond = F.when(here <= F.get("__near", last), last).otherwise(-1)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(here.desc())) - 1
        band = F.when(last >= 1, F.coalesce(band, beyond)).otherwise(place)
    return joined.withColumn("rule_band", band.cast("int")).drop("__near")


def footer_row(rows: DataFrame) -> DataFrame:
    """The lowest row of a page if it lies over three times the usual distance below the next."""
    page = Window.partitionBy(*PAGE)
    up = page.orderBy("row_y")
    gaps = rows.dropna(subset=PAGE).withColumns({"gap": F.lead("row_y").over(up) - F.col("row_y"), "at": F.row_number().over(up)})
    usual = gaps.withColumn("body", F.percentile("gap", 0.5).over(page))
    return usual.where((F.col("at") == 1) & (F.col("gap") > 3 * F.col("body"))).select(*PAGE, "row_y", "gap", "body")


def table_cells(rows: DataFrame, glyphs: DataFrame, rules: DataFrame, keys: list[str] | None = None, reach: float = 5.0) -> DataFrame:
    """Cells of the paragraphs (keys) of at least two rows (row_y, size, x1): row (place of its first row), gid, col, x0, x1, y0, y1, right, size and text.

    Column starts are first glyphs and those after a gap of max(2 * size, 6); those within
    reach of the first seen are one, and starts seen once are none. Fewer than two columns give
    no cells. Rows between the same rules are one row of cells; right is the next column's
    start, or the paragraph's right edge.
    """
    keys = keys or PAGE
    down = Window.partitionBy(*keys).orderBy(F.col("row_y").desc())
    whole = Window.partitionBy(*keys)
    band = Window.partitionBy(*keys, "gid")
    placed = rows.select(*keys, "row_y", "size", "x1").withColumns({"at": F.row_number().over(down) - 1, "edge": F.max("x1").over(whole), "many": F.count(F.lit(1)).over(whole)})
    banded = rule_bands(placed.where("many >= 2").drop("x1", "many"), rules, keys, outside=True).withColumnRenamed("rule_band", "gid")
    high = banded.withColumns({"row": F.min("at").over(band), "low": F.min("row_y").over(band), "top": F.max("row_y").over(band), "tall": F.max_by("size", "row_y").over(band)})
    # The rows of a page come to its glyphs as an array, in which a glyph's place is that of its row's height; glyphs are made again rather than kept.
    listed = high.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "row_y", "size", "gid", "row", "low", "top", "tall"))).alias("rows"), F.first("edge").alias("edge"))
    held = staged(listed.select("*", F.transform("rows", lambda r: r["row_y"]).alias("heights")), "cell-rows")

    def sized(pages: DataFrame) -> DataFrame:
        found = glyphs.join(pages.hint("merge"), keys).withColumn("own", F.get("rows", (F.array_position("heights", F.col("row_y")) - 1).cast("int")))
        return found.where("own IS NOT NULL").drop("rows", "heights")

    line = Window.partitionBy(*keys, "row_y").orderBy("x0", "op_index", "char_index")
    spaced = sized(held).select(*keys, "row_y", "own.at", "own.size", "x0", "x1", "op_index", "char_index").withColumn("gap", F.col("x0") - F.lag("x1").over(line))
    starts = spaced.where(F.col("gap").isNull() | (F.col("gap") > F.greatest(F.col("size") * 2, F.lit(6.0))))
    seen = starts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("x0").alias("x")))), lambda s: s["x"]).alias("xs"))
    fold = F.aggregate("xs", F.array().cast("array<struct<x:double,n:int>>"), lambda acc, v: F.when(
        F.exists(acc, lambda b: F.abs(b["x"] - v) <= reach),
        F.transform(acc, lambda b, i: F.when(i == F.array_position(F.transform(acc, lambda c: F.abs(c["x"] - v) <= reach), True) - 1, F.struct(b["x"].alias("x"), (b["n"] + 1).alias("n"))).otherwise(b))
    ).otherwise(F.concat(acc, F.array(F.struct(v.alias("x"), F.lit(1).alias("n"))))))
    cols = staged(seen.select(*keys, F.sort_array(F.transform(F.filter(fold, lambda b: b["n"] >= 2), lambda b: b["x"])).alias("cols")).where(F.size("cols") >= 2), "cell-columns")
    of = sized(held.join(cols.hint("merge"), keys)).select(*keys, "own", "edge", "cols", "x0", "x1", "y0", "op_index", "char_index", "text").withColumns(
        {"gid": F.col("own.gid"), "col": F.greatest(F.size(F.filter("cols", lambda c: c <= F.col("x0") + reach)) - 1, F.lit(0))})
    made = of.groupBy(*keys, "gid", "col").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.coalesce(F.get(F.first("cols"), F.col("col") + 1), F.first("edge")).alias("right"), F.first("own").alias("own"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.round("y0", 2)).alias("d"), "x0", "op_index", "char_index", "text"))), lambda g: g["text"]), "").alias("text"))
    return made.select(*keys, "own.row", "gid", "col", "x0", "x1", F.col("own.low").alias("y0"), (F.col("own.top") + F.col("own.tall")).alias("y1"), "right", F.col("own.tall").alias("size"), "text")


def merge_boxes(glyphs: DataFrame, keys: list[str], gap: float = 2.0) -> DataFrame:
    """Boxes of glyphs joined along rows: those within `gap` of the one before on nearly the same height."""
    run = Window.partitionBy(*keys).orderBy(F.round("y0", 1).desc(), "x0", "x1")
    same = (F.abs(F.col("y0") - F.lag("y0").over(run)) <= 2.0) & (F.col("x0") - F.lag("x1").over(run) <= gap)
    marked = glyphs.withColumn("fresh", (~F.coalesce(same, F.lit(False))).cast("int"))
    grouped = marked.withColumn("box", F.sum("fresh").over(run))
    return grouped.groupBy(*keys, "box").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def items_to_lines(items: DataFrame, keys: list[str], reach: float = 3.0) -> DataFrame:
    """The text of items (x0, y0, text) read line by line, joined by line ends."""
    rows = build_rows(items, reach, keys)
    lines = rows.groupBy(*keys, "row_y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), "").alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("d"), "line"))), lambda t: t["line"]), "\n").alias("text"))


def text_in_region(items: DataFrame, boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """The text of the items whose centre lies in a box (doc_id, page, box, r_x0, r_y0, r_x1, r_y1), read line by line."""
    joined = items.join(boxes, PAGE)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("r_x0") - slack, F.col("r_x1") + slack) & cy.between(F.col("r_y0") - slack, F.col("r_y1") + slack)
    return items_to_lines(joined.where(inside), [*PAGE, "box"])


def span_to_glyphs(glyphs: DataFrame, spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Glyphs of each span (keys, hit, a, b): those whose characters overlap it in the flat text of the segment; glyphs without text have none."""
    place = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("text")
    offset = glyphs.withColumn("e", F.sum(n).over(place)).withColumn("s", F.col("e") - n).where(F.col("e") > F.col("s"))
    return offset.join(spans, keys).where((F.col("e") > F.col("a")) & (F.col("s") < F.col("b"))).drop("e", "s")


def term_regions(hit_glyphs: DataFrame, keys: list[str], mode: str = "term", inset: float = 0.02, least: float = 0.05) -> DataFrame:
    """Boxes to redact: of the hits themselves, of their whole rows (line) or of the whole segment (para); distinct, drawn in a little.

    hit_glyphs: glyphs with keys and hit; for line and para also row_x0, row_x1 or seg_x0 to seg_y1.
    """
    if mode == "term":
        boxes = merge_boxes(hit_glyphs, [*keys, "hit"])
    elif mode == "line":
        boxes = hit_glyphs.groupBy(*keys, "row_y").agg(F.min("row_x0").alias("x0"), F.min("y0").alias("y0"), F.max("row_x1").alias("x1"), F.max("y1").alias("y1"))
    elif mode == "para":
        boxes = hit_glyphs.groupBy(*keys).agg(*[F.first(f"seg_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    else:
        raise ValueError(mode)
    drawn = boxes.select(*keys, *[F.round(F.col(c) + (inset if c[1] == "0" else -inset), 2).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return drawn.where((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least)).dropDuplicates()


def merge_line_rects(rects: DataFrame, keys: list[str], gap: float = 1.6) -> DataFrame:
    """Rectangles (keys, x0, y0, x1, y1) joined along rows: starts within max(2.5, height / 4) are one row, gaps up to `gap` close."""
    reach = rects.groupBy(*keys).agg(F.greatest(F.lit(2.5), F.max(F.col("y1") - F.col("y0")) / 4).alias("reach"), F.collect_set("y0").alias("ys"))
    starts = reach.select(*keys, "reach", F.explode(F.aggregate(
        F.sort_array("ys", asc=False), F.struct(F.array().cast("array<double>").alias("out"), F.col("reach").alias("r")),
        lambda acc, v: F.struct(F.when((F.size(acc["out"]) > 0) & (F.abs(F.try_element_at(acc["out"], F.lit(-1)) - v) <= acc["r"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(v))).alias("out"), acc["r"].alias("r")),
        lambda acc: acc["out"])).alias("row_y"))
    near = rects.join(starts, keys).where(F.abs(F.col("row_y") - F.col("y0")) <= F.col("reach"))
    own = near.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.max("row_y").alias("row_y"))
    row = Window.partitionBy(*keys, "row_y")
    run = row.orderBy("x0", "x1")
    far = F.max("x1").over(run.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("fresh", F.coalesce((F.col("x0") - far > gap).cast("int"), F.lit(1)))
    parts = marked.withColumns({"part": F.sum("fresh").over(run), "low": F.min("y0").over(row), "high": F.max("y1").over(row)})
    return parts.groupBy(*keys, "row_y", "part").agg(F.min("x0").alias("x0"), F.first("low").alias("y0"), F.max("x1").alias("x1"), F.first("high").alias("y1")).drop("part")


def replace_regions(glyphs: DataFrame, hits: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(glyphs that stay, one new text per page at the first glyph that goes). hits: glyphs under the regions; none is an error."""
    if hits.isEmpty():
        raise ValueError("nothing under the regions")
    keys = [*PAGE, "op_index", "char_index"]
    first = hits.groupBy(*PAGE).agg(F.min_by(F.struct("x0", (F.col("y0") + (F.col("y1") - F.col("y0")) * 0.2).alias("y"), (F.col("y1") - F.col("y0")).alias("size")), F.struct("op_index", "char_index")).alias("at"))
    return glyphs.join(hits.select(*keys), keys, "left_anti"), first.select(*PAGE, "at.*", F.lit(text).alias("text"))
