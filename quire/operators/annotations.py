"""Annotations, edit objects and regions: geometry, cleaning, joining to pages, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of annotations and objects, fonts and labels, as they are accepted and shown.
ANNOTATION_KINDS = ("highlight", "underline", "wavy", "strike", "box", "note")
OBJECT_KINDS = ("whiteout", "text", "rect", "ellipse", "line", "image", "redact")
FONTS = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Times-Roman", "Times-Bold", "Courier", "Courier-Bold")
LABELS = {"highlight": "高亮", "underline": "下划线", "wavy": "波浪线", "strike": "删除线", "note": "笔记", "box": "区域"}
DEFAULT_COLOR = "#f59e0b"
LINE_REACH = 0.012


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _within(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_number(x: Column | str, default: float = 0.0) -> Column:
    """The number, or the default if it is missing or not finite."""
    v = _col(x)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(default))


def norm_to_pdf(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column) -> Column:
    """A box in shares of the page (y down) in points (y up)."""
    return F.struct((x * pw).alias("x"), (ph * (1 - y - h)).alias("y"), (w * pw).alias("w"), (h * ph).alias("h"))


def pdf_to_norm(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column) -> Column:
    """The other way; a page without width or height gives zeros."""
    ok = (pw != 0) & (ph != 0)
    z = lambda v: F.when(ok, v).otherwise(F.lit(0.0))
    return F.struct(z(F.try_divide(x, pw)).alias("x"), z(1 - F.try_divide(y + h, ph)).alias("y"), z(F.try_divide(w, pw)).alias("w"), z(F.try_divide(h, ph)).alias("h"))


def percent_box_to_rect(box: Column, page: Column) -> Column:
    """[x0, y0, x1, y1] of a box in percent of a page (x0, y1, width, height)."""
    x0 = page["x0"] + box["x"] / 100 * page["width"]
    y1 = page["y1"] - box["y"] / 100 * page["height"]
    return F.array(x0, y1 - box["h"] / 100 * page["height"], x0 + box["w"] / 100 * page["width"], y1)


def item_rect(x: Column, y: Column, width: Column, height: Column, length: Column, start: Column, end: Column) -> Column:
    """[x0, y0, x1, y1] of the characters start to end of a text item, by share of its length."""
    n = F.greatest(length, F.lit(1))
    s = F.least(F.greatest(start, F.lit(0)), n)
    e = F.least(F.greatest(end, s), n)
    high = F.when(height == 0, F.lit(10.0)).otherwise(F.abs(height))
    return F.array(x + s / n * F.abs(width), y, x + e / n * F.abs(width), y + high)


def parse_color(color: Column | str) -> Column:
    """#rgb and #rrggbb as they are, rgb(r,g,b) as #rrggbb, all else black."""
    s = F.trim(_col(color))
    pattern = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    part = lambda i: F.lower(F.lpad(F.hex(F.least(F.regexp_extract(s, pattern, i).try_cast("int"), F.lit(255))), 2, "0"))
    return F.when(s.rlike(r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), s).when(s.rlike(pattern), F.concat(F.lit("#"), part(1), part(2), part(3))).otherwise(F.lit("#000000"))


def color_triple(color: Column | str) -> Column:
    """Three shares of 0 to 1, to three places."""
    s = parse_color(color)
    short = F.length(s) == 4
    one = lambda i: F.round(F.conv(F.when(short, F.repeat(F.substring(s, i + 1, 1), 2)).otherwise(F.substring(s, 2 * i, 2)), 16, 10).cast("int") / 255, 3)
    return F.array(one(1), one(2), one(3))


def clean_rects(rects: Column | str) -> Column:
    """Rectangles of four finite numbers below 1e6 and sides of 0.1 or more, low corner first, to two places; the first 400."""
    r = F.slice(_col(rects), 1, 400)
    fits = lambda q: (F.size(q) == 4) & F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e6))
    wide = lambda q: (F.abs(F.get(q, F.lit(2)) - F.get(q, F.lit(0))) >= 0.1) & (F.abs(F.get(q, F.lit(3)) - F.get(q, F.lit(1))) >= 0.1)
    at = lambda q, i: F.get(q, F.lit(i))
    tidy = lambda q: F.array(*[F.round(f(at(q, i), at(q, i + 2)), 2) for f in (F.least, F.greatest) for i in (0, 1)])
    return F.transform(F.filter(F.filter(r, fits), wide), tidy)


def sanitize_annotations(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """rows (doc_id, seq, type, page, rects, color, note) cleaned, with `accepted`. With a cap, rows beyond it per document are not accepted."""
    rows = rows.withColumn("type", F.lower("type"))
    within = F.lit(True)
    if cap is not None:
        rows, within = rows.withColumn("__at", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))), F.col("__at") <= cap
    clean = rows.withColumns({
        "rects": clean_rects("rects"), "color": F.when(F.col("color").isNull(), F.lit(DEFAULT_COLOR)).otherwise(parse_color("color")),
        "note": F.substring(F.coalesce("note", F.lit("")), 1, 2000)})
    return clean.withColumn("accepted", F.coalesce(within & F.col("type").isin(*ANNOTATION_KINDS) & (F.col("page") >= 1) & (F.size("rects") > 0), F.lit(False))).drop("__at")


def sanitize_objects(rows: DataFrame) -> DataFrame:
    """Edit objects with defaults and bounds, with `accepted`."""
    kind = F.lower(F.coalesce("kind", F.lit("")))
    shape = kind.isin("rect", "ellipse")
    is_text, is_image = kind == "text", kind == "image"
    ok = kind.isin(*OBJECT_KINDS) & (F.coalesce("page", F.lit(1)) >= 1) & (~is_text | (F.coalesce("text", F.lit("")) != ""))
    ok = ok & (~is_image | (F.coalesce("img", F.lit("")).rlike(r"^[0-9a-f]{40}\.(png|jpg|jpeg)$") & (safe_number("w") > 0) & (safe_number("h") > 0)))
    return rows.withColumns({
        "kind": kind, "page": F.coalesce("page", F.lit(1)), **{c: safe_number(c) for c in "xywh"},
        "id": F.when(F.col("id").rlike(r"^[A-Za-z0-9_-]{1,40}$"), F.col("id")),
        "lineWidth": F.when(shape, _within(safe_number("lineWidth", 1.0), 0.1, 40.0)),
        "text": F.when(is_text, F.substring("text", 1, 4000)), "size": F.when(is_text, _within(safe_number("size", 12.0), 4.0, 200.0)),
        "font": F.when(is_text, F.when(F.trim("font").isin(*FONTS), F.trim("font")).otherwise(F.lit("Helvetica"))),
        "color": parse_color("color"), "accepted": F.coalesce(ok, F.lit(False))})


def sanitize_regions(rows: DataFrame) -> DataFrame:
    """Regions on pages from 1 on, sides kept within 1 to 20000."""
    page = F.coalesce("page", F.lit(1))
    return rows.where(page >= 1).withColumns({"page": page, "x": safe_number("x"), "y": safe_number("y"), "w": _within(safe_number("w"), 1.0, 20000.0), "h": _within(safe_number("h"), 1.0, 20000.0)})


def annotation_records(rows: DataFrame) -> DataFrame:
    """rect (the union, or an 18-point icon of a note), quads (8 numbers per rectangle) and opacity of cleaned annotations."""
    side = lambda i, f: f(F.transform("rects", lambda r: F.get(r, F.lit(i))))
    x0, y0, x1, y1 = side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)
    at = lambda r, i: F.get(r, F.lit(i))
    quads = F.flatten(F.transform("rects", lambda r: F.array(at(r, 0), at(r, 3), at(r, 2), at(r, 3), at(r, 0), at(r, 1), at(r, 2), at(r, 1))))
    low = F.greatest(y0, y1 - 18.0)
    marked = F.col("type").isin("highlight", "underline", "wavy", "strike")
    return rows.withColumns({
        "rect": F.when(F.col("type") == "note", F.array(x0, low, x0 + 18.0, low + 18.0)).otherwise(F.array(x0, y0, x1, y1)),
        "quads": F.when(marked, quads), "opacity": F.when(F.col("type") == "highlight", F.lit(0.45))})


def quad_boxes(quads: Column, rect: Column) -> Column:
    """One box per 8 numbers of quads, or the rectangle itself where there are none."""
    even = lambda q, k: F.filter(q, lambda v, i: i % 2 == k)
    box = lambda q: F.array(F.array_min(even(q, 0)), F.array_min(even(q, 1)), F.array_max(even(q, 0)), F.array_max(even(q, 1)))
    whole = F.floor(F.size(quads) / 8).cast("int")
    boxes = F.transform(F.sequence(F.lit(0), whole - 1), lambda i: box(F.slice(quads, i * 8 + 1, 8)))
    at = lambda i: F.get(rect, F.lit(i))
    plain = F.array(F.array(F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))))
    return F.when(F.size(quads) >= 8, boxes).when(F.size(rect) == 4, plain).otherwise(F.array().cast("array<array<double>>"))


def ensure_ids(rows: DataFrame, order: str) -> DataFrame:
    """Ids that are missing or repeated in a document are made anew; the first holder keeps its own."""
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(order))
    fresh = F.concat(F.lit("o"), F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("id", F.lit("")), F.col(order).cast("string"))), 1, 16))
    return rows.withColumn("__at", again).withColumn("id", F.when(F.col("id").isNull() | (F.col("__at") > 1), fresh).otherwise(F.col("id"))).drop("__at")


def hit_test(points: DataFrame, objects: DataFrame) -> DataFrame:
    """The topmost object under each point (doc_id, page, point, nx, ny). objects: kind, z, x, y, w, h, x2, y2, pw, ph."""
    joined = points.join(objects, ["doc_id", "page"])
    p = pdf_to_norm(*(F.col(c) for c in ("x", "y", "w", "h", "pw", "ph")))
    zero = F.lit(0.0)
    a, b = pdf_to_norm(F.col("x"), F.col("y"), zero, zero, F.col("pw"), F.col("ph")), pdf_to_norm(F.col("x2"), F.col("y2"), zero, zero, F.col("pw"), F.col("ph"))
    made = joined.withColumns({"p": p, "a": a, "b": b})
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    square = dx * dx + dy * dy
    t = _within(F.coalesce(F.try_divide((F.col("nx") - F.col("a.x")) * dx + (F.col("ny") - F.col("a.y")) * dy, F.when(square >= 1e-9, square)), zero), 0.0, 1.0)
    near = F.hypot(F.col("nx") - (F.col("a.x") + t * dx), F.col("ny") - (F.col("a.y") + t * dy)) < LINE_REACH
    inside = F.col("nx").between(F.col("p.x"), F.col("p.x") + F.col("p.w")) & F.col("ny").between(F.col("p.y"), F.col("p.y") + F.col("p.h"))
    hit = made.where(F.when(F.col("kind") == "line", near).otherwise(inside))
    return hit.groupBy("doc_id", "page", "point").agg(F.max("z").alias("z"))


def anchors_to_rects(anchors: DataFrame, items: DataFrame) -> DataFrame:
    """Parts (doc_id, page, item, start, end) of annotations as rectangles of their text items; sides of 0.1 or less go."""
    joined = anchors.join(items, ["doc_id", "page", "item"])
    rect = item_rect(*(F.col(c) for c in ("x", "y", "width", "height", "length", "start", "end")))
    made = joined.withColumn("rect", rect)
    return made.where((F.get("rect", F.lit(2)) - F.get("rect", F.lit(0)) > 0.1) & (F.get("rect", F.lit(3)) - F.get("rect", F.lit(1)) > 0.1))


def missing_assets(objects: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct image names that no asset has."""
    return objects.where("kind = 'image'").select("img").distinct().join(assets, objects["img"] == assets["name"], "left_anti")


def annotation_stats(rows: DataFrame) -> DataFrame:
    """Per document: written, pages and skipped."""
    return rows.groupBy("doc_id").agg(F.count_if("accepted").alias("written"), F.count_distinct(F.when(F.col("accepted"), F.col("page"))).alias("pages"), F.count_if(~F.col("accepted")).alias("skipped"))


def progress_markers(rows: DataFrame, pages: DataFrame, order: str) -> DataFrame:
    """The first annotation per document, page and type, and its place in the document from 0 to 1."""
    first = rows.groupBy("doc_id", "page", "type").agg(F.min(order).alias(order))
    return first.join(pages, "doc_id").withColumn("place", (F.col("page") - 1) / F.col("n_pages"))


def regions_summary(regions: DataFrame) -> DataFrame:
    """Regions per document and page, and per document (page null)."""
    return regions.rollup("doc_id", "page").agg(F.count(F.lit(1)).alias("regions"), F.grouping("doc_id").alias("g")).where("g = 0").drop("g")


def annotation_list(own: DataFrame, embedded: DataFrame, kind: str | None = None) -> DataFrame:
    """Own and embedded annotations together on their columns, optionally of one type, with shown and total per document."""
    every = own.withColumn("embedded", F.lit(False)).unionByName(embedded.withColumn("embedded", F.lit(True)), allowMissingColumns=True)
    doc = Window.partitionBy("doc_id")
    counted = every.withColumn("total", F.count(F.lit(1)).over(doc))
    shown = counted if kind is None else counted.where(F.col("type") == kind)
    return shown.withColumn("shown", F.count(F.lit(1)).over(doc))


def notes_markdown(rows: DataFrame) -> DataFrame:
    """One Markdown text per document: a section per page in order, an entry per annotation."""
    label = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in LABELS.items()], F.col("type"))
    quote = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    head = F.concat(F.lit("- **["), label, F.lit("]**"), F.when(F.coalesce("color", F.lit("")) != "", F.concat(F.lit(" `"), F.col("color"), F.lit("`"))).otherwise(""))
    entry = F.concat(head, F.when(quote != "", F.concat(F.lit("\n  > "), quote)).otherwise(""), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n  \n  "), F.col("note"))).otherwise(""), F.lit("\n"))
    pages = rows.withColumn("entry", entry).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "entry"))).alias("es"))
    text = F.concat(F.lit("## "), F.col("page").cast("string"), F.lit("\n\n"), F.array_join(F.transform("es", lambda e: e["entry"]), "\n"))
    return pages.select("doc_id", "page", F.size("es").alias("k"), text.alias("t")).groupBy("doc_id").agg(
        F.sum("k").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("markdown"))


def bookmarks(rows: DataFrame, by_time: bool = False) -> DataFrame:
    """page and name of bookmarks stored as JSON: [[page, name], ...], or a bare list of pages (older form)."""
    pairs = F.from_json("json", "array<array<string>>")
    plain = F.from_json("json", "array<int>")
    new = F.transform(pairs, lambda p, i: F.struct(F.get(p, F.lit(0)).try_cast("int").alias("page"), F.get(p, F.lit(1)).alias("name"), i.alias("added")))
    old = F.transform(plain, lambda p, i: F.struct(p.alias("page"), F.lit(None).cast("string").alias("name"), i.alias("added")))
    each = rows.select("doc_id", F.inline(F.when(F.col("json").startswith("[["), new).otherwise(old)))
    named = each.where("page IS NOT NULL").withColumn("name", F.coalesce("name", F.concat(F.lit("Page "), F.col("page").cast("string"))))
    at = Window.partitionBy("doc_id").orderBy("added" if by_time else "page", "added")
    return named.withColumn("at", F.row_number().over(at)).drop("added")
