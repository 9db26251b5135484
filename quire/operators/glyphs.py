"""Glyphs: positions from text runs, decoding, widths, regions and what redaction leaves.

Glyphs are the fact table, keyed by (doc_id, page). Dimensions are joined by doc and font;
regions are joined on the page key first, so no join is without a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_wide, normalised

#: Widths of the characters from blank to tilde in thousandths of the size (fixed values).
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
WIDE_WIDTH, OTHER_WIDTH = 1000, 556
PAGE = ["doc_id", "page"]


def char_width(char: Column) -> Column:
    """Thousandths of the size: the table's, 1000 for wide characters, else 556."""
    code = F.ascii(char)  # the code point of the first character
    listed = F.get(F.array(*map(F.lit, HELVETICA)), (code - 32).cast("int"))
    return F.coalesce(F.when((code >= 32) & (code <= 126), listed), F.when(is_wide(char), F.lit(WIDE_WIDTH)), F.lit(OTHER_WIDTH))


def measure_text(text: Column, size: Column | float) -> Column:
    """The width of a text."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    total = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + char_width(c).cast("long"))
    return total / 1000.0 * size


def glyph_boxes(runs: DataFrame, widths: DataFrame, missing: float = 500.0) -> DataFrame:
    """One row per glyph of text runs, with its box on the page.

    runs: doc_id, page, op_index, codes, adjust (thousandths to move back before each glyph, or
    null), font_alias, font_size, char_space, word_space, h_scale, rise, tm and ctm (six numbers).
    The pen is a running sum inside the run.
    """
    each = runs.select("*", F.posexplode("codes").alias("char_index", "code")).drop("codes").withColumn("back", F.coalesce(F.get("adjust", F.col("char_index")), F.lit(0.0)))
    wide = each.join(widths, ["doc_id", "font_alias", "code"], "left").withColumn("w", F.coalesce("width", F.lit(missing)))
    advance = (F.col("w") / 1000 * F.col("font_size") + F.col("char_space") + F.when(F.col("code") == 32, F.col("word_space")).otherwise(0.0)) * F.col("h_scale")
    shift = -F.col("back") / 1000 * F.col("font_size") * F.col("h_scale")
    run = Window.partitionBy("doc_id", "page", "op_index").orderBy("char_index")
    pen = wide.withColumns({"adv": advance, "shift": shift}).withColumn("pen", F.sum(F.col("adv") + F.col("shift")).over(run) - F.col("adv"))
    t = lambda m, i: F.get(m, F.lit(i))
    # A point of the glyph, in its own unit square, through the run's matrix and the page's.
    def corner(gx: Column, gy: float) -> tuple[Column, Column]:
        x = F.col("pen") + gx * F.col("font_size") * F.col("h_scale")
        y = F.lit(gy) * F.col("font_size") + F.col("rise")
        u = x * t("tm", 0) + y * t("tm", 2) + t("tm", 4)
        v = x * t("tm", 1) + y * t("tm", 3) + t("tm", 5)
        return u * t("ctm", 0) + v * t("ctm", 2) + t("ctm", 4), u * t("ctm", 1) + v * t("ctm", 3) + t("ctm", 5)

    corners = [corner(gx, gy) for gx in (F.lit(0.0), F.col("w") / 1000) for gy in (0.0, 1.0)]
    xs, ys = ([c[i] for c in corners] for i in (0, 1))
    return pen.select(*PAGE, "op_index", "char_index", "code", "font_alias", "font_size", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def cp1252(spark: SparkSession) -> DataFrame:
    """(code, plain) of the single-byte codes."""
    return spark.createDataFrame([(i, bytes([i]).decode("cp1252", "ignore")) for i in range(256)], "code int, plain string")


def decode_glyphs(glyphs: DataFrame, fonts: DataFrame, font_chars: DataFrame) -> DataFrame:
    """text of each glyph: by its font's map; without a map by cp1252 for one-byte fonts; else empty."""
    mapped = font_chars.select("doc_id", "font_alias").distinct().withColumn("has_map", F.lit(True))
    known = fonts.select("doc_id", "font_alias", "code_bytes").join(mapped, ["doc_id", "font_alias"], "left")
    chars = font_chars.groupBy("doc_id", "font_alias", "code").agg(F.min_by("text", "ord").alias("own"))
    joined = glyphs.join(known, ["doc_id", "font_alias"], "left").join(chars, ["doc_id", "font_alias", "code"], "left").join(F.broadcast(cp1252(glyphs.sparkSession)), "code", "left")
    text = F.when(F.col("has_map"), F.coalesce("own", F.lit(""))).when(F.coalesce("code_bytes", F.lit(1)) == 1, F.coalesce("plain", F.lit(""))).otherwise(F.lit(""))
    return joined.withColumn("text", text).drop("has_map", "own", "plain", "code_bytes")


def glyph_width(glyphs: DataFrame, fonts: DataFrame, font_widths: DataFrame) -> DataFrame:
    """w1000 of each glyph: the font's own width, else the standard one by character for simple fonts, else the missing width."""
    joined = glyphs.join(fonts.select("doc_id", "font_alias", "is_cid", "missing_width"), ["doc_id", "font_alias"], "left").join(font_widths, ["doc_id", "font_alias", "code"], "left")
    standard = F.when(~F.coalesce("is_cid", F.lit(False)) & F.col("code").between(32, 126), F.get(F.array(*map(F.lit, HELVETICA)), F.col("code") - 32).cast("double"))
    return joined.withColumn("w1000", F.coalesce("width", standard, "missing_width")).drop("width", "is_cid", "missing_width")


def expand_ranges(ranges: DataFrame, widest: int = 65_536) -> DataFrame:
    """One value per code of ranges (doc_id, font_alias, ord, lo, hi, value, step); later entries win; too wide ones go."""
    fits = ranges.where((F.col("hi") >= F.col("lo")) & (F.col("hi") - F.col("lo") < widest))
    each = fits.select("doc_id", "font_alias", "ord", "lo", "value", "step", F.explode(F.sequence("lo", "hi")).alias("code"))
    value = F.col("value") + (F.col("code") - F.col("lo")) * F.col("step")
    return each.groupBy("doc_id", "font_alias", "code").agg(F.max_by(value, "ord").alias("value"))


def overlaps(g: str = "", r: str = "r_") -> Column:
    """Open intersection of two boxes: edges that only touch do not meet."""
    return (F.col(f"{g}x0") < F.col(f"{r}x1")) & (F.col(f"{g}x1") > F.col(f"{r}x0")) & (F.col(f"{g}y0") < F.col(f"{r}y1")) & (F.col(f"{g}y1") > F.col(f"{r}y0"))


def region_boxes(regions: DataFrame) -> DataFrame:
    return regions.select(*PAGE, F.col("x").alias("r_x0"), F.col("y").alias("r_y0"), (F.col("x") + F.col("w")).alias("r_x1"), (F.col("y") + F.col("h")).alias("r_y1"))


def glyphs_in_regions(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """Glyphs that meet a region of their page, once each."""
    boxes = region_boxes(regions)
    named = boxes.select(*[F.col(c).alias(f"__{c}") for c in PAGE], *[c for c in boxes.columns if c not in PAGE])
    return glyphs.join(named, (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & overlaps(), "left_semi")


def redact_glyphs(glyphs: DataFrame, regions: DataFrame) -> DataFrame:
    """Glyphs that meet no region of their page."""
    boxes = region_boxes(regions)
    named = boxes.select(*[F.col(c).alias(f"__{c}") for c in PAGE], *[c for c in boxes.columns if c not in PAGE])
    return glyphs.join(named, (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & overlaps(), "left_anti")


def redaction_boxes(regions: DataFrame, pad: float = 2.0) -> DataFrame:
    """The boxes to draw over redacted regions, wider above and below."""
    return regions.select(*PAGE, F.col("x").alias("x0"), (F.col("y") - pad).alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h") + pad).alias("y1"))


def redaction_stats(killed: DataFrame, regions: DataFrame) -> DataFrame:
    """Removed glyphs and boxes per page, per document (page null) and in all (both null)."""
    parts = killed.select(*PAGE, F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(regions.select(*PAGE, F.lit(0).alias("g"), F.lit(1).alias("b")))
    return parts.rollup(*PAGE).agg(F.sum("g").alias("glyphs"), F.sum("b").alias("boxes"), F.count_distinct("page").alias("pages"))


def killed_text(killed: DataFrame) -> DataFrame:
    """Distinct normalised texts of removed glyphs per document, one per page and font."""
    run = killed.groupBy(*PAGE, "font_alias").agg(F.array_sort(F.collect_list(F.struct("op_index", "char_index", "text"))).alias("t"))
    return run.select("doc_id", normalised(F.array_join(F.transform("t", lambda x: x["text"]), "")).alias("text")).distinct()


def redact_outline(outline: DataFrame, killed: DataFrame) -> DataFrame:
    """outline with redacted: the title holds killed text of its document or is held by it; an empty title is, if there is any."""
    title = normalised("title")
    hit = outline.select("doc_id", "node_id", title.alias("t")).join(killed.where("text <> ''").select("doc_id", F.col("text").alias("k")), "doc_id").where(F.col("t").contains(F.col("k")) | F.col("k").contains(F.col("t")))
    found = hit.select("doc_id", "node_id").distinct().withColumn("redacted", F.lit(True))
    return outline.join(found, ["doc_id", "node_id"], "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))


def clean_metadata(docs: DataFrame, producer: str = "redacted") -> DataFrame:
    """docs (info: map, xmp) with an info map of the producer only and no xmp, and what was removed; a null info map stays null and is not listed, an empty one is."""
    named = F.create_map(F.lit("Producer"), F.lit(producer))
    removed = F.array_compact(F.array(F.when(F.col("info").isNotNull(), "Info"), F.when(F.col("xmp").isNotNull(), "XMP Metadata")))
    return docs.withColumns({"removed": removed, "info": F.when(F.col("info").isNotNull(), named), "xmp": F.lit(None).cast(docs.schema["xmp"].dataType)})


def missing_chars(needed: DataFrame, font_chars: DataFrame) -> DataFrame:
    """Distinct characters (doc_id, font_alias, text) that the font cannot show."""
    return needed.select("doc_id", "font_alias", "text").distinct().join(font_chars, ["doc_id", "font_alias", "text"], "left_anti")


def reverse_map(font_chars: DataFrame) -> DataFrame:
    """One code per character: that mapped first."""
    return font_chars.where("text <> ''").groupBy("doc_id", "font_alias", "text").agg(F.min_by("code", "ord").alias("code"))


def width_ranges(widths: DataFrame, least: int = 3) -> DataFrame:
    """Runs of neighbouring codes of equal width (doc_id, font_alias, code, width); runs of `least` and more are ranges."""
    run = Window.partitionBy("doc_id", "font_alias", "width").orderBy("code")
    islands = widths.withColumn("island", F.col("code") - F.row_number().over(run))
    return islands.groupBy("doc_id", "font_alias", "width", "island").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count(F.lit(1)).alias("n")).drop("island").withColumn("is_range", F.col("n") >= least)


def preferred_char(chars: DataFrame) -> DataFrame:
    """The best character per glyph id (doc_id, gid, block, code): least block preference, then least code."""
    return chars.groupBy("doc_id", "gid").agg(F.min(F.struct("block", "code"))["code"].alias("code"))
