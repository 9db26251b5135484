"""Queries on glyphs: every turn of a conversation is a page, set 60 characters to a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import glyphs as G
from quire.operators import pagemodel as M
from quire.operators import redaction as RD
from quire.operators import reflow as R
from quire.plans.registry import query, table
from quire.sources.staging import staged

WIDTHS_SQL = "[" + ", ".join(map(str, G.HELVETICA)) + "]"
WIDTH_SQL = f"CASE WHEN unicode(ch) BETWEEN 32 AND 126 THEN {WIDTHS_SQL}[unicode(ch) - 31] ELSE 556 END"
GLYPHS_SQL = f"""
ch AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM conversations WHERE text <> ''),
cw AS (SELECT doc_id, page, CAST(i // 60 AS INTEGER) AS op_index, CAST(i % 60 AS INTEGER) AS char_index, ch, unicode(ch) AS code, CAST({WIDTH_SQL} AS BIGINT) AS w FROM ch),
g AS (SELECT *, 50 + (sum(w) OVER (PARTITION BY doc_id, page, op_index ORDER BY char_index) - w) / 100.0::DOUBLE + CASE WHEN char_index >= 40 AND page % 2 = 0 THEN 40 ELSE 0 END AS x0, 800 - 15.0::DOUBLE * op_index - 0.5::DOUBLE * (char_index % 3) AS y0,
             CASE WHEN char_index % 5 = 0 THEN 'F2' ELSE 'F1' END AS font_alias FROM cw),
glyphs AS (SELECT *, x0 + w / 100.0::DOUBLE AS x1, y0 + 10 AS y1, ch AS text FROM g),
rows_ AS (SELECT doc_id, page, op_index, max(y0) AS row_y, min(x0) AS x0, arg_max(x1, x0) AS x1, count(*) AS n, string_agg(text, '' ORDER BY char_index) AS text FROM glyphs GROUP BY doc_id, page, op_index)"""


def glyph_table(spark, sf_dir) -> DataFrame:
    # Texts are dealt by page before they become glyphs, which then need not be moved.
    turns = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text").repartition("doc_id", "page")
    turns = turns.select("doc_id", "page", F.posexplode(F.split("text", "")).alias("i", "text"))
    each = turns.where("text <> ''").select("doc_id", "page", F.floor(F.col("i") / 60).cast("int").alias("op_index"), (F.col("i") % 60).alias("char_index"), "text", F.ascii("text").alias("code"), G.char_width(F.col("text")).cast("long").alias("w"))
    row = Window.partitionBy("doc_id", "page", "op_index").orderBy("char_index")
    placed = each.withColumn("x0", 50 + (F.sum("w").over(row) - F.col("w")) / 100.0 + F.when((F.col("char_index") >= 40) & (F.col("page") % 2 == 0), 40).otherwise(0))
    placed = placed.withColumn("y0", 800 - 15.0 * F.col("op_index") - 0.5 * (F.col("char_index") % 3))
    return placed.withColumns({"x1": F.col("x0") + F.col("w") / 100.0, "y1": F.col("y0") + 10, "font_alias": F.when(F.col("char_index") % 5 == 0, "F2").otherwise("F1")})


def row_table(spark, sf_dir) -> DataFrame:
    return M.row_stats(M.build_rows(glyph_table(spark, sf_dir)))


def region_table(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page")).distinct()
    return pages.where("page % 3 <> 0").select("doc_id", "page", F.lit(60.0).alias("x"), F.lit(780.0).alias("y"), F.lit(70.0).alias("w"), F.lit(32.0).alias("h"))


HIT_SQL = "page % 3 <> 0 AND x0 < 130 AND x1 > 60 AND y0 < 812 AND y1 > 780"


@query("l1_measure_text", f"WITH {GLYPHS_SQL} SELECT doc_id, page, round(sum(w) / 100.0, 4)::DOUBLE AS width FROM cw GROUP BY doc_id, page")
def l1_measure_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text <> ''")
    return turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.round(G.measure_text(F.col("text"), 10.0), 4).alias("width"))


@query("w1_glyph_boxes", f"""
WITH {GLYPHS_SQL}, pen AS (SELECT *, CASE WHEN code % 2 = 0 THEN w ELSE 500 END AS ww FROM cw),
adv AS (SELECT *, (ww / 1000.0::DOUBLE * 10 + 0.5 + CASE WHEN code = 32 THEN 2 ELSE 0 END) * 0.9::DOUBLE AS adv, -(CASE WHEN char_index = 3 THEN 100 ELSE 0 END) / 1000.0::DOUBLE * 10 * 0.9::DOUBLE AS back FROM pen),
p AS (SELECT *, sum(adv + back) OVER (PARTITION BY doc_id, page, op_index ORDER BY char_index) - adv AS x FROM adv)
SELECT doc_id, page, op_index, char_index, round(2 * x + 30, 3) AS x0, round(2 * (x + ww / 1000.0::DOUBLE * 10 * 0.9::DOUBLE) + 30, 3) AS x1, round(100.0::DOUBLE - 15 * op_index + 1, 3) AS y0, round(100.0::DOUBLE - 15 * op_index + 11, 3) AS y1 FROM p""")
def w1_glyph_boxes(spark, sf_dir):
    g = glyph_table(spark, sf_dir)
    packed = g.groupBy("doc_id", "page", "op_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("char_index", "code"))), lambda x: x["code"]).alias("codes"))
    num = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    runs = packed.withColumns({
        "adjust": num(0.0, 0.0, 0.0, 100.0), "font_alias": F.lit("F1"), "font_size": F.lit(10.0), "char_space": F.lit(0.5), "word_space": F.lit(2.0), "h_scale": F.lit(0.9), "rise": F.lit(1.0),
        "tm": num(1.0, 0.0, 0.0, 1.0, 10.0, 100.0 - 15.0 * F.col("op_index")), "ctm": num(2.0, 0.0, 0.0, 1.0, 10.0, 0.0)})
    widths = g.where("code % 2 = 0").select("doc_id", F.lit("F1").alias("font_alias"), "code", F.col("w").cast("double").alias("width")).distinct()
    return G.glyph_boxes(runs, widths).select("doc_id", "page", "op_index", "char_index", *[F.round(c, 3).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query("j1_decode_glyphs", f"""
WITH {GLYPHS_SQL}, m AS (SELECT DISTINCT doc_id, code FROM glyphs WHERE font_alias = 'F2' AND code % 2 = 0)
SELECT g.doc_id, g.page, g.op_index, g.char_index, CASE WHEN g.font_alias = 'F2' AND EXISTS (SELECT 1 FROM m x WHERE x.doc_id = g.doc_id) THEN CASE WHEN m.code IS NOT NULL THEN upper(ch) ELSE '' END
       WHEN code_ok THEN ch ELSE '' END AS text
FROM (SELECT *, code < 128 OR code BETWEEN 160 AND 255 AS code_ok FROM glyphs) g LEFT JOIN m ON g.font_alias = 'F2' AND m.doc_id = g.doc_id AND m.code = g.code""")
def j1_decode_glyphs(spark, sf_dir):
    g = glyph_table(spark, sf_dir)
    fonts = g.select("doc_id", "font_alias").distinct().withColumn("code_bytes", F.lit(1))
    chars = g.where("font_alias = 'F2' AND code % 2 = 0").select("doc_id", "font_alias", "code", F.upper("text").alias("text"), F.lit(0).alias("ord")).distinct()
    return G.decode_glyphs(g.drop("text"), fonts, chars).select("doc_id", "page", "op_index", "char_index", "text")


@query("j2_glyph_width", f"WITH {GLYPHS_SQL} SELECT doc_id, page, op_index, char_index, CASE WHEN code % 7 = 0 THEN 123.0::DOUBLE WHEN font_alias = 'F1' AND code BETWEEN 32 AND 126 THEN w::DOUBLE ELSE 400.0::DOUBLE END AS w1000 FROM glyphs")
def j2_glyph_width(spark, sf_dir):
    g = glyph_table(spark, sf_dir)
    fonts = g.select("doc_id", "font_alias").distinct().withColumns({"is_cid": F.col("font_alias") == "F2", "missing_width": F.lit(400.0)})
    own = g.where("code % 7 = 0").select("doc_id", "font_alias", "code", F.lit(123.0).alias("width")).distinct()
    return G.glyph_width(g, fonts, own).select("doc_id", "page", "op_index", "char_index", "w1000")


@query("j3_expand_ranges", """
WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 50 AS lo, o_orderkey % 50 + o_orderkey % 7 AS hi FROM orders), e AS (SELECT doc_id, ord, lo, unnest(range(lo, hi + 1)) AS code FROM r)
SELECT doc_id, code, arg_max(ord + (code - lo) * 2, ord) AS value FROM e GROUP BY doc_id, code""")
def j3_expand_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lo = F.col("o_orderkey") % 50
    ranges = o.select(F.col("o_custkey").alias("doc_id"), F.lit("F1").alias("font_alias"), F.col("o_orderkey").alias("ord"), lo.alias("lo"), (lo + F.col("o_orderkey") % 7).alias("hi"), F.col("o_orderkey").alias("value"), F.lit(2).alias("step"))
    return G.expand_ranges(ranges).select("doc_id", "code", "value")


@query("j4_glyphs_in_regions", f"WITH {GLYPHS_SQL} SELECT doc_id, page, op_index, char_index FROM glyphs WHERE {HIT_SQL}")
def j4_glyphs_in_regions(spark, sf_dir):
    return G.glyphs_in_regions(glyph_table(spark, sf_dir), region_table(spark, sf_dir)).select("doc_id", "page", "op_index", "char_index")


@query("j5_redact_glyphs", f"WITH {GLYPHS_SQL} SELECT doc_id, page, count(*) AS n, sum(code)::BIGINT AS codes FROM glyphs WHERE NOT ({HIT_SQL}) GROUP BY doc_id, page")
def j5_redact_glyphs(spark, sf_dir):
    left = G.redact_glyphs(glyph_table(spark, sf_dir), region_table(spark, sf_dir))
    return left.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("codes"))


@query("a7_redaction_stats", f"""
WITH {GLYPHS_SQL}, u AS (SELECT doc_id, page, 1 AS g, 0 AS b FROM glyphs WHERE {HIT_SQL} UNION ALL SELECT DISTINCT conv_id, CAST(turn + 1 AS INTEGER), 0, 1 FROM conversations WHERE (turn + 1) % 3 <> 0)
SELECT doc_id, page, sum(g)::BIGINT AS glyphs, sum(b)::BIGINT AS boxes, count(DISTINCT page) AS pages FROM u GROUP BY ROLLUP (doc_id, page)""")
def a7_redaction_stats(spark, sf_dir):
    regions = region_table(spark, sf_dir)
    return G.redaction_stats(G.glyphs_in_regions(glyph_table(spark, sf_dir), regions), regions)


@query("a9_killed_text", rf"""
WITH {GLYPHS_SQL}, k AS (SELECT doc_id, page, font_alias, string_agg(text, '' ORDER BY op_index, char_index) AS t FROM glyphs WHERE {HIT_SQL} GROUP BY doc_id, page, font_alias)
SELECT DISTINCT doc_id, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS text FROM k""")
def a9_killed_text(spark, sf_dir):
    return G.killed_text(G.glyphs_in_regions(glyph_table(spark, sf_dir), region_table(spark, sf_dir)))


@query("j14_redact_outline", rf"""
WITH {GLYPHS_SQL}, k AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(string_agg(text, '' ORDER BY op_index, char_index), '\s+', ' ', 'g'))) AS t FROM glyphs WHERE {HIT_SQL} GROUP BY doc_id, page, font_alias),
w AS (SELECT conv_id AS doc_id, turn, unnest(string_split(text, ' ')) AS title, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations),
o AS (SELECT doc_id, turn * 1000000 + pos AS node_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS n FROM w)
SELECT doc_id, node_id::BIGINT AS node_id, EXISTS (SELECT 1 FROM k WHERE k.doc_id = o.doc_id AND k.t <> '' AND (contains(o.n, k.t) OR contains(k.t, o.n))) AS redacted FROM o""")
def j14_redact_outline(spark, sf_dir):
    killed = G.killed_text(G.glyphs_in_regions(glyph_table(spark, sf_dir), region_table(spark, sf_dir)))
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", " ", -1)).alias("at", "title"))
    outline = words.select("doc_id", (F.col("turn").cast("long") * 1000000 + F.col("at")).alias("node_id"), "title")
    return G.redact_outline(outline, killed).select("doc_id", "node_id", "redacted")


@query("p16_clean_metadata", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'redacted' END AS producer, CASE WHEN page_id % 3 <> 0 THEN 1 END AS n_keys, true AS no_xmp,
       CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'Info,XMP Metadata' WHEN page_id % 3 <> 0 THEN 'Info' WHEN page_id % 2 = 0 THEN 'XMP Metadata' ELSE '' END AS removed FROM pages""")
def p16_clean_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    info = F.when(F.col("page_id") % 3 != 0, F.create_map(F.lit("Title"), F.col("url"), F.lit("Producer"), F.lit("x")))
    done = G.clean_metadata(p.select("page_id", info.alias("info"), F.when(F.col("page_id") % 2 == 0, F.col("html")).alias("xmp")))
    n = F.when(F.col("info").isNotNull(), F.size("info"))
    return done.select("page_id", F.try_element_at("info", F.lit("Producer")).alias("producer"), n.alias("n_keys"), F.col("xmp").isNull().alias("no_xmp"), F.array_join("removed", ",").alias("removed"))


@query("j8_missing_chars", f"WITH {GLYPHS_SQL} SELECT DISTINCT doc_id, text FROM glyphs g WHERE font_alias = 'F1' AND NOT EXISTS (SELECT 1 FROM glyphs h WHERE h.doc_id = g.doc_id AND h.font_alias = 'F2' AND h.text = g.text)")
def j8_missing_chars(spark, sf_dir):
    g = glyph_table(spark, sf_dir).withColumn("kind", F.col("font_alias")).withColumn("font_alias", F.lit("F"))
    return G.missing_chars(g.where("kind = 'F1'"), g.where("kind = 'F2'")).select("doc_id", "text")


@query("a11_reverse_map", f"WITH {GLYPHS_SQL} SELECT doc_id, font_alias, lower(text) AS text, arg_min(code, page * 100000 + op_index * 100 + char_index) AS code FROM glyphs GROUP BY doc_id, font_alias, lower(text)")
def a11_reverse_map(spark, sf_dir):
    chars = glyph_table(spark, sf_dir).select("doc_id", "font_alias", F.lower("text").alias("text"), "code", (F.col("page") * 100000 + F.col("op_index") * 100 + F.col("char_index")).alias("ord"))
    return G.reverse_map(chars)


@query("w11_width_ranges", f"""
WITH {GLYPHS_SQL}, d AS (SELECT DISTINCT doc_id, code, w FROM cw), i AS (SELECT *, code - row_number() OVER (PARTITION BY doc_id, w ORDER BY code) AS k FROM d)
SELECT doc_id, w AS width, min(code) AS lo, max(code) AS hi, count(*) AS n, count(*) >= 3 AS is_range FROM i GROUP BY doc_id, w, k""")
def w11_width_ranges(spark, sf_dir):
    widths = glyph_table(spark, sf_dir).select("doc_id", F.lit("F").alias("font_alias"), "code", F.col("w").alias("width")).distinct()
    return G.width_ranges(widths).drop("font_alias")


@query("a12_preferred_char", f"WITH {GLYPHS_SQL}, d AS (SELECT DISTINCT doc_id, code % 40 AS gid, CASE WHEN code < 128 THEN 0 ELSE 1 END AS block, code FROM cw) SELECT doc_id, gid, arg_min(code, block * 100000 + code) AS code FROM d GROUP BY doc_id, gid")
def a12_preferred_char(spark, sf_dir):
    chars = glyph_table(spark, sf_dir).select("doc_id", (F.col("code") % 40).alias("gid"), F.when(F.col("code") < 128, 0).otherwise(1).alias("block"), "code").distinct()
    return G.preferred_char(chars)


@query("w3_build_rows", f"WITH {GLYPHS_SQL} SELECT doc_id, page, row_y, n FROM rows_")
def w3_build_rows(spark, sf_dir):
    rows = M.build_rows(glyph_table(spark, sf_dir))
    return rows.groupBy("doc_id", "page", "row_y").agg(F.count(F.lit(1)).alias("n"))


@query("a1_row_stats", f"WITH {GLYPHS_SQL} SELECT doc_id, page, row_y, round(x0, 3) AS x0, round(x1, 3) AS x1, 10.0::DOUBLE AS size, CASE WHEN n > 1 THEN 'F1,F2' ELSE 'F2' END AS fonts, md5(text) AS text FROM rows_")
def a1_row_stats(spark, sf_dir):
    return row_table(spark, sf_dir).select("doc_id", "page", "row_y", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"), "size", F.array_join("fonts", ",").alias("fonts"), F.md5("text").alias("text"))


@query("w4_row_columns", f"WITH {GLYPHS_SQL} SELECT doc_id, page, row_y, CASE WHEN page % 2 = 0 AND n > 40 THEN 2 ELSE 1 END AS cols, CASE WHEN page % 2 = 0 AND n > 40 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS maxgap FROM rows_")
def w4_row_columns(spark, sf_dir):
    return row_table(spark, sf_dir).select("doc_id", "page", "row_y", "cols", F.round("maxgap", 3).alias("maxgap"))


@query("w2_split_columns", f"""
WITH {GLYPHS_SQL}, s AS (SELECT DISTINCT doc_id, page, x0, x1 FROM glyphs), f AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 12 THEN 1 ELSE 0 END AS fresh FROM s),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS band FROM f)
SELECT g.doc_id, g.page, b.band::BIGINT AS band, count(*) AS n FROM glyphs g JOIN b USING (doc_id, page, x0, x1) GROUP BY ALL""")
def w2_split_columns(spark, sf_dir):
    return M.split_columns(glyph_table(spark, sf_dir)).groupBy("doc_id", "page", "band").agg(F.count(F.lit(1)).alias("n"))


@query("a3_dominant_font", f"""
WITH {GLYPHS_SQL}, c AS (SELECT doc_id, page, font_alias, count(*) AS n, min(op_index * 100 + char_index) AS f FROM glyphs GROUP BY ALL)
SELECT doc_id, page, arg_min(font_alias, -n * 1000000 + f) AS font_alias FROM c GROUP BY doc_id, page""")
def a3_dominant_font(spark, sf_dir):
    return M.dominant_font(glyph_table(spark, sf_dir), ["doc_id", "page"])


@query("a4_left_margin", f"WITH {GLYPHS_SQL} SELECT DISTINCT doc_id, page, 50.0::DOUBLE AS \"left\" FROM rows_")
def a4_left_margin(spark, sf_dir):
    return M.left_margin(row_table(spark, sf_dir))


@query("w5_paragraphs", f"WITH {GLYPHS_SQL} SELECT doc_id, page, row_y, 0 AS para FROM rows_")
def w5_paragraphs(spark, sf_dir):
    return M.paragraphs(row_table(spark, sf_dir)).select("doc_id", "page", "row_y", "para")


@query("a2_paragraph_stats", f"""
WITH {GLYPHS_SQL}, r AS (SELECT *, CASE WHEN page % 2 = 0 AND n > 40 THEN 2 ELSE 1 END AS cols FROM rows_)
SELECT doc_id, page, 0 AS para, max(row_y) AS top, min(row_y) AS bottom, count(*) AS lines, max(cols) AS cols, count(*) FILTER (WHERE cols = 2) >= 2 AND count(*) FILTER (WHERE cols = 2) * 2 >= count(*) AS table_like FROM r GROUP BY doc_id, page""")
def a2_paragraph_stats(spark, sf_dir):
    return M.paragraph_stats(M.paragraphs(row_table(spark, sf_dir))).select("doc_id", "page", "para", "top", "bottom", "lines", "cols", "table_like")


@query("w17_items_to_lines", f"WITH {GLYPHS_SQL} SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY op_index)) AS text FROM rows_ GROUP BY doc_id, page")
def w17_items_to_lines(spark, sf_dir):
    return M.items_to_lines(glyph_table(spark, sf_dir), ["doc_id", "page"]).withColumn("text", F.md5("text"))


@query("j21_text_in_region", f"""
WITH {GLYPHS_SQL}, i AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM glyphs WHERE page % 3 <> 0),
l AS (SELECT doc_id, page, op_index, string_agg(text, '' ORDER BY char_index) AS line FROM i WHERE cx BETWEEN 58 AND 132 AND cy BETWEEN 778 AND 814 GROUP BY ALL)
SELECT doc_id, page, md5(string_agg(line, chr(10) ORDER BY op_index)) AS text FROM l GROUP BY doc_id, page""")
def j21_text_in_region(spark, sf_dir):
    boxes = G.region_boxes(region_table(spark, sf_dir)).withColumn("box", F.lit(0))
    return M.text_in_region(glyph_table(spark, sf_dir), boxes).select("doc_id", "page", F.md5("text").alias("text"))


@query("w8_merge_boxes", f"""
WITH {GLYPHS_SQL}, k AS (SELECT * FROM glyphs WHERE {HIT_SQL})
SELECT doc_id, page, count(*) AS boxes FROM (SELECT *, lag(x1) OVER o AS p, lag(y0) OVER o AS q FROM k WINDOW o AS (PARTITION BY doc_id, page ORDER BY round(y0, 1) DESC, x0, x1)) WHERE p IS NULL OR x0 - p > 2 OR abs(y0 - q) > 2 GROUP BY doc_id, page""")
def w8_merge_boxes(spark, sf_dir):
    hits = G.glyphs_in_regions(glyph_table(spark, sf_dir), region_table(spark, sf_dir))
    return M.merge_boxes(hits, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("boxes"))


@query("w10_footer_row", f"""
WITH {GLYPHS_SQL}, o AS (SELECT doc_id, page, CASE WHEN row_y = min(row_y) OVER (PARTITION BY doc_id, page) THEN row_y - 60 * (page % 2) ELSE row_y END AS row_y FROM rows_),
d AS (SELECT *, lead(row_y) OVER (PARTITION BY doc_id, page ORDER BY row_y) - row_y AS gap, row_number() OVER (PARTITION BY doc_id, page ORDER BY row_y) AS k FROM o), m AS (SELECT doc_id, page, median(gap) AS body FROM d GROUP BY doc_id, page)
SELECT doc_id, page, row_y, gap, body FROM d JOIN m USING (doc_id, page) WHERE k = 1 AND gap > 3 * body""")
def w10_footer_row(spark, sf_dir):
    rows = row_table(spark, sf_dir)
    lowest = F.min("row_y").over(Window.partitionBy("doc_id", "page"))
    moved = rows.withColumn("row_y", F.when(F.col("row_y") == lowest, F.col("row_y") - 60 * (F.col("page") % 2)).otherwise(F.col("row_y")))
    return M.footer_row(moved)


RECT_SQL = """
r AS (SELECT l_orderkey AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS seq, 50 + l_quantity AS x0, l_linenumber * 20.0::DOUBLE AS y0,
             50 + l_quantity + l_extendedprice % 100 AS x1, l_linenumber * 20 + l_discount * 30 AS y1, l_returnflag <> 'A' AS painted, l_linestatus = 'F' AND l_returnflag = 'R' AS rotated FROM lineitem),
u AS (SELECT *, (y0 + y1) / 2 AS y FROM r WHERE painted AND NOT rotated AND y1 - y0 <= 2 AND x1 - x0 >= 30)"""


def rect_table(spark, sf_dir) -> DataFrame:
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x0 = 50 + F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(place).alias("seq"), x0.alias("x0"), (F.col("l_linenumber") * 20.0).alias("y0"), (x0 + F.col("l_extendedprice") % 100).alias("x1"),
        (F.col("l_linenumber") * 20 + F.col("l_discount") * 30).alias("y1"), (F.col("l_returnflag") != "A").alias("painted"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("rotated"))


@query("w7_horizontal_rules", f"WITH RECURSIVE {RECT_SQL}" + """,
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, seq) AS k FROM u),
f AS (SELECT doc_id, k, y AS rule_y, seq FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, CASE WHEN f.rule_y - o.y <= 0.6 THEN f.rule_y ELSE o.y END, o.seq FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
SELECT f.doc_id, round(f.rule_y, 3) AS rule_y, round(max(u.y1), 3) AS top, min(u.y0) AS bottom, count(*) AS parts FROM f JOIN u ON u.doc_id = f.doc_id AND u.seq = f.seq GROUP BY f.doc_id, f.rule_y""")
def w7_horizontal_rules(spark, sf_dir):
    return M.horizontal_rules(rect_table(spark, sf_dir)).select("doc_id", F.round("rule_y", 3).alias("rule_y"), F.round("top", 3).alias("top"), "bottom", "parts")


@query("j10_enclosing_rules", f"WITH {RECT_SQL}" + """, q AS (SELECT DISTINCT doc_id, y0 AS rule_y FROM u), p AS (SELECT doc_id, seq AS id, y0 + 12 AS top, y0 + 8 AS bottom FROM r),
e AS (SELECT p.doc_id, p.id, min(CASE WHEN rule_y >= top - 0.6 THEN rule_y END) AS above, max(CASE WHEN rule_y <= bottom + 0.6 THEN rule_y END) AS below FROM p JOIN q USING (doc_id) GROUP BY p.doc_id, p.id)
SELECT doc_id, 1 AS page, id, above, below, above - below AS height FROM e WHERE above - below > 1""")
def j10_enclosing_rules(spark, sf_dir):
    rects = rect_table(spark, sf_dir)
    flat = rects.where("painted AND NOT rotated AND y1 - y0 <= 2 AND x1 - x0 >= 30").select("doc_id", "page", F.col("y0").alias("rule_y")).distinct()
    return M.enclosing_rules(rects.select("doc_id", "page", F.col("seq").alias("id"), (F.col("y0") + 12).alias("top"), (F.col("y0") + 8).alias("bottom")), flat)


@query("j9_row_rule_band", f"WITH {RECT_SQL}" + """, q AS (SELECT DISTINCT doc_id, y0 AS rule_y FROM u), b AS (SELECT doc_id, rule_y AS high, lead(rule_y) OVER (PARTITION BY doc_id ORDER BY rule_y DESC) AS low, row_number() OVER (PARTITION BY doc_id ORDER BY rule_y DESC) - 1 AS band FROM q),
t AS (SELECT DISTINCT doc_id, y0 + 10 AS row_y FROM r) SELECT t.doc_id, t.row_y, min(band)::INTEGER AS rule_band FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND low IS NOT NULL AND row_y <= high + 1.5 AND row_y > low - 1.5 GROUP BY t.doc_id, t.row_y""")
def j9_row_rule_band(spark, sf_dir):
    rects = rect_table(spark, sf_dir)
    flat = rects.where("painted AND NOT rotated AND y1 - y0 <= 2 AND x1 - x0 >= 30").select("doc_id", "page", F.col("y0").alias("rule_y")).distinct()
    rows = rects.select("doc_id", "page", (F.col("y0") + 10).alias("row_y")).distinct()
    return M.row_rule_band(rows, flat).select("doc_id", "row_y", "rule_band")


#: Rules above every second row of pages that 3 does not divide, and one further up.
RULES_SQL = "rules AS (SELECT doc_id, page, row_y + 12 AS rule_y FROM rows_ WHERE page % 3 <> 0 AND op_index % 2 = 0 UNION ALL SELECT DISTINCT doc_id, page, 828.0::DOUBLE FROM rows_ WHERE page % 3 = 1)"


def rule_table(rows: DataFrame) -> DataFrame:
    """The same from rows of the glyph table, whose height says which they are."""
    above = rows.where("page % 3 <> 0 AND (800 - row_y) % 30 = 0").select("doc_id", "page", (F.col("row_y") + 12).alias("rule_y"))
    return above.unionByName(rows.where("page % 3 = 1").select("doc_id", "page", F.lit(828.0).alias("rule_y")).distinct())


@query("w6_table_cells", f"""
WITH RECURSIVE {GLYPHS_SQL}, {RULES_SQL}, p AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS edge, count(*) OVER (PARTITION BY doc_id, page) AS many, min(row_y) OVER (PARTITION BY doc_id, page) AS low, max(row_y) OVER (PARTITION BY doc_id, page) AS high FROM rows_),
near AS (SELECT DISTINCT r.doc_id, r.page, r.rule_y FROM rules r JOIN p ON p.doc_id = r.doc_id AND p.page = r.page WHERE rule_y BETWEEN low - 25 AND high + 25),
ruled AS (SELECT *, lead(rule_y) OVER o AS under, row_number() OVER o - 1 AS no, count(*) OVER (PARTITION BY doc_id, page) AS n_rules FROM near WINDOW o AS (PARTITION BY doc_id, page ORDER BY rule_y DESC)),
b AS (SELECT p.doc_id, p.page, p.op_index, p.row_y, p.edge, CASE WHEN coalesce(max(n_rules), 0) < 2 THEN p.op_index ELSE coalesce(min(no) FILTER (WHERE p.row_y <= rule_y + 1.5 AND p.row_y > under - 1.5), CASE WHEN p.row_y <= min(rule_y) THEN max(n_rules) - 1 ELSE -1 END) END::INTEGER AS gid
  FROM p LEFT JOIN ruled r ON r.doc_id = p.doc_id AND r.page = p.page WHERE p.many >= 2 GROUP BY p.doc_id, p.page, p.op_index, p.row_y, p.edge),
gaps AS (SELECT g.*, x0 - lag(x1) OVER (PARTITION BY doc_id, page, op_index ORDER BY x0, char_index) AS gap FROM glyphs g),
starts AS (SELECT g.doc_id, g.page, g.x0, row_number() OVER (PARTITION BY g.doc_id, g.page ORDER BY g.op_index, g.x0) AS k FROM gaps g JOIN b USING (doc_id, page, op_index) WHERE gap IS NULL OR gap > 20),
f AS (SELECT doc_id, page, k, [{{'x': x0, 'n': 1}}] AS bs FROM starts WHERE k = 1
  UNION ALL SELECT s.doc_id, s.page, s.k, CASE WHEN len(list_filter(bs, lambda e: abs(e.x - s.x0) <= 5)) = 0 THEN list_append(bs, {{'x': s.x0, 'n': 1}})
    ELSE list_transform(bs, lambda e, i: {{'x': e.x, 'n': e.n + CASE WHEN i = list_position(list_transform(bs, lambda q: abs(q.x - s.x0) <= 5), true) THEN 1 ELSE 0 END}}) END
  FROM f JOIN starts s ON s.doc_id = f.doc_id AND s.page = f.page AND s.k = f.k + 1),
c AS (SELECT doc_id, page, list_sort(list_transform(list_filter(arg_max(bs, k), lambda e: e.n >= 2), lambda e: e.x)) AS cols FROM f GROUP BY doc_id, page),
h AS (SELECT doc_id, page, gid, min(op_index) AS row, min(row_y) AS y0, max(row_y) + 10 AS y1 FROM b GROUP BY ALL),
full_ AS (SELECT g.*, b.gid, b.edge, c.cols, greatest(len(list_filter(cols, lambda v: v <= g.x0 + 5)) - 1, 0) AS col FROM glyphs g JOIN b USING (doc_id, page, op_index) JOIN c USING (doc_id, page) WHERE len(cols) >= 2)
SELECT g.doc_id, g.page, h.row::INTEGER AS row, g.gid, g.col::INTEGER AS col, round(min(x0), 3) AS x0, round(max(x1), 3) AS x1, h.y0, h.y1, round(coalesce(any_value(cols)[g.col + 2], any_value(edge)), 3) AS "right", 10.0::DOUBLE AS size,
       md5(string_agg(text, '' ORDER BY -round(g.y0, 2), x0)) AS text FROM full_ g JOIN h USING (doc_id, page, gid) GROUP BY g.doc_id, g.page, h.row, g.gid, g.col, h.y0, h.y1""")
def w6_table_cells(spark, sf_dir):
    glyphs = M.build_rows(glyph_table(spark, sf_dir))
    rows = staged(M.row_stats(glyphs).select("doc_id", "page", "row_y", "size", "x1"), "rows")
    cells = M.table_cells(rows, glyphs, rule_table(rows))
    return cells.withColumns({c: F.round(c, 3) for c in ("x0", "x1", "right")} | {"text": F.md5("text")})


_PAGE_TEXT = f"""
WITH {GLYPHS_SQL}, e AS (SELECT *, 800 - 15.0::DOUBLE * op_index AS yy FROM glyphs),
t AS (SELECT doc_id, page, string_split(string_agg(text, '' ORDER BY op_index, char_index), 'the') AS p FROM glyphs GROUP BY doc_id, page),
c AS (SELECT doc_id, page, unnest(p[:-2]) AS piece, generate_subscripts(p[:-2], 1) AS hit FROM t WHERE len(p) > 1),
s AS (SELECT doc_id, page, hit, sum(length(piece)) OVER (PARTITION BY doc_id, page ORDER BY hit) + (hit - 1) * 3 AS a FROM c),
h AS (SELECT e.*, s.hit FROM e JOIN s ON e.doc_id = s.doc_id AND e.page = s.page AND e.op_index * 60 + e.char_index BETWEEN s.a AND s.a + 2)"""


def _even(spark, sf_dir) -> DataFrame:
    y0 = 800 - 15.0 * F.col("op_index")
    return glyph_table(spark, sf_dir).withColumns({"y0": y0, "y1": y0 + 10})


def _hit_glyphs(spark, sf_dir) -> DataFrame:
    from quire.functions.text import find_spans

    g = _even(spark, sf_dir)
    pages = g.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_index", "char_index", "text"))), lambda x: x["text"]), "").alias("t"))
    spans = pages.select("doc_id", "page", F.posexplode(find_spans(F.col("t"), F.lit("the"))).alias("hit", "x")).select("doc_id", "page", (F.col("hit") + 1).alias("hit"), "x.a", "x.b")
    return M.span_to_glyphs(g, spans, ["doc_id", "page"], ["op_index", "char_index"])


@query("j13_span_to_glyphs", _PAGE_TEXT + " SELECT doc_id, page, hit::INTEGER AS hit, op_index, char_index FROM h")
def j13_span_to_glyphs(spark, sf_dir):
    return _hit_glyphs(spark, sf_dir).select("doc_id", "page", "hit", "op_index", "char_index")


@query("t8_term_regions", _PAGE_TEXT + """, b AS (SELECT doc_id, page, hit, op_index, page % 2 = 0 AND char_index >= 40 AS far, min(x0) AS x0, max(x1) AS x1, min(yy) AS y FROM h GROUP BY ALL)
SELECT DISTINCT doc_id, page, round(x0 + 0.02, 2) AS x0, round(y + 0.02, 2) AS y0, round(x1 - 0.02, 2) AS x1, round(y + 9.98, 2) AS y1 FROM b""")
def t8_term_regions(spark, sf_dir):
    return M.term_regions(_hit_glyphs(spark, sf_dir), ["doc_id", "page"])


@query("t11_redaction_boxes", "SELECT DISTINCT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, 60.0::DOUBLE AS x0, 778.0::DOUBLE AS y0, 130.0::DOUBLE AS x1, 814.0::DOUBLE AS y1 FROM conversations WHERE (turn + 1) % 3 <> 0")
def t11_redaction_boxes(spark, sf_dir):
    return G.redaction_boxes(region_table(spark, sf_dir))


@query("t10_replace_regions", f"WITH {GLYPHS_SQL} SELECT doc_id, page, round(arg_min(x0, op_index * 100 + char_index), 3) AS x0, arg_min(y0, op_index * 100 + char_index) + 2 AS y, 'NEW' AS text FROM glyphs WHERE {HIT_SQL} GROUP BY doc_id, page")
def t10_replace_regions(spark, sf_dir):
    g = glyph_table(spark, sf_dir)
    _, made = M.replace_regions(g, G.glyphs_in_regions(g, region_table(spark, sf_dir)), "NEW")
    return made.select("doc_id", "page", F.round("x0", 3).alias("x0"), "y", "text")


@query("w9_merge_line_rects", f"""
WITH {GLYPHS_SQL}, e AS (SELECT doc_id, page, op_index, x0, x1, lag(x1) OVER (PARTITION BY doc_id, page, op_index ORDER BY x0) AS p FROM glyphs WHERE ch <> ' ')
SELECT doc_id, page, count(*) AS boxes FROM e WHERE p IS NULL OR x0 - p > 1.6 GROUP BY doc_id, page""")
def w9_merge_line_rects(spark, sf_dir):
    rects = glyph_table(spark, sf_dir).where("text <> ' '").select("doc_id", "page", "x0", "y0", "x1", "y1")
    return M.merge_line_rects(rects, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("boxes"))


#: The characters of the hits of two terms in a page's text, and the boxes that redacting them draws. whole: rather all glyphs of their rows.
def _redacted_sql(whole: bool) -> str:
    chosen = "SELECT DISTINCT e.* FROM e JOIN hit h ON h.doc_id = e.doc_id AND h.page = e.page AND h.op_index = e.op_index" if whole else "SELECT * FROM hit"
    return f"""
WITH {GLYPHS_SQL}, e AS (SELECT *, 800 - 15.0::DOUBLE * op_index AS yy FROM glyphs), terms(ord, term) AS (VALUES (0, 'the'), (1, 'tion')),
t AS (SELECT doc_id, page, ord, term, string_split(whole, term) AS p FROM (SELECT doc_id, page, lower(string_agg(text, '' ORDER BY op_index, char_index)) AS whole FROM glyphs GROUP BY doc_id, page), terms),
c AS (SELECT doc_id, page, ord, term, unnest(p[:-2]) AS piece, generate_subscripts(p[:-2], 1) AS k FROM t WHERE len(p) > 1),
s AS (SELECT doc_id, page, ord, sum(length(piece) + length(term)) OVER (PARTITION BY doc_id, page, ord ORDER BY k) - length(term) AS a, length(term) AS n FROM c),
hit AS (SELECT DISTINCT e.* FROM e JOIN s ON e.doc_id = s.doc_id AND e.page = s.page AND e.op_index * 60 + e.char_index >= a AND e.op_index * 60 + e.char_index < a + n),
chosen AS ({chosen}),
o AS (SELECT *, lag(x1) OVER w AS px, lag(yy) OVER w AS py FROM chosen WINDOW w AS (PARTITION BY doc_id, page ORDER BY yy DESC, x0, x1)),
i AS (SELECT *, sum(CASE WHEN px IS NULL OR abs(yy - py) > 2 OR x0 - px > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY yy DESC, x0, x1 ROWS UNBOUNDED PRECEDING) AS b FROM o),
boxes AS (SELECT doc_id, page, b, round(min(x0) + 0.02, 2) AS x0, round(min(yy) + 0.02, 2) AS y0, round(max(x1) - 0.02, 2) AS x1, round(max(yy) + 9.98, 2) AS y1 FROM i GROUP BY doc_id, page, b),
k AS (SELECT e.*, EXISTS (SELECT 1 FROM boxes r WHERE r.doc_id = e.doc_id AND r.page = e.page AND e.x0 < r.x1 AND e.x1 > r.x0 AND e.yy < r.y1 AND e.yy + 10 > r.y0) AS gone FROM e),
left_ AS (SELECT doc_id, page, count(*) FILTER (WHERE gone) AS removed, coalesce(string_agg(text, '' ORDER BY op_index, char_index) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id, page)
SELECT g.doc_id, g.page, (SELECT count(*) FROM s WHERE s.doc_id = g.doc_id AND s.page = g.page) AS hits, (SELECT count(*) FROM boxes r WHERE r.doc_id = g.doc_id AND r.page = g.page) AS regions, removed, md5(kept) AS text_left,
       (contains(lower(kept), 'the')::INTEGER + contains(lower(kept), 'tion')::INTEGER) AS residue FROM left_ g WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = g.doc_id AND s.page = g.page)"""


def _redacted(spark, sf_dir, mode: str) -> DataFrame:
    pages = RD.redact_terms(_even(spark, sf_dir).withColumn("row_y", F.col("y0")), ["the", "tion"], True, mode)
    hits = F.aggregate(F.map_values("hits"), F.lit(0).cast("long"), lambda s, n: s + n)
    return pages.select("doc_id", "page", hits.alias("hits"), F.size("regions").cast("long").alias("regions"), "removed", F.md5("left").alias("text_left"), "residue")


@query("t8_redacted_pages", _redacted_sql(False))
def t8_redacted_pages(spark, sf_dir):
    return _redacted(spark, sf_dir, "term")


@query("t8_redacted_lines", _redacted_sql(True))
def t8_redacted_lines(spark, sf_dir):
    return _redacted(spark, sf_dir, "line")


@query("t3_find_boxes", _PAGE_TEXT + """, b AS (SELECT doc_id, page, hit, op_index, page % 2 = 0 AND char_index >= 40 AS far, min(x0) AS x0, max(x1) AS x1, min(yy) AS y FROM h GROUP BY ALL),
n AS (SELECT doc_id, page, count(*) AS count FROM s GROUP BY ALL)
SELECT b.doc_id, b.page, count, round(x0, 2) AS x0, round(y, 2) AS y0, round(x1, 2) AS x1, round(y + 10, 2) AS y1 FROM b JOIN n USING (doc_id, page)""")
def t3_find_boxes(spark, sf_dir):
    found = RD.find_boxes(_even(spark, sf_dir).withColumn("row_y", F.col("y0")), "the")
    return found.select("doc_id", "page", "count", F.inline("boxes"))


#: Turns as runs whose text is known. By page: all glyphs; none for blanks; none for blanks but a narrow one after every tenth; one glyph too few.
_RUNS_SQL = """
shown AS (SELECT doc_id, page, op_index * 60 + char_index AS i, font_alias, code + 1000 * (op_index % 2) AS code, x0, x1, ch FROM glyphs),
chosen AS (SELECT *, i * 2 AS pos FROM shown WHERE page % 4 = 0 OR (page % 4 < 3 AND ch <> ' ') OR (page % 4 = 3 AND i > 0)
  UNION ALL SELECT doc_id, page, i, 'F9', 7, x0, x0 + 0.1, ch, i * 2 + 1 FROM shown WHERE page % 4 = 2 AND i % 10 = 0)"""


@query("j17_align_text", f"""
WITH {GLYPHS_SQL}, {_RUNS_SQL},
t AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, replace(replace(text, chr(10), ''), chr(13), '') AS every, replace(replace(replace(text, chr(10), ''), chr(13), ''), ' ', '') AS bare FROM conversations WHERE text <> ''),
n AS (SELECT doc_id, page, count(*) AS n_all, count(*) FILTER (WHERE x1 - x0 > 1.5) AS n_solid FROM chosen GROUP BY ALL),
f AS (SELECT t.*, CASE WHEN length(bare) = 0 THEN NULL WHEN n_all = length(bare) THEN 1 WHEN n_all = length(every) THEN 2 WHEN n_solid = length(bare) THEN 3 WHEN n_solid = length(every) THEN 4 END AS fit FROM t JOIN n USING (doc_id, page)),
c AS (SELECT doc_id, page, unnest(string_split(CASE WHEN fit % 2 = 1 THEN bare ELSE every END, '')) AS text, generate_subscripts(string_split(CASE WHEN fit % 2 = 1 THEN bare ELSE every END, ''), 1) AS k FROM f WHERE fit IS NOT NULL),
side AS (SELECT x.doc_id, x.page, font_alias, x.code, row_number() OVER (PARTITION BY x.doc_id, x.page ORDER BY pos) AS k FROM chosen x JOIN f USING (doc_id, page) WHERE fit <= 2 OR (fit > 2 AND x1 - x0 > 1.5)),
p AS (SELECT side.*, c.text FROM side JOIN c USING (doc_id, page, k)),
w AS (SELECT *, first_value(font_alias || code) OVER o AS first, row_number() OVER o AS r FROM p WINDOW o AS (PARTITION BY doc_id, page, text ORDER BY k))
SELECT doc_id, page, text, arg_min(font_alias, r) AS font_alias, arg_min(code, r)::INTEGER AS code, (count(*) FILTER (WHERE font_alias || code <> first))::INTEGER AS conflicts FROM w GROUP BY doc_id, page, text""")
def j17_align_text(spark, sf_dir):
    i = F.col("op_index") * 60 + F.col("char_index")
    g = glyph_table(spark, sf_dir).select("doc_id", F.col("page").alias("run"), i.alias("i"), "font_alias", (F.col("code") + 1000 * (F.col("op_index") % 2)).alias("code"), "x0", "x1", "text")
    kind = F.col("run") % 4
    kept = g.where((kind == 0) | ((kind < 3) & (F.col("text") != " ")) | ((kind == 3) & (F.col("i") > 0))).withColumn("pos", F.col("i") * 2)
    narrow = g.where((kind == 2) & (F.col("i") % 10 == 0)).withColumns({"font_alias": F.lit("F9"), "code": F.lit(7), "x1": F.col("x0") + 0.1, "pos": F.col("i") * 2 + 1})
    texts = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("run"), "text")
    found, _ = R.align_text(kept.unionByName(narrow).withColumn("size", F.lit(10.0)), texts)
    return found.withColumnRenamed("run", "page")
