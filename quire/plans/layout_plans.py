"""Queries on rows set with indents, gaps, sizes and rules, which hang on the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import edits as E
from quire.operators import pagemodel as M
from quire.plans.reflow_plans import RULED, wrapped_sql
from quire.plans.registry import query, table

#: Twenty lines to a page. The length of a line decides its indent, size, columns, band and the gap above it.
ROWS_SQL = """
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, (i // 20 + 1)::INTEGER AS page, i, length(line) AS n FROM l),
r AS (SELECT doc_id, page, n, 50 + CASE WHEN n % 6 = 0 THEN 20 ELSE 0 END::DOUBLE AS x0, 60 + n % 300::DOUBLE AS x1, CASE WHEN n % 11 = 0 THEN 14 ELSE 10 END::DOUBLE AS size,
             CASE WHEN n % 5 < 2 THEN 2 ELSE 1 END AS cols, CASE n % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS band,
             800 - sum(15 + CASE WHEN n % 7 = 0 THEN 12 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i)::DOUBLE AS row_y FROM m),
rules AS (SELECT doc_id, page, row_y + 11 AS rule_y FROM r WHERE n % 9 < 2 UNION SELECT doc_id, page, 812.0 + page % 8 FROM r),
g AS (SELECT *, lag(row_y) OVER (PARTITION BY doc_id, page ORDER BY row_y DESC) - row_y AS gap, lag(size) OVER (PARTITION BY doc_id, page ORDER BY row_y DESC) AS above FROM r),
u AS (SELECT doc_id, page, median(gap) AS body FROM g GROUP BY doc_id, page),
c AS (SELECT doc_id, page, round(x0, 1) AS x, count(*) AS k FROM r GROUP BY ALL),
margin AS (SELECT doc_id, page, arg_min(x, -k * 1000 + x) AS "left" FROM c GROUP BY doc_id, page),
near AS (SELECT r.doc_id, r.page, rule_y FROM rules r JOIN (SELECT doc_id, page, min(row_y) AS low, max(row_y) AS high FROM r GROUP BY ALL) e ON e.doc_id = r.doc_id AND e.page = r.page WHERE rule_y BETWEEN low - 30 AND high + 30),
bands AS (SELECT *, lead(rule_y) OVER o AS under, row_number() OVER o - 1 AS no FROM near WINDOW o AS (PARTITION BY doc_id, page ORDER BY rule_y DESC)),
ruled AS (SELECT g.*, (SELECT min(no) FROM bands b WHERE b.doc_id = g.doc_id AND b.page = g.page AND g.row_y <= rule_y + 1.5 AND g.row_y > under - 1.5)::INTEGER AS rule_band FROM g),
told AS (SELECT *, coalesce(rule_band = lag(rule_band) OVER (PARTITION BY doc_id, page ORDER BY row_y DESC), false)
  OR coalesce(body > 0 AND abs(gap - body) <= greatest(1.2, body * 0.25) AND abs(x0 - "left") <= 3 AND abs(size - above) <= 0.6, false) AS same FROM ruled JOIN u USING (doc_id, page) JOIN margin USING (doc_id, page)),
paras AS (SELECT *, (sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY row_y DESC) - 1)::INTEGER AS para FROM told)"""


def laid_rows(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    n, place = F.char_length("line"), Window.partitionBy("doc_id", "page").orderBy("i")
    made = lines.select("doc_id", F.floor(F.col("i") / 20 + 1).cast("int").alias("page"), "i", n.alias("n"))
    k = F.col("n")
    return made.select(
        "doc_id", "page", "n", F.when(k % 6 == 0, 70.0).otherwise(50.0).alias("x0"), (60.0 + k % 300).alias("x1"), F.when(k % 11 == 0, 14.0).otherwise(10.0).alias("size"), F.when(k % 5 < 2, 2).otherwise(1).alias("cols"),
        F.when(k % 10 == 0, 1).when(k % 10 == 1, 2).when(k % 10 == 2, 0).otherwise(3).alias("band"), (800.0 - F.sum(F.when(k % 7 == 0, 27.0).otherwise(15.0)).over(place)).alias("row_y"))


def rule_table(rows: DataFrame) -> DataFrame:
    own = rows.where("n % 9 < 2").select("doc_id", "page", (F.col("row_y") + 11).alias("rule_y"))
    return own.unionByName(rows.select("doc_id", "page", (812.0 + F.col("page") % 8).alias("rule_y"))).distinct()


def _paragraphs(spark, sf_dir) -> DataFrame:
    rows = laid_rows(spark, sf_dir)
    return M.paragraphs(M.rule_bands(rows, rule_table(rows)))


@query("w5_ruled_paragraphs", f"WITH {ROWS_SQL} SELECT doc_id, page, row_y, rule_band, para FROM paras")
def w5_ruled_paragraphs(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "page", "row_y", "rule_band", "para")


@query("a2_ruled_paragraph_stats", f"""
WITH {ROWS_SQL} SELECT doc_id, page, para, max(row_y) AS top, min(row_y) AS bottom, min(x0) AS "left", max(x1) AS "right", count(*) AS lines, max(cols) AS cols, count(*) FILTER (WHERE cols = 2) >= 2 AND count(*) FILTER (WHERE cols = 2) * 2 >= count(*) AS table_like,
  round(CASE WHEN count(*) > 1 THEN (max(row_y) - min(row_y)) / (count(*) - 1) ELSE coalesce(any_value(body), 0) END, 6)::DOUBLE AS gap FROM paras GROUP BY doc_id, page, para""")
def a2_ruled_paragraph_stats(spark, sf_dir):
    return M.paragraph_stats(_paragraphs(spark, sf_dir)).withColumn("gap", F.round("gap", 6))


@query("a4_indented_margin", f"WITH {ROWS_SQL} SELECT doc_id, page, \"left\" FROM margin")
def a4_indented_margin(spark, sf_dir):
    return M.left_margin(laid_rows(spark, sf_dir))


@query("j9_rule_bands_outside", f"""
WITH {ROWS_SQL}, e AS (SELECT doc_id, page, min(row_y) AS low, max(row_y) AS high, greatest(arg_max(size, row_y) * 2.5, 20) AS pad FROM r GROUP BY ALL),
q AS (SELECT x.doc_id, x.page, rule_y, lead(rule_y) OVER o AS under, row_number() OVER o - 1 AS no, count(*) OVER (PARTITION BY x.doc_id, x.page) AS many FROM rules x JOIN e ON e.doc_id = x.doc_id AND e.page = x.page WHERE rule_y BETWEEN low - pad AND high + pad WINDOW o AS (PARTITION BY x.doc_id, x.page ORDER BY rule_y DESC)),
w AS (SELECT r.doc_id, r.page, r.row_y, min(no) FILTER (WHERE r.row_y <= rule_y + 1.5 AND r.row_y > under - 1.5) AS inside, max(many) AS many, min(rule_y) AS lowest FROM r LEFT JOIN q ON q.doc_id = r.doc_id AND q.page = r.page GROUP BY ALL)
SELECT doc_id, page, row_y, CASE WHEN coalesce(many, 0) < 2 THEN row_number() OVER (PARTITION BY doc_id, page ORDER BY row_y DESC) - 1 ELSE coalesce(inside, CASE WHEN row_y <= lowest THEN many - 1 ELSE -1 END) END::INTEGER AS rule_band FROM w""")
def j9_rule_bands_outside(spark, sf_dir):
    rows = laid_rows(spark, sf_dir)
    return M.rule_bands(rows, rule_table(rows), outside=True).select("doc_id", "page", "row_y", "rule_band")


@query("w2_merge_thin_bands", f"""
WITH RECURSIVE {ROWS_SQL}, b AS (SELECT doc_id, page, band, count(*) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY band) AS k, count(*) OVER (PARTITION BY doc_id, page) AS bands FROM r GROUP BY doc_id, page, band),
f AS (SELECT DISTINCT doc_id, page, 0::BIGINT AS k, 0 AS made, 0::BIGINT AS carried, -1 AS col, -1 AS band FROM b
  UNION ALL SELECT b.doc_id, b.page, b.k, CASE WHEN n + carried >= 2 OR (made = 0 AND b.k = bands) THEN made + 1 ELSE made END, CASE WHEN n + carried < 2 AND made = 0 AND b.k < bands THEN n + carried ELSE 0 END,
    CASE WHEN n + carried >= 2 OR (made = 0 AND b.k = bands) THEN made WHEN made = 0 THEN 0 ELSE made - 1 END, b.band FROM f JOIN b ON b.doc_id = f.doc_id AND b.page = f.page AND b.k = f.k + 1)
SELECT r.doc_id, r.page, f.col::BIGINT AS col, count(*) AS n FROM r JOIN f ON f.doc_id = r.doc_id AND f.page = r.page AND f.band = r.band GROUP BY r.doc_id, r.page, f.col""")
def w2_merge_thin_bands(spark, sf_dir):
    rows = laid_rows(spark, sf_dir)
    return M.merge_thin_bands(rows).groupBy("doc_id", "page", "col").agg(F.count(F.lit(1)).alias("n"))


#: Four rows to a band, with rules above and below; of five bands, the second is copied and the fourth taken out, on odd pages the first, too.
EDITS_SQL = """
rows_ AS (SELECT doc_id, page, i % 20 AS spot, 790 - (i % 20) * 15.0::DOUBLE AS row_y, i % 20 = 19 AS is_footer FROM m),
tops AS (SELECT DISTINCT doc_id, page, spot // 4 AS band, 800 - (spot // 4) * 60.0::DOUBLE AS high, 740 - (spot // 4) * 60.0::DOUBLE AS low FROM rows_),
edits AS (SELECT *, CASE WHEN band = 1 THEN 60.0 ELSE -60.0 END::DOUBLE AS delta, CASE WHEN band = 1 THEN 'insert' ELSE 'delete' END AS kind FROM tops WHERE band IN (1, 3) OR (band = 0 AND page % 2 = 1)),
rects AS (SELECT doc_id, page, band * 10 AS seq, 50.0::DOUBLE AS x0, low - 0.5::DOUBLE AS y0, 250.0::DOUBLE AS x1, low + 0.5::DOUBLE AS y1, band = 4 AS rotated FROM tops
  UNION ALL SELECT doc_id, page, band * 10 + 1, 50.0, low - 30, 51.0, high + 30, false FROM tops WHERE band % 2 = 0
  UNION ALL SELECT doc_id, page, band * 10 + 2, 60.0, low + 2, 90.0, high - 2, false FROM tops)"""


def _edits(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    at = F.col("i") % 20
    rows = lines.select("doc_id", F.floor(F.col("i") / 20 + 1).cast("int").alias("page"), F.lit(0).alias("col"), at.alias("spot"), (790 - at * 15.0).alias("row_y"), (at == 19).alias("is_footer"))
    tops = rows.select("doc_id", "page", "col", F.floor(F.col("spot") / 4).cast("int").alias("band")).distinct().withColumns({"high": 800 - F.col("band") * 60.0, "low": 740 - F.col("band") * 60.0})
    edits = E.row_edits(tops.where("band = 1"), "insert").unionByName(E.row_edits(tops.where("band = 3 OR (band = 0 AND page % 2 = 1)"), "delete"))
    rect = lambda n, x0, y0, x1, y1, rotated=F.lit(False): ["doc_id", "page", "col", (F.col("band") * 10 + n).alias("seq"), F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), y1.alias("y1"), rotated.alias("rotated")]
    low, high = F.col("low"), F.col("high")
    rects = tops.select(*rect(0, 50.0, low - 0.5, 250.0, low + 0.5, F.col("band") == 4))
    rects = rects.unionByName(tops.where("band % 2 = 0").select(*rect(1, 50.0, low - 30, 51.0, high + 30))).unionByName(tops.select(*rect(2, 60.0, low + 2, 90.0, high - 2)))
    return rows, rects, edits


@query("l8_edited_rows", f"""
WITH {ROWS_SQL}, {EDITS_SQL}, s AS (SELECT r.*, coalesce(sum(e.delta), 0) AS shift FROM rows_ r LEFT JOIN edits e ON e.doc_id = r.doc_id AND e.page = r.page AND e.low - 0.5 > r.row_y
    WHERE r.is_footer OR NOT EXISTS (SELECT 1 FROM edits d WHERE d.kind = 'delete' AND d.doc_id = r.doc_id AND d.page = r.page AND r.row_y < d.high AND r.row_y > d.low) GROUP BY ALL),
y AS (SELECT doc_id, page, spot, is_footer, CASE WHEN is_footer THEN row_y ELSE row_y - shift END AS new_y, row_y, false AS copied FROM s),
both_ AS (SELECT * FROM y UNION ALL SELECT y.doc_id, y.page, spot, is_footer, new_y - 60, row_y, true FROM y JOIN edits e ON e.kind = 'insert' AND e.doc_id = y.doc_id AND e.page = y.page AND row_y < high AND row_y > low AND NOT is_footer)
SELECT doc_id, page, spot, new_y, copied, coalesce(min(CASE WHEN NOT is_footer THEN new_y END) OVER (PARTITION BY doc_id, page) >= 500, true) AS fits FROM both_""")
def l8_edited_rows(spark, sf_dir):
    rows, _, edits = _edits(spark, sf_dir)
    return E.edit_rows(rows, edits, 500.0).select("doc_id", "page", "spot", "new_y", "copied", "fits")


@query("l8_edited_rects", f"""
WITH {ROWS_SQL}, {EDITS_SQL}, k AS (SELECT *, CASE WHEN x1 - x0 <= 1.5 THEN y0 ELSE (y0 + y1) / 2 END AS a, CASE WHEN x1 - x0 <= 1.5 THEN y1 ELSE (y0 + y1) / 2 END AS b FROM rects r
    WHERE x1 - x0 <= 1.5 OR rotated OR NOT EXISTS (SELECT 1 FROM edits d WHERE d.kind = 'delete' AND d.doc_id = r.doc_id AND d.page = r.page AND abs((y0 + y1) / 2 - d.low) <= 1.5)),
s AS (SELECT k.*, coalesce(sum(delta) FILTER (WHERE e.low - 0.5 > a), 0) AS da, coalesce(sum(delta) FILTER (WHERE e.low - 0.5 > b), 0) AS db FROM k LEFT JOIN edits e ON e.doc_id = k.doc_id AND e.page = k.page GROUP BY ALL),
n AS (SELECT *, CASE WHEN rotated THEN y0 ELSE y0 - da END AS new_y0, CASE WHEN rotated THEN y1 ELSE y1 - db END AS new_y1 FROM s)
SELECT doc_id, page, seq::INTEGER AS seq, new_y0, new_y1, false AS added FROM n
UNION ALL SELECT n.doc_id, n.page, seq::INTEGER, new_y0 - 60, new_y1 - 60, true FROM n JOIN edits e ON e.kind = 'insert' AND e.doc_id = n.doc_id AND e.page = n.page WHERE x1 - x0 > 1.5 AND NOT rotated AND abs((y0 + y1) / 2 - e.low) <= 1.5""")
def l8_edited_rects(spark, sf_dir):
    _, rects, edits = _edits(spark, sf_dir)
    return E.edit_rects(rects, edits).select("doc_id", "page", "seq", "new_y0", "new_y1", "added")


@query("l6_rewrapped_rows", f"""
WITH RECURSIVE {RULED}, {wrapped_sql('30000')}, c AS (SELECT conv_id, turn, count(*) AS lines FROM wrapped GROUP BY ALL),
p AS (SELECT conv_id AS doc_id, turn AS para, 800.0::DOUBLE - turn * 30 AS top, 785.0::DOUBLE - turn * 30 AS bottom, CASE WHEN turn % 2 = 0 THEN (lines - 2) * 15.0 ELSE 0 END::DOUBLE AS delta FROM c),
r AS (SELECT doc_id, para, unnest([top, bottom]) AS row_y FROM p)
SELECT r.doc_id, r.para, r.row_y, (r.row_y - coalesce(sum(e.delta), 0))::DOUBLE AS new_y FROM r LEFT JOIN p e ON e.doc_id = r.doc_id AND e.bottom - 0.5 > r.row_y GROUP BY r.doc_id, r.para, r.row_y""")
def l6_rewrapped_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("col"), F.col("turn").alias("para"), "text")
    paragraphs = turns.drop("text").withColumns({"top": 800.0 - F.col("para") * 30, "bottom": 785.0 - F.col("para") * 30, "left": F.lit(50.0), "right": F.lit(350.0), "size": F.lit(10.0), "gap": F.lit(15.0), "lines": F.lit(2)})
    edits = E.rewraps(paragraphs, turns.where("para % 2 = 0"))
    rows = paragraphs.select("doc_id", "page", "col", "para", F.explode(F.array("top", "bottom")).alias("row_y"), F.lit(False).alias("is_footer"))
    return E.edit_rows(rows, edits).select("doc_id", "para", "row_y", "new_y")
