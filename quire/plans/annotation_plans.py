"""Queries on annotations (events), regions and objects (line items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import annotations as A
from quire.plans.registry import query, table

KINDS = ["highlight", "underline", "BOX", "note", "sticker"]
_KIND_SQL = "['highlight', 'underline', 'box', 'note', 'sticker'][CAST(event_id % 5 AS INTEGER) + 1]"
ANN_SQL = f"""
a AS (SELECT user_id AS doc_id, event_id AS seq, {_KIND_SQL} AS type, CAST(extract(hour FROM ts) AS INTEGER) AS page, "value" AS v,
             CASE event_id % 3 WHEN 0 THEN '#f59e0b' WHEN 1 THEN '#0a0b0c' ELSE '#000000' END AS color FROM events),
r AS (SELECT *, round(v, 2) AS x0, round(least(v + 10, v * 2), 2) AS y0, round(v + 20, 2) AS x1, round(greatest(v + 10, v * 2), 2) AS y1,
             abs(v * 2 - (v + 10)) >= 0.1 AND abs(v) < 1e6 AS wide FROM a),
c AS (SELECT *, type <> 'sticker' AND page >= 1 AND coalesce(wide, false) AS accepted FROM r)"""


def _annotations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 5).cast("int")).alias("type"), F.hour("ts").alias("page"),
                    F.array(F.array(v, v + 10, v + 20, v * 2), F.array(v, v)).alias("rects"), F.get(F.array(F.lit(None), F.lit("rgb(10, 11,12)"), F.lit("green")), (F.col("event_id") % 3).cast("int")).alias("color"), F.col("event_type").alias("note"))


@query("p8_sanitize_annotations", f"WITH {ANN_SQL} SELECT doc_id, seq, type, page, accepted, color, CASE WHEN wide THEN x0 END AS x0, CASE WHEN wide THEN y1 END AS y1 FROM c")
def p8_sanitize_annotations(spark, sf_dir):
    clean = A.sanitize_annotations(_annotations(spark, sf_dir))
    first = F.get("rects", F.lit(0))
    return clean.select("doc_id", "seq", "type", "page", "accepted", "color", F.get(first, F.lit(0)).alias("x0"), F.get(first, F.lit(3)).alias("y1"))


@query("p17_annotation_records", f"""
WITH {ANN_SQL} SELECT seq, x0, CASE WHEN type = 'note' THEN greatest(y0, y1 - 18) ELSE y0 END AS y0, CASE WHEN type = 'note' THEN x0 + 18 ELSE x1 END AS x1,
       CASE WHEN type = 'note' THEN greatest(y0, y1 - 18) + 18 ELSE y1 END AS y1, CASE WHEN type IN ('highlight', 'underline') THEN 8 END AS n_quads, CASE WHEN type = 'highlight' THEN 0.45::DOUBLE END AS opacity FROM c WHERE accepted""")
def p17_annotation_records(spark, sf_dir):
    made = A.annotation_records(A.sanitize_annotations(_annotations(spark, sf_dir)).where("accepted"))
    return made.select("seq", *[F.get("rect", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.when(F.col("quads").isNotNull(), F.size("quads")).alias("n_quads"), "opacity")


@query("p19_quad_boxes", f"WITH {ANN_SQL} SELECT seq, x0, y0, x1, y1 FROM c WHERE accepted AND type <> 'note'")
def p19_quad_boxes(spark, sf_dir):
    made = A.annotation_records(A.sanitize_annotations(_annotations(spark, sf_dir)).where("accepted AND type <> 'note'"))
    boxes = made.select("seq", F.explode(A.quad_boxes(F.coalesce("quads", F.array().cast("array<double>")), F.col("rect"))).alias("b"))
    return boxes.select("seq", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("a13_annotation_stats", f"WITH {ANN_SQL} SELECT doc_id, count(*) FILTER (WHERE accepted) AS written, count(DISTINCT page) FILTER (WHERE accepted) AS pages, count(*) FILTER (WHERE NOT accepted) AS skipped FROM c GROUP BY doc_id")
def a13_annotation_stats(spark, sf_dir):
    return A.annotation_stats(A.sanitize_annotations(_annotations(spark, sf_dir)))


@query("a14_progress_markers", f"WITH {ANN_SQL}, n AS (SELECT doc_id, max(page) AS n_pages FROM c GROUP BY doc_id), f AS (SELECT doc_id, page, type, min(seq) AS seq FROM c WHERE accepted GROUP BY doc_id, page, type) SELECT f.*, n_pages, (page - 1) / n_pages AS place FROM f JOIN n USING (doc_id)")
def a14_progress_markers(spark, sf_dir):
    clean = A.sanitize_annotations(_annotations(spark, sf_dir))
    return A.progress_markers(clean.where("accepted"), clean.groupBy("doc_id").agg(F.max("page").alias("n_pages")), "seq")


@query("g14_annotation_list", f"WITH {ANN_SQL}, u AS (SELECT doc_id, seq, type, page, seq % 2 = 1 AS embedded, count(*) OVER (PARTITION BY doc_id) AS total FROM c) SELECT *, count(*) OVER (PARTITION BY doc_id) AS shown FROM u WHERE type = 'note'")
def g14_annotation_list(spark, sf_dir):
    clean = A.sanitize_annotations(_annotations(spark, sf_dir)).select("doc_id", "seq", "type", "page")
    return A.annotation_list(clean.where("seq % 2 = 0"), clean.where("seq % 2 = 1"), "note")


@query("s8_notes_markdown", f"""
WITH {ANN_SQL}, e AS (SELECT c.doc_id, c.page, c.seq, '- **[' || CASE c.type WHEN 'highlight' THEN '高亮' WHEN 'underline' THEN '下划线' WHEN 'note' THEN '笔记' ELSE '区域' END || ']** `' || c.color || '`' || chr(10) || '  > ' || v.props_text || chr(10) || '  ' || chr(10) || '  ' || v.event_type || chr(10) AS entry
  FROM c JOIN (SELECT event_id, event_type, trim(replace(event_type || chr(10) || user_id, chr(10), ' ')) AS props_text FROM events) v ON v.event_id = c.seq WHERE accepted),
p AS (SELECT doc_id, page, count(*) AS k, '## ' || page || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY seq) AS t FROM e GROUP BY doc_id, page)
SELECT doc_id, sum(k)::BIGINT AS n, md5(string_agg(t, chr(10) ORDER BY page)) AS markdown FROM p GROUP BY doc_id""")
def s8_notes_markdown(spark, sf_dir):
    clean = A.sanitize_annotations(_annotations(spark, sf_dir)).where("accepted").withColumn("text", F.concat("note", F.lit("\n"), F.col("doc_id").cast("string")))
    return A.notes_markdown(clean).withColumn("markdown", F.md5("markdown"))


@query("g13_bookmarks", """
WITH b AS (SELECT user_id AS doc_id, CAST(event_id % 40 AS INTEGER) AS page, CASE WHEN user_id % 2 = 0 THEN 'b' || event_id ELSE 'Page ' || event_id % 40 END AS name, event_id FROM events)
SELECT doc_id, page, name, row_number() OVER (PARTITION BY doc_id ORDER BY page, event_id)::INTEGER AS at FROM b""")
def g13_bookmarks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    page = (F.col("event_id") % 40).cast("int")
    per = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", page.alias("page")))).alias("x"))
    new = F.to_json(F.transform("x", lambda x: F.array(x["page"].cast("string"), F.concat(F.lit("b"), x["event_id"].cast("string")))))
    old = F.to_json(F.transform("x", lambda x: x["page"]))
    return A.bookmarks(per.select("doc_id", F.when(F.col("doc_id") % 2 == 0, new).otherwise(old).alias("json")))


_REGION_SQL = "g AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey AS part, CAST(l_linenumber - 1 AS INTEGER) AS page, l_quantity * 10 AS x, l_extendedprice % 600 AS y, l_discount * 3000 AS w, l_tax * 3000 - 20 AS h FROM lineitem)"


def regions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") - 1).alias("page"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_extendedprice") % 600).alias("y"), (F.col("l_discount") * 3000).alias("w"), (F.col("l_tax") * 3000 - 20).alias("h"))


@query("p11_sanitize_regions", f"WITH {_REGION_SQL} SELECT doc_id, seq, part, page, x, round(y, 4) AS y, least(greatest(w, 1.0), 20000.0) AS w, least(greatest(h, 1.0), 20000.0) AS h FROM g WHERE page >= 1")
def p11_sanitize_regions(spark, sf_dir):
    return A.sanitize_regions(regions(spark, sf_dir)).withColumn("y", F.round("y", 4))


@query("a16_regions_summary", f"WITH {_REGION_SQL} SELECT doc_id, page, count(*) AS regions FROM g WHERE page >= 1 GROUP BY GROUPING SETS ((doc_id, page), (doc_id))")
def a16_regions_summary(spark, sf_dir):
    return A.regions_summary(A.sanitize_regions(regions(spark, sf_dir)))


@query("g11_distinct_regions", f"WITH {_REGION_SQL} SELECT DISTINCT doc_id, page, round(x, 1) AS x, round(w, 1) AS w FROM g WHERE page >= 1")
def g11_distinct_regions(spark, sf_dir):
    return regions(spark, sf_dir).where("page >= 1").select("doc_id", "page", F.round("x", 1).alias("x"), F.round("w", 1).alias("w")).dropDuplicates()


@query("p9_sanitize_objects", """
SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey AS part, CASE l_linenumber % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'text' ELSE 'blob' END AS kind,
       CASE WHEN l_linenumber % 3 = 0 THEN least(greatest(l_quantity, 0.1), 40.0) END AS "lineWidth", CASE WHEN l_linenumber % 3 = 1 THEN least(greatest(l_extendedprice / 100, 4.0), 200.0) END AS size,
       CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_returnflag = 'R' THEN 'Courier' ELSE 'Helvetica' END END AS font, l_linenumber % 3 = 0 OR (l_linenumber % 3 = 1 AND l_linestatus = 'O') AS accepted FROM lineitem""")
def p9_sanitize_objects(spark, sf_dir):
    none = F.lit(None).cast("string")
    k = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.when(k == 0, "Rect").when(k == 1, "TEXT").otherwise("blob").alias("kind"), F.lit(None).cast("int").alias("page"),
        *[F.col("l_tax").alias(c) for c in "xywh"], none.alias("id"), F.col("l_quantity").alias("lineWidth"), F.when(F.col("l_linestatus") == "O", "t").otherwise("").alias("text"), (F.col("l_extendedprice") / 100).alias("size"),
        F.when(F.col("l_returnflag") == "R", "Courier").otherwise("Comic").alias("font"), none.alias("img"), none.alias("color"))
    return A.sanitize_objects(rows).select("doc_id", "seq", "part", "kind", "lineWidth", "size", "font", "accepted")


@query("p5_norm_and_back", "SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey AS part, round(l_discount * 595, 4) AS x, round(842 * (1 - l_tax - 0.1), 4) AS y, round(l_discount, 6) AS nx, round(l_tax, 6) AS ny FROM lineitem")
def p5_norm_and_back(spark, sf_dir):
    pw, ph, tenth = F.lit(595.0), F.lit(842.0), F.lit(0.1)
    made = table(spark, sf_dir, "lineitem").withColumn("b", A.norm_to_pdf(F.col("l_discount"), F.col("l_tax"), tenth, tenth, pw, ph))
    back = made.withColumn("n", A.pdf_to_norm(F.col("b.x"), F.col("b.y"), F.col("b.w"), F.col("b.h"), pw, ph))
    return back.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.round("b.x", 4).alias("x"), F.round("b.y", 4).alias("y"), F.round("n.x", 6).alias("nx"), F.round(F.abs("n.y"), 6).alias("ny"))


@query("p6_percent_box", "SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey AS part, round(5 + l_discount / 100 * 595, 4) AS x0, round(847 - l_tax / 100 * 842, 4) AS y1 FROM lineitem")
def p6_percent_box(spark, sf_dir):
    box = F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    page = F.struct(F.lit(5.0).alias("x0"), F.lit(847.0).alias("y1"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    made = table(spark, sf_dir, "lineitem").withColumn("r", A.percent_box_to_rect(box, page))
    return made.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.round(F.get("r", F.lit(0)), 4).alias("x0"), F.round(F.get("r", F.lit(3)), 4).alias("y1"))


_ITEMS = "i AS (SELECT conv_id AS doc_id, turn AS page, 0 AS item, 50.0 AS x, 700.0 AS y, length(text) * 5.0 AS width, 12.0 AS height, length(text) AS n FROM conversations)"


@query("p7_item_rect", f"WITH {_ITEMS} SELECT doc_id, page, round(x + least(3, greatest(n, 1)) / greatest(n, 1)::DOUBLE * width, 4) AS x0, round(x + least(20, greatest(n, 1)) / greatest(n, 1)::DOUBLE * width, 4) AS x1, (y + height)::DOUBLE AS y1 FROM i")
def p7_item_rect(spark, sf_dir):
    rect = A.item_rect(F.lit(50.0), F.lit(700.0), F.col("n") * 5.0, F.lit(12.0), F.col("n"), F.lit(3), F.lit(20))
    items = table(spark, sf_dir, "conversations").withColumn("n", F.char_length("text")).withColumn("r", rect)
    return items.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.round(F.get("r", F.lit(0)), 4).alias("x0"), F.round(F.get("r", F.lit(2)), 4).alias("x1"), F.get("r", F.lit(3)).alias("y1"))


@query("j19_anchors_to_rects", f"WITH {_ITEMS} SELECT i.doc_id, i.page, e.user_id AS note, count(*) AS n FROM i JOIN (SELECT DISTINCT user_id, CAST(event_id % 20 AS BIGINT) AS s FROM events) e ON i.doc_id = e.user_id WHERE (least(s + 5, greatest(i.n, 1)) - least(s, greatest(i.n, 1))) / greatest(i.n, 1)::DOUBLE * width > 0.1 GROUP BY ALL")
def j19_anchors_to_rects(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("item"), F.lit(50.0).alias("x"), F.lit(700.0).alias("y"), (F.char_length("text") * 5.0).alias("width"), F.lit(12.0).alias("height"), F.char_length("text").alias("length"))
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("user_id").alias("note"), (F.col("event_id") % 20).alias("start")).distinct()
    anchors = marks.join(items.select("doc_id", "page").distinct(), "doc_id").withColumns({"item": F.lit(0), "end": F.col("start") + 5})
    return A.anchors_to_rects(anchors, items).groupBy("doc_id", "page", "note").agg(F.count(F.lit(1)).alias("n"))


@query("p12_parse_color", "SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_partkey AS part, printf('#%02x%02x%02x', CAST(l_partkey % 300 AS INTEGER) - CASE WHEN l_partkey % 300 > 255 THEN CAST(l_partkey % 300 AS INTEGER) - 255 ELSE 0 END, CAST(l_quantity AS INTEGER), l_linenumber) AS color, round(least(l_partkey % 300, 255) / 255.0::DOUBLE, 3) AS red FROM lineitem")
def p12_parse_color(spark, sf_dir):
    text = F.concat(F.lit(" rgb( "), (F.col("l_partkey") % 300).cast("string"), F.lit(" , "), F.col("l_quantity").cast("int").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"), F.lit(")"))
    made = table(spark, sf_dir, "lineitem").withColumn("color", A.parse_color(text))
    return made.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), "color", F.get(A.color_triple("color"), F.lit(0)).alias("red"))


@query("p20_ensure_ids", "SELECT doc_id, count(*) AS n, count(DISTINCT id) AS kept FROM (SELECT l_orderkey AS doc_id, l_returnflag AS id FROM lineitem) GROUP BY doc_id")
def p20_ensure_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    made = A.ensure_ids(rows, "at")
    return made.groupBy("doc_id").agg(F.count_distinct("id").alias("n"), F.count_if(F.length("id") == 1).alias("kept"))


_OBJ = "o AS (SELECT doc_id, seq AS z, x, y, greatest(w, 1.0) AS w, greatest(h, 1.0) AS h FROM g)"


@query("j12_hit_test", f"WITH {_REGION_SQL}, {_OBJ} SELECT doc_id, 1 AS page, 0 AS point, max(z) AS z FROM o WHERE 0.5 BETWEEN x / 595 AND x / 595 + w / 595 AND 0.5 BETWEEN 1 - (y + h) / 842 AND 1 - (y + h) / 842 + h / 842 GROUP BY doc_id")
def j12_hit_test(spark, sf_dir):
    zero = F.lit(0.0)
    objects = regions(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.col("seq").alias("z"), F.lit("rect").alias("kind"), "x", "y", F.greatest("w", F.lit(1.0)).alias("w"), F.greatest("h", F.lit(1.0)).alias("h"), zero.alias("x2"), zero.alias("y2"), F.lit(595.0).alias("pw"), F.lit(842.0).alias("ph"))
    points = objects.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).alias("point"), F.lit(0.5).alias("nx"), F.lit(0.5).alias("ny"))
    return A.hit_test(points, objects)


@query("j20_missing_images", "SELECT DISTINCT sha1(text) || '.png' AS img FROM documents WHERE sha1(text) NOT IN (SELECT sha1(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
def j20_missing_images(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.sha1("text"), F.lit(".png"))
    objects = d.select(F.lit("image").alias("kind"), name.alias("img"))
    return A.missing_assets(objects, d.join(table(spark, sf_dir, "labels"), "doc_id").select(name.alias("name")))
