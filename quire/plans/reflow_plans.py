"""Queries on layout and reflow (documents, line items) and on edit sessions (events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import reflow as R
from quire.plans.glyph_plans import RECT_SQL, WIDTHS_SQL, rect_table
from quire.plans.registry import query, table
from quire.sources.staging import new_folder
from quire.streaming import sessions as S
from quire.streaming import stateful


@query("w16_paginate_lines", """
WITH l AS (SELECT doc_id, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS line FROM documents)
SELECT doc_id, line::INTEGER AS line, (line // 49)::INTEGER AS page, round(798.72 - (line % 49) * 15, 4)::DOUBLE AS y FROM l""")
def w16_paginate_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).drop("t")
    return R.paginate_lines(lines, 12.0)


#: Lines of the turns (para from 0) with, by place, their characters, whether these are wide, the sums of widths up to each, and the last blank before each.
RULED = rf"""
paras AS (SELECT conv_id, turn, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS para FROM (SELECT conv_id, turn, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM conversations)),
each AS (SELECT conv_id, turn, para, unnest(string_split(line, '')) AS ch, generate_subscripts(string_split(line, ''), 1) AS i FROM paras WHERE line <> ''),
wide AS (SELECT *, regexp_matches(ch, '[\x{{1100}}-\x{{115F}}\x{{2E80}}-\x{{A4CF}}\x{{AC00}}-\x{{D7A3}}\x{{F900}}-\x{{FAFF}}\x{{FE30}}-\x{{FE6F}}\x{{FF00}}-\x{{FF60}}\x{{FFE0}}-\x{{FFE6}}\x{{1F300}}-\x{{1FAFF}}]') AS w FROM each),
sized AS (SELECT *, CASE WHEN unicode(ch) BETWEEN 32 AND 126 THEN {WIDTHS_SQL}[unicode(ch) - 31] WHEN w THEN 1000 ELSE 556 END::BIGINT AS size FROM wide),
summed AS (SELECT *, sum(size) OVER own AS upto, max(CASE WHEN ch = ' ' THEN i END) OVER (PARTITION BY conv_id, turn, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blank FROM sized WINDOW own AS (PARTITION BY conv_id, turn, para ORDER BY i ROWS UNBOUNDED PRECEDING)),
lists AS (SELECT conv_id, turn, para, list(upto::BIGINT ORDER BY i) AS sums, list(coalesce(blank, 0) ORDER BY i) AS blanks, list(ch ORDER BY i) AS ch, list(w ORDER BY i) AS wide FROM summed GROUP BY ALL),
ruled AS (SELECT p.*, length(p.line) AS n, coalesce(sums, []) AS sums, coalesce(blanks, []) AS blanks, coalesce(ch, []) AS ch, coalesce(wide, []) AS wide FROM paras p LEFT JOIN lists USING (conv_id, turn, para))"""


def wrapped_sql(most: str) -> str:
    """Steps of breaking each line: from (before the line's first character), least (characters consumed at least), and the line just ended. most: thousandths."""
    return f"""
broken AS (
  SELECT conv_id, turn, para, 0::BIGINT AS k, 0::BIGINT AS start, 1::BIGINT AS lo, NULL::VARCHAR AS line FROM ruled
  UNION ALL
  SELECT conv_id, turn, para, k + 1, CASE WHEN down THEN blank ELSE brk END, brk + 1, CASE WHEN down THEN substr(whole, start + 1, blank - 1 - start) ELSE substr(whole, start + 1, brk - start) END
  FROM (SELECT *, blank > start + 1 AND here <> ' ' AND NOT broad AS down FROM (
    SELECT f.*, r.line AS whole, r.blanks[brk + 1] AS blank, r.ch[brk + 1] AS here, r.wide[brk + 1] AS broad FROM (
      SELECT f.*, greatest(len(list_filter(r.sums, lambda s: s <= CASE WHEN f.start = 0 THEN 0 ELSE r.sums[f.start] END + {most})), f.lo) AS brk, r.n
      FROM broken f JOIN ruled r USING (conv_id, turn, para)) f JOIN ruled r USING (conv_id, turn, para) WHERE brk < f.n))),
ends AS (SELECT conv_id, turn, para, max(k) AS k, max(start) AS start FROM broken GROUP BY ALL),
wrapped AS (SELECT conv_id, turn, para, k, line FROM broken WHERE k > 0 UNION ALL SELECT e.conv_id, e.turn, e.para, e.k + 1, substr(r.line, e.start + 1) FROM ends e JOIN ruled r USING (conv_id, turn, para))"""


@query("l2_wrap_text", f"""
WITH RECURSIVE {RULED}, {wrapped_sql('30000')}
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY para, k) - 1)::INTEGER AS i, line FROM wrapped""")
def l2_wrap_text(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations")
    return docs.select("conv_id", "turn", F.posexplode(R.wrap_text(F.col("text"), F.lit(10.0), F.lit(300.0))).alias("i", "line"))


#: How many marks in a row begin at a place, and how many end before it.
MARKS = """
runs AS (SELECT conv_id, turn, para, i, contains({close}, ch) AS c, contains({open}, ch) AS o FROM each),
until AS (SELECT *, min(CASE WHEN NOT c THEN i END) OVER (PARTITION BY conv_id, turn, para ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop, max(CASE WHEN NOT o THEN i END) OVER (PARTITION BY conv_id, turn, para ORDER BY i ROWS UNBOUNDED PRECEDING) AS back, max(i) OVER (PARTITION BY conv_id, turn, para) AS n FROM runs),
marked AS (SELECT conv_id, turn, para, list((coalesce(stop, n + 1) - i)::BIGINT ORDER BY i) AS closing, list((i - coalesce(back, 0))::BIGINT ORDER BY i) AS opening FROM until GROUP BY ALL)""".format(
    close="'" + R.NO_LINE_START + "'", open="'" + R.NO_LINE_END + "'")


@query("l3_wrap_kinsoku", f"""
WITH RECURSIVE {RULED}, {MARKS}, m AS (SELECT r.*, coalesce(closing, []) AS closing, coalesce(opening, []) AS opening FROM ruled r LEFT JOIN marked USING (conv_id, turn, para)),
broken AS (
  SELECT conv_id, turn, para, 0::BIGINT AS k, 0::BIGINT AS start, 1::BIGINT AS lo, CASE WHEN para = 0 THEN 28000 ELSE 30000 END AS room, NULL::VARCHAR AS line FROM m
  UNION ALL
  SELECT conv_id, turn, para, k + 1, stop, CASE WHEN stop > brk THEN stop + 1 ELSE brk + 1 END, 30000, substr(whole, start + 1, stop - start) FROM (
    SELECT *, CASE WHEN cut = brk + 1 AND cut < n THEN cut + least(closing[cut + 1], least(brk + 3, n) - cut) ELSE cut END AS stop FROM (
      SELECT *, kept - CASE WHEN kept > 0 THEN least(opening[kept], kept - greatest(kept - 6, start + 1)) ELSE 0 END AS cut FROM (
        SELECT *, most + CASE WHEN ch[most] <> ' ' THEN least(closing[most + 1], least(most + 6, brk + 1) - most) ELSE 0 END AS kept FROM (
          SELECT *, CASE WHEN blanks[brk + 1] > start + 1 AND sums[blanks[brk + 1]] - base >= room / 2 THEN blanks[brk + 1] ELSE brk END AS most FROM (
            SELECT f.*, m.n, m.line AS whole, m.sums, m.blanks, m.ch, m.closing, m.opening, CASE WHEN f.start = 0 THEN 0 ELSE m.sums[f.start] END AS base,
                   greatest(len(list_filter(m.sums, lambda s: s <= CASE WHEN f.start = 0 THEN 0 ELSE m.sums[f.start] END + f.room + 50)), f.lo) AS brk
            FROM broken f JOIN m USING (conv_id, turn, para)) WHERE brk < n AND start < n))))),
ends AS (SELECT conv_id, turn, para, max(k) AS k, max(start) AS start FROM broken GROUP BY ALL),
every AS (SELECT conv_id, turn, para, k, line, true AS cut FROM broken WHERE k > 0 UNION ALL SELECT e.conv_id, e.turn, e.para, e.k + 1, substr(r.line, e.start + 1), false FROM ends e JOIN ruled r USING (conv_id, turn, para) WHERE e.start < r.n OR e.k = 0)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY para, k) - 1)::INTEGER AS i, line, cut FROM every""")
def l3_wrap_kinsoku(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations")
    return docs.select("conv_id", "turn", F.posexplode(R.wrap_kinsoku(F.col("text"), F.lit(10.0), F.lit(280.0), F.lit(300.0))).alias("i", "x")).select("conv_id", "turn", "i", "x.line", "x.cut")


@query("l4_justify", """
WITH w AS (SELECT l_orderkey AS doc_id, list(l_quantity ORDER BY l_quantity) AS ws, sum(l_quantity) AS used FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, round(CASE WHEN 150 - used > 0.2 AND NOT 150 - used > 60 THEN 150 WHEN used > 150.01 THEN used * greatest(0.1, 150 / used) ELSE used END, 4) AS total FROM w""")
def l4_justify(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list("l_quantity")).alias("ws"))
    zero, right = F.lit(0.0), F.lit(150.0)
    made = lines.withColumn("j", R.justify(F.col("ws"), F.lit(0), zero, right)).withColumn("f", R.fit_line(F.col("j"), zero, right))
    return made.select("doc_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, w: s + w), 4).alias("total"))


@query("l12_place_text_box", f"""
WITH RECURSIVE {RULED}, {wrapped_sql("floor((577 - f.turn * 40) * 1000 / 12.0 + 1e-6)")}, c AS (SELECT conv_id, turn, count(*) AS lines FROM wrapped GROUP BY ALL),
b AS (SELECT conv_id, turn, turn * 40.0::DOUBLE AS x, turn * 20.0::DOUBLE + 10 AS y, 12.0::DOUBLE AS size, 595.0::DOUBLE AS page_w, 842.0::DOUBLE AS page_h, lines FROM c JOIN (SELECT DISTINCT conv_id, turn FROM conversations) USING (conv_id, turn))
SELECT conv_id, turn, x, CASE WHEN y - (lines - 1) * size * 1.25 < 12 THEN least(y + (12 - (y - (lines - 1) * size * 1.25)), greatest(page_h - 12, y)) ELSE y END::DOUBLE AS y, size, page_w, page_h, (577 - x)::DOUBLE AS max_width FROM b""")
def l12_place_text_box(spark, sf_dir):
    boxes = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 40.0).alias("x"), (F.col("turn") * 20.0 + 10).alias("y"), F.lit(12.0).alias("size"), "text", F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"))
    return R.place_text_box(boxes).drop("text")


_ROWS = "w AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS n, l_quantity AS height FROM lineitem), t AS (SELECT *, 700 - n * 60.0::DOUBLE AS row_y FROM w)"


def _rows(spark, sf_dir):
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.row_number().over(place).alias("n"), F.col("l_quantity").alias("height"))
    return rows.withColumn("row_y", 700 - F.col("n") * 60.0)


@query("l6_apply_paragraph_edits", f"""
WITH {_ROWS}, p AS (SELECT *, (n - 1) // 2 AS para FROM t), s AS (SELECT doc_id, para, count(*) AS old, max(row_y) AS top, 15.0::DOUBLE AS step FROM p GROUP BY doc_id, para),
g AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND para = 0 THEN (5 - old) * step ELSE 0 END AS delta FROM s),
h AS (SELECT doc_id, para, coalesce(sum(delta) OVER (PARTITION BY doc_id ORDER BY top DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM g)
SELECT p.doc_id, p.n, (p.row_y - h.shift)::DOUBLE AS new_y, min(p.row_y - h.shift) OVER (PARTITION BY p.doc_id) >= 250 AS fits FROM p JOIN h USING (doc_id, para)""")
def l6_apply_paragraph_edits(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumns({"band": F.lit(0), "para": F.floor((F.col("n") - 1) / 2), "gap": F.lit(15.0), "is_footer": F.lit(False)})
    edits = rows.where("doc_id % 2 = 0 AND para = 0").select("doc_id", "page", "band", "para", F.lit(5).alias("new_lines")).distinct()
    return R.apply_paragraph_edits(rows, edits, 250.0).select("doc_id", "n", "new_y", "fits")


@query("l7_flow_pages", f"""
WITH RECURSIVE {_ROWS}, r AS (SELECT doc_id, ((n - 1) // 2 + 1)::INTEGER AS page, n, height, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM t),
f AS (SELECT doc_id, k, page AS own, page AS p, page AS origin, 60.0::DOUBLE AS y, height, n FROM r WHERE k = 1
  UNION ALL SELECT r.doc_id, r.k, r.page,
    CASE WHEN r.page > f.p THEN r.page WHEN f.y - f.height - r.height < 24 AND f.y - f.height < 60 THEN f.p + 1 ELSE f.p END, CASE WHEN r.page > f.p THEN r.page ELSE f.origin END,
    CASE WHEN r.page > f.p OR (f.y - f.height - r.height < 24 AND f.y - f.height < 60) THEN 60.0 ELSE f.y - f.height END, r.height, r.n
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1),
o AS (SELECT doc_id, max(p) - max(own) <= 1 AND max(p - origin) <= 3 AS fits FROM f GROUP BY doc_id)
SELECT f.doc_id, f.own AS page, f.n, CASE WHEN fits THEN p ELSE own END AS new_page, CASE WHEN fits THEN y END AS new_y, fits FROM f JOIN o USING (doc_id)""")
def l7_flow_pages(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("page", F.floor((F.col("n") - 1) / 2 + 1).cast("int"))
    return R.flow_pages(rows, 60.0, 24.0, most_new=1, most_pushed=3)


@query("l8_delete_table_rows", f"WITH {_ROWS} SELECT doc_id, n, (row_y + coalesce(sum(CASE WHEN n % 3 = 1 THEN height END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS new_y FROM t QUALIFY n % 3 <> 1")
def l8_delete_table_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("is_footer", F.lit(False))
    return R.delete_table_rows(rows, rows.where("n % 3 = 1")).select("doc_id", "n", "new_y")


@query("l8_insert_table_rows", f"""
WITH {_ROWS}, m AS (SELECT *, (row_y - coalesce(sum(CASE WHEN n = 2 THEN height END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS new_y FROM t)
SELECT doc_id, n, new_y, false AS copied FROM m UNION ALL SELECT doc_id, n, new_y - height, true FROM m WHERE n = 2""")
def l8_insert_table_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("is_footer", F.lit(False))
    return R.insert_table_rows(rows, rows.where("n = 2")).select("doc_id", "n", "new_y", "copied")


@query("l9_shift_vectors", f"""
WITH {RECT_SQL}, c AS (SELECT *, (y0 + y1) / 2 AS mid, x1 - x0 <= 1.5 AND y1 > 60 AND y0 < 60 AS bar FROM r)
SELECT doc_id, seq, CASE WHEN NOT rotated AND (bar OR mid < 60) THEN y0 - 15 ELSE y0 END AS new_y0, round(CASE WHEN NOT rotated AND mid < 60 AND NOT bar THEN y1 - 15 ELSE y1 END, 4) AS new_y1, rotated AND mid < 60 AS skipped FROM c""")
def l9_shift_vectors(spark, sf_dir):
    rects = rect_table(spark, sf_dir).withColumns({"line": F.lit(60.0), "delta": F.lit(15.0)})
    return R.shift_vectors(rects, "line", "delta").select("doc_id", "seq", "new_y0", F.round("new_y1", 4).alias("new_y1"), "skipped")


@query("l10_take_vectors", f"WITH {RECT_SQL} SELECT doc_id, seq FROM r WHERE (y0 + y1) / 2 < 60")
def l10_take_vectors(spark, sf_dir):
    return R.take_vectors(rect_table(spark, sf_dir).withColumn("cut", F.lit(60.0)), "cut").select("doc_id", "seq")


@query("l10_drop_rules", f"WITH {RECT_SQL} SELECT doc_id, seq FROM r WHERE abs((y0 + y1) / 2 - 41) > 0.6")
def l10_drop_rules(spark, sf_dir):
    rects = rect_table(spark, sf_dir)
    return R.drop_rules(rects, rects.select("doc_id", "page", F.lit(41.0).alias("at")).distinct()).select("doc_id", "seq")


@query("j11_row_vbars", f"WITH {RECT_SQL} SELECT DISTINCT doc_id, 1 AS page, 0 AS id, round((x0 + x1) / 2, 2) AS x FROM r WHERE painted AND NOT rotated AND x1 - x0 <= 1.5 AND y1 - y0 >= 1.5 AND y0 < 100 AND y1 > 10")
def j11_row_vbars(spark, sf_dir):
    rects = rect_table(spark, sf_dir)
    bands = rects.select("doc_id", "page", F.lit(0).alias("id"), F.lit(10.0).alias("low"), F.lit(100.0).alias("high")).distinct()
    return R.row_bars(rects, bands)


@query("j17_align_chars", f"WITH {_ROWS}, p AS (SELECT doc_id, n AS pos, CAST(height AS INTEGER) % 10 AS code, chr(65 + CAST(height AS INTEGER) % 20) AS text FROM t), f AS (SELECT doc_id, code, arg_min(text, pos) AS text FROM p GROUP BY doc_id, code) SELECT f.doc_id, f.code, f.text, count(*) FILTER (WHERE p.text <> f.text)::INTEGER AS conflicts FROM f JOIN p USING (doc_id, code) GROUP BY ALL")
def j17_align_chars(spark, sf_dir):
    whole = F.col("height").cast("int")
    rows = _rows(spark, sf_dir).select("doc_id", F.lit(0).alias("run"), F.col("n").alias("pos"), (whole % 10).alias("code"), F.chr(65 + whole % 20).alias("text"))
    return R.align_chars(rows.drop("text"), rows.drop("code"))


@query("j18_locate_cell", f"""
WITH {_ROWS}, c AS (SELECT doc_id, CAST(height AS INTEGER) % 5 AS text, n::INTEGER AS r, (n % 3)::INTEGER AS c FROM t), q AS (SELECT doc_id AS id, doc_id, CAST(doc_id % 5 AS INTEGER) AS text FROM (SELECT DISTINCT doc_id FROM t)),
j AS (SELECT q.id, abs(3 - c.r) + abs(1 - c.c) AS far, c.r, c.c FROM q JOIN c USING (doc_id, text)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, r, c) AS z FROM j)
SELECT id, far, r AS c_row, c AS c_col FROM k WHERE z = 1""")
def j18_locate_cell(spark, sf_dir):
    cells = _rows(spark, sf_dir).select("doc_id", (F.col("height").cast("int") % 5).alias("text"), F.col("n").alias("row"), (F.col("n") % 3).alias("col"))
    wanted = cells.select("doc_id").distinct().select(F.col("doc_id").alias("id"), "doc_id", (F.col("doc_id") % 5).cast("int").alias("text"), F.lit(3).alias("row"), F.lit(1).alias("col"))
    return R.locate_cell(cells, wanted)


@query("l5_char_runs", f"WITH {_ROWS}, c AS (SELECT doc_id, n, CAST(height AS INTEGER) AS h FROM t) SELECT doc_id, n, CASE WHEN h % 2 = 0 THEN 'A' WHEN h % 3 = 0 THEN 'O' WHEN h % 5 = 0 THEN 'F' END AS font_alias, CASE WHEN h % 2 = 0 OR h % 3 = 0 OR h % 5 = 0 THEN h END AS code FROM c")
def l5_char_runs(spark, sf_dir):
    chars = _rows(spark, sf_dir).select("doc_id", "n", F.col("height").cast("int").alias("text"))
    maps = [chars.where(f"text % {k} = 0").select("doc_id", "text", F.lit(name).alias("font_alias"), F.col("text").alias("code")).distinct() for k, name in ((2, "A"), (3, "O"), (5, "F"))]
    return R.char_runs(chars, *maps).select("doc_id", "n", "font_alias", "code")


@query("l11_list_paragraphs", f"WITH {_ROWS} SELECT doc_id, ((n - 1) // 2)::BIGINT AS para, count(*)::INTEGER AS n_rows, max(row_y) AS first_y FROM t GROUP BY ALL")
def l11_list_paragraphs(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("doc_id", "page", F.floor((F.col("n") - 1) / 2).alias("para"), "row_y", F.lit(0.0).alias("x0"), "height", F.col("height").alias("x1"), F.lit("t").alias("text"))
    listed = R.list_paragraphs(rows.select("doc_id", "page", "para").distinct(), rows)
    return listed.select("doc_id", "para", F.size("rows").alias("n_rows"), F.get("rows", F.lit(0))["row_y"].alias("first_y"))


@query("r1_autosave", """
WITH g AS (SELECT user_id AS stage, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY stage ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT stage, min(ts) AS start, arg_max(event_id, epoch_us(ts)) AS state, count(*) AS changes FROM s GROUP BY stage, k""")
def r1_autosave(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), "ts", F.col("event_id").alias("state"))
    return S.autosave(e, "30 minutes")


_LOG = "l AS (SELECT user_id AS stage, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'save' END AS op, 's' || event_id % 4 AS state FROM events)"


def _log(spark, sf_dir, read=table):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("save")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("state"))


@query("r2_version_stack", f"""
WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq) AS k FROM l WHERE op <> 'redo'),
f AS (SELECT stage, k, CASE WHEN op = 'save' THEN state END AS cur, []::VARCHAR[] AS vs, CASE WHEN op = 'undo' THEN 1 ELSE 0 END AS errors FROM o WHERE k = 1
  UNION ALL SELECT o.stage, o.k, CASE WHEN op = 'save' THEN state WHEN len(vs) = 0 THEN cur ELSE vs[-1] END,
    CASE WHEN op = 'save' THEN CASE WHEN cur IS NULL THEN vs ELSE list_append(vs, cur)[-20:] END WHEN len(vs) = 0 THEN vs ELSE vs[:-2] END, errors + CASE WHEN op = 'undo' AND len(vs) = 0 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.stage = f.stage AND o.k = f.k + 1)
SELECT stage, arg_max(cur, k) AS current, array_to_string(arg_max(vs, k), ',') AS versions, max(errors)::INTEGER AS errors FROM f GROUP BY stage""")
def r2_version_stack(spark, sf_dir):
    return S.version_stack(_log(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


_HISTORY = f"""
WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq) AS k FROM l),
f AS (SELECT stage, k, CASE WHEN op = 'save' THEN state END AS cur, []::VARCHAR[] AS d, []::VARCHAR[] AS u FROM o WHERE k = 1
  UNION ALL SELECT o.stage, o.k,
    CASE WHEN op = 'save' THEN state WHEN op = 'undo' AND len(d) > 0 THEN d[-1] WHEN op = 'redo' AND len(u) > 0 THEN u[-1] ELSE cur END,
    CASE WHEN op = 'save' AND state IS NOT DISTINCT FROM cur THEN d WHEN op = 'save' THEN CASE WHEN cur IS NULL THEN d ELSE list_append(d, cur)[-60:] END WHEN op = 'undo' AND len(d) > 0 THEN d[:-2] WHEN op = 'redo' AND len(u) > 0 THEN list_append(d, cur) ELSE d END,
    CASE WHEN op = 'save' AND state IS NOT DISTINCT FROM cur THEN u WHEN op = 'save' THEN [] WHEN op = 'undo' AND len(d) > 0 THEN list_append(u, cur) WHEN op = 'redo' AND len(u) > 0 THEN u[:-2] ELSE u END
  FROM f JOIN o ON o.stage = f.stage AND o.k = f.k + 1)
SELECT stage, arg_max(cur, k) AS current, array_to_string(arg_max(d, k), ',') AS done, array_to_string(arg_max(u, k), ',') AS undone FROM f GROUP BY stage"""


@query("r3_edit_history", _HISTORY)
def r3_edit_history(spark, sf_dir):
    return S.edit_history(_log(spark, sf_dir)).withColumns({"done": F.array_join("done", ","), "undone": F.array_join("undone", ",")})


def _arriving(spark, sf_dir, name):
    """The table as a stream of its files. A path with a pattern may be a single file, too."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query("r3_history_stream", _HISTORY)
def r3_history_stream(spark, sf_dir):
    log = _log(spark, sf_dir, _arriving)
    news = stateful.delivered(stateful.stream_history(log), "update")
    last = news.groupBy(F.col("stage").cast("long").alias("stage")).agg(F.max_by(F.struct("current", "done", "undone"), "batch").alias("x"))
    return last.select("stage", "x.current", F.array_join("x.done", ",").alias("done"), F.array_join("x.undone", ",").alias("undone"))


@query("r4_stale_stream", "SELECT user_id::VARCHAR AS stage, date_trunc('millisecond', max(ts)) AS last FROM events GROUP BY user_id HAVING max(ts) < date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 6 HOUR")
def r4_stale_stream(spark, sf_dir):
    changes = _arriving(spark, sf_dir, "events").select(F.col("user_id").alias("stage"), "ts")
    return stateful.delivered(stateful.stream_stale(changes, 6), "append").select("stage", F.col("last").cast("timestamp_ntz").alias("last"))


@query("r5_ingest_stream", "SELECT sha1(html) AS sha, length(html)::BIGINT AS size FROM pages GROUP BY html")
def r5_ingest_stream(spark, sf_dir):
    pages = _arriving(spark, sf_dir, "pages")
    files = pages.select(F.col("url").alias("path"), F.timestamp_seconds(F.lit(86400)).alias("modificationTime"), F.char_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return stateful.delivered(S.catalogued(files), "append").select("sha", "size")


@query("r7_upsert_latest", "SELECT user_id AS doc_id, max(event_id) AS updated, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def r7_upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("updated"), "event_type", F.hour("ts").alias("hour"))
    path = new_folder(spark, "upserts")
    for n in range(3):  # three batches of a third of the day each
        S.merge_batch(e.where(F.floor(F.col("hour") / 8) == n).drop("hour"), path, n)
    return S.latest(spark, path, e.drop("hour").schema)
