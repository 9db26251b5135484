"""Queries on the text of documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S
from quire.plans.registry import query, table
from quire.streaming import sessions

#: Terms that the queries look for; the last never occurs.
TERMS = ["the", "and", "tion", "License", "zqzqzq"]
TERMS_SQL = "terms(ord, term) AS (VALUES (0, 'the'), (1, 'and'), (2, 'tion'), (3, 'License'), (4, 'zqzqzq'))"
#: Terms of a rule: a consonant, a vowel and a consonant. Of these, the ones with an a.
CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiou"
MANY = [a + v + b for a in CONSONANTS for v in VOWELS for b in CONSONANTS]
MANY_A = [t for t in MANY if t[1] == "a"]


def _many_sql(vowels: str) -> str:
    letters = f"SELECT unnest(string_split('{CONSONANTS}', '')) AS l"
    return f"many(term) AS (SELECT a.l || v.l || b.l FROM ({letters}) a, (SELECT unnest(string_split('{vowels}', '')) AS l) v, ({letters}) b)"


FLAT = "replace(coalesce(text, ''), chr(10), '')"
#: Spans of the hits of 'tion' by cumulative lengths of what lies between them.
SPANS = f"""
parts AS (SELECT doc_id, {FLAT} AS flat, string_split({FLAT}, 'tion') AS p FROM documents),
pieces AS (SELECT doc_id, flat, unnest(p[:-2]) AS piece, generate_subscripts(p[:-2], 1) AS i FROM parts WHERE len(p) > 1),
spans AS (
  SELECT doc_id, flat, i, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 4)::BIGINT AS a,
         (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + i * 4)::BIGINT AS b FROM pieces)
"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("t1_segments", f"SELECT doc_id, (length(coalesce(text, '')) - length({FLAT}) + 1)::BIGINT AS n_lines, length({FLAT})::BIGINT AS n_chars FROM documents")
def t1_segments(spark, sf_dir):
    segs = S.segments(_docs(spark, sf_dir))
    return segs.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.char_length(T.flat("lines")).cast("long").alias("n_chars"))


@query("t1_table_segments", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS para FROM documents),
c AS (SELECT doc_id, para, unnest(string_split(line, ',')) AS cell, generate_subscripts(string_split(line, ','), 1) - 1 AS col FROM l WHERE contains(line, ','))
SELECT doc_id, (para // 49 + 1)::INTEGER AS page, para::INTEGER AS para, NULL::INTEGER AS cell_row, NULL::INTEGER AS cell_col, md5(line) AS text FROM l WHERE NOT contains(line, ',')
UNION ALL SELECT doc_id, (para // 49 + 1)::INTEGER, para::INTEGER, 0, col::INTEGER, md5(cell) FROM c""")
def t1_table_segments(spark, sf_dir):
    lines = S.line_segments(_docs(spark, sf_dir)).withColumn("table_like", F.get("lines", F.lit(0)).contains(","))
    cells = lines.where("table_like").select("doc_id", "page", "para", F.lit(0).alias("row"), F.posexplode(F.split(F.get("lines", F.lit(0)), ",", -1)).alias("col", "text"))
    return S.table_segments(lines, cells).select("doc_id", "page", "para", "cell_row", "cell_col", F.md5(T.flat("lines")).alias("text"))


@query("t2_find_spans", f"WITH {SPANS} SELECT doc_id, a, b FROM spans")
def t2_find_spans(spark, sf_dir):
    found = S.segments(_docs(spark, sf_dir)).select("doc_id", F.inline(T.find_spans(T.flat("lines"), F.lit("tion"))))
    return found.select("doc_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("t3_find_text", f"""
WITH {SPANS}, first AS (SELECT doc_id, flat, min(a) AS a, count(*) AS n, greatest(min(a) - 18, 0) AS lo, least(min(a) + 22, length(flat)) AS hi FROM spans GROUP BY doc_id, flat)
SELECT doc_id, n AS count, (CASE WHEN lo > 0 THEN '…' ELSE '' END) || substr(flat, lo + 1, hi - lo) || (CASE WHEN hi < length(flat) THEN '…' ELSE '' END) AS preview FROM first""")
def t3_find_text(spark, sf_dir):
    return S.find_text(S.segments(_docs(spark, sf_dir)), "tion").select("doc_id", "count", "preview")


@query("t3_find_text_capped", """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS para FROM documents),
hits AS (SELECT doc_id, para, (length(line) - length(replace(line, 'tion', ''))) // 4 AS n FROM lines WHERE contains(line, 'tion')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS seq, count(*) OVER (PARTITION BY doc_id) > 3 AS truncated FROM hits)
SELECT doc_id, (para // 49 + 1)::INTEGER AS page, para::INTEGER AS para, n::BIGINT AS count, seq::INTEGER AS seq, truncated FROM r WHERE seq <= 3""")
def t3_find_text_capped(spark, sf_dir):
    hits = S.find_text(S.line_segments(_docs(spark, sf_dir)), "tion", cap=3)
    return hits.select("doc_id", "page", "para", "count", "seq", "truncated")


_ESCAPED = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("p18_marked_previews", f"""
WITH {SPANS}, first AS (SELECT doc_id, flat, min(a) AS a, greatest(min(a) - 18, 0) AS lo, least(min(a) + 22, length(flat)) AS hi FROM spans GROUP BY doc_id, flat),
p AS (SELECT doc_id, (CASE WHEN lo > 0 THEN '…' ELSE '' END) || substr(flat, lo + 1, hi - lo) || (CASE WHEN hi < length(flat) THEN '…' ELSE '' END) AS preview FROM first)
SELECT doc_id, array_to_string(list_transform(string_split(preview, 'tion'), lambda x: {_ESCAPED}), '<mark>tion</mark>') AS marked FROM p""")
def p18_marked_previews(spark, sf_dir):
    return S.find_text(S.segments(_docs(spark, sf_dir)), "tion").select("doc_id", T.marked("preview", "tion").alias("marked"))


@query("t4_page_search", """
SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS count
FROM conversations WHERE contains(lower(text), 'the')""")
def t4_page_search(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.array("text").alias("lines"))
    return S.find_text(pages, "The", ignore_case=True).select("doc_id", "page", "count")


_HITS = f"hits AS (SELECT doc_id, ord, term, ((length({FLAT}) - length(replace({FLAT}, term, ''))) // length(term))::BIGINT AS n FROM documents, terms WHERE contains({FLAT}, term))"


@query("t5_scan_terms", f"""
WITH {TERMS_SQL}, {_HITS}
SELECT doc_id, arg_min(n, ord) AS count, array_to_string(list_sort(list(DISTINCT term)), ',') AS words FROM hits GROUP BY doc_id""")
def t5_scan_terms(spark, sf_dir):
    return S.scan_terms(S.segments(_docs(spark, sf_dir)), TERMS).withColumn("words", F.array_join("words", ","))


@query("t5_many_terms", f"""
WITH {_many_sql(VOWELS)}, d AS (SELECT doc_id, {FLAT} AS flat FROM documents), h AS (SELECT doc_id, term, ((length(flat) - length(replace(flat, term, ''))) // 3)::BIGINT AS n FROM d, many WHERE contains(flat, term))
SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS hits, md5(string_agg(term || n, ',' ORDER BY term)) AS found FROM h GROUP BY doc_id""")
def t5_many_terms(spark, sf_dir):
    hits = S.term_hits(S.segments(_docs(spark, sf_dir)), MANY).withColumn("n", F.col("count"))
    listed = F.array_sort(F.collect_list(F.struct("term", "n")))
    made = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("hits"), listed.alias("l"))
    return made.select("doc_id", "n_terms", "hits", F.md5(F.array_join(F.transform("l", lambda x: F.concat(x["term"], x["n"].cast("string"))), ",")).alias("found"))


@query("a5_term_counts", f"""
WITH {TERMS_SQL}, {_HITS}
SELECT t.ord, t.term, count(h.doc_id) AS segments, coalesce(sum(h.n), 0)::BIGINT AS total FROM terms t LEFT JOIN hits h ON t.ord = h.ord GROUP BY t.ord, t.term""")
def a5_term_counts(spark, sf_dir):
    return S.term_counts(S.segments(_docs(spark, sf_dir)), TERMS)


@query("r6_scan_stream", f"""
WITH {TERMS_SQL} SELECT conv_id AS doc_id, turn, ord, term, ((length(text) - length(replace(text, term, ''))) // length(term))::BIGINT AS count
FROM conversations, terms WHERE contains(text, term)""")
def r6_scan_stream(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.array("text").alias("lines"))
    return sessions.scan_stream(turns, TERMS).select("doc_id", "turn", "ord", "term", "count")


@query("a6_hit_words", f"WITH {TERMS_SQL}, {_HITS} SELECT words, count(*) AS segments FROM (SELECT doc_id, array_to_string(list_sort(list(DISTINCT term)), ',') AS words FROM hits GROUP BY doc_id) GROUP BY words")
def a6_hit_words(spark, sf_dir):
    found = S.scan_terms(S.segments(_docs(spark, sf_dir)), TERMS)
    return found.groupBy(F.array_join("words", ",").alias("words")).agg(F.count(F.lit(1)).alias("segments"))


@query("j7_missing_terms", f"WITH {TERMS_SQL}, {_HITS} SELECT ord, term FROM terms WHERE ord NOT IN (SELECT ord FROM hits)")
def j7_missing_terms(spark, sf_dir):
    return S.missing_terms(S.segments(_docs(spark, sf_dir)), TERMS)


@query("j6_restrict_to_targets", """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS para FROM documents)
SELECT doc_id, para::INTEGER AS para, ((length(line) - length(replace(line, 'the', ''))) // 3)::BIGINT AS count FROM lines
WHERE contains(line, 'the') AND (para % 2 = 0 OR para IS NULL) AND doc_id IN (SELECT doc_id FROM labels)""")
def j6_restrict_to_targets(spark, sf_dir):
    none = F.lit(None).cast("int")
    hits = S.find_text(S.line_segments(_docs(spark, sf_dir)), "the").withColumns({"cell_row": none, "cell_col": none})
    chosen = table(spark, sf_dir, "labels").select("doc_id").join(S.line_segments(_docs(spark, sf_dir)), "doc_id").where("para % 2 = 0")
    targets = chosen.select("doc_id", "page", "para", none.alias("cell_row"), none.alias("cell_col"))
    return S.restrict_to_targets(hits, targets).select("doc_id", "para", "count")


@query("t6_replace_all", f"""
SELECT doc_id, ((length({FLAT}) - length(replace({FLAT}, 'tion', ''))) // 4)::BIGINT AS occurrences, md5(replace({FLAT}, 'tion', 'TIONS')) AS new_flat,
       (length(text) - length({FLAT}) + 1)::BIGINT AS n_lines
FROM documents WHERE contains({FLAT}, 'tion')""")
def t6_replace_all(spark, sf_dir):
    done = S.replace_all(S.segments(_docs(spark, sf_dir)), "tion", "TIONS")
    return done.select("doc_id", "occurrences", F.md5(T.flat("new_lines")).alias("new_flat"), F.size("new_lines").cast("long").alias("n_lines"))


@query("t6_replaced_lines", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS no FROM documents)
SELECT doc_id, no, replace(line, 'the ', 'THE_') AS line FROM lines WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(replace(text, chr(10), ''), 'the '))""")
def t6_replaced_lines(spark, sf_dir):
    done = S.replace_all(S.segments(_docs(spark, sf_dir)), "the ", "THE_")
    return done.select("doc_id", F.posexplode("new_lines").alias("no", "line")).withColumn("no", F.col("no") + 1)


@query("t7_delete_terms", f"""
WITH x AS (SELECT doc_id, {FLAT} AS flat FROM documents)
SELECT doc_id, ((length(flat) - length(replace(flat, 'License', ''))) // 7)::BIGINT AS hits, md5(replace(flat, 'License', '')) AS new_flat
FROM x WHERE contains(flat, 'License')""")
def t7_delete_terms(spark, sf_dir):
    done = S.delete_terms(S.segments(_docs(spark, sf_dir)), ["License", "zqzqzq"])
    return done.select("doc_id", "hits", F.md5(T.flat("new_lines")).alias("new_flat"))


@query("t7_many_terms", f"""
WITH {_many_sql("a")}, d AS (SELECT doc_id, {FLAT} AS flat FROM documents), p AS (SELECT doc_id, term, string_split(flat, term) AS p FROM d, many WHERE contains(flat, term)),
q AS (SELECT doc_id, term, unnest(p[:-2]) AS piece, generate_subscripts(p[:-2], 1) AS i FROM p),
s AS (SELECT doc_id, sum(length(piece) + 3) OVER (PARTITION BY doc_id, term ORDER BY i) - 3 AS a, sum(length(piece) + 3) OVER (PARTITION BY doc_id, term ORDER BY i) AS b FROM q),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
u AS (SELECT doc_id, g, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY doc_id, g),
k AS (SELECT u.*, d.flat, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM u JOIN d USING (doc_id))
SELECT doc_id, sum(n)::BIGINT AS hits, count(*) AS removed, md5(string_agg(substr(flat, last::BIGINT + 1, (a - last)::BIGINT), '' ORDER BY a) || substr(any_value(flat), max(b)::BIGINT + 1)) AS new_flat FROM k GROUP BY doc_id""")
def t7_many_terms(spark, sf_dir):
    done = S.delete_terms(S.segments(_docs(spark, sf_dir)), MANY_A)
    return done.select("doc_id", "hits", "removed", F.md5(T.flat("new_lines")).alias("new_flat"))


@query("t9_residue", f"""
WITH x AS (SELECT doc_id, replace({FLAT}, 'tion', '') AS flat FROM documents WHERE contains({FLAT}, 'tion'))
SELECT 0 AS ord, 'tion' AS term, count(*) AS segments FROM x WHERE contains(flat, 'tion') HAVING count(*) > 0""")
def t9_residue(spark, sf_dir):
    done = S.delete_terms(S.segments(_docs(spark, sf_dir)), ["tion"]).select("doc_id", F.col("new_lines").alias("lines"))
    return S.residue(done, ["tion"])


@query("a8_delete_stats", f"""
WITH x AS (SELECT {FLAT} AS flat FROM documents WHERE contains({FLAT}, 'License'))
SELECT count(*) AS edits, sum((length(flat) - length(replace(flat, 'License', ''))) // 7)::BIGINT AS hits,
       count(*) FILTER (WHERE contains(replace(flat, 'License', ''), 'License')) AS residue FROM x""")
def a8_delete_stats(spark, sf_dir):
    done = S.delete_terms(S.segments(_docs(spark, sf_dir)), ["License"])
    after = done.select("doc_id", F.col("new_lines").alias("lines"))
    return S.edit_stats(done.drop("removed"), after, ["License"])


@query("w12_merge_spans", """
WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
f AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT doc_id, min(a)::BIGINT AS a, max(b)::BIGINT AS b FROM f GROUP BY doc_id, g""")
def w12_merge_spans(spark, sf_dir):
    a = F.rint("l_quantity").cast("long")  # the SQL's cast rounds halves to even
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(a.alias("a"), (a + F.col("l_linenumber")).alias("b")).alias("s"))
    return rows.groupBy("doc_id").agg(T.merge_spans(F.collect_list("s")).alias("m")).select("doc_id", F.inline("m"))


@query("w15_hit_numbers", """
WITH h AS (SELECT conv_id AS doc_id, turn AS page FROM conversations WHERE contains(text, 'the')),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS number, count(*) OVER (PARTITION BY doc_id) AS c FROM h)
SELECT doc_id, page, number, (number + 1) % c AS next, (number - 1 + c) % c AS previous FROM n""")
def w15_hit_numbers(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").where(F.col("text").contains("the")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return S.hit_numbers(hits, ["page"], ["doc_id"])


@query("w15_hit_numbers_overall", """
WITH h AS (SELECT doc_id, length(text) AS n FROM documents WHERE contains(text, 'tion')), k AS (SELECT doc_id, row_number() OVER (ORDER BY n, doc_id) - 1 AS number, count(*) OVER () AS c FROM h)
SELECT doc_id, number, (number + 1) % c AS next, (number - 1 + c) % c AS previous FROM k""")
def w15_hit_numbers_overall(spark, sf_dir):
    hits = _docs(spark, sf_dir).where(F.col("text").contains("tion")).select("doc_id", F.char_length("text").alias("n"))
    return S.hit_numbers(hits, ["n", "doc_id"]).drop("n")


@query("a15_hit_summary", """
SELECT conv_id AS doc_id, count(*) AS segments, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS occurrences
FROM conversations WHERE contains(text, 'the') GROUP BY conv_id""")
def a15_hit_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.array("text").alias("lines"))
    return S.hit_summary(S.find_text(pages, "the"))


@query("a10_charset", "SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch")
def a10_charset(spark, sf_dir):
    return S.charset(_docs(spark, sf_dir))


@query("p13_normalize_text", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS norm FROM documents")
def p13_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalised("text")).alias("norm"))


@query("p14_split_lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def p14_split_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.split_lines("text")).alias("line"))


@query("p15_char_kinds", r"""
SELECT ch, regexp_matches(ch, '[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}]') AS wide,
       unicode(ch) > 255 AS non_latin, count(*) AS n
FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch""")
def p15_char_kinds(spark, sf_dir):
    chars = S.charset(_docs(spark, sf_dir)).groupBy("ch").agg(F.sum("n").alias("n"))
    return chars.select("ch", T.is_wide("ch").alias("wide"), T.has_non_latin("ch").alias("non_latin"), "n")


@query("g11_terms_minus_found", f"WITH {TERMS_SQL}, {_HITS} SELECT term FROM terms EXCEPT SELECT term FROM hits")
def g11_terms_minus_found(spark, sf_dir):
    every = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return every.subtract(S.term_hits(S.segments(_docs(spark, sf_dir)), TERMS).select("term"))


@query("g12_top_hits", f"""
SELECT doc_id, n AS count FROM (SELECT doc_id, ((length({FLAT}) - length(replace({FLAT}, 'tion', ''))) // 4)::BIGINT AS n FROM documents)
WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20""")
def g12_top_hits(spark, sf_dir):
    return S.find_text(S.segments(_docs(spark, sf_dir)), "tion").select("doc_id", "count").orderBy(F.col("count").desc(), "doc_id").limit(20)
