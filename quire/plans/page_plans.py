"""Queries on pages: every order is a document and its lines are pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import pageplan as P
from quire.plans.registry import query, table

PAGES_SQL = """
p AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS page,
             l_quantity * 10 + 100 AS width, l_quantity * 14 + 100 AS height, CAST(l_linenumber % 4 * 90 AS INTEGER) AS rotate FROM lineitem)"""
DOCS_SQL = PAGES_SQL + """,
d AS (SELECT doc_id, count(*)::INTEGER AS n, list({'number': page, 'width': width, 'height': height, 'rotate': rotate} ORDER BY page) AS pages FROM p GROUP BY doc_id)"""
#: How the plans of the queries follow from the number of a document and its pages.
PLAN_SQL = DOCS_SQL + """,
x AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN [CAST(doc_id % n AS INTEGER)] ELSE []::INTEGER[] END AS gone,
             CASE WHEN doc_id % 4 = 1 THEN [n - 1, 0, 0, CAST(doc_id % 5 AS INTEGER), 99] END AS ord FROM d),
del AS (SELECT *, list_filter(pages, lambda q, i: NOT list_contains(gone, i - 1)) AS kept FROM x),
reo AS (SELECT *, CASE WHEN ord IS NULL THEN kept ELSE list_transform(list_filter(list_transform(ord, lambda o: CASE WHEN list_contains(gone, o) THEN o ELSE o - len(list_filter(gone, lambda g: g < o)) END),
        lambda o: o >= 0 AND o < len(kept)), lambda o: kept[o + 1]) END AS ordered FROM del),
rot AS (SELECT *, list_transform(ordered, lambda q, i: {'number': q.number, 'width': q.width, 'height': q.height, 'rotate': CASE WHEN doc_id % 5 = 0 AND i = 1 THEN (q.rotate + 90) % 360 ELSE q.rotate END}) AS turned FROM reo),
fin AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN list_concat(turned[1:1], [{'number': NULL::INTEGER, 'width': coalesce(turned[1].width, 595.0), 'height': coalesce(turned[1].height, 842.0), 'rotate': 0}], turned[2:]) ELSE turned END AS final FROM rot)"""


def page_rows(spark, sf_dir) -> DataFrame:
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(place).alias("page"), (F.col("l_quantity") * 10 + 100).alias("width"),
        (F.col("l_quantity") * 14 + 100).alias("height"), (F.col("l_linenumber") % 4 * 90).cast("int").alias("rotate"))


def page_arrays(spark, sf_dir) -> DataFrame:
    rows = page_rows(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("number"), "width", "height", "rotate"))).alias("pages"))
    return rows.withColumn("n", F.size("pages"))


def with_plans(spark, sf_dir) -> DataFrame:
    docs, key = page_arrays(spark, sf_dir), F.col("doc_id")
    return docs.withColumns({
        "gone": F.when(key % 3 == 0, F.array((key % F.col("n")).cast("int"))).otherwise(F.array().cast("array<int>")),
        "ord": F.when(key % 4 == 1, F.array(F.col("n") - 1, F.lit(0), F.lit(0), (key % 5).cast("int"), F.lit(99))),
        "turns": F.when(key % 5 == 0, F.create_map(F.lit(0), F.lit(90))),
        "inserts": F.when(key % 7 == 0, F.array(F.struct(F.lit(1).alias("at"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height")))),
    })


def rows_of(docs: DataFrame, pages, *keys: str) -> DataFrame:
    return docs.select("doc_id", *keys, F.posexplode(pages).alias("i", "q")).select("doc_id", *keys, (F.col("i") + 1).alias("page"), "q.number", "q.width", "q.height", "q.rotate")


def _rows_sql(name: str, column: str) -> str:
    return f"SELECT doc_id, i::INTEGER AS page, q.number AS number, q.width AS width, q.height AS height, q.rotate AS rotate FROM (SELECT doc_id, unnest({column}) AS q, generate_subscripts({column}, 1) AS i FROM {name})"


@query("p3_page_info", """
SELECT l_orderkey AS doc_id, l_linenumber AS k, CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_discount END AS x, CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_tax END AS y,
       round(CASE WHEN l_discount < 0.05 THEN 595.0 ELSE l_quantity - l_discount END, 4) AS width, round(CASE WHEN l_discount < 0.05 THEN 842.0 ELSE l_extendedprice - l_tax END, 4) AS height,
       CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST((((l_linenumber - 3) * 90) % 360 + 360) % 360 AS INTEGER) END AS rotate FROM lineitem""")
def p3_page_info(spark, sf_dir):
    boxed = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k"), F.when(F.col("l_discount") >= 0.05, F.col("l_discount")).alias("x0"), F.col("l_tax").alias("y0"),
        F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y1"), F.when(F.col("l_returnflag") == "N", F.lit("x")).otherwise(((F.col("l_linenumber") - 3) * 90).cast("string")).alias("rotate"))
    return P.page_info(boxed).withColumns({"width": F.round("width", 4), "height": F.round("height", 4)})


@query("p4_parse_pages", f"""
WITH {PAGES_SQL}, d AS (SELECT doc_id, count(*)::INTEGER AS n FROM p GROUP BY doc_id),
s AS (SELECT doc_id, n, unnest([1, 2, 3]) AS k FROM d),
r AS (SELECT doc_id, k, CASE k WHEN 1 THEN list_concat([1], CASE WHEN n = 1 THEN [1] ELSE range(2, n + 1) END) WHEN 2 THEN list_concat(range(1, least(3, n) + 1), CASE WHEN n >= 2 THEN [2] ELSE [] END)
      ELSE range(1, n + 1) END AS numbers FROM s)
SELECT doc_id, k, i::INTEGER AS i, v::INTEGER AS page FROM (SELECT doc_id, k, unnest(numbers) AS v, generate_subscripts(numbers, 1) AS i FROM r)""")
def p4_parse_pages(spark, sf_dir):
    specs = F.array(F.struct(F.lit(1).alias("k"), F.lit("1，2-").alias("spec")), F.struct(F.lit(2).alias("k"), F.lit("3-1, 2,99").alias("spec")), F.struct(F.lit(3).alias("k"), F.lit(" ").alias("spec")))
    docs = page_rows(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "n", F.inline(specs))
    return docs.select("doc_id", "k", F.posexplode(P.parse_pages("spec", "n")).alias("i", "page")).withColumn("i", F.col("i") + 1)


@query("p10_sanitize_plan", """
SELECT l_orderkey AS doc_id, l_linenumber AS k, l_partkey AS part,
       array_to_string(list_filter([l_linenumber - 2, l_linenumber, -1], lambda i: i >= 0), ',') AS ord,
       CASE WHEN (l_suppkey * 45) % 90 = 0 THEN CAST((l_suppkey * 45) % 360 AS INTEGER) END AS turn, least(greatest(l_extendedprice, 10.0), 20000.0) AS width,
       CAST(CASE WHEN l_linenumber < 2 THEN 2 ELSE 1 END + CASE WHEN (l_suppkey * 45) % 90 = 0 THEN 0 ELSE 1 END AS INTEGER) AS dropped FROM lineitem""")
def p10_sanitize_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("part"), F.array(F.col("l_linenumber") - 2, F.col("l_linenumber"), F.lit(-1)).alias("order"),
        F.array().cast("array<int>").alias("delete"), F.create_map(F.lit(0), (F.col("l_suppkey") * 45).cast("int")).alias("rotate"),
        F.array(F.struct(F.lit(0).alias("at"), F.col("l_extendedprice").alias("width"), F.lit(None).cast("double").alias("height"))).alias("insert"))
    clean = P.sanitize_plan(rows)
    return clean.select("doc_id", "k", "part", F.coalesce(F.array_join("order", ","), F.lit("")).alias("ord"), F.try_element_at("rotate", F.lit(0)).alias("turn"), F.get("insert", F.lit(0))["width"].alias("width"), "dropped")


@query("g1_delete_pages", f"WITH {PLAN_SQL} {_rows_sql('del', 'kept')}")
def g1_delete_pages(spark, sf_dir):
    docs = with_plans(spark, sf_dir)
    return rows_of(docs, P.delete_pages(F.col("pages"), F.col("gone")))


@query("g2_reorder_pages", f"WITH {PLAN_SQL}, o AS (SELECT doc_id, list_transform(list_filter(ord, lambda o: o < n), lambda o: pages[o + 1]) AS ordered FROM x WHERE ord IS NOT NULL) {_rows_sql('o', 'ordered')}")
def g2_reorder_pages(spark, sf_dir):
    docs = with_plans(spark, sf_dir).where("ord IS NOT NULL")
    return rows_of(docs, P.reorder_pages(F.col("pages"), F.col("ord")))


@query("g3_rotate_pages", f"WITH {PAGES_SQL} SELECT doc_id, page, page AS number, width, height, CASE WHEN page = 1 THEN (rotate + 90) % 360 ELSE rotate END AS rotate FROM p WHERE doc_id % 5 = 0")
def g3_rotate_pages(spark, sf_dir):
    docs = with_plans(spark, sf_dir).where("turns IS NOT NULL")
    return rows_of(docs, P.rotate_pages(F.col("pages"), F.col("turns")))


@query("g4_insert_blank", f"""
WITH {DOCS_SQL}, i AS (SELECT doc_id, list_concat(pages[1:1], [{{'number': NULL::INTEGER, 'width': pages[1].width, 'height': pages[1].height, 'rotate': 0}}], pages[2:]) AS final FROM d WHERE doc_id % 7 = 0) {_rows_sql('i', 'final')}""")
def g4_insert_blank(spark, sf_dir):
    docs = with_plans(spark, sf_dir).where("inserts IS NOT NULL")
    return rows_of(docs, P.insert_blank(F.col("pages"), F.col("inserts")))


@query("g5_apply_page_plan", f"WITH {PLAN_SQL} {_rows_sql('fin', 'final')}")
def g5_apply_page_plan(spark, sf_dir):
    docs = with_plans(spark, sf_dir)
    return rows_of(docs, P.apply_page_plan(*(F.col(c) for c in ("pages", "gone", "ord", "turns", "inserts"))))


@query("g6_effective_order", f"WITH {PLAN_SQL} SELECT doc_id, array_to_string(list_filter(coalesce(ord, range(n)), lambda o: NOT list_contains(gone, o)), ',') AS places FROM x")
def g6_effective_order(spark, sf_dir):
    docs = with_plans(spark, sf_dir)
    return docs.select("doc_id", F.array_join(P.effective_order(F.col("n"), F.col("gone"), F.col("ord")), ",").alias("places"))


@query("g7_export_pages", f"""
WITH {PAGES_SQL}, n AS (SELECT doc_id, max(page) AS n FROM p GROUP BY doc_id), o AS (SELECT doc_id, 1 AS page, n AS number FROM n UNION ALL SELECT doc_id, 2, 1 FROM n)
SELECT o.doc_id, o.page::INTEGER AS page, o.number::INTEGER AS number, p.width, p.height, p.rotate FROM o JOIN p ON o.doc_id = p.doc_id AND o.number = p.page""")
def g7_export_pages(spark, sf_dir):
    docs = page_arrays(spark, sf_dir).withColumn("numbers", P.parse_pages(F.concat(F.col("n").cast("string"), F.lit(",1")), F.col("n")))
    return rows_of(docs, P.export_pages(F.col("pages"), F.col("numbers")))


@query("w13_split_parts", f"""
WITH {PAGES_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, ((page - 1) // 3 + 1)::INTEGER AS part FROM p)
SELECT doc_id, page, part, min(page) OVER (PARTITION BY doc_id, part) AS first, max(page) OVER (PARTITION BY doc_id, part) AS last FROM t WHERE n > 3""")
def w13_split_parts(spark, sf_dir):
    return P.split_parts(page_rows(spark, sf_dir), 3).select("doc_id", "page", "part", "first", "last")


_MERGE = f"WITH {PAGES_SQL}, m AS (SELECT o_custkey AS target, o_orderkey AS ord, o_orderkey AS doc_id FROM orders), c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)"


def _members(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("doc_id"))


@query("g8_merge_documents", _MERGE + """, f AS (SELECT m.*, (sum(n) OVER (PARTITION BY target ORDER BY ord) - n) AS before FROM m JOIN c USING (doc_id))
SELECT f.target, f.ord, p.doc_id, p.page AS old_page, (p.page + f.before)::BIGINT AS page FROM p JOIN f USING (doc_id)""")
def g8_merge_documents(spark, sf_dir):
    return P.merge_documents(page_rows(spark, sf_dir), _members(spark, sf_dir))


@query("w14_object_offset", "SELECT o_custkey AS target, o_orderkey AS ord, o_orderkey AS doc_id, (o_orderkey % 50)::BIGINT AS max_id, (sum(o_orderkey % 50) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey % 50)::BIGINT AS \"offset\" FROM orders")
def w14_object_offset(spark, sf_dir):
    return P.object_offsets(_members(spark, sf_dir).withColumn("max_id", F.col("ord") % 50))


@query("g9_blank_documents", """
WITH s(size, w, h) AS (VALUES ('a4', 595.28::DOUBLE, 841.89::DOUBLE), ('a3', 841.89, 1190.55), ('a5', 419.53, 595.28), ('letter', 612.0, 792.0), ('legal', 612.0, 1008.0)),
r AS (SELECT c_custkey AS doc_id, ['A4', 'a3', 'a5', 'letter', 'legal', 'b5'][CAST(c_custkey % 6 AS INTEGER) + 1] AS size, c_custkey % 2 = 0 AS landscape, c_custkey % 4 AS n FROM customer)
SELECT doc_id, unnest(range(1, n + 1))::INTEGER AS page, CASE WHEN landscape THEN h ELSE w END AS width, CASE WHEN landscape THEN w ELSE h END AS height FROM r JOIN s ON lower(r.size) = s.size WHERE n BETWEEN 1 AND 200""")
def g9_blank_documents(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("A4", "a3", "a5", "letter", "legal", "b5")])
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(names, (F.col("c_custkey") % 6).cast("int")).alias("size"), (F.col("c_custkey") % 2 == 0).alias("landscape"), (F.col("c_custkey") % 4).alias("n"))
    return P.blank_documents(asked)


@query("g10_attach_objects", f"""
WITH {PLAN_SQL}, f AS ({_rows_sql('fin', 'final')})
SELECT f.doc_id, f.page, l.l_linenumber AS object, l.l_partkey AS part, f.number FROM lineitem l JOIN f ON l.l_orderkey = f.doc_id AND l.l_linenumber + 1 = f.page""")
def g10_attach_objects(spark, sf_dir):
    docs = with_plans(spark, sf_dir)
    final = rows_of(docs, P.apply_page_plan(*(F.col(c) for c in ("pages", "gone", "ord", "turns", "inserts")))).select("doc_id", "page", "number")
    objects = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + 1).alias("page"), F.col("l_linenumber").alias("object"), F.col("l_partkey").alias("part"))
    return P.attach_objects(final, objects)


def _nodes(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    return (r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), none.alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(False).alias("is_leaf"), F.col("r_name").alias("box"), F.lit("0").alias("rotate"))
            .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.lit(False).alias("is_leaf"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("box"), none.alias("rotate")))
            .unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").cast("long").alias("ord"), F.lit(True).alias("is_leaf"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).alias("box"), F.when(F.col("c_custkey") % 3 == 0, F.lit("90")).alias("rotate"))))


_TREE = """SELECT concat('c', c_custkey) AS node, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS box,
       coalesce(CASE WHEN c_custkey % 3 = 0 THEN '90' END, '0') AS rotate"""
_TREE_FROM = " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("j15_flatten_tree", _TREE + ", concat_ws('.', r_regionkey, n_nationkey, c_custkey) AS path, 2 AS depth" + _TREE_FROM)
def j15_flatten_tree(spark, sf_dir):
    return P.flatten_tree(_nodes(spark, sf_dir), ["box", "rotate"]).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


@query("j16_materialize_inherited", _TREE + ", o_orderkey AS page" + _TREE_FROM + " JOIN orders ON o_custkey = c_custkey")
def j16_materialize_inherited(spark, sf_dir):
    leaves = P.flatten_tree(_nodes(spark, sf_dir), ["box", "rotate"]).select("node", "box", "rotate")
    pages = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("node"), F.col("o_orderkey").alias("page"))
    return leaves.join(pages, "node")
