"""Queries on catalogues: pages are files, their URLs paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.registry import query, table
from quire.sources import catalog as C

NAME_SQL = r"regexp_extract(url, '([^/\\]*)$', 1)"
CAT_SQL = f"c AS (SELECT page_id, url AS path, {NAME_SQL} AS name, length(html)::BIGINT AS size, html AS content FROM pages)"


def _catalog(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("path"), C.base_name("url").alias("name"), F.char_length("html").cast("long").alias("size"), F.col("html").alias("content"))


@query("s2_doc_id", f"WITH {CAT_SQL} SELECT page_id, substr(sha1(name || '|' || size), 1, 16) AS doc_id FROM c")
def s2_doc_id(spark, sf_dir):
    return _catalog(spark, sf_dir).select("page_id", C.doc_key("name", "size").alias("doc_id"))


@query("s1_listed", f"""
SELECT e.event_id AS id, '/data/' || e.user_id || '/' || e.event_id || '.pdf' AS path, e.event_id::VARCHAR AS name, '/data/' || e.user_id AS folder, e.event_id AS size FROM events e WHERE e.user_id % 3 <> 0""")
def s1_listed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    folder = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("/data/.git/"), "user_id")).otherwise(F.concat(F.lit("/data/"), "user_id"))
    files = e.select(F.concat(folder, F.lit("/"), "event_id", F.when(F.col("event_id") % 2 == 0, ".pdf").otherwise(".PDF")).alias("path"), F.col("event_id").alias("size"), F.col("ts").alias("mtime"))
    return C.listed(files).select(F.col("size").alias("id"), F.regexp_replace("path", "PDF$", "pdf").alias("path"), "name", "folder", "size")


@query("s3_fingerprint_collisions", "SELECT substr(sha1(lang || '|' || n_chars), 1, 16) AS doc_id, count(DISTINCT sha1(text)) AS contents FROM documents GROUP BY lang, n_chars HAVING count(DISTINCT sha1(text)) > 1")
def s3_fingerprint_collisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return C.fingerprint_collisions(d.select(C.doc_key("lang", "n_chars").alias("doc_id"), F.col("text").alias("content")))


@query("s4_dedupe_uploads", "SELECT min(url) AS path, sha1(html) AS sha FROM pages WHERE starts_with(html, '<!DOCT') AND strlen(html) <= 5000 GROUP BY html")
def s4_dedupe_uploads(spark, sf_dir):
    return C.dedupe_uploads(_catalog(spark, sf_dir), b"<!DOCT", 5000).select("path", "sha")


@query("s6_save_latest", "SELECT user_id AS doc_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def s6_save_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("updated"), "event_type")
    return C.save_latest(e).select("doc_id", F.col("updated").alias("event_id"))


@query("s5_load_json", """
WITH u AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS n, max(event_id) AS last FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'u' || user_id END AS doc_id, CASE WHEN user_id % 5 = 0 OR user_id % 5 = 1 THEN 0 ELSE n END::BIGINT AS n_items,
       CASE WHEN user_id % 5 = 0 OR user_id % 5 = 2 THEN 0.0 ELSE last END::DOUBLE AS updated, user_id % 5 = 0 AS corrupt FROM u""")
def s5_load_json(spark, sf_dir):
    user = F.col("user_id")
    item = F.struct(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 40).cast("int").alias("page"), F.col("event_type").alias("type"))
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_id") % 2 == 0, item)).alias("items"), F.max("event_id").cast("double").alias("last"))
    # Nulls are left out of the JSON, so some objects lack a key.
    whole = F.struct(F.concat(F.lit("u"), user).alias("doc_id"), F.when(user % 5 != 1, F.col("items")).alias("items"), F.when(user % 5 != 2, F.col("last")).alias("updated"))
    text = F.when(user % 5 == 0, F.lit("{broken")).otherwise(F.to_json(whole))
    read = C.parse_json(each.select("user_id", text.alias("value")))
    return read.select("user_id", "doc_id", F.size("items").cast("long").alias("n_items"), "updated", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("s9_outcome", "SELECT doc_id, CASE WHEN text IS NULL OR replace(text, 'tion', 'sion') = text THEN 'unchanged' ELSE 'changed' END AS outcome FROM documents")
def s9_outcome(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.outcome("text", F.replace("text", F.lit("tion"), F.lit("sion"))).alias("outcome"))


@query("s7_unique_names", """
WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '-' || user_id % 9 WHEN 1 THEN event_type || '-2' ELSE event_type END AS stem FROM events),
t AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN event_type || '-' || (user_id % 31 + 5) ELSE 'error' END AS stem FROM events WHERE user_id % 5 = 0),
k AS (SELECT n.*, row_number() OVER (PARTITION BY stem ORDER BY event_id) - 1 + CASE WHEN stem IN (SELECT stem FROM t) THEN 1 ELSE 0 END AS k FROM n),
r AS (SELECT DISTINCT regexp_extract(stem, '^(.*)-([1-9][0-9]*)$', 1) AS stem, regexp_extract(stem, '^(.*)-([1-9][0-9]*)$', 2)::BIGINT AS no FROM (SELECT stem FROM n UNION SELECT stem FROM t) WHERE regexp_matches(stem, '^(.*)-([1-9][0-9]*)$')),
f AS (SELECT stem, no - 1 - row_number() OVER (PARTITION BY stem ORDER BY no) AS free FROM r WHERE no >= 2),
j AS (SELECT k.event_id, count(f.stem) AS skip FROM k LEFT JOIN f ON f.stem = k.stem AND f.free < k.k GROUP BY k.event_id)
SELECT event_id, CASE WHEN k = 0 THEN stem ELSE stem || '-' || (k + 1 + skip) END AS out_name FROM k JOIN j USING (event_id)""")
def s7_unique_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = lambda n: F.concat("event_type", F.lit("-"), n.cast("string"))
    four = F.col("event_id") % 4
    rows = e.select("event_id", F.when(four == 0, number(F.col("user_id") % 9)).when(four == 1, number(F.lit(2))).otherwise(F.concat("event_type", F.lit(":"))).alias("name"))
    taken = e.where("user_id % 5 = 0").select(F.when(F.col("user_id") % 2 == 0, number(F.col("user_id") % 31 + 5)).otherwise("error").alias("name"))
    return C.unique_names(rows, "name", "event_id", taken).select("event_id", "out_name")


@query("p1_catalog_search", f"WITH {CAT_SQL} SELECT page_id, path FROM c WHERE contains(lower(name), 'blog') OR contains(lower(path), 'blog') ORDER BY path LIMIT 300")
def p1_catalog_search(spark, sf_dir):
    return C.catalog_search(_catalog(spark, sf_dir), " Blog ", cap=300).select("page_id", "path")


@query("p2_human_size", """
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0 < 1024 THEN printf('%.1f KB', n / 1024.0) WHEN n / 1048576.0 < 1024 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size_text
FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 17 AS BIGINT) AS n FROM orders)""")
def p2_human_size(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 17).alias("size_text"))


@query("r4_expire", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def r4_expire(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return C.expire(e, e.agg(F.max("ts")).scalar(), 6, "ts").select("event_id")
