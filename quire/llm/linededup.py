"""Line dedup: drop lines that many documents share.

Lines are exploded, normalised and hashed (128 bits); distinct documents are counted per
hash with map-side combining, so one line in a third of all documents costs one counter per
task. What comes back to a document is only the list of positions to drop, and the text is
reassembled by position from its own lines.

A text of very many lines is split once and put together in one pass.

Defined results: a null or empty text is one empty line; a null doc_id does not count as a
document and is never the one that keeps a line; rows that repeat a doc_id count once; an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.util import hash128, let

#: The characters of [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of each line whose key has at least min_chars code points; t1, t2 name the text."""
    lines = docs.select("doc_id", *[h.alias(f"t{i}") for i, h in enumerate(hash128("text"), 1)],
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "t1", "t2", "pos", *[h.alias(f"h{i}") for i, h in enumerate(hash128("key"), 1)])


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of the keys found in at least min_docs documents; keeper is the largest doc_id."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with __kept (the text that stays), __n_lines and __n_dropped beside its own columns."""
    lines = long_lines(docs, min_chars)
    hits = lines.join(repeated_lines(lines, min_docs), ["h1", "h2"])
    drops = (hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(*[h.alias(f"__k{i}") for i, h in enumerate(hash128("doc_id", "t1", "t2"), 1)])
             .agg(F.collect_set("pos").alias("__drop")))
    t1, t2 = hash128("text")
    keyed = docs.withColumns({f"__k{i}": h for i, h in enumerate(hash128(F.col("doc_id"), t1, t2), 1)})
    joined = keyed.join(drops, ["__k1", "__k2"], "left").drop("__k1", "__k2")
    whole = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(whole, "\n", -1)
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    kept = F.array_join(let(parts, lambda lines: F.transform(stay(lines), lambda i: F.get(lines, i))), "\n")
    return joined.withColumns({
        "__n_lines": (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"))) + 1).cast("long"),
        "__n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
        "__kept": F.when(F.col("__drop").isNull(), whole).otherwise(kept),
    }).drop("__drop")


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                                    F.sha2("__kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
